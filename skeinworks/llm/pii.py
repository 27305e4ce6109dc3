"""Personal data: patterns, and a skip-chain conditional random field that adds what they miss.

Patterns give the base spans, and the values of assignments to names of secrets.  The field has
a node for every such span, whose label is observed, and for every other token that holds a
digit or an at sign, or that repeats the local part of an address found in the same document.
Neighbouring nodes share a transition potential.  Nodes anywhere in the document whose normal
forms agree (the same last seven digits, the same local part, the same token) share a skip
potential: each with the occurrence before it, and with the nearest that is observed, so what is
known of one reaches all others in a step.  Loopy messages pass over all documents of a slice
at once until they settle, and tokens that come out with a label are added.

Potentials are trained by maximum a posteriori pseudo-likelihood on a sample of documents of
documented size: each known node is predicted from its own features and its known neighbours',
and once more from the neighbours alone, as a repeat without telling features would be.
Tokens that repeat an observed span without matching a pattern are unknown, so they teach nothing.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.llm.common import sampled, text_or_empty, text_slices

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS, "secret")
SECRET = LABELS.index("secret")
#: Documents to train on, about at most; probability at which a label is taken.
FIT_ROWS, CERTAIN = 4_000, 0.9
#: Messages have settled when none changes by more; rounds after which they are taken as they are, if some still swing.
SETTLED, MOST_ROUNDS, DAMPING = 1e-4, 1_000, 0.3
#: Log potential of the observed label of a span, beyond what any number of neighbours could say; log odds that a token's own features give at most.
OBSERVED, MOST_OWN = 1e9, 4.0
#: Where training starts, and what it is drawn to: potentials of repeats that agree, of one labelled and one not, and of two kinds.
AGREE, LABELLED_OR_NOT, TWO_KINDS = 6.0, -2.0, -4.0
#: Weight of that start, known neighbours of a label that training tells apart, gradient steps.
PRIOR, MOST_COUNTED, STEPS = 0.02, 3, 400
#: Characters between nodes that are neighbours, at most; digits that a normal form keeps.
NEAR, LAST_DIGITS = 3, 7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Names of secrets, an equals sign or colon, and the value.
_ASSIGNED = re.compile(r"(?i)\b(?:api[_-]?key|access[_-]?key|secret[_-]?key|auth[_-]?token|token|secret|password|passwd|pwd)[\"']?\s{0,8}[:=]\s{0,8}([\"']?)([^\s\"',;]{8,})")
_SIGN, _DIGIT, _TOKEN, _EDGE = re.compile(r"[0-9@]"), re.compile(r"[0-9]"), re.compile(r"\S+"), "()[]{}<>\"'.,;:!?|*#&%$="

Span = tuple[int, int, int]  # kind (place in LABELS), start, end


# ---- patterns ----


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum((2 * d) // 10 + (2 * d) % 10 for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each at sign leftwards: the same matches as a scan from the left, in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by kind and start."""
    if not _SIGN.search(text):
        return []
    found = [(1, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        found += [(2, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append((3, m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                found.append((4, m.start(), m.end()))
    return found


def secrets(text: str) -> list[Span]:
    """The values assigned to names of secrets; unquoted ones need a digit."""
    return [(SECRET, *m.span(2)) for m in _ASSIGNED.finditer(text) if m[1] or _DIGIT.search(m[2])]


# ---- nodes and edges ----


@dataclass
class Nodes:
    """The nodes of one document in order: their place, observed label (0: none) and normal forms."""

    spans: list[tuple[int, int]]
    observed: list[int]
    features: list[list[int]]
    forms: list[list[str]]


FEATURES = 32


def features(token: str) -> list[int]:
    """Places of the binary features that hold: always 0, then signs, number of digits, dots, tests, length."""
    digits = "".join(c for c in token if "0" <= c <= "9")
    n, dots = len(digits), token.count(".")
    on = [0]
    on += [1] * ("@" in token) + [2] * token.startswith("+") + [3] * any(c.isalpha() for c in token) + [4] * ("-" in token) + [5] * ("(" in token or ")" in token)
    on.append(6 + sum(n >= least for least in (1, 4, 7, 9, 13, 16, 20)))
    on.append(14 + min(dots, 4))
    on += [19] * (13 <= n <= 19 and luhn(digits)) + [20] * (dots == 3 and all(p and p.isascii() and p.isdigit() and _small(p) for p in token.split(".")))
    on.append(21 + sum(len(token) >= least for least in (4, 8, 12, 16, 24, 48)))
    return on


def forms(token: str) -> list[str]:
    """Normal forms: the token itself, its last digits if there are enough, and an address' local part."""
    found = [f"t:{token.casefold()}"]
    digits = "".join(c for c in token if "0" <= c <= "9")
    if len(digits) >= LAST_DIGITS:
        found.append(f"d:{digits[-LAST_DIGITS:]}")
    local = token.partition("@")[0].casefold()
    if len(local) >= 4 and not local.isdigit():
        found.append(f"l:{local}")
    return found


def nodes_of(text: str, spans: list[Span]) -> Nodes:
    """A node for each given span that begins outside of earlier ones, and for each telling token outside of all."""
    placed, reach = [], -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= reach:
            placed.append((a, b, kind))
            reach = b
    locals_ = {text[a:b].partition("@")[0].casefold() for a, b, k in placed if k == 1}
    locals_ = {x for x in locals_ if len(x) >= 4}
    nodes, at = list(placed), 0
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if a == b or not (_SIGN.search(text, a, b) or (locals_ and text[a:b].casefold() in locals_)):
            continue
        while at < len(placed) and placed[at][1] <= a:
            at += 1
        if at == len(placed) or placed[at][0] >= b:
            nodes.append((a, b, 0))
    nodes.sort()
    words = [text[a:b] for a, b, _ in nodes]
    return Nodes([(a, b) for a, b, _ in nodes], [k for *_, k in nodes], [features(w) for w in words], [forms(w) for w in words])


def edges_of(nodes: Nodes) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Neighbours; and for each normal form each node with the one before, and those that aren't observed with the last observed one before, else the first after."""
    chain = [(i, i + 1) for i in range(len(nodes.spans) - 1) if nodes.spans[i + 1][0] - nodes.spans[i][1] <= NEAR]
    skip = set()
    for at in _same_form(nodes):
        skip.update(zip(at, at[1:], strict=False))
        seen = [i for i in at if nodes.observed[i]]
        for i in at:
            if seen and not nodes.observed[i]:
                nearest = seen[max(0, bisect_left(seen, i) - 1)]
                skip.add((min(i, nearest), max(i, nearest)))
    return chain, sorted(skip)


def _same_form(nodes: Nodes) -> list[list[int]]:
    places: dict[str, list[int]] = {}
    for i, found in enumerate(nodes.forms):
        for form in found:
            places.setdefault(form, []).append(i)
    return [at for at in places.values() if len(at) > 1]


def known(nodes: Nodes) -> list[bool]:
    """Whether a node's label is known: it is observed, or it repeats nothing that is."""
    out = [True] * len(nodes.spans)
    for at in _same_form(nodes):
        if any(nodes.observed[i] for i in at):
            for i in at:
                out[i] = out[i] and nodes.observed[i] > 0
    return out


# ---- the field ----


@dataclass
class Field:
    """Weights (features, labels), and log potentials (labels, labels) of both kinds of edge, symmetric."""

    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def scores(self, feature_lists: list[list[int]], observed: list[int]) -> np.ndarray:
        at = np.repeat(np.arange(len(feature_lists)), [len(f) for f in feature_lists])
        out = np.zeros((len(feature_lists), len(LABELS)))
        np.add.at(out, at, self.weights[np.array([x for f in feature_lists for x in f], np.int64)])
        out = np.maximum(out - out.max(axis=1, keepdims=True), -MOST_OWN)
        seen = np.array(observed)
        rows = np.flatnonzero(seen)
        out[rows] = 0.0
        out[rows, seen[rows]] = OBSERVED
        return out

    def marginals(self, scores: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Beliefs when damped sum-product messages along all edges, both ways, have settled; graphs that have are left alone."""
        if not len(chain) and not len(skip):
            return _softmax(scores)
        start = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
        end = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
        c, s = len(chain), len(skip)
        back = np.concatenate([np.arange(c, 2 * c), np.arange(c), 2 * c + np.arange(s, 2 * s), 2 * c + np.arange(s)])
        potential, kind = np.stack([self.chain, self.skip]), np.repeat([0, 1], [2 * c, 2 * s])
        messages, active = np.zeros((len(start), len(LABELS))), np.arange(len(start))
        belief = scores.copy()
        for _ in range(MOST_ROUNDS):
            out = belief[start[active]] - messages[back[active]]
            both = out[:, :, None] + potential[kind[active]]
            top = both.max(axis=1)
            new = np.log(np.exp(both - top[:, None, :]).sum(axis=1)) + top
            new -= new.max(axis=1, keepdims=True)
            change = (1 - DAMPING) * (new - messages[active])
            messages[active] += change
            np.add.at(belief, end[active], change)
            moved = np.zeros(len(scores), bool)
            moved[end[active[np.abs(change).max(axis=1) > SETTLED]]] = True
            if not moved.any():
                break
            # Only messages out of a node that has moved, or that still move themselves, can change
            active = np.flatnonzero(moved[start] | moved[end])
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def start_of_skip() -> np.ndarray:
    out = np.full((len(LABELS), len(LABELS)), TWO_KINDS)
    out[0, :] = out[:, 0] = LABELLED_OR_NOT
    np.fill_diagonal(out, AGREE)
    return out


def train(examples: Counter) -> Field:
    """The field from counted (features, label, neighbours' labels, repeats' labels), the last two as counts by label.

    Climbs the log pseudo-likelihood, labels weighing alike, with each example seen twice: whole, and
    without features.  Weights and transitions are drawn to 0, skip potentials to where they start.
    """
    n_labels, drawn_to = len(LABELS), start_of_skip()
    weights, chain, skip = np.zeros((FEATURES, n_labels)), np.zeros((n_labels, n_labels)), drawn_to.copy()
    if not examples:
        weights[0, 0] = MOST_OWN
        return Field(weights, chain, skip)
    ordered = sorted(examples.items())
    x, near, far = np.zeros((len(ordered), FEATURES)), np.zeros((len(ordered), n_labels)), np.zeros((len(ordered), n_labels))
    for i, ((on, _, beside, repeats), _) in enumerate(ordered):
        x[i, list(on)], near[i], far[i] = 1, beside, repeats
    label, n = np.array([k[1] for k, _ in ordered]), np.array([v for _, v in ordered], float)
    n = n / np.sqrt(np.bincount(label, n, minlength=n_labels)[label])
    n /= n.sum()
    target = np.eye(n_labels)[label]
    # The second half has no features, and counts only where a neighbour is known
    x, near, far = np.vstack([x, np.zeros_like(x)]), np.vstack([near, near]), np.vstack([far, far])
    n, target = np.concatenate([n, n * (near + far).any(axis=1)[len(n) :]]), np.vstack([target, target])
    for _ in range(STEPS):
        miss = (target - _softmax(x @ weights + near @ chain + far @ skip)) * n[:, None]
        weights += 5.0 * (x.T @ miss - 1e-3 * weights)
        slope = near.T @ miss
        chain += (slope + slope.T) - PRIOR * chain
        slope = far.T @ miss
        skip += (slope + slope.T) - PRIOR * (skip - drawn_to)
    return Field(weights, chain, skip)


def examples_of(text: str) -> Iterator[tuple]:
    """(features, label, neighbours' labels, repeats' labels) of the known nodes of a text; labels as counts of known nodes, at most ``MOST_COUNTED`` each."""
    nodes = nodes_of(text, base_spans(text) + secrets(text))
    sure = known(nodes)
    beside, repeats = np.zeros((2, len(sure), len(LABELS)), np.int64)
    for counts, edges in zip((beside, repeats), edges_of(nodes), strict=True):
        for i, j in edges:
            if sure[i] and sure[j]:
                counts[i, nodes.observed[j]] += 1
                counts[j, nodes.observed[i]] += 1
    for i in np.flatnonzero(sure).tolist():
        yield tuple(nodes.features[i]), nodes.observed[i], tuple(np.minimum(beside[i], MOST_COUNTED).tolist()), tuple(np.minimum(repeats[i], MOST_COUNTED).tolist())


def fit(docs: DataFrame, *, text: str = "text", fit_rows: int = FIT_ROWS) -> Field:
    """Train on about ``fit_rows`` documents at most that hold a digit or an at sign, labelled by the patterns; repeated texts of a sample count once.

    What comes to the driver is a row for each combination of a few features and counts.
    Without any document every token is ``none``, but for repeats of observed ones.
    """
    rows = docs.select(F.col(text).cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    numbers = lambda x: ",".join(map(str, x))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                seen.update((numbers(on), label, numbers(beside), numbers(repeats)) for on, label, beside, repeats in examples_of(value.as_py()))
        columns = [pa.array([k[i] for k in seen], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(seen.values()), pa.int64())], names=["on", "label", "beside", "repeats", "n"])

    counted = sampled(rows, fit_rows, "text").mapInArrow(count, "`on` string, label int, beside string, repeats string, n long")
    tuples = lambda x: tuple(map(int, x.split(",")))
    found = counted.groupBy("on", "label", "beside", "repeats").agg(F.sum("n").alias("n")).collect()
    return train(Counter({(tuples(r["on"]), r["label"], tuples(r["beside"]), tuples(r["repeats"])): r["n"] for r in found}))


def tag(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and those that are added: assigned secrets, and what the field finds."""
    base, added = [base_spans(t) for t in texts], [secrets(t) for t in texts]
    graphs = [(i, nodes_of(t, base[i] + added[i])) for i, t in enumerate(texts) if base[i] or added[i] or _SIGN.search(t)]
    graphs = [(i, g) for i, g in graphs if g.spans]
    if not graphs:
        return list(zip(base, added, strict=True))
    chain, skip, offset = [], [], 0
    for _, nodes in graphs:
        for to, edges in zip((chain, skip), edges_of(nodes), strict=True):
            to.extend((a + offset, b + offset) for a, b in edges)
        offset += len(nodes.spans)
    scores = field.scores([f for _, g in graphs for f in g.features], [k for _, g in graphs for k in g.observed])
    beliefs = field.marginals(scores, np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2))
    at = 0
    for i, nodes in graphs:
        part = beliefs[at : at + len(nodes.spans)]
        at += len(nodes.spans)
        best = part.argmax(axis=1)
        for k in np.flatnonzero((np.array(nodes.observed) == 0) & (best > 0) & (part.max(axis=1) >= CERTAIN)).tolist():
            added[i].append((int(best[k]), *nodes.spans[k]))
    return list(zip(base, added, strict=True))


def find(docs: DataFrame, field: Field, *, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` without ``text``, with ``out``: an array of (kind, start, end, base), by kind as in ``LABELS``, then start.

    Places are code points, the end exclusive; ``base`` tells the spans of the four base patterns from added
    ones.  A null or empty text has none.  Rows are independent: repeated rows agree, an empty
    table gives an empty one.  A column named ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    others = [c for c in docs.columns if c not in (text, out)]
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())])
    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField(out, T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, len(others)):
            found = tag(part.column(len(others)).to_pylist(), shared.value)
            rows = [[{"kind": LABELS[k], "start": a, "end": b, "base": own} for k, a, b, own in sorted([(*s, True) for s in base] + [(*s, False) for s in more])] for base, more in found]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], pa.array(rows, arrow)], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in others), text_or_empty(text).alias(text)).mapInArrow(run, schema)


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def counted(found: DataFrame, *, key: str = "doc_id", spans: str = "pii") -> DataFrame:
    """``key``, the number of base spans of each kind, the SHA-256 of their list, the list of all spans of these kinds, the list of secrets, and the number of spans of all kinds.

    A row for each row of ``found``, repeated ones alike; a text without spans has zeros, empty lists and the hash of the empty one; a null key stays null, and an empty table gives an empty one.
    """
    base, secret = F.filter(spans, lambda s: s["base"]), F.filter(spans, _of_kind("secret"))
    listed = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    numbers = [F.size(F.filter(base, _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    personal = F.filter(spans, lambda s: s["kind"] != "secret")
    return found.select(key, *numbers, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(personal).alias("spans"), listed(secret).alias("secrets"), F.size(spans).cast("long").alias("n_found"))
