"""Clustering, lexical search and license scans: brute force, and the cases that tables hold."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinworks.llm import clusters, lexical, licenses, words

DOCS = "doc_id long, text string"
SAME = "Under the MIT License and the MIT License."
ODD = [(0, None), (1, ""), (2, " \n\t . ,"), (3, "word " * 60_000 + "MIT License"), (4, SAME), (4, SAME), (None, SAME), (5, "x" * 50_000), (6, "ünïcode 😀 STRASSE \x00 MIT LICENSE mit\r\nlicense"), (7, "cc-by cc by 4.0")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumns({"size": F.lit("clash"), "__text": F.lit(1), "places": F.lit(2), "score": F.lit(3)}).repartition(3)


def rows_of(found, *columns):
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)


# ---- 11: clusters ----


def slow_clusters(rows, clusters_, rounds):
    """All distances of all vectors, in Python's integers; ``rows`` are (id, vector)."""
    kept = [(k, [math.floor(256 * float(x)) for x in v]) for k, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{'' if k is None else k}".encode()).hexdigest(), v) for k, v in kept)
    centroids = [v for _, v in first[:clusters_]]
    near = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        whose = [near(v)[1] for _, v in kept]
        for n in set(whose):
            mine = [v for (_, v), w in zip(kept, whose, strict=True) if w == n]
            centroids[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(k, *near(v)) for k, v in kept]
    total, each = sum(d for _, d, _ in found), Counter()
    for _, d, n in found:
        each[n] += d
    mark = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((k, n, d, each[n], total, mark[n]) for k, d, n in found), key=repr)


CLUSTER_COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def test_clusters_as_slowly(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(scale=0.2, size=64) + (i % 5)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(60)]  # a hot vector, so that several centroids are equal
    rows += [(300, None), (301, []), (302, rows[0][1][:63]), (303, [None] + rows[0][1][1:]), (304, [float("nan")] + rows[0][1][1:]), (305, [float("-inf")] + rows[0][1][1:]), (None, rows[1][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("clash"), "keys": F.lit(1)}).repartition(3)
    as_floats = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows]
    assert rows_of(clusters.cluster(df, clusters=12, rounds=3), *CLUSTER_COLUMNS) == slow_clusters(as_floats, 12, 3)


def test_clusters_of_few_and_none(spark):
    rows = [(7, [0.5] * 64), (8, [-0.5] * 64)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    assert rows_of(clusters.cluster(df), *CLUSTER_COLUMNS) == slow_clusters(rows, 40, 5)
    none = clusters.cluster(df.where("vec_id > 9"))
    assert none.columns == list(CLUSTER_COLUMNS) and none.count() == 0


def test_huge_components_are_cut(spark):
    df = spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64)], "vec_id long, embedding array<double>")
    far = rows_of(clusters.cluster(df, clusters=1, rounds=0), "distance")
    assert far == [(0,), (64 * (2 * clusters.MOST) ** 2,)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 300), st.integers(1, 9), st.sampled_from([2, 50, 1 << 20, 1 << 26]))
def test_trees_settle_every_vector(seed, n, k, size):
    """Few distinct values make ties; sizes beyond doubles take the integer path."""
    rng = np.random.default_rng(seed)
    vectors, centroids = rng.integers(-size, size, (n, 3)), rng.integers(-size, size, (k, 3))
    tree, order = clusters.grow(vectors)
    assert (vectors[order] == tree.vectors).all()
    tree = clusters.unpacked(tree.packed(), n)
    rows, numbers = clusters.distinct(centroids.tolist())
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for v in tree.vectors]
    want = [min(range(k), key=lambda c: (d[c], c)) for d in exact]
    assert numbers[clusters.labels(tree, rows)].tolist() == want
    count, total = clusters.sums(tree, rows)
    for at, number in enumerate(numbers):
        mine = tree.vectors[np.array(want) == number]
        assert count[at] == len(mine) and (total[at] == mine.sum(axis=0)).all()


def test_clustered_vectors_are_settled_by_nodes():
    rng = np.random.default_rng(1)
    centers = rng.integers(-20_000, 20_000, (8, 64))
    tree, _ = clusters.grow(np.repeat(centers, 200, axis=0) + rng.integers(-50, 50, (1600, 64)))
    single = sum(len(places) for whole, places, _ in clusters.settled(tree, centers) if not whole)
    assert single == 0


# ---- 12: lexical search ----


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def slow_search(docs, queries, best=10):
    """Every query against every document, in Python's integers."""
    kept = [(k, Counter(terms_of(t))) for k, t in docs if terms_of(t)]
    n, total = len(kept), sum(c.total() for _, c in kept)
    df = Counter(t for _, c in kept for t in c)
    found = []
    for q, text in set(queries):
        scores = []
        for k, c in kept:
            m = 100 - 90 + 90 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if c[t])
            if score > 0:
                scores.append((-score, k is None, k if k is not None else 0, k))
        found += [(q, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:best])]
    return sorted(found, key=repr)


SEARCHED = ("item_id", "rank", "doc_id", "score")


def test_search_of_odd_rows(spark, odd):
    asked = [(1, "the MIT license"), (2, None), (3, ""), (4, "WORD x ünïcode straße STRASSE 😀"), (5, "the MIT license"), (5, "the MIT license"), (None, "cc, by!"), (6, "nowhere")]
    queries = spark.createDataFrame(asked, "item_id long, text string").withColumn("score", F.lit("clash"))
    want = slow_search(ODD, asked)
    assert want and rows_of(lexical.search(odd, queries), *SEARCHED) == want
    assert rows_of(lexical.search(odd, queries, terms_at_once=2), *SEARCHED) == want
    assert lexical.search(odd.limit(0), queries).count() == 0 and lexical.search(odd, queries.limit(0)).count() == 0


def test_search_across_windows(spark, monkeypatch):
    """Many ties, ids dealt out in no order, windows of a few documents."""
    monkeypatch.setattr(lexical, "WINDOW_DOCS", 7)
    monkeypatch.setattr(lexical, "WINDOW_POSTINGS", 12)
    monkeypatch.setattr(lexical, "KEPT_BITS", 1)
    rng = np.random.default_rng(4)
    docs = [(int(k), " ".join(rng.choice(list("abcdef"), rng.integers(0, 6)))) for k in rng.permutation(200)]
    asked = [(q, " ".join(rng.choice(list("abcdefg"), 3))) for q in range(6)]
    found = lexical.search(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(asked, "item_id long, text string"))
    assert rows_of(found, *SEARCHED) == slow_search(docs, asked)


def test_windows_hold_every_row_in_order(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical, "WINDOW_DOCS", 5)
    monkeypatch.setattr(lexical, "WINDOW_POSTINGS", 8)
    sizes = [0, 3, 9, 1, 0, 0, 4, 4, 4, 20, 0, 1, 1, 1, 1, 1, 1]
    lists = pa.array([[1] * n for n in sizes], pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array(sizes), lists], names=["k", "size", "terms"])
    found = [[k for part in window for k in part.column(0).to_pylist()] for window in lexical.windows(iter([batch, batch.slice(0, 0), batch]))]
    assert [k for w in found for k in w] == [*range(len(sizes))] * 2
    assert all(len(w) <= 5 and (len(w) == 1 or sum(sizes[k] for k in w) <= 8) for w in found)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aZ0é😀 .-\n", max_size=60), st.integers(1, 9))
def test_stretches_cut_no_word(text, size):
    found = [w.decode() for some in words.stretches(text.encode(), lexical.TERM, size) for w in some]
    assert found == terms_of(text)


# ---- 13: licenses ----


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def slow_counts(rows):
    found = []
    for k, text in rows:
        said = words_of(text)
        base = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(said)) if said[i : i + len(phrase.split())] == phrase.split())
        joined = f" {' '.join(said)} "
        more = {label for label, t in licenses.TEMPLATES if re.search(licenses.regex(licenses.parse(t)) + " ", joined)}
        places, n = [i for i, _ in base], len(base)
        labels = {label for _, label in base}
        found.append((k, len(said), n, min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | more)), 1.0 if more else n / (n + 1)))
    return sorted(found, key=repr)


COUNTED = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def test_scan_of_odd_rows(spark, odd):
    found = licenses.scan(odd)
    assert rows_of(licenses.counted(found), *COUNTED) == slow_counts(ODD)
    assert found.schema["size"].dataType.simpleString() == "string" and licenses.scan(odd.limit(0)).count() == 0


def filled(part, rng):
    """One of the texts that a template accepts."""
    if part.optional and rng.random() < 0.5:
        return []
    if part.parts is not None:
        return [w for p in part.parts for w in filled(p, rng)]
    return [part.word.decode() if part.word else str(rng.choice(["acme", "the", "of", "license"]))]


def test_templates_accept_their_texts_and_no_other():
    rng = np.random.default_rng(8)
    automaton = licenses.compiled(licenses.TEMPLATES, licenses.PHRASES)
    for label, template in licenses.TEMPLATES:
        part = licenses.parse(template)
        for _ in range(20):
            said = filled(part, rng)
            before = list(rng.choice(["so", "the", "cc", "mit", "under"], rng.integers(0, 4)))
            found = automaton.places([w.encode() for w in before + said + ["end"]])
            assert any(p[:2] == (label, False) and p[2] <= len(before) + 2 and p[3] == len(before) + len(said) for p in found), (label, said)
            # A mandatory word changed: the automaton agrees with the regular expression on whatever is left
            at = int(rng.integers(len(said)))
            changed = before + said[:at] + ["zzz"] + said[at + 1 :]
            want = {name for name, t in licenses.TEMPLATES if re.search(licenses.regex(licenses.parse(t)) + " ", f" {' '.join(changed)} ")}
            assert {p[0] for p in automaton.places([w.encode() for w in changed]) if not p[1]} == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14))
def test_markup_against_regular_expressions(said):
    templates = [("one", "a <<optional>>b <<optional>>c<</optional>><</optional>> <<words 0-2>> c"), ("two", "<<optional>>a<</optional>> b <<words 1-3>> a"), ("three", "<<words 1-2>> b b")]
    automaton = licenses.compiled(templates, {"c c": "base"})
    found = automaton.places([w.encode() for w in said])
    for label, template in templates:
        pattern = re.compile(licenses.regex(licenses.parse(template)))
        # The longest of every start
        want = []
        for i in range(len(said)):
            ends = [j for j in range(i + 1, len(said) + 1) if pattern.fullmatch("".join(f" {w}" for w in said[i:j]))]
            want += [(i, max(ends))] if ends else []
        assert [p[2:] for p in found if p[0] == label] == want
    assert [p[2] for p in found if p[1]] == [i for i in range(len(said) - 1) if said[i : i + 2] == ["c", "c"]]


@pytest.mark.parametrize("template", ["", "<<optional>>a<</optional>>", "<<words 1-3>>", "a <<optional>> b", "a <</optional>>", "a <<words 3-2>>", "a <<words 0-0>>", "a <<words 0-999>>"])
def test_templates_that_are_errors(template):
    with pytest.raises(ValueError):
        licenses.parse(template)


def test_repeated_heads_take_linear_time():
    automaton = licenses.compiled(licenses.TEMPLATES, licenses.PHRASES)
    said = [b"copyright"] * 100_000 + [b"mit", b"license"]
    assert ("mit", True, 100_000, 100_002) in automaton.places(said)


# ---- counts of personal data ----


def test_counts_of_odd_rows(spark, odd):
    from skeinworks.llm import pii

    rows = odd.union(odd.where("doc_id = 7").withColumns({"doc_id": F.lit(9).cast("long"), "text": F.lit("a.b@c.de, +1 (234) 567-8901, a.b@c.de")}))
    found = pii.counted(pii.find(rows, pii.fit(rows)))
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    assert sorted(by_id, key=repr) == sorted({k for k, _ in ODD} | {9}, key=repr) and len(by_id[4]) == 2 and by_id[4][0] == by_id[4][1]
    empty = hashlib.sha256(b"").hexdigest()
    for k in (0, 1, 2, None):
        assert [(r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans, r.secrets, r.n_found) for r in by_id[k]] == [(0, 0, 0, 0, empty, "", "", 0)]
    one = by_id[9][0]
    base = "email:0:8,email:29:37,phone:10:27"
    assert (one.n_email, one.n_phone, one.base_sha256) == (2, 1, hashlib.sha256(base.encode()).hexdigest()) and set(base.split(",")) <= set(one.spans.split(","))
    assert pii.counted(pii.find(rows.limit(0), pii.fit(rows))).count() == 0


def test_columns_that_operators_have_themselves(spark, odd):
    from skeinworks.llm import langid, simhash

    rows = odd.withColumn("lang", F.lit("en"))
    assert langid.predict(rows, langid.fit(rows)).count() == len(ODD)
    found = simhash.fingerprints(rows)
    assert found.count() == len(ODD) and {r["__text"] for r in found.collect()} == {1}


# ---- similar pairs ----


def shingles_of(text):
    found = text.lower().split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()


def slow_pairs(texts, least=0.8):
    sets = {k: shingles_of(t or "") for k, t in texts}
    return sorted((a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]))


@pytest.mark.parametrize("common", [0, 1 << 20])
def test_all_similar_pairs(spark, monkeypatch, common):
    """Edited copies, texts that share a passage, short and empty ones; whatever is known to be common."""
    from skeinworks.llm import similar

    monkeypatch.setattr(similar, "MOST_COMMON", common)
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = list(rng.choice(vocabulary, 60))
    texts = [(0, None), (1, ""), (2, "one two"), (3, "one two three four five six")]
    for k in range(30):
        body = list(rng.choice(vocabulary, int(rng.integers(20, 120))))
        texts.append((len(texts), " ".join(passage + body)))
        for _ in range(int(rng.integers(0, 4))):
            edited = list(body)
            for _ in range(int(rng.integers(1, 6))):
                edited[int(rng.integers(len(edited)))] = "edited"
            texts.append((len(texts), " ".join(passage + edited)))
    rows = spark.createDataFrame(texts, "id long, text string").repartition(3)
    want = slow_pairs(texts)
    links = similar.pairs(rows, node="id")
    assert len(want) > 10 and sorted((r.a, r.b) for r in links.collect()) == want
    # The first of each that stays decides
    stay = []
    for k, _ in texts:
        if not any((a, k) in want for a in stay):
            stay.append(k)
    gone = similar.later_of(links, rows.withColumnRenamed("id", "node"), F.col("node"))
    assert sorted(r.node for r in gone.distinct().collect()) == sorted({k for k, _ in texts} - set(stay))
    assert similar.pairs(rows.limit(0), node="id").count() == 0 and similar.later_of(links.limit(0), rows.withColumnRenamed("id", "node"), F.col("node")).count() == 0
