"""Columns over text: splitting, packing, eliding, references, formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinworks.functions.messages import turn_labels

#: References to turns in prose; a fixed value.
TURN_REFERENCE = r"\b[UA]\d+(?:[–-][UA]?\d+)?(?:\s*(?:,|and)\s*[UA]\d+(?:[–-][UA]?\d+)?)?"
#: ``index|consumption|extension|review`` on a line of its own; a fixed value.
RESULT_LINE = r"^(\d+)\|(yes|no|uncertain)\|(none|potential|clear)\|(yes|maybe|no)$"
#: Language labels that need no translation; fixed values.
ENGLISH_LABELS = ("english", "unknown", "")


def hard_pieces(text: Column, limit: int) -> Column:
    """Pieces of ``limit`` characters; none of an empty text."""
    steps = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.floor((F.length(text) - 1) / limit).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda i: F.substring(text, i * limit + 1, F.lit(limit)))


def segments(messages: Column, limit: int = 115_000) -> Column:
    """``[U1] text`` for each message, ``[U1 part 1/2] ...`` for pieces of those beyond ``limit`` less 64."""

    def of(pair: Column) -> Column:
        label, pieces = pair["label"], hard_pieces(pair["m"]["content"], limit - 64)
        n = F.size(pieces)
        head = lambda i: F.when(n > 1, F.concat(F.lit("["), label, F.lit(" part "), (i + 1).cast("string"), F.lit("/"), n.cast("string"), F.lit("] "))).otherwise(F.concat(F.lit("["), label, F.lit("] ")))
        return F.when(n == 0, F.array(F.concat(F.lit("["), label, F.lit("] ")))).otherwise(F.transform(pieces, lambda piece, i: F.concat(head(i), piece)))

    zipped = F.transform(F.arrays_zip(turn_labels(messages).alias("label"), messages.alias("m")), lambda z: F.struct(z["label"].alias("label"), z["m"].alias("m")))
    return F.flatten(F.transform(zipped, of))


def _groups(lengths: Column, is_full) -> Column:
    """Groups of consecutive items as struct<first, n>: a new one begins where ``is_full`` of (items, characters so far, next length) says so.

    The fold holds numbers and where groups begin, which are copied only where a new one does.
    """
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("items"), F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("starts"))

    def step(s: Column, n: Column) -> Column:
        new = (s["items"] == 0) | is_full(s["items"], s["held"], n)
        starts = F.when(new, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"])
        return F.struct((s["at"] + 1).alias("at"), F.when(new, 1).otherwise(s["items"] + 1).alias("items"), F.when(new, n.cast("long")).otherwise(s["held"] + n).alias("held"), starts.alias("starts"))

    return F.aggregate(lengths, zero, step, lambda s: F.transform(s["starts"], lambda first, k: F.struct(first.alias("first"), (F.coalesce(F.get(s["starts"], k + 1), s["at"]) - first).alias("n"))))


def greedy_chunks(pieces: Column, limit: int = 115_000, separator: str = "\n\n") -> Column:
    """Pieces joined in order into chunks of at most ``limit`` characters, separators counted; a longer piece is a chunk alone."""
    gap = len(separator)
    groups = _groups(F.transform(pieces, lambda p: F.length(p)), lambda items, held, n: held + n + items * gap > limit)
    # An array of one, so that the pieces are made once and not for each chunk
    both = F.array(F.struct(pieces.alias("pieces"), groups.alias("groups")))
    return F.get(F.transform(both, lambda x: F.transform(x["groups"], lambda g: F.array_join(F.slice(x["pieces"], g["first"] + 1, g["n"]), separator))), F.lit(0))


def batch_numbers(lengths: Column, *, max_items: int = 8, max_characters: int = 4_000) -> Column:
    """For each length the number of its batch, from 0: a batch closes before it would exceed either bound; a longer item is a batch alone."""
    groups = _groups(lengths, lambda items, held, n: (items >= max_items) | (held + n > max_characters))
    return F.flatten(F.transform(groups, lambda g, k: F.array_repeat(k, g["n"])))


def soft_pieces(text: Column, limit: int = 3_000) -> Column:
    """Pieces of at most ``limit`` characters that lose nothing: each ends before the last newline in reach, else before the last space, either only in its second half, else at the limit.

    A null text has no pieces, an empty one is a piece.  One pattern finds piece after piece, each from where the last one
    ended, so no text leaves the JVM and the time is linear in it.
    """
    half = limit // 2
    soft = [rf".{{{half},{limit - 1}}}(?={mark})" for mark in (r"\n", " ")] if half else []
    ends = "|".join([rf".{{1,{limit}}}\z", *soft, f".{{{limit}}}"])
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(f"(?s){ends}"), F.lit(0)))


def elide(text: Column, limit: int, reserve: int = 36, mark: str = " […omitted…] ") -> Column:
    """A text over ``limit`` as its first and last halves of what ``reserve`` leaves, around ``mark``."""
    half = (limit - reserve) // 2
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, half), F.lit(mark), F.substring(text, -half, half))).otherwise(text)


#: Control characters that XML forbids; a fixed value.
FORBIDDEN = r"\x00-\x08\x0B\x0C\x0E-\x1F"


def visible_controls(text: Column) -> Column:
    """Control characters that XML forbids, spelled out; tab and line ends stay.  A text that has any is cut at them once, others aren't touched."""
    parts = F.regexp_extract_all(text, F.lit(f"[{FORBIDDEN}]|[^{FORBIDDEN}]+"), F.lit(0))
    spelled = lambda p: F.concat(F.lit("⟦U+"), F.lpad(F.hex(F.ascii(p)), 4, "0"), F.lit(" CONTROL CHARACTER⟧"))
    return F.when(text.rlike(f"[{FORBIDDEN}]"), F.array_join(F.transform(parts, lambda p: F.when(p.rlike(f"^[{FORBIDDEN}]"), spelled(p)).otherwise(p)), "")).otherwise(text)


def turn_references(text: Column) -> Column:
    """The distinct references to turns in order, joined; or a note that there are none."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(TURN_REFERENCE), 0))
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise("not directly evidenced")


#: White space of any alphabet, and the separators that count as such.
SPACE = r"[\s\x1C-\x1F]"
#: Whatever ends a line.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def stripped(text: Column) -> Column:
    """A text without white space of any kind around it."""
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def is_english_label(label: Column) -> Column:
    return F.lower(stripped(F.coalesce(label, F.lit("")))).isin(*ENGLISH_LABELS)


def result_lines(response: Column) -> Column:
    """The valid lines of a batch answer as array<struct<index, c, r, q>>, white space around them aside; others are skipped."""
    lines = F.filter(F.transform(F.split(response, LINE_END), stripped), lambda x: x.rlike(RESULT_LINE))
    part = lambda x, i: F.regexp_extract(x, RESULT_LINE, i)
    return F.transform(lines, lambda x: F.struct(part(x, 1).cast("int").alias("index"), part(x, 2).alias("c"), part(x, 3).alias("r"), part(x, 4).alias("q")))


#: A last run of pictographs; a fixed value.
LAST_PICTOGRAPHS = r"\s*[\x{1F300}-\x{1FAFF}\u2600-\u27BF\uFE0F\u200D]+\s*\z"
#: Words that capitalised titles write their own way; fixed values.
TITLE_WORDS = {"Ai": "AI", "Jcr": "JCR", "Genai": "GenAI", "Lgbtq": "LGBTQ", "Ui": "UI", "Ux": "UX"}


def without_residue(text: Column, *, head: str | None = None, sentences: Sequence[str] = ()) -> Column:
    """A text without what a template left in it: a ``head`` (pattern), whole sentences, the last run of pictographs, more than one empty line in a row, outer space."""
    if head:
        text = F.regexp_replace(text, rf"\A{head}", "")
    for sentence in sentences:
        text = F.replace(text, F.lit(sentence), F.lit(""))
    text = F.regexp_replace(F.regexp_replace(text, LAST_PICTOGRAPHS, ""), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def title(text: Column, words: dict[str, str] = TITLE_WORDS) -> Column:
    """A heading without punctuation, each run of letters capitalised, ``words`` written their own way, and levels as ``L3``."""
    spaced = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))
    runs = F.regexp_extract_all(spaced, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    found = F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, F.length(x))))), "")
    for plain, own in words.items():
        found = F.regexp_replace(found, rf"(?U)\b{plain}\b", own)
    return F.regexp_replace(found, r"\bL ([0-6])\b", "L$1")


def thousands_list(pairs: list[tuple[str, Column]], *, omit_zero: bool = False) -> Column:
    """``name: 1,234`` for each pair in the given order, joined by line breaks."""
    items = F.array(*(F.when(F.lit(omit_zero) & (n == 0), F.lit(None)).otherwise(F.concat(F.lit(f"{name}: "), F.format_number(n, 0))) for name, n in pairs))
    return F.array_join(F.filter(items, lambda x: x.isNotNull()), "<br/>")


def long_date(when: Column) -> Column:
    """``7 March 2026``"""
    return F.date_format(when, "d MMMM yyyy")
