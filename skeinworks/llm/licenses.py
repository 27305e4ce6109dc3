"""License scans: templates with markup, compiled to automata over words.

A template is the wording of a license or notice.  ``<<optional>>`` to ``<</optional>>`` may be left out, and may hold more
such; ``<<words 1-12>>`` stands for so many words of any kind.  All other words are mandatory, in their order;
punctuation, case and line breaks don't count.  Templates are compiled together to one automaton, each of whose
positions takes a word; sets of positions are the states, made as texts need them, and each is entered with
a single lookup.  A text is matched from every word that a template can begin with, so
every place is found, and as templates are finite no start is followed further than the longest of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.llm.common import handed_back, text_or_empty, text_slices
from skeinworks.llm.words import stretches

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Public wordings of licenses and notices, with their labels.  Fixed values.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "<<optional>>Released<</optional>> under the <<optional>>terms of the<</optional>> MIT License"),
    ("isc", "Permission to use, copy, modify, and<<optional>>/or<</optional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2.0", "Licensed under the Apache License, <<optional>>Version<</optional>> 2.0"),
    ("apache-2.0", "You may not use this <<words 1-3>> except in compliance with the License. You may obtain a copy of the License at <<optional>>http<<optional>>s<</optional>>://<</optional>><<optional>>www.<</optional>>apache.org/licenses/LICENSE-2.0"),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<optional>>1.<</optional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<optional>>2.<</optional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED"),
    ("bsd-3-clause", "<<optional>>3.<</optional>> Neither the name of <<words 1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl-2.0", "GNU General Public License <<optional>>as published by the Free Software Foundation; either<</optional>> version 2"),
    ("gpl-3.0", "GNU General Public License <<optional>>as published by the Free Software Foundation; either<</optional>> version 3"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-4.0", "CC BY 4.0"),
    ("cc-by-nc-4.0", "CC BY-NC 4.0"),
    ("cc-by-sa-4.0", "CC BY-SA 4.0"),
    ("cc-by-nd-4.0", "CC BY-ND 4.0"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 <<optional>>International<</optional>> <<optional>>Public<</optional>> License"),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 <<optional>>International<</optional>> <<optional>>Public<</optional>> License"),
    ("all-rights-reserved", "Copyright <<words 1-12>> All rights reserved"),
]
TAG = re.compile(r"<<(/?optional|words [0-9]+-[0-9]+)>>")
#: Words that a replaceable region may have, at most, and states that are remembered.
MOST_WORDS, MOST_STATES = 64, 1 << 16
#: Text of a batch, in bytes.
BYTES_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Part:
    """A piece of a template: a ``word`` (None: any), or a sequence of pieces; whether it may be left out."""

    word: bytes | None = None
    parts: tuple[Part, ...] | None = None
    optional: bool = False


def parse(template: str) -> Part:
    """A template's pieces.  Tags that don't pair, empty regions of words, and templates without a mandatory word are errors."""
    open_parts: list[list[Part]] = [[]]
    for k, piece in enumerate(TAG.split(template)):
        if k % 2 == 0:
            open_parts[-1] += [Part(w) for w in WORD.findall(piece.encode().lower())]
        elif piece == "optional":
            open_parts.append([])
        elif piece == "/optional":
            inner = tuple(open_parts.pop())
            if not open_parts:
                raise ValueError("an optional region ends that hasn't begun")
            open_parts[-1].append(Part(parts=inner, optional=True))
        else:
            least, most = map(int, piece.split()[1].split("-"))
            if not least <= most <= MOST_WORDS or not most:
                raise ValueError(f"a region of {least} to {most} words")
            rest: tuple[Part, ...] = ()
            for _ in range(most - least):  # each further word only after the one before it
                rest = (Part(parts=(Part(), *rest), optional=True),)
            open_parts[-1] += [*(Part() for _ in range(least)), *rest]
    if len(open_parts) > 1:
        raise ValueError("an optional region has no end")
    whole = Part(parts=tuple(open_parts[0]))
    if not mandatory(whole):
        raise ValueError("a template needs a mandatory word")
    return whole


def mandatory(part: Part) -> bool:
    """Whether a word of the template's own must stand in every text that it accepts."""
    return not part.optional and (part.word is not None if part.parts is None else any(map(mandatory, part.parts)))


@dataclass
class Automaton:
    """The positions of all templates: which take a word, which take any, where texts begin, what follows, and what is accepted at each."""

    takes: dict[bytes, int] = field(default_factory=dict)
    takes_any: int = 0
    begin: int = 0
    follow: list[int] = field(default_factory=list)
    accept: dict[int, tuple[str, bool]] = field(default_factory=dict)
    states: dict[tuple[int, bytes | None], int] = field(default_factory=dict)
    found: dict[int, tuple[tuple[str, bool], ...]] = field(default_factory=dict)

    def add(self, label: str, whole: Part, base: bool = False) -> None:
        """One more template; ``base`` marks what it accepts as a phrase's place."""
        first, last, _ = self._place(whole)
        self.begin |= first
        for at in _bits(last):
            self.accept[at] = label, base

    def _place(self, part: Part) -> tuple[int, int, bool]:
        """(first, last, whether it may be empty) of a piece, its positions joined."""
        if part.parts is None:
            at = 1 << len(self.follow)
            self.follow.append(0)
            if part.word is None:
                self.takes_any |= at
            else:
                self.takes[part.word] = self.takes.get(part.word, 0) | at
            return at, at, part.optional
        first, last, empty = 0, 0, True
        for piece in part.parts:
            f, l, e = self._place(piece)  # noqa: E741
            for at in _bits(last):
                self.follow[at] |= f
            first |= f if empty else 0
            last = l | (last if e else 0)
            empty = empty and e
        return first, last, empty or part.optional

    def step(self, state: int, word: bytes) -> int:
        """The state after ``word``; a word that no template has counts as any other such."""
        known = word if word in self.takes else None
        after = self.states.get((state, known))
        if after is None:
            reached = 0
            for at in _bits(state):
                reached |= self.follow[at]
            after = reached & (self.takes.get(known, 0) | self.takes_any)
            self._remember(self.states, (state, known), after)
        return after

    def accepted(self, state: int) -> tuple[tuple[str, bool], ...]:
        found = self.found.get(state)
        if found is None:
            found = tuple(sorted({self.accept[at] for at in _bits(state) if at in self.accept}))
            self._remember(self.found, state, found)
        return found

    def _remember(self, where: dict, key, value) -> None:
        if len(where) >= MOST_STATES:
            where.clear()
        where[key] = value

    def places(self, words: list[bytes]) -> list[tuple[str, bool, int, int]]:
        """(label, base, start, end) of every match, by start; of a template's at one place the longest."""
        found = []
        starts = range(len(words)) if self.begin & self.takes_any else [i for i, w in enumerate(words) if self.takes.get(w, 0) & self.begin]
        for start in starts:
            state, end = self.begin & (self.takes.get(words[start], 0) | self.takes_any), start + 1
            here: dict[tuple[str, bool], int] = {}
            while state:
                for one in self.accepted(state):
                    here[one] = end
                if end == len(words):
                    break
                state, end = self.step(state, words[end]), end + 1
            found += [(label, base, start, to) for (label, base), to in here.items()]
        return found


def _bits(state: int) -> Iterator[int]:
    while state:
        low = state & -state
        yield low.bit_length() - 1
        state ^= low


def compiled(templates: list[tuple[str, str]], phrases: dict[str, str]) -> Automaton:
    """One automaton of templates and phrases (templates without markup)."""
    automaton = Automaton()
    for label, template in templates:
        automaton.add(label, parse(template))
    for phrase, label in phrases.items():
        automaton.add(label, parse(phrase), base=True)
    return automaton


PLACES = "array<struct<label:string,base:boolean,start:int,end:int>>"


def scan(docs: DataFrame, *, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, text: str = "text", n_words: str = "n_words", places: str = "places") -> DataFrame:
    """``docs`` without ``text``, with the number of its words, and every place that a template or phrase (``base``) has, as words from 0, the end exclusive, by start.

    A null text is empty: no words, no places.  Places of different templates may overlap, and each counts.
    Rows are independent: repeated rows agree, an empty table gives an empty one.  Columns named ``n_words`` and ``places`` are replaced.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(compiled(TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases))
    others = [c for c in docs.columns if c not in (text, n_words, places)]
    schema = T.StructType([*(docs.schema[c] for c in others), *T.StructType.fromDDL(f"`{n_words}` long, `{places}` {PLACES}")])
    place = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(handed_back(batches), len(others), BYTES_AT_ONCE):
            size, found = [], []
            for raw in part.column(len(others)).cast(pa.binary()):
                words = [w for some in stretches(raw.as_py(), WORD) for w in some]
                size.append(len(words))
                found.append([dict(zip(("label", "base", "start", "end"), p, strict=True)) for p in automaton.value.places(words)])
            yield pa.RecordBatch.from_arrays([*part.columns[: len(others)], pa.array(size, pa.int64()), pa.array(found, place)], names=schema.names)

    return docs.select(*(F.col(f"`{c}`") for c in others), text_or_empty(f"`{text}`").alias(text)).mapInArrow(run, schema)


def _labels(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def counted(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score from the columns of ``scan``.

    The score is 1 where a template is accepted; else k places of phrases give k / (k + 1).  Without any, labels are empty and the first and last word null.
    """
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform("base", lambda p: p["start"].cast("long"))
    rows = scanned.select("doc_id", "n_words", "places", base.alias("base"))
    n = F.size("base").cast("long")
    score = F.when(F.exists("places", lambda p: ~p["base"]), F.lit(1.0)).otherwise(n / (n + 1))
    return rows.select("doc_id", "n_words", n.alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), _labels(F.col("base")).alias("base_labels"), _labels(F.col("places")).alias("labels"), score.alias("score"))


def regex(part: Part) -> str:
    """The texts of a piece as a regular expression over words that each follow a space: a plainer form to compare with."""
    inner = "".join(map(regex, part.parts)) if part.parts is not None else " " + (re.escape(part.word.decode()) if part.word else "[^ ]+")
    return f"(?:{inner})?" if part.optional else inner


def _oracle() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD_PATTERN}')"
    heads = {label: phrase.split() for phrase, label in PHRASES.items()}
    is_base = "CASE " + " ".join("WHEN " + " AND ".join((f"lead(w, {k}) OVER o" if k else "w") + f" = '{w}'" for k, w in enumerate(ws)) + f" THEN '{label}'" for label, ws in heads.items()) + " END"
    ours = ", ".join(f"CASE WHEN regexp_matches(said, '{regex(parse(t))} ') THEN '{label}' END" for label, t in TEMPLATES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
u AS (SELECT r, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM d),
p AS (SELECT r, i, {is_base} AS label FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
b AS (SELECT r, count(*) AS n, min(i) AS first, max(i) AS last, list(DISTINCT label) AS found FROM p WHERE label IS NOT NULL GROUP BY r),
m AS (SELECT r, list_filter([{ours}], lambda x: x IS NOT NULL) AS more FROM (SELECT r, ' ' || array_to_string(words, ' ') || ' ' AS said FROM d))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, CAST(first AS BIGINT) AS first_word, CAST(last AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(found), ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(found, []), more))), ','), '') AS labels,
  CASE WHEN len(more) > 0 THEN 1.0::DOUBLE ELSE coalesce(n, 0) / (coalesce(n, 0) + 1) END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)"""


#: The same with regular expressions over the joined words.
ORACLE = _oracle()
