"""Licence notices in texts, by a positional index of the templates' rare words."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: A passage is found, and a template confirmed, from this share of their words on.
SHARE_NUM, SHARE_DEN = 7, 10
#: Words of all templates; they are broadcast.
MAX_WORDS = 200_000
#: Cells of a comparison of places with a passage.
CELLS = 1 << 22
#: A-Z to a-z; everything that parts words to a blank.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


class Phrase(NamedTuple):
    """Words that must stand consecutively, and what they stand for."""

    label: str
    text: str


class Template(NamedTuple):
    """A notice: passages that may stand in any order, and phrases that must stand within them word for word."""

    label: str
    passages: tuple[str, ...]
    keys: tuple[str, ...]


PHRASES = (
    Phrase("gpl", "gnu general public license"), Phrase("apache", "apache license"), Phrase("cc-by", "cc by"), Phrase("mit", "mit license"),
)

_GNU = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation"
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"
_BSD = ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer")

TEMPLATES = (
    Template("gpl-3.0", ("This work is licensed under the GNU General Public License, version 3",), ("gnu general public license", "version 3")),
    Template("gpl-2.0", ("This work is licensed under the GNU General Public License, version 2",), ("gnu general public license", "version 2")),
    Template("gpl-3.0", (_GNU.format("General Public License"), "either version 3 of the License, or (at your option) any later version"), ("gnu general public license", "version 3")),
    Template("gpl-2.0", (_GNU.format("General Public License"), "either version 2 of the License, or (at your option) any later version"), ("gnu general public license", "version 2")),
    Template("lgpl", (_GNU.format("Lesser General Public License"),), ("gnu lesser general public license",)),
    Template("agpl", (_GNU.format("Affero General Public License"),), ("gnu affero general public license",)),
    Template("apache-2.0", ("Licensed under the Apache License, Version 2.0",), ("apache license", "version 2 0")),
    Template("apache-2.0", ("you may not use this file except in compliance with the License", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"), ("compliance with the license", "applicable law")),
    Template("mit", ("Released under the MIT License",), ("mit license",)),
    Template("mit", ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", _AS_IS), ("permission is hereby granted free of charge",)),
    Template("isc", ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",), ("with or without fee is hereby granted",)),
    Template("bsd", _BSD, ("redistributions of source code", "redistributions in binary form")),
    Template("bsd-3-clause", (*_BSD, "nor the names of its contributors may be used to endorse or promote products derived from this software"), ("names of its contributors", "endorse or promote")),
    Template("mpl-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",), ("mozilla public license", "2 0")),
    Template("unlicense", ("This is free and unencumbered software released into the public domain",), ("unencumbered software", "public domain")),
    Template("cc-by-nc-4.0", ("Licensed under CC BY-NC 4.0",), ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", ("Licensed under CC BY-SA 4.0",), ("cc by sa 4 0",)),
    Template("cc-by-4.0", ("Licensed under CC BY 4.0",), ("cc by 4 0",)),
    Template("cc-by-4.0", ("licensed under a Creative Commons Attribution 4.0 International License",), ("creative commons attribution 4 0",)),
    Template("cc0-1.0", ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "CC0 1.0 Universal"), ("waived all copyright",)),
)


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of a text with A-Z lower-cased."""
    return (text or "").encode().translate(FOLD).split()


class RareIndex:
    """Postings of the rarest words of each passage.

    A passage of m words is found where c of them (SHARE of m, rounded up; all m of a phrase) stand at one relative
    position. Any m - c + 1 of its places hold one of those, so its m - c + 1 rarest are posted, and no other word has
    to be looked up. The rarity decides the work, never the result.
    """

    def __init__(self, phrases: tuple[Phrase, ...], templates: tuple[Template, ...], rarity: dict[bytes, float]):
        self.phrases, self.templates = phrases, templates
        self.passages: list[np.ndarray] = []
        self.least: list[int] = []
        self.number: dict[bytes, int] = {}
        postings = defaultdict(list)

        def passage(text: str, exact: bool) -> int:
            words = words_of(text)
            m, p = len(words), len(self.passages)
            least = m if exact else -(-SHARE_NUM * m // SHARE_DEN)
            for at in sorted(range(m), key=lambda i: (-rarity.get(words[i], 0.0), i))[: m - least + 1]:
                postings[self.number.setdefault(words[at], len(self.number))].append((p, at))
            self.passages.append(np.array([self.number.setdefault(w, len(self.number)) for w in words], np.int32))
            self.least.append(least)
            return p

        self.phrase_at = [passage(x.text, True) for x in phrases]
        self.parts = [[passage(x, False) for x in t.passages] for t in templates]
        self.keys = [[np.array([self.number.setdefault(w, len(self.number)) for w in words_of(k)], np.int32) for k in t.keys] for t in templates]
        self.posted = dict(postings)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """(label, first word) of each place of a phrase, and (label, first word, words, share) of each confirmed template."""
        file = np.fromiter((self.number.get(w, -1) for w in words), np.int32, len(words))
        asked = [w for w in np.unique(file).tolist() if w in self.posted]
        if not asked:
            return [], []
        # from the rare words' places to the offsets at which passages would begin
        begins = defaultdict(list)
        for w in asked:
            at = np.flatnonzero(file == w)
            for p, within in self.posted[w]:
                begins[p].append(at - within)
        hits = {p: self._met(file, p, np.unique(np.concatenate(found))) for p, found in begins.items()}
        places = [(x.label, at) for x, p in zip(self.phrases, self.phrase_at) if p in hits for at in hits[p][0].tolist()]
        notices = []
        for t, parts, keys in zip(self.templates, self.parts, self.keys):
            met = [(p, *hits[p]) for p in parts if p in hits and len(hits[p][0])]
            total = sum(len(self.passages[p]) for p in parts)
            have = sum(int(counts.max()) for _, _, counts in met)
            if met and SHARE_DEN * have >= SHARE_NUM * total and all(any(self._holds(file, p, begin, k) for p, begin, _ in met) for k in keys):
                first = min(int(begin[counts.argmax()]) for _, begin, counts in met)
                last = max(int(begin[counts.argmax()]) + len(self.passages[p]) for p, begin, counts in met)
                first, last = max(first, 0), min(last, len(words))
                notices.append((t.label, first, last - first, have / total))
        return sorted(places, key=lambda x: (x[1], x[0])), notices

    def _met(self, file: np.ndarray, p: int, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The offsets at which enough words of the passage stand in their places, and how many."""
        want = self.passages[p]
        m = len(want)
        padded = np.concatenate((np.full(m, -2, np.int32), file, np.full(m, -2, np.int32)))
        rows = max(1, CELLS // m)
        counts = [(padded[begins[at : at + rows, None] + m + np.arange(m)] == want).sum(axis=1) for at in range(0, len(begins), rows)]
        count = np.concatenate(counts)
        enough = count >= self.least[p]
        return begins[enough], count[enough]

    def _holds(self, file: np.ndarray, p: int, begins: np.ndarray, key: np.ndarray) -> bool:
        """Some place of the passage holds the key phrase."""
        m, k = len(self.passages[p]), len(key)
        if k > m:
            return False
        padded = np.concatenate((np.full(m, -2, np.int32), file, np.full(m, -2, np.int32)))
        rows = max(1, CELLS // m)
        for at in range(0, len(begins), rows):
            seen = padded[begins[at : at + rows, None] + m + np.arange(m)]
            whole = np.ones((len(seen), m - k + 1), bool)
            for j, w in enumerate(key.tolist()):
                whole &= seen[:, j : j + m - k + 1] == w
            if whole.any():
                return True
        return False


def rarity(docs: DataFrame, words: set[bytes], text_col: str = "text") -> dict[bytes, float]:
    """The inverse document frequency of the given words over all texts. One row for each word comes to the driver."""
    if not words:
        return {}
    asked = frozenset(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, defaultdict(int)
        for batch in batches:
            n += batch.num_rows
            for text in batch.column(0):
                for w in asked.intersection(words_of(text.as_py())):
                    seen[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array([None, *seen], pa.binary()), pa.array([n, *seen.values()], pa.int64())], ["w", "n"])

    counts = docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    rows = {None if r.w is None else bytes(r.w): r.n for r in counts.collect()}
    total = rows.pop(None, 0) or 0
    return {w: math.log((total + 1) / (rows.get(w, 0) + 1)) for w in words}


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple[Phrase, ...] = PHRASES, templates: tuple[Template, ...] = TEMPLATES
) -> DataFrame:
    """One row per input row: id, n_words, places (label, start) of the phrases, and notices (label, start, length, share).

    1. One pass counts in how many texts each word of phrases and templates stands; a row a word comes back.
    2. Each passage posts its rarest words with their positions (`RareIndex`). A text's rare licence words give the offsets at
       which passages may begin, and the words at the passage's relative positions are compared there.
    3. A phrase is found where all its words stand. A template is confirmed when its passages, each found from SHARE of its
       words on, hold SHARE of all its words, and each key phrase stands whole within a place of them.

    Defined results: a null or empty text has no words, places or notices. Null or repeated ids are rows like any other.
    An empty table gives no rows. Every template is reported once a text, at its best place. Only the two named columns
    are read. There is no shuffle but for the word counts; the templates (MAX_WORDS words at most) are sent to the tasks.
    """
    for text in [*(x.text for x in phrases), *(x for t in templates for x in (*t.passages, *t.keys))]:
        if not words_of(text):
            raise ValueError(f"no words in {text!r}")
    told = [w for x in [*(x.text for x in phrases), *(x for t in templates for x in t.passages)] for w in words_of(x)]
    if len(told) > MAX_WORDS:
        raise ValueError(f"phrases and templates of more than {MAX_WORDS} words")
    index = RareIndex(phrases, templates, rarity(docs, set(told), text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, places, notices = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                found, confirmed = index.scan(words)
                n.append(len(words))
                places.append([{"label": x, "start": at} for x, at in found])
                notices.append([{"label": x, "start": at, "length": size, "share": share} for x, at, size, share in confirmed])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(n, pa.int64()),
                    pa.array(places, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))),
                    pa.array(notices, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("share", pa.float64())]))),
                ],
                ["_id", "n_words", "places", "notices"],
            )

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    out = "places array<struct<label:string,start:bigint>>, notices array<struct<label:string,start:bigint,length:bigint,share:double>>"
    return src.mapInArrow(run, f"_id {kind}, n_words long, {out}").withColumnRenamed("_id", id_col)
