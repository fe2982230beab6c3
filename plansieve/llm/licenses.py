"""Licence scan by a positional rare-token index over licence templates.

Texts are lower-cased (A-Z) and cut into words. A first pass counts, for each word of
the templates, the documents that hold it. In the second pass each file looks up its own
licence words in an index that holds every word of every template with its positions. The
difference of the positions in file and template is an alignment. Of a template's mandatory
key phrase, which a match holds whole, the ``agree`` words with the highest IDF are looked up, and their
alignments are intersected, so no match is missed. Alignments at which
the key phrase stands word by word and enough IDF weight of the template
agrees are matches. Base phrases are posted under their rarest word, so each of their places
is met exactly once.

Defined cases: null text counts as empty; a text without words has no labels (''),
score 0 and null positions; overlapping places all count; ids may be null or repeat;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, small_batches

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Public licence notices, their labels and the phrase that must stand.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "in compliance with the license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-3", "either version 3 of the license or at your option any later version", "version 3 of the license"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", "the software is provided as is without warranty of any kind"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "distributed on an as is basis"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software for any purpose"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced", "all rights reserved"),
)

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words are runs of digits, a-z and everything from 0x80 up; the rest becomes a space.
WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in LOWER)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def vocabulary(templates=TEMPLATES, base: Mapping[str, str] = BASE) -> list[bytes]:
    """Every word of a template or base phrase."""
    return sorted({w for x in (*[t for _, t, _ in templates], *base) for w in x.encode().split()})


def document_frequencies(docs: DataFrame, text_col: str = "text", words: list[bytes] | None = None) -> tuple[int, dict[bytes, int]]:
    """Documents in all, and documents that hold each word; the result is as small as the templates."""
    wanted = frozenset(vocabulary() if words is None else words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = Counter(), 0
        for batch in slices(batches):
            for text in as_bytes(batch.column(0)):
                n += 1
                total.update(wanted.intersection(words_of(text)))
        found = [(w.decode(), c) for w, c in total.items()]
        yield pa.record_batch([pa.array([None, *[w for w, _ in found]], pa.string()), pa.array([n, *[c for _, c in found]], pa.int64())], ["word", "n"])

    rows = docs.select(text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {r["word"]: r["n"] for r in rows}
    return got.pop(None, 0), {w.encode(): n for w, n in got.items()}


class Index:
    """All words of the templates with their positions, and base phrases under their rarest word."""

    def __init__(self, n: int, df: Mapping[bytes, int], templates=TEMPLATES, base: Mapping[str, str] = BASE, agree: int = 2):
        self.idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-3 for w in vocabulary(templates, base)}
        self.base_labels = list(base.values())
        self.templates, self.keys = [], []
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.base: dict[bytes, list[tuple[int, int, list[bytes]]]] = {}
        for label, text, key in templates:
            t, k = text.encode().split(), key.encode().split()
            at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
            for i, w in enumerate(t):
                self.postings.setdefault(w, []).append((len(self.templates), i))
            self.templates.append((label, t, at, k, sum(self.idf[w] for w in t)))
            self.keys.append(frozenset(k))
        for i, phrase in enumerate(base):
            p = phrase.encode().split()
            at = max(range(len(p)), key=lambda j: (self.idf[p[j]], -j))
            self.base.setdefault(p[at], []).append((i, at, p))
        self.lookup = frozenset(self.postings) | frozenset(self.base)
        self.rarest = [sorted(k, key=lambda w: (-self.idf[w], w))[:agree] for k in self.keys]
        self.anchors = frozenset(words[0] for words in self.rarest) | frozenset(self.base)

    def alignments(self, places: Mapping[bytes, list[int]]) -> set[tuple[int, int]]:
        """(template, shift) at which the postings of a file's rarest words meet.

        A match holds its whole key phrase, so only templates whose key words the file has
        are looked up, under the rarest of these, and no match is missed.
        """
        out: set[tuple[int, int]] = set()
        for t, words in enumerate(self.rarest):
            if self.keys[t] <= places.keys():
                first, *others = ({i - at for at in self.postings_of(t, w) for i in places[w]} for w in words)
                out.update((t, shift) for shift in first.intersection(*others))
        return out

    def postings_of(self, template: int, word: bytes) -> list[int]:
        """The positions of a word in a template."""
        return [at for t, at in self.postings[word] if t == template]

    def scan(self, words: list[bytes], least: float) -> tuple[int, int | None, int | None, set[str], set[str], float]:
        """n_base, first, last, base labels, labels and score of a text."""
        if self.anchors.isdisjoint(words):
            return 0, None, None, set(), set(), 0.0
        lookup, places = self.lookup, {}
        for i, w in enumerate(words):
            if w in lookup:
                places.setdefault(w, []).append(i)
        starts, base, found, score = [], set(), set(), 0.0
        for w in self.base.keys() & places.keys():
            for which, at, phrase in self.base[w]:
                for i in places[w]:
                    if i >= at and words[i - at : i - at + len(phrase)] == phrase:
                        starts.append(i - at)
                        base.add(self.base_labels[which])
        for t, shift in self.alignments(places):
            label, template, at, key, weight = self.templates[t]
            k = shift + at
            if k < 0 or words[k : k + len(key)] != key:
                continue
            part = words[max(shift, 0) : shift + len(template)]
            got = sum(self.idf[x] for x, y in zip(template[max(-shift, 0) :], part, strict=False) if x == y) / weight
            score = max(score, got)
            if got >= least:
                found.add(label)
        score = 1.0 if base else min(1.0, score)
        return len(starts), min(starts, default=None), max(starts, default=None), base, base | found, score


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, base: Mapping[str, str] = BASE, agree: int = 2, least: float = 0.6) -> DataFrame:
    """A row per document: word count, places of base phrases, labels and the best IDF coverage."""
    small_batches(docs.sparkSession)
    n, df = document_frequencies(docs, text_col, vocabulary(templates, base))
    index = Index(n, df, templates, base, agree)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text in as_bytes(batch.column(1)):
                words = words_of(text)
                places, first, last, base_labels, labels, score = index.scan(words, least)
                out.append((len(words), places, first, last, ",".join(sorted(base_labels)), ",".join(sorted(labels)), score))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.record_batch([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    id_type = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), text_col).mapInArrow(scan, f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
