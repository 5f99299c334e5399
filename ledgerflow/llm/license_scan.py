"""Operator 1: license scan, MinHash bands over overlapping text windows, then exact shingle containment.

Templates are grouped by length. For a group with blocks of s shingles, a document is covered by windows of three blocks,
each starting one block after the last, so any run of up to 2s + 1 shingles lies inside some window; s is chosen so that a
template with a quarter of its length inserted still fits. A window that holds at least ``CONTAINED`` of a template's
shingles has a known least Jaccard similarity J with it, and ``band_plan`` takes so many bands that such a pair shares
a band with probability 1 - ``MISS`` or more. Pairs that share a band are verified on the words themselves: the share
of the template's shingles found in the window is exact, so nothing false is reported.

One pass without a shuffle. Tasks receive the bands of ``MOST_TEMPLATES`` templates at most; more take one pass for each so many.

Defined results. Null, empty and short texts have no match. Words are runs of 0-9, a-z (A-Z lower-cased) and everything above
7F, so case and punctuation do not matter. Repeated rows are scanned alike; overlapping templates are all reported.
Empty table, or no templates: empty result. Input columns named like a result column are replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ledgerflow.llm import textkit

WORDS, CONTAINED, MISS, MOST_TEMPLATES, SLICE_BYTES = 5, 0.8, 1e-4, 5000, 1 << 20

#: License notices as their publishers word them.
TEMPLATES = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-short": "Released under the MIT License.",
    "MIT-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ISC-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words_of(text: str) -> list[str]:
    w = textkit.scan(pa.array([text]), "alnum")
    return [w.word(i).decode() for i in range(len(w.start))]


def shingles(words: list[str]) -> list[tuple[str, ...]]:
    return [tuple(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)]


def band_plan(jaccard: float, miss: float = MISS, rows: int = 1) -> int:
    """Bands of ``rows`` hashes so that a pair this similar shares none with probability ``miss`` at most."""
    return 1 if jaccard >= 1 else max(1, math.ceil(math.log(miss) / math.log(1 - jaccard**rows)))


class Group:
    """Templates scanned with the same windows: three blocks of ``block`` shingles."""

    def __init__(self, block: int, templates: dict[str, str], contained: float):
        self.block, self.names = block, list(templates)
        self.sets = [set(shingles(words_of(t))) for t in templates.values()]
        least = min(math.ceil(contained * len(s) - 1e-9) / (3 * block + len(s) - math.ceil(contained * len(s) - 1e-9)) for s in self.sets)
        self.bands = band_plan(least)
        rng = np.random.default_rng(1000 + block)
        self.factors = rng.integers(0, 1 << 63, self.bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        own = [np.unique(self._hashes(t)) for t in templates.values()]
        # values[k]: each template's minimum under hash k; hints[k]: which leading 16 bits occur among them.
        self.values = np.array([[(h * f).min() for h in own] for f in self.factors], np.uint64)
        self.hints = np.zeros((self.bands, 1 << 16), bool)
        for k in range(self.bands):
            self.hints[k, (self.values[k] >> np.uint64(48)).astype(np.int64)] = True

    @staticmethod
    def _hashes(text: str) -> np.ndarray:
        return textkit.shingle_hashes(textkit.hash_words(textkit.scan(pa.array([text]), "alnum")), WORDS)

    def candidates(self, h: np.ndarray, start: np.ndarray, nxt: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(block number, template number) of windows that share a band. ``start``: first shingle of each block;
        ``nxt``: for each block the one or two blocks after it in the same document, or itself."""
        for k, f in enumerate(self.factors):
            low = np.minimum.reduceat(h * f, start)
            low = np.minimum(np.minimum(low, low[nxt[0]]), low[nxt[1]])
            for b in np.flatnonzero(self.hints[k][(low >> np.uint64(48)).astype(np.int64)]):
                for t in np.flatnonzero(self.values[k] == low[b]):
                    yield int(b), int(t)


def groups(templates: dict[str, str], contained: float = CONTAINED) -> list[Group]:
    by: dict[int, dict[str, str]] = defaultdict(dict)
    for name, text in templates.items():
        n = len(words_of(text)) - WORDS + 1
        if n < 1:
            raise ValueError(f"template {name} has fewer than {WORDS} words")
        by[1 << max(0, math.ceil(math.log2(max(n * 1.25 - 1, 1) / 2)))][name] = text
    return [Group(b, t, contained) for b, t in sorted(by.items())]


def scan_texts(column: pa.ChunkedArray, plan: list[Group], contained: float) -> list[tuple[int, str, float, int, int]]:
    """(text number, template, containment, first word, end word) of each occurrence."""
    w = textkit.scan(column, "alnum")
    word_hash = textkit.hash_words(w)
    h = textkit.shingle_hashes(word_hash, WORDS)
    first, counts = w.first[:-1], np.maximum(w.counts - WORDS + 1, 0)
    out = []
    some = np.flatnonzero(counts)
    # Shingles that run over the end of a text belong to no block.
    keep = np.repeat(first[some] - (np.cumsum(counts[some]) - counts[some]), counts[some]) + np.arange(int(counts.sum()))
    h, base = h[keep], (np.cumsum(counts) - counts)
    for g in plan if len(some) else []:
        n_blocks = -(-counts[some] // g.block)
        block_doc = np.repeat(some, n_blocks)
        number = np.arange(len(block_doc)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        start = base[block_doc] + number * g.block
        last = np.repeat(np.cumsum(n_blocks) - 1, n_blocks)
        here = np.arange(len(block_doc))
        nxt = (np.minimum(here + 1, last), np.minimum(here + 2, last))
        spans = defaultdict(list)
        for b, t in set(g.candidates(h, start, nxt)):
            doc = int(block_doc[b])
            a = int(number[b]) * g.block
            e = min(a + 3 * g.block, int(counts[doc]))
            at = int(first[doc])
            own = shingles([w.word(i).decode() for i in range(at + a, at + e + WORDS - 1)])
            found = [i for i, s in enumerate(own) if s in g.sets[t]]
            share = len({own[i] for i in found}) / len(g.sets[t])
            if share >= contained:
                spans[doc, t].append((a + found[0], a + found[-1] + WORDS, share))
        for (doc, t), rows in spans.items():
            rows.sort()
            merged = [rows[0]]
            for a, e, s in rows[1:]:
                if a < merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(e, merged[-1][1]), max(s, merged[-1][2]))
                else:
                    merged.append((a, e, s))
            out += [(doc, g.names[t], s, a, e) for a, e, s in merged]
    return sorted(out)


def scan(df: DataFrame, text: str = "text", templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """A row per occurrence of a license: the columns of ``df`` but the text, with ``license``, ``containment`` and the
    words ``start_word`` to ``end_word`` (not included) that the matching shingles span."""
    named = list((TEMPLATES if templates is None else templates).items())
    if len(named) > MOST_TEMPLATES:
        return reduce(DataFrame.unionAll, [scan(df, text, dict(named[k : k + MOST_TEMPLATES]), contained) for k in range(0, len(named), MOST_TEMPLATES)])
    plan = groups(dict(named), contained)
    added = [StructField("license", StringType()), StructField("containment", DoubleType()), StructField("start_word", IntegerType()), StructField("end_word", IntegerType())]
    placed, (text_at,) = textkit.by_place(df, text)
    rest = [f"c{k}" for k, c in enumerate(df.columns) if f"c{k}" != text_at and c.lower() not in {f.name for f in added}]
    names = [df.columns[int(c[1:])] for c in rest] + [f.name for f in added]
    schema = StructType([*placed.select(*rest).schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in textkit.in_slices(batches, text_at, SLICE_BYTES):
            found = scan_texts(t.column(text_at), plan, contained)
            at = pa.array([f[0] for f in found], pa.int64())
            new = [pa.array([f[k + 1] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.int32(), pa.int32()))]
            yield from pa.table([*t.select(rest).take(at).columns, *new], names=[*rest, *(f.name for f in added)]).to_batches()

    return placed.select(*rest, text_at).mapInArrow(run, schema).toDF(*names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
