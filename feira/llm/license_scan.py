"""Licences in texts: fixed phrases, and an exact set-similarity join with licence notices.

A text is cut into blocks of words for every size class of the templates: with ``s`` the power of two that
holds the longest template of the class, blocks of ``2 s`` words start at every ``s`` words, so each stretch of
up to ``s + 1`` words lies within one. A template is found in a block that holds ``percent`` of its distinct
words. The join that finds all such pairs works on sets of words in one global order:

1. The words of the templates are counted over all documents and ordered from the rarest up. Words of no
   template can't add to an overlap, so blocks are kept as the ranks of the words they share with templates.
2. A template of ``t`` words that must share ``o`` of them meets a block by a word of its prefix, the rarest
   ``t - o + 1``; the block shows its own prefix in return. Blocks without a word of a prefix never leave the scan.
3. Prefix words are joined; a block of fewer than ``o`` words is dropped (length filter), and so is a pair of
   which too few words follow the shared one in either set (positional filter).
4. What is left is verified on the whole sets.

Texts are not shuffled: a document sends one row and its candidate blocks. Counts come to the driver for the
words of the templates only, a few hundred whatever the corpus. The templates are a parameter.

Defined cases: a null text counts as empty; rows that are equal give a row each, rows of one id with other
texts too; a null id is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm._text import CHUNK, GOLDEN, _power_tables, mix64

# Phrases that name a licence, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices by which works state their licence, and the labels they stand for.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

PERCENT = 80
LEAST_SPAN = 8

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_OUTSIDE = bytes(b for b in range(256) if not _INSIDE[b])

SCAN_SCHEMA = "doc_id long, key long, n_words long, n_base long, first_word long, last_word long, base array<string>, span int, words array<int>"
REPORT_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


@dataclass(frozen=True)
class Template:
    """A notice as a set: ``need`` of its distinct ``words`` must be in a block of ``2 span`` words."""

    label: str
    words: tuple[str, ...]
    span: int
    need: int


def words_of(text: str) -> list[str]:
    """The words of a short text."""
    raw = text.encode("utf-8", "surrogatepass")
    spaced = bytes(_LOWER[b] if _INSIDE[b] else 0x20 for b in raw)
    return spaced.decode("utf-8", "surrogatepass").split()


def templates_of(notices=TEMPLATES, percent: int = PERCENT) -> list[Template]:
    made = []
    for label, text in notices:
        words = words_of(text)
        distinct = tuple(sorted(set(words)))
        span = max(LEAST_SPAN, 1 << (len(words) - 1).bit_length())
        made.append(Template(label, distinct, span, -(-percent * len(distinct) // 100)))
    return made


def _hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    edges = np.flatnonzero(np.diff(_INSIDE[raw].view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(GOLDEN))


class Vocabulary:
    """Places of known words in a text, whatever its length."""

    def __init__(self, words: list[str]) -> None:
        hashes = np.array([_hashes(w.encode())[0] for w in words], dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]

    def _known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.sorted, hashes)
        at[at == len(self.sorted)] = 0
        places = np.flatnonzero(self.sorted[at] == hashes)
        return places, self.order[at[places]]

    def places(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        """Word count, and the places and numbers of the known words."""
        data = text.encode("utf-8", "surrogatepass")
        n, found, at = 0, [], 0
        while at < len(data):
            end = min(at + CHUNK, len(data))
            while end < len(data) and _INSIDE[data[end]]:
                end += 1
            hashes = _hashes(data[at:end])
            places, numbers = self._known(hashes)
            found.append((places + n, numbers))
            n, at = n + len(hashes), end
        if not found:
            return 0, np.empty(0, np.intp), np.empty(0, np.intp)
        return n, np.concatenate([p for p, _ in found]), np.concatenate([k for _, k in found])


def _phrase_places(places: np.ndarray, numbers: np.ndarray, phrase: list[int]) -> np.ndarray:
    """Starts of the places where the phrase's words stand consecutively."""
    starts = places[numbers == phrase[0]]
    for i, number in enumerate(phrase[1:], 1):
        starts = starts[np.isin(starts + i, places[numbers == number], assume_unique=True)]
    return starts


def _blocks(places: np.ndarray, numbers: np.ndarray, span: int, prefix: np.ndarray, least: int) -> Iterator[np.ndarray]:
    """Known words, in order of rank, of the blocks that hold a word of a prefix and ``least`` known words."""
    own = np.unique(places[np.isin(numbers, prefix)] // span)
    for k in np.union1d(own, own[own > 0] - 1):
        lo, hi = np.searchsorted(places, (k * span, (k + 2) * span))
        words = np.unique(numbers[lo:hi])
        if len(words) >= least:
            yield words


def word_counts(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How often each of ``words`` stands in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Vocabulary(words), np.zeros(len(words), dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(known.places(text.as_py() or "")[2], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(total)], ["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counted.collect()}  # one row per word of the templates
    return {w: found.get(w, 0) for w in words}


def scan_licenses(docs: DataFrame, notices=TEMPLATES, percent: int = PERCENT) -> DataFrame:
    """Licences named or stated in every text, see ``REPORT_SCHEMA``.

    ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` tell of the phrases alone. ``labels`` has those of
    templates too. ``score`` is 1 where a phrase stands, else the greatest containment of a template that is found.
    """
    spark = docs.sparkSession
    templates = templates_of(notices, percent)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    phrases = [(words_of(p), label) for p, label in PHRASES.items()]
    needed = sorted({w for t in templates for w in t.words} | {w for p, _ in phrases for w in p})
    counts = word_counts(rows, needed)
    ranked = sorted(needed, key=lambda w: (counts[w], w))
    rank = {w: i for i, w in enumerate(ranked)}
    sets = [(t, sorted(rank[w] for w in t.words)) for t in templates]
    spans = {}
    for t, ranks in sets:
        prefix, least = spans.get(t.span, ([], t.need))
        spans[t.span] = (prefix + ranks[: len(ranks) - t.need + 1], min(least, t.need))
    in_template = np.zeros(len(ranked), dtype=bool)
    in_template[[r for _, ranks in sets for r in ranks]] = True
    numbered = [([rank[w] for w in p], label) for p, label in phrases]
    types = [pa.int64()] * 6 + [pa.list_(pa.string()), pa.int32(), pa.list_(pa.int32())]
    names = [c.split()[0] for c in SCAN_SCHEMA.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, out = Vocabulary(ranked), []

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for doc_id, text, key in zip(*(batch.column(i) for i in range(3)), strict=True):
                doc_id, key = doc_id.as_py(), key.as_py()
                n, places, numbers = known.places(text.as_py() or "")
                met = [(_phrase_places(places, numbers, p), label) for p, label in numbered]
                starts = np.concatenate([s for s, _ in met])
                edges = (int(starts.min()), int(starts.max())) if len(starts) else (None, None)
                out.append((doc_id, key, n, len(starts), *edges, sorted({label for s, label in met if len(s)}), None, None))
                of_template = in_template[numbers]
                for span, (prefix, least) in spans.items():
                    for words in _blocks(places[of_template], numbers[of_template], span, np.array(prefix), least):
                        out.append((doc_id, key, None, None, None, None, None, span, words))
                        if len(out) >= 5000:
                            yield flush()
            if out:
                yield flush()

    scanned = rows.withColumn("key", F.xxhash64("text")).mapInArrow(scan, SCAN_SCHEMA)
    met = _join(scanned, spark, sets, {s: least for s, (_, least) in spans.items()})
    merged = met.groupBy("doc_id", "key").agg(
        *(F.max(c).alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "base")),
        F.collect_set("label").alias("found"),
        F.max("containment").alias("containment"),
        F.count("n_words").alias("copies"),
    )
    single = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return single.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "found")), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def _join(scanned: DataFrame, spark, sets: list[tuple[Template, list[int]]], least: dict[int, int]) -> DataFrame:
    """The scan's rows with ``label`` and ``containment`` where a block matches a template; rows of documents pass."""
    prefixes = [
        (t.span, word, place, len(ranks), t.need, ranks, t.label) for t, ranks in sets for place, word in enumerate(ranks[: len(ranks) - t.need + 1])
    ]
    side = spark.createDataFrame(prefixes, "t_span int, t_word int, t_place int, t_size int, need int, t_words array<int>, label string")
    size = F.size("words")
    shown = F.lit(0)
    for span, few in least.items():
        shown = F.when(F.col("span") == span, F.greatest(size - few + 1, F.lit(0))).otherwise(shown)
    blocks = scanned.select("*", F.posexplode_outer(F.when(F.col("span").isNotNull(), F.slice("words", 1, shown))).alias("place", "word"))
    after = F.least(F.col("t_size") - F.col("t_place"), F.size("words") - F.col("place"))
    pair = (F.col("span") == F.col("t_span")) & (F.col("word") == F.col("t_word")) & (F.size("words") >= F.col("need")) & (after >= F.col("need"))
    overlap = F.size(F.array_intersect("words", "t_words"))
    joined = blocks.join(side, pair, "left").filter(F.col("span").isNull() | F.col("label").isNotNull())
    verified = joined.withColumn("overlap", F.when(F.col("label").isNotNull(), overlap)).filter(F.col("overlap").isNull() | (F.col("overlap") >= F.col("need")))
    return verified.withColumn("containment", F.col("overlap") / F.col("t_size"))
