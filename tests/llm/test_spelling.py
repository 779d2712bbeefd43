"""Spelling variants against all pairs, and their defined cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from feira.llm import spelling

DOCS = "doc_id long, text string"


def is_near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_counts(rows) -> Counter:
    counts: Counter = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return Counter({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})


def plain(counts) -> set[tuple]:
    near = {w: [v for v in counts if is_near(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def groups(spark, rows, **more):
    docs = spark.createDataFrame(rows, DOCS)
    for c, v in more.items():
        docs = docs.withColumn(c, F.lit(v))
    return [tuple(r) for r in spelling.variant_groups(docs).collect()]


def dense_rows(seed: int) -> list[tuple]:
    draw = random.Random(seed)
    words = ["".join(draw.choice("abÀz") for _ in range(draw.randrange(5, 9))) for _ in range(300)]
    words += ["prefix" + "".join(draw.choice("xyé") for _ in range(5)) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa", "a" * 300, "a" * 301, "a" * 150 + "b" + "a" * 150]
    return [(d, " ".join(w.upper() if d % 2 and w.isascii() else w for w in words for _ in range(draw.randrange(1, 9)))) for d in range(3)]


@pytest.mark.parametrize(("bucket", "shard"), [(20_000, 150_000), (7, 500)])
def test_equals_all_pairs(spark, monkeypatch, bucket, shard):
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    monkeypatch.setattr(spelling, "SHARD", shard)
    rows = dense_rows(3)
    found = groups(spark, rows)
    assert set(found) == plain(plain_counts(rows)) and len(found) == len(set(found))
    assert sum(n_near for *_, n_near, _ in found) > 500


def test_documents_equal_all_pairs_of_their_commonest_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = plain_counts([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert {(r["word"], r["n"]) for r in spelling.word_counts(docs).collect()} == set(counts.items())
    some = Counter(dict(counts.most_common(1500)))
    words = spark.createDataFrame(list(some.items()), "word string, n long")
    near = {r["word"]: (r["n_near"], r["near"]) for r in spelling.near_words(words).collect()}
    for w in some:
        vs = [v for v in some if is_near(w, v)]
        assert near.get(w) == ((len(vs), min(vs, key=lambda v: (-some[v], v))) if vs else None)


def test_nulls_repeats_clashes_and_empty_table(spark):
    rows = [(None, "colour colour colour"), (1, None), (2, ""), (3, "color " * 9), (3, "color " * 9), (4, "Ünder ünder under under under x")]
    assert set(groups(spark, rows, word="clash", n=5, key="clash")) == plain(plain_counts(rows))
    assert groups(spark, [(1, None)]) == []
    assert spelling.variant_groups(spark.createDataFrame([], DOCS)).count() == 0


def test_texts_are_cut_between_runs(monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 4)
    pieces = list(spelling._pieces("abcdefgh IJ klmnoéÀpq×rs"))
    assert "".join(pieces) == "abcdefgh ij klmnoéÀpq×rs" and pieces[0] == "abcdefgh"


def test_wavelet_tree_reports_rectangles():
    values = np.random.default_rng(1).permutation(300)
    tree = spelling.WaveletTree(values)
    start, end, low, high = np.array([0, 10, 299, 5, 7]), np.array([300, 200, 300, 5, 90]), np.array([0, 50, 0, 0, 90]), np.array([300, 80, 300, 300, 91])
    which, found = tree.report(start, end, low, high)
    for q in range(5):
        inside = values[start[q] : end[q]]
        assert sorted(found[which == q]) == sorted(inside[(inside >= low[q]) & (inside < high[q])])
