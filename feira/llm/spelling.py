"""Spelling variants: words that differ by one code point, grouped under their most frequent form.

A word ``v`` of ``L`` letters is near ``w`` if, for some place ``i``, it is a letter between the first ``i`` letters of
``w`` and its last ``L - 1 - i``. So for each place the words near ``w`` are a rectangle: the interval of its prefix in the
forward order of all words of ``L`` letters, by the interval of its suffix in the order of reversed words. A
wavelet tree over the reverse ranks, in forward order, reports the words of each rectangle (replaced letters for ``w``
of ``L`` letters, inserted ones for ``w`` of ``L - 1``; a deleted one is an inserted one seen from the other word).

The index is dealt out so that a rectangle lies within one tree. A bucket holds the words of ``L`` letters that agree
outside the places ``[a, b)``; a word is in the buckets of its first and its second half of places, and is looked up
there for these places only. A bucket of more than ``BUCKET`` rows is split in two by halving ``[a, b)`` until it is small:
with one place left, its words differ in one letter, of which there are 90. Buckets are dealt by hash to shards of
about ``SHARD`` rows; a shard is one group and has one tree per ``(L, a, b)``. Every pair of near words is reported
exactly once: an inserted letter counts where it is the first of equal ones.

Of the pairs a shard returns, per word, their number and the best; pairs are not shuffled. Counts of words are added up
in the scanning tasks before the shuffle. Forms are followed by doubling the steps, as a form's count is at least
twice the word's.

Defined cases: null and empty texts have no words; a null id counts as an empty one in the hash that picks a letter to
delete; repeated rows count again; runs of any length take part, texts are cut between runs; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm._store import materialise

LEAST_LETTERS = 5
LEAST_COUNT = 3
EVERY = 97
PIECE = 1 << 20
HELD_WORDS = 200_000
BUCKET = 20_000
SHARD = 150_000
AT_ONCE = 1 << 16

_LETTER = "a-zÀ-ÿ"
_RUN = re.compile(f"[{_LETTER}]{{{LEAST_LETTERS},}}")
_GAP = re.compile(f"[^{_LETTER}]")

FOUND_SCHEMA = "word string, n_near long, below long, near string"


def _pieces(text: str) -> Iterator[str]:
    """The text, ASCII letters lower-cased, in pieces that end between runs."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            lowered = re.compile(_GAP.pattern.replace("a-z", "A-Za-z")).search(text, end)
            end = lowered.start() if lowered else len(text)
        yield text[at:end].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return made

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for piece in _pieces(text.as_py() or ""):
                for run, n in Counter(_RUN.findall(piece)).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % EVERY == 0:
                        cut = h % len(run)
                        run = run[:cut] + run[cut + 1 :]
                        if len(run) < LEAST_LETTERS:
                            continue
                    held[run] += n
                if len(held) > HELD_WORDS:
                    yield flush()
    if held:
        yield flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` of the words that count."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


class WaveletTree:
    """Reports which values of a stretch of a permutation are in a range (kept as a matrix of levels)."""

    def __init__(self, values: np.ndarray) -> None:
        self.levels, self.zeros = [], []
        self.depth = max(1, int(len(values) - 1).bit_length())
        for shift in range(self.depth - 1, -1, -1):
            bit = (values >> shift) & 1 == 1
            self.levels.append(np.concatenate([[0], np.cumsum(~bit)]))
            self.zeros.append(int(self.levels[-1][-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def report(self, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (rectangle, value) of all values in ``[low, high)`` at places ``[start, end)``."""
        which, base = np.arange(len(start)), np.zeros(len(start), dtype=np.int64)
        for level, (zero, n_zero) in enumerate(zip(self.levels, self.zeros, strict=True)):
            half = 1 << (self.depth - 1 - level)
            z_start, z_end = zero[start], zero[end]
            left = (z_start < z_end) & (low[which] < base + half) & (high[which] > base)
            right = (end - z_end > start - z_start) & (low[which] < base + 2 * half) & (high[which] > base + half)
            which, base, start, end = (
                np.concatenate([which[left], which[right]]),
                np.concatenate([base[left], base[right] + half]),
                np.concatenate([z_start[left], n_zero + (start - z_start)[right]]),
                np.concatenate([z_end[left], n_zero + (end - z_end)[right]]),
            )
        return which, base


class _Order:
    """Rows in the order of their letters, with the ranks that a prefix of any length spans among the target rows."""

    def __init__(self, letters: np.ndarray, target: np.ndarray) -> None:
        width = letters.shape[1]
        self.order = np.argsort(np.ascontiguousarray(letters).view(f"S{width}").ravel(), kind="stable")
        self.rank = np.empty(len(self.order), dtype=np.int64)
        self.rank[self.order] = np.arange(len(self.order))
        differs = letters[self.order[1:]] != letters[self.order[:-1]]
        self.common = np.where(differs.any(axis=1), differs.argmax(axis=1), width)
        self.targets_before = np.concatenate([[0], np.cumsum(target[self.order])])

    def spans(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row: first and last target rank with its first ``length`` letters, and how many rows have them."""
        edges = np.concatenate([[0], np.flatnonzero(self.common < length) + 1, [len(self.order)]])
        group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[self.rank]
        first, last = edges[group], edges[group + 1]
        return self.targets_before[first], self.targets_before[last], last - first


def _near_in_class(words: list[bytes], n: np.ndarray, target: np.ndarray, size: int, places: range) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per row of one ``(L, a, b)``: number of near words, and count and row of the best."""
    rows = len(words)
    letters = np.frombuffer(b"".join(w.ljust(size, b"\0") for w in words), dtype=np.uint8).reshape(rows, size)
    backward = np.frombuffer(b"".join(w[::-1].ljust(size, b"\0") for w in words), dtype=np.uint8).reshape(rows, size)
    ahead, behind = _Order(letters, target), _Order(backward, target)
    forward_targets, reverse_targets = (o.order[target[o.order]] for o in (ahead, behind))
    reverse_rank = np.empty(rows, dtype=np.int64)
    reverse_rank[reverse_targets] = np.arange(len(reverse_targets))
    tree = WaveletTree(reverse_rank[forward_targets])
    number, best_n, best = np.zeros(rows, dtype=np.int64), np.full(rows, -1, dtype=np.int64), np.full(rows, -1, dtype=np.int64)

    def note(own: np.ndarray, other: np.ndarray) -> None:
        number[:] += np.bincount(own, minlength=rows)
        order = np.lexsort((ahead.rank[other], -n[other], own))
        own, other = own[order], other[order]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        own, other = own[first], other[first]
        better = (n[other] > best_n[own]) | ((n[other] == best_n[own]) & (ahead.rank[other] < ahead.rank[best[own]]))
        best_n[own[better]], best[own[better]] = n[other[better]], other[better]

    for i in places:
        start, end, ahead_rows = ahead.spans(i)
        low, high, behind_rows = behind.spans(size - 1 - i)
        asked = np.flatnonzero((end - start > target) & (high - low > target) & (ahead_rows > 1) & (behind_rows > 1))
        for k in range(0, len(asked), AT_ONCE):
            some = asked[k : k + AT_ONCE]
            which, value = tree.report(start[some], end[some], low[some], high[some])
            own, other = some[which], reverse_targets[value]
            swapped = target[own] & (own != other)
            note(own[swapped], other[swapped])
            first = letters[other, i] != letters[other, i - 1] if i else np.ones(len(other), dtype=bool)
            longer = ~target[own] & first
            note(np.concatenate([own[longer], other[longer]]), np.concatenate([other[longer], own[longer]]))
    return number, best_n, best


def _near_in_shard(rows: pd.DataFrame) -> pd.DataFrame:
    found = []
    for (size, a, b), part in rows.groupby(["size", "a", "b"], sort=False):
        target = part["target"].to_numpy(dtype=bool)
        if len(part) < 2 or not target.any():
            continue
        words = part["word"].to_numpy()
        number, best_n, best = _near_in_class([w.encode("latin-1") for w in words], part["n"].to_numpy(), target, int(size), range(a, b))
        has = np.flatnonzero(number)
        found.append(pd.DataFrame({"word": words[has], "n_near": number[has], "below": -best_n[has], "near": words[best[has]]}))
    return pd.concat(found) if found else pd.DataFrame({"word": [], "n_near": [], "below": [], "near": []})


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the hash of their bucket: the letters outside the places ``[a, b)``."""
    tail = F.col("b") + F.when(F.col("target"), 1).otherwise(0)
    return rows.withColumn("key", F.xxhash64("size", "a", "b", F.substr("word", F.lit(1), F.col("a")), F.substr("word", tail)))


def _halves(rows: DataFrame) -> DataFrame:
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    both = F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))
    return rows.select("word", "n", "size", "target", F.explode(both).alias("_p")).select("word", "n", "size", "target", "_p.a", "_p.b")


def _buckets(words: DataFrame) -> DataFrame:
    """Every word as a target and as a query for a letter more, in the buckets where it is looked up."""
    zero = F.lit(0)
    as_target = F.struct(F.length("word").alias("size"), F.lit(True).alias("target"))
    as_query = F.struct((F.length("word") + 1).alias("size"), F.lit(False).alias("target"))
    whole = words.select("word", "n", F.explode(F.array(as_target, as_query)).alias("_r")).select("word", "n", "_r.size", "_r.target", zero.alias("a"), F.col("_r.size").alias("b"))
    open_rows, done = _keyed(_halves(whole)), None
    while True:
        crowded = materialise(open_rows.filter("b - a > 1").groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > BUCKET).select("key"), "crowded")
        if crowded.isEmpty():
            return open_rows if done is None else done.unionByName(open_rows)
        small = open_rows.join(crowded, "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        open_rows = materialise(_keyed(_halves(open_rows.join(crowded, "key", "left_semi"))), "buckets")


def near_words(words: DataFrame) -> DataFrame:
    """``word``, ``n_near`` and the near word ``near`` of the largest count ``near_n`` (the smallest on ties), for words with a near one."""
    rows = _buckets(words)
    shards = max(1, -(-4 * words.count() // SHARD))
    dealt = rows.withColumn("shard", F.pmod("key", F.lit(shards))).drop("key")
    found = dealt.groupBy("shard").applyInPandas(lambda p: _near_in_shard(p), FOUND_SCHEMA)
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("below", "near")).alias("best"))
    return merged.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.below")).alias("near_n"))


def _roots(links: DataFrame) -> DataFrame:
    """``word`` and the last of its forms, from the links ``word`` to ``form``."""
    now = materialise(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while not now.filter("moved").isEmpty():
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialise(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
    return now.select("word", "root")


def variant_groups(docs: DataFrame) -> DataFrame:
    """``word``, its ``form``, the ``root`` of its forms, ``n``, ``n_near`` and ``form_n`` for every word of the texts that counts."""
    words = materialise(word_counts(docs), "words")
    met = words.join(near_words(words), "word", "left")
    fits = F.col("near_n") >= 2 * F.col("n")
    formed = met.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n"))
    formed = materialise(formed, "variants")
    rooted = formed.join(_roots(formed.filter("form IS NOT NULL").select("word", "form")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
