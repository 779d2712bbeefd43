"""Document fingerprints by one-permutation MinHash.

Every word shingle is hashed once; the top bits of the hash name one of ``BINS``
bins and each bin keeps its smallest remainder. A bin that stays empty copies the
first non-empty bin in a probing order of its own (optimal densification: the
order is random per bin but the same for all documents, so two documents agree
on a densified bin with the probability that they agree on any other). Of each
bin only the lowest ``BITS`` bits are packed. Two unequal minima share those bits
with probability 2^-BITS, which the likeness corrects for.

The edited text of a document ends in the beginning of its neighbour, so each
task must see neighbours in order. Documents are dealt by ranges of ``doc_id``
(``RANGES_PER_PARTITION`` ranges per shuffle partition, bounds from quantile
sketches), and the first document of each range is also dealt, marked as
borrowed, to the range before it. Whole texts are shuffled once.

Defined cases: a null text counts as empty; texts without words have the
all-zero fingerprint, are fully alike to each other and unlike all else; equal
ids are ordered by text; a null id sorts after every other; an empty table gives
an empty result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.llm._store import shuffle_partitions
from feira.llm._text import mix64, sequence64, shingle_hashes, word_hashes

SHINGLE_WORDS = 5
BINS = 512
BITS = 4
RANGES_PER_PARTITION = 8

NEIGHBOUR_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)

_order: list[np.ndarray] = []


def probing_order() -> np.ndarray:
    """``order[i, j]``: when an empty bin ``i`` would look at bin ``j``; each row is a permutation."""
    if not _order:
        draws = mix64(sequence64(BINS * BINS, start=1 << 20)).reshape(BINS, BINS)
        _order.append(draws.argsort(axis=1).argsort(axis=1).astype(np.int16))
    return _order[0]


def fingerprint(data: bytes, k: int = SHINGLE_WORDS) -> bytes:
    """The packed fingerprint of a UTF-8 text, ``BINS * BITS / 8`` bytes long."""
    hashes = shingle_hashes(word_hashes(data), k)
    if not len(hashes):
        return bytes(BINS * BITS // 8)
    shift = np.uint64(64 - (BINS.bit_length() - 1))
    lowest = np.full(BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    where = (hashes >> shift).astype(np.intp)
    np.minimum.at(lowest, where, hashes & np.uint64((1 << int(shift)) - 1))
    full = np.zeros(BINS, dtype=bool)
    full[where] = True
    empty, donors = np.flatnonzero(~full), np.flatnonzero(full)
    if len(empty):
        first = probing_order()[np.ix_(empty, donors)].argmin(axis=1)
        lowest[empty] = lowest[donors[first]]
    low = (mix64(lowest) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return np.packbits(((low[:, None] >> np.arange(BITS, dtype=np.uint8)) & 1).astype(np.uint8).ravel()).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity of two fingerprints' shingle sets, corrected for chance agreement."""
    blank = bytes(BINS * BITS // 8)
    if a == b:
        return 1.0
    if a == blank or b == blank:
        return 0.0
    differs = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(BINS, BITS).any(axis=1)
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, ((1 - differs.mean()) - chance) / (1 - chance))))


def fingerprint_documents(docs: DataFrame, text: str = "text", k: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with a column ``fingerprint`` (binary); no shuffle."""
    from pyspark.sql.types import BinaryType

    @F.pandas_udf(BinaryType())
    def prints(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint((t or "").encode("utf-8", "surrogatepass"), k))

    return docs.withColumn("fingerprint", prints(F.col(text)))


def _neighbour_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs each row with the one that follows it in its range."""
    held: tuple | None = None
    out: list[tuple] = []

    def emit(now: tuple, after: tuple) -> None:
        _, doc_id, text, data, print_ = now
        k = len(text) // 2
        edited = text[: len(text) - k] + after[2][:k]
        raw = edited.encode("utf-8", "surrogatepass")
        edited_print = print_ if raw == data else fingerprint(raw)
        out.append((doc_id, len(text), hashlib.sha256(raw).hexdigest(), print_.hex(), edited_print.hex(), likeness(print_, edited_print), likeness(print_, after[4])))

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in NEIGHBOUR_SCHEMA.split(", ")])

    for batch in batches:
        ranges, borrowed, ids, texts = (batch.column(i) for i in range(4))
        for i in range(batch.num_rows):
            text = texts[i].as_py() or ""
            data = text.encode("utf-8", "surrogatepass")
            row = (ranges[i].as_py(), ids[i].as_py(), text, data, fingerprint(data))
            if held is not None and held[0] == row[0]:
                emit(held, row)
            held = None if borrowed[i].as_py() else row
            if len(out) >= 1000:
                yield flush()
    if out:
        yield flush()


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, see ``NEIGHBOUR_SCHEMA``.

    The edited text has the last half of the code points replaced by as many
    first code points of the next document in descending ``doc_id`` (the first
    again after the last).
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = RANGES_PER_PARTITION * parts
    # A null id counts as the smallest, so its range is the first. Bounds: n numbers, whatever the input.
    bounds = np.unique(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) or [0.0])

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, ids.to_numpy(dtype="float64", na_value=-np.inf), side="right")
        return pd.Series(at.astype("int32"))

    ranged = rows.withColumn("range", range_of("doc_id"))
    # The largest id of each range: one number per range, whatever the input.
    heads = sorted((r["range"], r["head"]) for r in ranged.groupBy("range").agg(F.max("doc_id").alias("head")).collect())
    if not heads:
        return spark.createDataFrame([], NEIGHBOUR_SCHEMA)
    head_id = np.full(len(bounds) + 1, np.nan)
    lends_to = np.full(len(bounds) + 1, -1, dtype="int32")
    for i, (at, doc_id) in enumerate(heads):
        head_id[at] = -np.inf if doc_id is None else doc_id
        lends_to[at] = heads[(i + 1) % len(heads)][0]  # ids descend, so the range above comes before

    @F.pandas_udf("int")
    def lends(ids: pd.Series) -> pd.Series:
        values = ids.to_numpy(dtype="float64", na_value=-np.inf)
        at = np.searchsorted(bounds, values, side="right")
        return pd.Series(np.where(values == head_id[at], lends_to[at], -1).astype("int32"))

    own = F.struct(F.col("range"), F.lit(False).alias("borrowed"))
    lent = F.struct(F.col("lent").alias("range"), F.lit(True).alias("borrowed"))
    dealt = (
        ranged.withColumn("lent", lends("doc_id"))
        .select(F.explode(F.when(F.col("lent") >= 0, F.array(own, lent)).otherwise(F.array(own))).alias("to"), "doc_id", "text")
        .select("to.range", "to.borrowed", "doc_id", "text")
    )
    return (
        dealt.repartition(parts, "range")
        .sortWithinPartitions("range", "borrowed", F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())
        .mapInArrow(_neighbour_rows, NEIGHBOUR_SCHEMA)
    )
