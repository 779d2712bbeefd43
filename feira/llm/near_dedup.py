"""Near-duplicate groups by HyperMinHash sketches.

1. One pass over the texts gives each document its number of distinct word
   shingles, a digest of the shingle set and a sketch of ``BANDS * ROWS`` 16-bit
   registers: per bucket, the number of leading zeros of the smallest hash and
   ``MANTISSA`` of the bits after them.
2. Documents of equal sets form one class, represented by the smallest id; only
   representatives go on.
3. Empty registers borrow another's value in an order that is the same for all documents,
   so that short documents collide like long ones. Bands of ``ROWS`` registers are hashed to
   keys. Documents at the similarity threshold 0.8 share no key with probability
   (1 - 0.8^4)^40 < 1e-9. Of each key with several documents every document is paired with two
   leaders: the one with the most partners over all its keys (the centre of a group of copies)
   and the smallest. That is linear in the group, however large it is. In a key of three whose
   smallest leads both ways the largest leads too, so that all three pairs are tried.
4. Pairs pass the collision-corrected similarity estimate on the true registers (cut six
   standard errors below the threshold) and are then confirmed on the full shingle sets.
5. Keys of more than three documents may still hold different components. A document outside
   its key's main component is then looked up by its rarest shingles: a partner must have
   one of the floor(0.2 n) + 1 rarest of its n shingles among its own rarest (counted among the documents of such
   keys). What an edited copy has alone has no partner and bounds its partners' sizes, so
   large groups of copies make few pairs. After this every pair that shares a key is linked, connected otherwise, or refuted.

Joins of large tables are always shuffled, so that the plan is the same at every size.

Defined cases: null and blank texts have no shingles and are linked with nothing;
a text with fewer words than a shingle is one shingle; rows with a null id are
returned with a null component and kept; repeated rows are returned as often as
they occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.llm._store import materialise
from feira.llm._text import GOLDEN, mix64, sequence64, shingle_set
from feira.llm.graph import components

BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
EMPTY = 0xFFFF
#: Documents of a key up to which the pairs with its two leaders are all pairs.
LED_WHOLE = 3

SKETCH_SCHEMA = "doc_id long, n_shingles long, digest_1 long, digest_2 long, sketch binary"


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set of 64-bit hashes: ``REGISTERS`` 16-bit registers."""
    out = np.full(REGISTERS, EMPTY, dtype=np.uint16)
    if len(hashes):
        bucket = ((hashes >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.intp)
        least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
        np.minimum.at(least, bucket, mix64(hashes ^ np.uint64(GOLDEN)) >> np.uint64(11))
        full = np.zeros(REGISTERS, dtype=bool)
        full[bucket] = True
        value = least[full]
        zeros = 53 - np.frexp(value.astype(np.float64))[1]  # of 53 bits
        after = (value << zeros.astype(np.uint64)) >> np.uint64(52 - MANTISSA)
        out[full] = zeros.astype(np.uint16) << MANTISSA | (after & np.uint64((1 << MANTISSA) - 1)).astype(np.uint16)
    return out


_orders: list[np.ndarray] = []


def densified(regs: np.ndarray) -> np.ndarray:
    """Sketches (rows) whose empty registers hold the value of the first used one in their own probing order."""
    if not _orders:
        draws = mix64(sequence64(REGISTERS * REGISTERS, start=1 << 24)).reshape(REGISTERS, REGISTERS)
        _orders.append(draws.argsort(axis=1).argsort(axis=1).astype(np.int16))
    out = regs.copy()
    for i in np.flatnonzero((regs == EMPTY).any(axis=1)):
        empty, donors = np.flatnonzero(regs[i] == EMPTY), np.flatnonzero(regs[i] != EMPTY)
        if len(donors):
            out[i, empty] = regs[i, donors[_orders[0][np.ix_(empty, donors)].argmin(axis=1)]]
    return out


def estimated_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of sketches (rows of ``a`` and ``b``) and the number of buckets it rests on.

    Two independent minima fall into one register value with probability
    c * 2^-MANTISSA * nm / (n + m)^2 with c = 1 / (2 ln 2): the mean width of the
    cell around a value is that share of the value. Those are taken off the matches.
    """
    used_a, used_b = a != EMPTY, b != EMPTY
    used = (used_a | used_b).sum(axis=1)
    same = ((a == b) & used_a).sum(axis=1)
    by_chance = ((a != b) & used_a & used_b).sum(axis=1) * (2.0**-MANTISSA / (2 * np.log(2))) * (n_a * n_b / np.maximum(n_a + n_b, 1.0) ** 2)
    return np.clip((same - by_chance) / np.maximum(used, 1), 0, 1), used


def _sketcher(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, one, two, regs = [], [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), k)
                counts.append(len(found))
                one.append(found.sum(dtype=np.uint64))
                two.append(mix64(found).sum(dtype=np.uint64))
                regs.append(registers(found).tobytes())
            columns = [batch.column(0), pa.array(counts, pa.int64()), *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (one, two)), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest_1", "digest_2", "sketch"])

    return sketch


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, key) for every band."""
    salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(GOLDEN))
    for batch in batches:
        for at in range(0, batch.num_rows, 5000):
            part = batch.slice(at, 5000)
            packed = densified(_matrix(part.column(1))).view(np.uint64).reshape(-1, BANDS)
            reps = np.repeat(part.column(0).to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(reps), pa.array(mix64(packed ^ salt).ravel().view(np.int64))], ["rep", "key"])


def _estimator(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the pairs (a, b) whose sketches and set sizes allow a link."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
            value, used = estimated_jaccard(_matrix(batch.column(4)), _matrix(batch.column(5)), n_a, n_b)
            likely = value >= threshold - 6 * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))
            likely &= np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(likely))

    return estimate


def _set_maker(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(t.as_py(), k).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "hashes"])

    return sets


def _confirmer(parts: int, of: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(small) else 0
                keep.append(bool(both) and of * both >= parts * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return confirm


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, n, hash) per shingle."""
    for batch in batches:
        for rep, packed in zip(batch.column(0), batch.column(1), strict=True):
            hashes = np.frombuffer(packed.as_py(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), x, dtype=np.int64)) for x in (rep.as_py(), len(hashes))] + [pa.array(hashes)], ["rep", "n", "hash"])


def _size_bucket(n: Column) -> Column:
    """Set sizes that differ by about a tenth share a bucket."""
    return F.floor(F.log(n.cast("double")) * 10).cast("int")


def _rare_partners(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of different components, one of them outside a main component, that hold one of their rarest shingles in common.

    Sets of sizes n and m that are linked share at least o = (n + m) * p / (1 + p) shingles. In the order of rarity the
    first shared one is among the n - ceil(p * n) + 1 rarest of the one and likewise of the other, and behind
    its ranks i and j there is room for the rest: o <= 1 + min(n - i, m - j). What an edited copy has alone takes up
    its first ranks, so that members of a large group of copies meet few of each other.
    """
    shingles = materialise(opened.join(sets.hint("merge"), opened["rep"] == sets["id"]).select("rep", "hashes").mapInArrow(_set_rows, "rep long, n long, hash long"), "shingles")
    counts = shingles.groupBy("hash").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("rep").orderBy("df", "hash")
    ranked = shingles.join(counts.hint("merge"), "hash").withColumn("rank", F.row_number().over(rarest))
    prefix = ranked.filter((F.col("rank") <= F.floor(F.col("n") * (100 - percent) / 100) + 1) & (F.col("df") > 1))
    prefix = materialise(prefix.select("rep", "n", "hash", "rank").join(opened, "rep"), "rare-shingles")
    least = F.ceil(F.col("n") * percent / 100)
    most = F.least(F.floor(F.col("n") * 100 / percent), F.floor((F.col("n") - F.col("rank") + 1) * (100 + percent) / percent) - F.col("n"))
    probes = prefix.filter("outside").select(F.col("rep").alias("x"), F.col("component").alias("c"), F.col("n").alias("n_x"), F.col("rank").alias("i"), least.alias("least"), most.alias("most"), "hash")
    probes = probes.filter("least <= most").withColumn("bucket", F.explode(F.sequence(_size_bucket(F.col("least")), _size_bucket(F.col("most")))))
    held = prefix.select("hash", _size_bucket(F.col("n")).alias("bucket"), F.col("rep").alias("y"), "component", "n", F.col("rank").alias("j"))
    shared = 1 + F.least(F.col("n_x") - F.col("i"), F.col("n") - F.col("j"))
    possible = F.col("n").between(F.col("least"), F.col("most")) & ((100 + percent) * shared >= percent * (F.col("n_x") + F.col("n")))
    return probes.join(held.hint("merge"), (probes["hash"] == held["hash"]) & (probes["bucket"] == held["bucket"]) & (F.col("c") != F.col("component")) & possible).select("x", "y")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` per document.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of
    ``k``-word shingles; a component is what links connect, named by its smallest id,
    which is the one kept.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = materialise(rows.mapInArrow(_sketcher(k), SKETCH_SCHEMA), "sketches")
    usable = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = usable.groupBy("digest_1", "digest_2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    members = materialise(
        usable.join(classes.hint("merge"), ["digest_1", "digest_2", "n_shingles"]).select("doc_id", "n_shingles", "rep", F.when(F.col("doc_id") == F.col("rep"), F.col("sketch")).alias("sketch")),
        "classes",
    )
    reps = members.filter("sketch IS NOT NULL").select("rep", "n_shingles", "sketch")
    bands = reps.select("rep", "sketch").mapInArrow(_band_rows, "rep long, key long")

    groups = bands.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo <> hi")
    shared = materialise(bands.join(groups.select("key", "n"), "key").select("rep", "key", "n"), "shared")
    weight = shared.groupBy("rep").agg(F.sum("n").alias("weight"))
    leaders = shared.join(weight, "rep").groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("top"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.max("n").alias("n"))
    lead = -F.col("top.minus")
    leaders = materialise(leaders.select("key", F.when((F.col("n") == LED_WHOLE) & (lead == F.col("lo")), F.col("hi")).otherwise(lead).alias("lead"), "lo"), "leaders")

    def estimated(pairs: DataFrame) -> DataFrame:
        side = lambda x: reps.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")).hint("merge")
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
        return materialise(both.mapInArrow(_estimator(percent / 100), "a long, b long"), "likely")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = rows.join(ids.hint("merge"), rows["doc_id"] == ids["id"], "left_semi").dropDuplicates(["doc_id"])
        return materialise(wanted.mapInArrow(_set_maker(k), "id long, hashes binary"), "sets")

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        side = lambda x: sets.select(F.col("id").alias(x), F.col("hashes").alias(f"h_{x}")).hint("merge")
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "h_a", "h_b")
        return materialise(both.mapInArrow(_confirmer(percent, 100), "a long, b long"), "confirmed")

    with_leaders = shared.join(leaders, "key").select(F.col("rep").alias("x"), F.explode(F.array("lead", "lo")).alias("y"))
    likely = estimated(_ordered(with_leaders))
    links = confirmed(likely, sets_of(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    labels = materialise(components(links), "labels")

    # Documents of larger keys that still hold several components.
    placed = shared.filter(F.col("n") > LED_WHOLE).join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    per_key = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = per_key.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("several")).filter("several > 1")
    open_rows = placed.join(main.select("key", F.col("main.component").alias("main")), "key")
    opened = materialise(open_rows.groupBy("rep", "component").agg(F.max(F.col("component") != F.col("main")).alias("outside")), "open")
    if not opened.isEmpty():
        sets = sets_of(opened.select(F.col("rep").alias("id")))
        tried = estimated(_ordered(_rare_partners(opened, sets, percent)).join(likely, ["a", "b"], "left_anti"))
        links = links.unionByName(confirmed(tried, sets))
        labels = materialise(components(links), "labels")

    named = members.select("doc_id", "n_shingles", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
    named = named.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = sketched.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
