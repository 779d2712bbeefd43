"""The prefix trie of all conversations, by preorder intervals.

A node is a distinct sequence of first turns. Its subtree is an interval of the preorder, so what a subtree
holds is the difference of two prefix sums:

1. Conversations are ranked in the lexicographic order of their turns' digests. A conversation is cut into
   blocks of ``BLOCK`` turns, distinct blocks are ranked, and pairs of neighbouring ranks are ranked again until
   one rank is left per conversation: each round halves the blocks, so no row ever holds a whole conversation.
2. The rows of a node (a rolling prefix hash with the depth) are counted, with the smallest and the greatest rank
   of its members, ``lo`` and ``hi``. Preorder is the order by ``lo``, then depth: nodes of one depth have
   disjoint ranks, those that share ``lo`` are a chain.
3. Positions in preorder and running sums of leaves and savings are taken in ranges: within each, plus the totals
   of the ranges before. A node's subtree ends at the last node whose ``lo`` is the node's ``hi``.

Ranks and positions come from range partitions of distinct keys, so equal conversations, however many, are one
row there. Counts of nodes and children are pre-aggregated in the map tasks. The ids that end in a node are joined
in chunks of ``CHUNK_IDS`` ids first and then hashed as a stream: the task that has a node with very many reads
one row per chunk and holds one at a time.

Defined cases: rows with a null conversation id are left out; a null turn comes first, turns of one number are
ordered by role, then text; null roles and texts are empty; repeated rows are turns of their own; an empty table
has no node, not even a root; other columns are ignored. Turns are compared by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.llm._store import materialise, shuffle_partitions
from feira.llm.chat import _placed

BLOCK = 64
CHUNK_IDS = 4096
MOST_SHARED = 5
SUMS = ("a_low", "a_high", "b_low", "b_high")
NOTHING = hashlib.sha256().hexdigest()
NODE = ["depth", "k1", "k2"]


def digested_turns(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (from 1), the digest ``one``, ``two`` of role and text, and ``n_chars`` of the text."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return _placed(rows).select(
        "conv_id",
        F.col("place").cast("long").alias("place"),
        F.xxhash64(F.lit(1), "role", "text").alias("one"),
        F.xxhash64("text", "role", F.lit(2)).alias("two"),
        F.length("text").cast("long").alias("n_chars"),
    )


def with_shared_beginnings(turns: DataFrame, width: int = 100) -> DataFrame:
    """Conversations rebuilt as logged from a common beginning: ``digested_turns`` with new places, and turnless ones with a null place.

    The first h turns of conversation c are those of c - c % ``width`` (all if it has fewer, none if it is absent);
    c's own turns after its first h follow. h is the crc32 of the decimal c, modulo 6.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("long")
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    convs = lengths.select("conv_id", "n_own", (F.col("conv_id") - F.col("conv_id") % width).alias("base"), h.alias("h"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    known = convs.join(bases, "base", "left").withColumn("b", F.least("h", F.coalesce("n_base", F.lit(0))))
    known = known.withColumn("n_turns", F.col("b") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0)))
    columns = ("conv_id", "n_turns", "place", "one", "two", "n_chars")
    own = turns.join(known, "conv_id").filter("place > h").withColumn("place", F.col("place") - F.col("h") + F.col("b")).select(*columns)
    first = turns.filter(F.col("place") <= MOST_SHARED).withColumnRenamed("conv_id", "base")
    lent = known.filter("b > 0").join(first, "base").filter("place <= b").select(*columns)
    none = [F.lit(None).cast("long").alias(c) for c in ("place", "one", "two", "n_chars")]
    return own.unionByName(lent).unionByName(known.filter("n_turns = 0").select("conv_id", "n_turns", *none))


def _running(rows: DataFrame, keys: list[str], sums: dict[str, Column], label: str) -> DataFrame:
    """``rows``, whose ``keys`` are distinct, with inclusive sums of all rows up to each one in the order of the keys."""
    parts = shuffle_partitions(rows.sparkSession)
    ranged = materialise(rows.withColumns({f"_{c}": x for c, x in sums.items()}).repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), label)
    inner = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*(F.sum(f"_{c}").alias(f"_{c}") for c in sums))  # a row per partition
    starts = totals.select("_part", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_start") for c in sums))
    met = ranged.withColumns({f"_{c}": F.sum(f"_{c}").over(inner) for c in sums}).join(F.broadcast(starts), "_part")
    return met.withColumns({c: F.col(f"_{c}") + F.col(f"_{c}_start") for c in sums}).drop("_part", *(f"_{c}" for c in sums), *(f"_{c}_start" for c in sums))


def _ranks(rows: DataFrame) -> DataFrame:
    """``conv_id`` and ``rank`` (from 1, the same for equal conversations) in lexicographic order; without turnless ones."""
    turns = rows.filter("place IS NOT NULL").withColumn("block", F.floor((F.col("place") - 1) / BLOCK))
    path = F.array_sort(F.collect_list(F.struct("place", "one", "two")))
    blocks = turns.groupBy("conv_id", "block").agg(path.alias("path")).withColumns({"p1": F.xxhash64(F.lit(1), "path"), "p2": F.xxhash64("path", F.lit(2))})
    blocks = materialise(blocks, "trie-blocks")
    distinct = blocks.groupBy("p1", "p2").agg(F.any_value("path").alias("path"))
    ranked = _running(distinct, ["path"], {"rank": F.lit(1).cast("long")}, "trie-paths").select("p1", "p2", "rank")
    now = materialise(blocks.select("conv_id", "block", "p1", "p2").join(ranked, ["p1", "p2"]).select("conv_id", "block", "rank"), "trie-ranks")
    while (now.agg(F.max("block")).first()[0] or 0) > 0:
        side = lambda odd: F.coalesce(F.max(F.when(F.col("block") % 2 == odd, F.col("rank"))), F.lit(0))
        pairs = now.groupBy("conv_id", F.floor(F.col("block") / 2).alias("block")).agg(side(0).alias("left"), side(1).alias("right"))
        pairs = materialise(pairs, "trie-pairs")
        ranked = _running(pairs.select("left", "right").distinct(), ["left", "right"], {"rank": F.lit(1).cast("long")}, "trie-paths")
        now = materialise(pairs.join(ranked, ["left", "right"]).select("conv_id", "block", "rank"), "trie-ranks")
    return now.select("conv_id", "rank")


def _key(depth: Column, sums: list[Column]) -> list[Column]:
    return [F.xxhash64(depth, *sums).alias("k1"), F.xxhash64(*reversed(sums), depth).alias("k2")]


def _prefixes(rows: DataFrame) -> DataFrame:
    """Per turn the keys of the node that it leads to and of the node before."""
    mixed = rows.filter("place IS NOT NULL").withColumns({"block": F.floor(F.col("place") / BLOCK), "a": F.xxhash64("one", "place"), "b": F.xxhash64("place", "two")})
    halves = mixed.withColumns({f"{c}_{part}": F.shiftright(c, 32) if part == "high" else F.col(c).bitwiseAND(0xFFFFFFFF) for c in ("a", "b") for part in ("low", "high")})
    inner = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = halves.groupBy("conv_id", "block").agg(*(F.sum(c).alias(c) for c in SUMS))
    starts = totals.select("conv_id", "block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_start") for c in SUMS))
    run = halves.withColumns({f"{c}_run": F.sum(c).over(inner) for c in SUMS}).join(starts, ["conv_id", "block"])
    now = [F.col(f"{c}_run") + F.col(f"{c}_start") for c in SUMS]
    earlier = [x - F.col(c) for c, x in zip(SUMS, now, strict=True)]
    parent = [x.alias(f"p{x_name}") for x, x_name in zip(_key(F.col("place") - 1, earlier), ("k1", "k2"), strict=True)]
    return run.select("conv_id", "n_turns", F.col("place").alias("depth"), "n_chars", *_key(F.col("place"), now), *parent)


def _hashed_ends(ends: DataFrame) -> DataFrame:
    """``rank`` and the digest of its conversations' ids, from ``rank`` and ``conv_id``."""
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    chunks = ends.groupBy("rank", F.floor(F.col("conv_id") / CHUNK_IDS).alias("chunk")).agg(F.array_join(ids, ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, digest, out = None, None, []
        made = lambda: pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], ["rank", "ends_sha256"])
        for batch in batches:
            for r, text in zip(batch.column("rank").to_pylist(), batch.column("ids"), strict=True):
                if r != rank:
                    if digest is not None:
                        out.append((rank, digest.hexdigest()))
                    rank, digest = r, hashlib.sha256(text.as_py().encode())
                else:
                    digest.update(b"," + text.as_py().encode())
            if out:
                yield made()
                out = []
        if digest is not None:
            out.append((rank, digest.hexdigest()))
            yield made()

    parts = shuffle_partitions(ends.sparkSession)
    return chunks.repartition(parts, "rank").sortWithinPartitions("rank", "chunk").mapInArrow(hashed, "rank long, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the conversations in ``rows`` (see ``with_shared_beginnings``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``,
    ``position`` and ``subtree_end``: a node's subtree holds the nodes at these positions of the preorder, both included.
    """
    rows = materialise(rows, "trie-turns")
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, position long, subtree_end long")
    ranks = materialise(_ranks(rows).unionByName(rows.filter("place IS NULL").select("conv_id", F.lit(0).cast("long").alias("rank"))), "trie-ranks")
    met = _prefixes(rows).join(ranks, "conv_id")
    counted = [F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("rank").alias("lo"), F.max("rank").alias("hi")]
    inner = met.groupBy(*NODE).agg(*counted, F.max("n_chars").alias("n_chars"), F.max("pk1").alias("pk1"), F.max("pk2").alias("pk2"), F.max((F.col("depth") == F.col("n_turns")).cast("int")).alias("is_end"))
    zero = F.lit(0).cast("long")
    root = ranks.agg(*counted).select(zero.alias("depth"), *_key(zero, [zero] * 4), "n_convs", "conv_id", zero.alias("lo"), "hi", zero.alias("n_chars"), *(F.lit(None).cast("long").alias(c) for c in ("pk1", "pk2")), F.lit(1).alias("is_end"))
    nodes = materialise(inner.unionByName(root), "trie-nodes")
    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pk1").alias("k1"), F.col("pk2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("pk1"), F.col("k2").alias("pk2"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    deeper = linked.filter("depth > 0").join(parents, ["depth", "pk1", "pk2"])
    linked = deeper.unionByName(linked.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("n_chars")
    placed = materialise(_running(linked, ["lo", "depth"], {"position": F.lit(1).cast("long"), "leaves": leaf, "saved": saved}, "trie-order"), "trie-placed")
    last = placed.groupBy(F.col("lo").alias("hi")).agg(F.max("position").alias("subtree_end"), F.max("leaves").alias("end_leaves"), F.max("saved").alias("end_saved"))
    summed = placed.join(last, "hi").withColumns({"n_leaves": F.col("end_leaves") - F.col("leaves") + leaf, "saved_tokens": F.col("end_saved") - F.col("saved") + saved})
    ending = summed.filter("is_end = 1").join(_hashed_ends(ranks), F.col("lo") == F.col("rank"), "left")
    whole = ending.drop("rank").unionByName(summed.filter("is_end = 0").withColumn("ends_sha256", F.lit(None).cast("string")))
    return whole.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"), "position", "subtree_end")
