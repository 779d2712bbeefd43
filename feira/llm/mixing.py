"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weighted share of the total size, held below
``MAX_EPOCHS`` times the source's own size; what is held back goes to the other
sources by weight until none is above its limit (water-filling, in closed form:
limits per weight are sorted and the level is where the remaining target meets
them). A source whose target exceeds its size is first taken whole as many times
as fit (complete epochs). The rest is drawn: each document gets the exponential
key -ln(u) / w for its quality weight w and a uniform u that depends on its id
alone; documents are taken by ascending key, and sizes are summed along the
keys up to the rest of the target. A document is taken if its middle lies
within the rest, so the sum ends within half a document of it.

The running sum is taken in two levels. Keys are cut into ``SLICES`` slices of
about equal share per source; sizes are summed per slice, the slice sums are
accumulated (at most ``SLICES`` rows per source), and only the one slice in
which a source's rest ends is sorted. No step holds a source in one task. Only
ids, sizes and keys are shuffled, never texts.

Defined cases: a null text has size 0 and is taken 0 words; null sources form
one source, after all others; null ids share one draw and are told apart by
size; repeated rows are documents of their own; an empty table gives an empty
result; other columns are ignored. All on DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SLICES = 4096
#: Words are maximal runs of characters other than U+0020 and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, key: Column) -> Column:
    """A number in (0, 1) that depends on the key alone: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _with_names(rows: DataFrame) -> DataFrame:
    """Null sources as an empty name with the mark ``unnamed``, so that joins find them."""
    return rows.withColumn("unnamed", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``source``, ``source_size``, ``target`` from rows of ``source`` and ``size``.

    Sources are numbered by code point, null last, and take the weights in turn. One
    row per source goes through the numbering, whatever the number of documents.
    """
    named = F.when(~F.col("unnamed"), F.col("source")) if "unnamed" in sizes.columns else F.col("source")
    per_source = sizes.groupBy(named.alias("source")).agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    weighted = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)).withColumn("limit", F.col("source_size") * float(max_epochs))
    by_level = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = weighted.withColumns(
        {
            "filled": F.coalesce(F.sum("limit").over(before), F.lit(0.0)),
            "heavy": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "total": F.sum("source_size").over(whole),
        }
    )
    # If this source and all later ones were below their limits, the level would be:
    levels = levels.withColumn("level", (F.col("total") - F.col("filled")) / F.col("heavy"))
    # The true level is that of the first source whose limit it doesn't reach.
    level_if_met = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    levels = levels.withColumn("true", F.first(level_if_met, ignorenulls=True).over(whole))
    return levels.select("source", "source_size", F.coalesce(F.least("limit", F.col("true") * F.col("weight")), F.col("limit")).alias("target"))


def mix_sources(
    sized: DataFrame,
    seed: int = 17,
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: float = MAX_EPOCHS,
) -> DataFrame:
    """``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``taken`` and ``copies`` per row of ``sized``.

    ``sized`` has ``doc_id``, ``source``, ``size`` and ``quality`` (a positive weight; null counts as 1).
    """
    sized = _with_names(sized)
    targets = _with_names(source_targets(sized, weights, max_epochs)).withColumn(
        "epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    )
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    quality = F.greatest(F.coalesce(F.col("quality").cast("double"), F.lit(1.0)), F.lit(1e-6))
    keyed = sized.select("doc_id", "unnamed", "source", "size", (-F.log(uniform(seed, F.col("doc_id"))) / quality).alias("key"))
    keyed = keyed.withColumn("slice", F.least(F.floor((1 - F.exp(-F.col("key"))) * SLICES), F.lit(SLICES - 1)).cast("int"))
    per_slice = keyed.groupBy("unnamed", "source", "slice").agg(F.sum("size").alias("in_slice"))
    along = Window.partitionBy("unnamed", "source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.withColumn("start", F.coalesce(F.sum("in_slice").over(along), F.lit(0)))
    starts = starts.join(targets, ["unnamed", "source"])
    placed = keyed.join(starts, ["unnamed", "source", "slice"])
    cut = (F.col("start") < F.col("rest")) & (F.col("start") + F.col("in_slice") > F.col("rest"))
    inner = Window.partitionBy("unnamed", "source", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sorted_ = placed.filter(cut).withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(inner), F.lit(0)))
    sorted_ = sorted_.withColumn("more", (F.col("before") + F.col("size") / 2 <= F.col("rest")).cast("long"))
    plain = placed.filter(~cut).withColumn("more", (F.col("start") + F.col("in_slice") <= F.col("rest")).cast("long"))
    both = plain.unionByName(sorted_.drop("before"))
    copies = F.col("epochs") + F.col("more")
    named = F.when(~F.col("unnamed"), F.col("source")).alias("source")
    return both.select("doc_id", named, "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))
