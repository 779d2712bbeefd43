"""Line deduplication within one word edit, by a deletion-neighbourhood join.

Lines are compared as sequences of lower-cased words (runs of characters other than
U+0020 and U+0009..U+000D). A line goes if an equal line comes earlier, in order of
``doc_id`` and line number, or if an earlier one differs by a single inserted, removed or
replaced word. "Earlier" means any earlier line, kept or not, so the result does not depend
on the order of work. Which lines take part is set by ``Bounds``: with ``WHOLE`` every
line that holds a word, and near ones if the longer has 5 words or more; with ``CUT`` only
lines of ``MIN_WORDS`` words, and near ones only if both have ``NEAR_WORDS``.

1. Lines become two hashes of their words, and equal lines one distinct line at its
   earliest place; the grouping is pre-aggregated, so a line that fills a third of the
   corpus is no hot task. All other places go.
2. One edit leaves the first or the last half of a line as it is. Distinct lines of
   ``HALVED_WORDS`` words or more that share neither half with another one are set aside;
   nothing is lost by that. Halves of shorter lines would be common word pairs.
3. The others emit all variants with one word deleted, and themselves, as hashed keys.
   Lines that share a variant with the same word's place deleted differ by a replaced word;
   a line that equals another's variant differs by an inserted word. Per key the earliest
   place is kept by aggregation, so a key's lines are never paired with each other.
4. The edit distance of each line and its earlier partner is verified on the words.

Variant hashes are running sums over a line's words, so a line of n words costs O(n).
Lines are shuffled once to fetch the words of step 3, and texts once more to rewrite documents.

Defined cases: null texts have no lines and stay; lines with fewer words than the bounds
always stay, among them blank ones; rows with a null id stay as they are and remove nothing; rows
that repeat an id have equal places and don't remove each other's lines; an empty table
gives an empty result; other columns are passed on, whatever their names. All on DataFrame functions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.llm._store import materialise, shuffle_partitions

MIN_WORDS = 5
NEAR_WORDS = 10
HALVED_WORDS = 10


class Bounds(NamedTuple):
    """Fewest words of a line that can be equal, that emits all its variants, and that emits itself as another's variant."""

    equal: int
    near: int
    shorter: int


CUT = Bounds(MIN_WORDS, NEAR_WORDS, NEAR_WORDS)
WHOLE = Bounds(1, 5, 4)
# The separators of words besides the space and, between lines, U+000A.
OTHER_SPACES = "\t\x0b\x0c\r"


def words(line: Column) -> Column:
    """The words of a line that ``lines`` gave."""
    return F.array_remove(F.split(line, " "), "")


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``line_no`` (from 0) and ``line`` of every line, in lower case and with spaces only between words.

    Documents without id or text have none.
    """
    text = F.lower("text")
    for space in OTHER_SPACES:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return docs.filter("doc_id IS NOT NULL").select("doc_id", F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def deletion_variants(rows: DataFrame, near_words: int = 1) -> DataFrame:
    """``key``, ``place`` and the other columns, from ``doc_id``, ``line_no``, ``h`` and ``w``: place 0 has the line itself, place i the line without its i-th word.

    Lines of less than ``near_words`` words have place 0 only. Two numbers make a key: sums over the words, hashed with
    their positions, where behind a deleted word all positions are one less.
    """
    line = ("doc_id", "line_no", "h")
    spread = rows.repartition(shuffle_partitions(rows.sparkSession), "doc_id", "line_no")  # the next two steps stay in these partitions
    exploded = spread.select(*line, F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    hashed = exploded.select(*line, "n", "i", F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("moved"))
    halves = {"low": lambda x: x.bitwiseAND(0x7FFFFFFF), "high": lambda x: F.shiftrightunsigned(x, 33)}
    parts = hashed.select(*line, "n", "i", *(f(F.col(c)).alias(f"{c}_{part}") for part, f in halves.items() for c in ("here", "moved")))
    whole = Window.partitionBy("doc_id", "line_no")
    before = whole.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    step = lambda part: F.col(f"here_{part}") - F.col(f"moved_{part}")
    summed = parts
    for part in halves:
        summed = summed.withColumns({f"run_{part}": F.coalesce(F.sum(step(part)).over(before), F.lit(0)), f"all_{part}": F.sum(f"moved_{part}").over(whole)})
    without = [F.col(f"all_{part}") + F.col(f"run_{part}") - F.col(f"moved_{part}") for part in halves]
    itself = [F.col(f"all_{part}") + F.col(f"run_{part}") + step(part) for part in halves]  # at the last word
    variant = F.when(F.col("n") >= near_words, F.struct((F.col("i") + 1).alias("place"), F.xxhash64(F.col("n") - 1, *without).alias("key")))
    last = F.when(F.col("i") == F.col("n") - 1, F.struct(F.lit(0).alias("place"), F.xxhash64("n", *itself).alias("key")))
    return summed.select(*line, F.explode(F.array(variant, last)).alias("v")).filter("v IS NOT NULL").select(*line, "v.place", "v.key")


def _halves(w: Column, n: Column) -> Column:
    """Keys of the first and last halves, for this length and for a partner that is one word shorter."""
    keys = []
    for size in (F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")):
        keys += [F.xxhash64(F.lit("first"), size, F.slice(w, 1, size)), F.xxhash64(F.lit("last"), size, F.slice(w, n - size + 1, size))]
    return F.array_distinct(F.array(*keys))


def repeated_lines(docs: DataFrame, bounds: Bounds = WHOLE) -> DataFrame:
    """``doc_id``, ``line_no`` and ``reason`` ("equal" or "near") of every line that goes."""
    every = lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    # Blank lines go by a test that needs no words: a filter on their number would make Spark cut every line twice.
    cut = every.filter(F.trim("line") != "").select("doc_id", "line_no", words(F.col("line")).alias("w")).withColumn("n", F.size("w"))
    halves = F.when(F.col("n") >= max(bounds.shorter, HALVED_WORDS - 1), _halves(F.col("w"), F.col("n")))
    hashed = materialise(cut.select("doc_id", "line_no", "n", _line_hash(F.col("w")).alias("h"), F.xxhash64(F.lit(1), "w").alias("h2"), halves.alias("halves")), "lines")
    hashed = hashed.filter(F.col("n") >= bounds.equal)
    by_line = hashed.groupBy("h", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.first("n").alias("n"), F.first("halves").alias("halves"))
    firsts = materialise(by_line.select("first.doc_id", "first.line_no", "h", "h2", "n", "halves"), "distinct-lines")

    keyed = firsts.select("doc_id", "line_no", "h", F.explode("halves").alias("half"))
    met = keyed.groupBy("half").agg(F.count(F.lit(1)).alias("several")).filter("several > 1").select("half")
    short = firsts.filter(F.col("n").between(bounds.shorter, HALVED_WORDS - 1)).select("doc_id", "line_no", "h")
    likely = keyed.join(met, "half").select("doc_id", "line_no", "h").unionByName(short).distinct()
    # Rows that repeat an id may have other texts; the hash tells whether this is the line.
    # Likely lines are few and their keys are dealt evenly, so they are hashed; lines needn't be sorted.
    long_enough = every.filter(F.length("line") >= 2 * bounds.shorter - 1)  # that many words and spaces
    fetched = long_enough.join(likely.hint("shuffle_hash"), ["doc_id", "line_no"]).select("doc_id", "line_no", "h", words(F.col("line")).alias("w")).filter(_line_hash(F.col("w")) == F.col("h"))
    fetched = materialise(fetched.dropDuplicates(["doc_id", "line_no"]), "likely-lines")

    variants = materialise(deletion_variants(fetched, bounds.near), "variants")
    several = variants.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo <> hi").select("key")
    at = F.struct("doc_id", "line_no")
    close = materialise(variants.join(several, "key").select("key", "place", at.alias("at")), "close-lines")
    by_place = close.filter("place > 0").groupBy("key", "place").agg(F.min("at").alias("earliest"))
    replaced = close.join(by_place, ["key", "place"]).select("at", "earliest")
    by_key = close.groupBy("key").agg(F.min(F.when(F.col("place") == 0, F.col("at"))).alias("whole"), F.min(F.when(F.col("place") > 0, F.col("at"))).alias("part"))
    inserted = close.join(by_key, "key").select("at", F.when(F.col("place") == 0, F.col("part")).otherwise(F.col("whole")).alias("earliest"))
    pairs = replaced.unionByName(inserted).filter("earliest < at").groupBy("at").agg(F.min("earliest").alias("earliest"))
    side = lambda name, w: fetched.select(at.alias(name), F.col("w").alias(w))
    near = pairs.join(side("at", "w"), "at").join(side("earliest", "v"), "earliest").filter(within_one_edit(F.col("w"), F.col("v")))
    near = near.select("at.doc_id", "at.line_no", F.lit("near").alias("reason"))

    # A line at another place than the first of its kind; places are no hot keys, however often a line occurs.
    equal = hashed.join(firsts, ["doc_id", "line_no", "h", "h2"], "left_anti").select("doc_id", "line_no", F.lit("equal").alias("reason"))
    # Of rows that repeat an id one line may be both.
    return equal.unionByName(near).groupBy("doc_id", "line_no").agg(F.min("reason").alias("reason"))


def _line_hash(w: Column) -> Column:
    return F.xxhash64(F.size(w), w)


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by at most one inserted, removed or replaced word."""
    longer, shorter = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    # The first place at which they differ; behind it, the rests must be equal after one edit.
    pairs = F.zip_with(longer, shorter, lambda x, y: x.eqNullSafe(y))
    at = F.coalesce(F.nullif(F.array_position(pairs, F.lit(False)), F.lit(0)), F.size(longer) + 1)
    rest = lambda x, start: F.slice(x, start.cast("int"), F.greatest(F.size(x) - start.cast("int") + 1, F.lit(0)))
    same_length = (F.size(longer) == F.size(shorter)) & (rest(longer, at + 1) == rest(shorter, at + 1))
    one_more = (F.size(longer) == F.size(shorter) + 1) & (rest(longer, at + 1) == rest(shorter, at))
    return (at > F.size(longer)) | same_length | one_more


def line_report(docs: DataFrame, bounds: Bounds = WHOLE) -> DataFrame:
    """``doc_id``, ``n_lines``, ``n_equal``, ``n_near`` and ``removed`` (line numbers, ascending, comma-joined) per document."""
    gone = repeated_lines(docs, bounds).groupBy("doc_id").agg(
        F.count_if(F.col("reason") == "equal").alias("n_equal"),
        F.count_if(F.col("reason") == "near").alias("n_near"),
        F.array_join(F.array_sort(F.collect_list("line_no")), ",").alias("removed"),
    )
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    zero = F.lit(0).cast("long")
    return counted.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("n_equal", zero).alias("n_equal"), F.coalesce("n_near", zero).alias("n_near"), F.coalesce("removed", F.lit("")).alias("removed"))


def drop_repeated_lines(docs: DataFrame, bounds: Bounds = WHOLE) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; documents of which no word is left are dropped.

    Documents that had no words to begin with stay.
    """
    gone = repeated_lines(docs, bounds).groupBy("doc_id").agg(F.collect_list("line_no").alias("lines"))
    # The documents' own columns travel in a struct, so that no name of theirs can clash.
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("*").alias("given"))
    met = given.join(gone, "doc_id", "left")
    all_lines = F.split("given.text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("lines"))
    kept = F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n")
    text = F.when(F.col("lines").isNull(), F.col("given.text")).otherwise(kept)
    emptied = F.col("lines").isNotNull() & ~text.rlike(r"[^\x20\x09-\x0D]")
    met = met.filter(~F.coalesce(emptied, F.lit(False)))
    return met.select(*(text.alias(c) if c == "text" else F.col(f"given.`{c}`").alias(c) for c in docs.columns))
