"""Secret scans: fixed patterns plus character Markov models.

The patterns find assignments, access keys and hex runs. The method adds to them:
two character-bigram models, one of random strings and one of ordinary identifiers, are
trained on labelled samples; every other run of ``TOKEN`` characters whose log-likelihood
ratio per character pair exceeds a threshold is a span of kind "random". The threshold is
the midpoint between the classes' means, moved to where at most ``FALSE_SHARE`` of the
training identifiers lie above it.

The samples are made here, ``SAMPLES`` per class: random strings are base-64, base-32 and
hex digits of SHA-2 digests of numbers; identifiers are joined from the vocabulary below
in the usual styles. The models are tables of at most 67 * 67 numbers and enter the
scan as literals, so the texts are read once and never shuffled.

Match offsets are in code points: what lies between matches is what split() leaves, and
running sums of lengths give the offsets.

Defined cases: a null text counts as empty; rows with a null id are scanned like others;
an empty table gives an empty result; other columns are ignored. All on DataFrame
functions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The patterns of the base kinds, in order of precedence at equal starts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
# The same matches of the last two, without the runs that are too short: a run's match
# is the longest from its first possible start, so no other match can come of a short one.
ACCESS_LONG = r"AKIA[A-Z0-9]{14,}"
HEX_LONG = r"[0-9a-f]{16,}"
LEAST = {"assign": 12, "access": 18, "hex": 16}

TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters of the models; all others are one.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLES = 4000
FALSE_SHARE = 0.001

# Words that identifiers are made of.
VOCABULARY = (
    "account action active address agent alert amount array batch block buffer build button cache call cancel center change channel check "
    "child class clear client close code column command config connect content context control copy count create current data date debug "
    "default delete detail device direct display document driver edit element email empty enable end entry error event export factory field "
    "file filter first flag folder font format frame function get group handle header height history icon image import index info input "
    "insert instance item key label last layout left length level limit line link list load local lock log login main manager map match max "
    "member menu message method min mode model module month move name network new next node note number object offset open option order "
    "output owner page panel param parent parse path pattern player point position prefix price print process product profile project query "
    "queue range rate read record region register release remove render report request reset resource response result right role root row "
    "rule sample save scale schema score screen search section select send sequence server service session set shape show signal size slot "
    "sort source space stack start state static status step stop storage stream string style submit success suffix sum support switch symbol "
    "system table target task template test text theme thread time title total track transfer tree type unit update upload user value "
    "variable vector version view visible volume wait week width window word worker write year zone"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """``text`` and ``label`` (1 for random strings): ``n`` of each, the same in every run."""
    ids = spark.range(2 * n)
    digest = lambda i, salt: F.sha2(F.concat_ws(":", F.lit(salt), i.cast("string")), 512)
    base64 = F.base64(F.unhex(digest(F.col("id"), "secret")))
    base32 = F.translate(F.upper(digest(F.col("id"), "upper")), "89", "GZ")
    width = (20 + F.col("id") % 25).cast("int")
    random = F.when(F.col("id") % 3 == 0, F.substring(base64, 1, width)).when(F.col("id") % 3 == 1, F.substring(F.regexp_replace(base64, "[+/=]", "x"), 1, width)).otherwise(F.substring(base32, 1, width))
    vocabulary = F.array(*[F.lit(w) for w in VOCABULARY])
    word = lambda k: F.element_at(vocabulary, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(VOCABULARY))) + 1).cast("int"))
    parts = F.array(*[word(k) for k in range(5)])
    title = F.transform(parts, F.initcap)
    number = F.when(F.col("id") % 5 == 0, F.pmod(F.xxhash64("id"), F.lit(100)).cast("string")).otherwise("")
    styles = [F.array_join(parts, "_"), F.array_join(parts, "-"), F.array_join(title, ""), F.upper(F.array_join(parts, "_")), F.array_join(parts, "/"), F.array_join(parts, "")]
    ordinary = F.concat(reduce(lambda rest, i: F.when(F.col("id") % len(styles) == i, styles[i]).otherwise(rest), range(1, len(styles)), styles[0]), number)
    return ids.select(F.when(F.col("id") < n, random).otherwise(ordinary).alias("text"), (F.col("id") < n).cast("int").alias("label"))


def _codes(text: Column) -> Column:
    """Model codes of a text's characters; 0 for what is not in the alphabet."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def train(spark: SparkSession, samples: DataFrame | None = None) -> tuple[list[float], float]:
    """Log-likelihood ratios of character pairs (row by row) and the threshold on their mean over a string, from ``text`` and ``label``."""
    samples = labelled_samples(spark) if samples is None else samples
    coded = samples.select("label", "text", _codes(F.col("text")).alias("c"))
    pairs = coded.select("label", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p"))
    width = len(ALPHABET) + 1
    counts = [[[0.5] * width for _ in range(width)] for _ in range(2)]
    for r in pairs.groupBy("label", "p.a", "p.b").count().collect():  # at most 2 * 67 * 67 rows
        counts[r["label"]][r["a"]][r["b"]] += r["count"]
    sums = [[sum(row) for row in table] for table in counts]
    ratios = [math.log(counts[1][a][b] / sums[1][a]) - math.log(counts[0][a][b] / sums[0][a]) for a in range(width) for b in range(width)]
    scored = samples.select("label", mean_ratio(F.col("text"), ratios).alias("s"))
    row = scored.agg(F.avg(F.when(F.col("label") == 1, F.col("s"))), F.avg(F.when(F.col("label") == 0, F.col("s"))), F.percentile(F.when(F.col("label") == 0, F.col("s")), 1 - FALSE_SHARE)).first()
    return ratios, max((row[0] + row[1]) / 2, row[2])


def quality(spark: SparkSession, held_out: DataFrame, model: tuple[list[float], float]) -> dict[str, float]:
    """``recall`` and ``false_share`` of a model on labelled strings."""
    ratios, threshold = model
    called = (mean_ratio(F.col("text"), ratios) > threshold).cast("double")
    row = held_out.agg(F.avg(F.when(F.col("label") == 1, called)), F.avg(F.when(F.col("label") == 0, called))).first()
    return {"recall": row[0], "false_share": row[1]}


def mean_ratio(text: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio of a string's character pairs."""
    table = F.lit([float(x) for x in ratios])
    width = len(ALPHABET) + 1
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, code: Column) -> Column:
        gain = F.when(acc["last"] < 0, F.lit(0.0)).otherwise(F.get(table, acc["last"] * width + code))
        return F.struct(code.alias("last"), (acc["sum"] + gain).alias("sum"))

    return F.aggregate(_codes(text), start, step, lambda acc: acc["sum"]) / F.greatest(F.char_length(text) - 1, F.lit(1))


def _matches(text: Column, pattern: str, kind: int, group: int = 0, keep: bool = False) -> Column:
    """Array of a pattern's matches in order: ``kind``, ``k``, the code points between it and the one before (``gap``), ``long``, the ``size`` of the group, and the match if it is to be kept."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sizes = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)  # one more than matches
    known = F.zip_with(found, sizes, lambda m, g: F.struct(m.alias("m"), F.char_length(g).alias("size")))
    rows = F.slice(F.zip_with(gaps, known, lambda g, m: F.struct(F.char_length(g).alias("gap"), m.alias("m"))), F.lit(1), F.size(found))
    said = lambda r: r["m"]["m"] if keep else F.lit(None).cast("string")
    listed = F.transform(rows, lambda r, k: F.struct(F.lit(kind).alias("kind"), k.alias("k"), r["gap"].alias("gap"), F.char_length(r["m"]["m"]).alias("long"), r["m"]["size"].alias("size"), said(r).alias("said")))
    return F.when(text.rlike(pattern), listed)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: tuple[list[float], float] | None = None) -> DataFrame:
    """``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base`` and ``spans`` (arrays of start, kind, end, in order) per document.

    Matches are rows: where they start is a running sum over a text's matches of a kind, and whether a token overlaps a
    base span follows from the greatest end of the base spans that start before the token's end. Both are linear in the matches.
    """
    ratios, threshold = model or train(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("_row", F.monotonically_increasing_id())
    text, random = F.col("text"), KINDS.index("random")
    kinds = [_matches(text, ASSIGN, 0, group=2), _matches(text, ACCESS_LONG, 1), _matches(text, HEX_LONG, 2), _matches(text, TOKEN, random, keep=True)]
    every = F.concat(*(F.coalesce(k, F.array().cast("array<struct<kind:int,k:int,gap:int,long:int,size:int,said:string>>")) for k in kinds))
    # A text without matches keeps one row of nulls.
    met = rows.select("_row", "doc_id", F.explode_outer(every).alias("m")).select("_row", "doc_id", "m.*")
    in_kind = Window.partitionBy("_row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = met.withColumn("end", F.sum(F.col("gap") + F.col("long")).over(in_kind)).withColumn("start", F.col("end") - F.col("long"))
    least = F.element_at(F.array(*[F.lit(LEAST[k]) for k in KINDS[:random]], F.lit(0)), F.col("kind") + 1)
    placed = placed.withColumn("kind", F.when(F.col("size") >= least, F.col("kind")))
    is_token, is_base = F.coalesce(F.col("kind") == random, F.lit(False)), F.coalesce(F.col("kind") < random, F.lit(False))
    in_text = Window.partitionBy("_row").orderBy(F.when(is_token, F.col("end")).otherwise(F.col("start")), F.when(is_token, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max(F.when(is_base, F.col("end"))).over(in_text), F.lit(0))
    judged = placed.withColumn("free", is_token & (covered <= F.col("start")))
    judged = judged.withColumn("found", is_base | F.when(F.col("free"), mean_ratio(F.col("said"), ratios) > threshold).otherwise(False))
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("kind").alias("kind"), F.col("end").cast("int").alias("end"))
    counts = [F.count(F.when(F.col("kind") == i, 1)).alias(f"n_{k}") for i, k in enumerate(KINDS[:random])]
    listed = judged.groupBy("_row").agg(F.max("doc_id").alias("doc_id"), *counts, F.array_sort(F.collect_list(F.when(is_base, span))).alias("base"), F.array_sort(F.collect_list(F.when(F.col("found"), span))).alias("spans"))
    return listed.drop("_row")


def scan_digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, the numbers of base spans, ``base_sha256`` and all ``spans`` as text."""
    found = scan(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
