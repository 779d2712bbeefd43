"""Raw documents to encoded training text: five stages, each written and read again before the next.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last
return the columns of ``documents``. ``sf_dir`` is only read for ``labels``.

Defined cases, for every stage: null, empty and blank texts stay (the first has no tokens in the last stage); null ids stay, each
row a document of its own; of rows that repeat an id and a text one passes the third stage, with different texts all do;
ties go as the operators say; texts may have any length; an empty table gives an empty one; further columns are passed on,
whatever their names, by all stages but the last, which ignores them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feira.llm import bpe, line_dedup, mixing, near_dedup, toxicity
from feira.llm._store import let_workers_import, materialise
from feira.llm.queries import quality_weights

TOKENIZER = "byte_bpe_multi_50k.tiktoken"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on labelled ones among them, does not reject."""
    let_workers_import(spark)
    return toxicity.drop_toxic(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line makes superfluous; ``n_chars`` follows the text."""
    left = line_dedup.drop_repeated_lines(docs, line_dedup.WHOLE)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, on five-word shingles at 0.8; of rows with equal ids and texts one stays."""
    let_workers_import(spark)
    found = materialise(near_dedup.near_duplicates(docs, k=5, percent=80).select("doc_id", "kept"), "kept")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct("*").alias("given"))
    given = given.join(found.filter(~F.col("kept")), "doc_id", "left_anti")
    # Rows that repeat an id are few or none; they are looked at apart, so that the others needn't be shuffled for them.
    repeated = materialise(found.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        alike = given.join(repeated, "doc_id").withColumn("text", F.col("given.text")).dropDuplicates(["doc_id", "text"])
        given = given.join(repeated, "doc_id", "left_anti").unionByName(alike.drop("text"))
    return _taken_out(given, docs)


def _taken_out(given: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` out of the struct in which they travelled, where no name of theirs can clash."""
    return given.select(*(F.col(f"given.`{c}`").alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, from not at all to three times."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("of"), mixing.word_count(F.col("text")).alias("words"), F.struct("*").alias("given"))
    sized = given.select("doc_id", F.col("of").alias("source"), F.col("words").alias("size"))
    mixed = mixing.mix_sources(sized.join(quality_weights(_labels(spark, sf_dir)), "doc_id", "left"))
    taken = mixed.filter("copies > 0").select("doc_id", F.col("source").alias("from"), F.col("size").alias("long"), F.col("copies").cast("int").alias("copies"))
    # Rows that repeat an id are told apart by source and size; those that agree in these as well are taken alike.
    named = taken.filter("doc_id IS NOT NULL").groupBy("doc_id", "from", "long").agg(F.max("copies").alias("copies"))
    repeated = given.join(named.withColumnRenamed("doc_id", "taken"), (F.col("doc_id") == F.col("taken")) & F.col("of").eqNullSafe(F.col("from")) & (F.col("words") == F.col("long")))
    # Null ids have no key: they are numbered among those of their source and size, which the mix can't tell apart either.
    nth = lambda source, size, *order: F.row_number().over(Window.partitionBy(source, size).orderBy(*order))
    from_mix = taken.filter("doc_id IS NULL").drop("doc_id").withColumn("nth", nth("from", "long", F.desc("copies")))
    nameless = given.filter("doc_id IS NULL").withColumn("place", nth("of", "words", "given.text")).join(
        from_mix, F.col("of").eqNullSafe(F.col("from")) & (F.col("words") == F.col("long")) & (F.col("place") == F.col("nth"))
    )
    both = repeated.select("given", "copies").unionByName(nameless.select("given", "copies"))
    return _taken_out(both.select("given", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives its text back."""
    let_workers_import(spark)
    return bpe.encode_corpus(docs, public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("byte-level BPE", encode),
]

#: SQL can't express the toxicity model and its training.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded documents that are left of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
