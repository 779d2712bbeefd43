"""The incremental path: raw records arrive as files, and history and snapshot follow (see ``state``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from feira.operators.ingest import RAW, RAW_FIELDS, deduplicate, normalise, split_valid
from feira.streaming import state

def record_stream(spark: SparkSession, directory: str, files_per_batch: int = 100) -> DataFrame:
    """Raw records of JSON array files as they arrive, with their file."""
    rows = spark.readStream.schema(RAW).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(directory)
    return rows.select(*RAW_FIELDS, F.col("_metadata.file_path").alias("ficheiro"))


def observations(records: DataFrame) -> DataFrame:
    """Valid raw records as rows of the history. A file is read in one go, so file and running number give a record's place in every run."""
    place = F.struct(F.col("ficheiro") if "ficheiro" in records.columns else F.lit("").alias("ficheiro"), F.monotonically_increasing_id().alias("n"))
    valid, _ = split_valid(normalise(deduplicate(records.withColumn("ordinal", place))))
    return valid.select(F.col("chave").alias("id_produto_loja"), F.col("recolhido").alias("data_recolha"), F.col("preco_atual").alias("preco"), F.col("preco_antes").alias("preco_original"), "em_promocao", "agente_origem", "ordinal")


def ingest_stream(records: DataFrame, root: str, checkpoint: str, buckets: int = state.BUCKETS, then: Callable[[SparkSession, int], None] | None = None) -> StreamingQuery:
    """Brings all files that are there into history and snapshot, one micro-batch after the other; ``then`` follows each batch."""

    def batch(rows: DataFrame, number: int) -> None:
        state.apply_batch(observations(rows), root, number + 1, buckets)
        if then:
            then(rows.sparkSession, number + 1)

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_observation(rows: DataFrame, lateness: str = "7 days") -> DataFrame:
    """A stream without repeats of product, time and agent that come within ``lateness``."""
    return rows.withWatermark("data_recolha", lateness).dropDuplicatesWithinWatermark(["id_produto_loja", "data_recolha", "agente_origem"])


def trailing_changes(rows: DataFrame, width: str = "24 hours", slide: str = "6 hours", lateness: str | None = None) -> DataFrame:
    """First and last price of each product in every sliding window; for streams and batches alike.

    ``rows`` has ``id_produto_loja``, ``ts``, ``ordem`` (unique) and ``preco``.
    """
    rows = rows.withWatermark("ts", lateness) if lateness else rows
    order = F.struct("ts", "ordem")
    seen = rows.groupBy(F.window("ts", width, slide).alias("w"), "id_produto_loja").agg(F.min_by("preco", order).alias("preco_antigo"), F.max_by("preco", order).alias("preco_novo"), F.count(F.lit(1)).alias("n"))
    return seen.select(F.col("w.start").alias("inicio"), "id_produto_loja", "preco_antigo", "preco_novo", "n").filter("preco_antigo <> preco_novo")
