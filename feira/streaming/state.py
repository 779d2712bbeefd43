"""Snapshot and history by key: a micro-batch rewrites what it touches and nothing else.

Products are dealt to buckets by a hash of their key, and the snapshot has a folder per bucket and batch. The history has a
folder per day and batch, to which rows are only added. What is current is told by a manifest per batch: for each bucket the batch
that wrote it last, for each day the batches that added to it. A manifest is written last and put in place by a rename, so
a batch that breaks off leaves the state as it was, and one that is run again writes its own folders again. Once its
manifest is there a batch is not applied a second time.

A batch reads the buckets of its products and the days of its rows. A late row reaches the history, but the snapshot
only if it is the newest of its product.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.operators.ingest import append_history, upsert_snapshot

SNAPSHOT = "id_produto_loja string, data_recolha timestamp, preco decimal(10,2), preco_original decimal(10,2), em_promocao boolean, agente_origem string"
EMPTY = {"buckets": {}, "days": {}}
BUCKETS = 64


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def manifest(spark: SparkSession, root: str, number: int) -> dict | None:
    """The state after ``number`` batches; None if it is not there (yet)."""
    if number == 0:
        return EMPTY
    files, where = _path(spark, f"{root}/manifest/{number}.json")
    if not files.exists(where):
        return None
    return json.loads(spark.read.option("wholetext", True).text(where.toString()).first()[0])


def _publish(spark: SparkSession, root: str, number: int, state: dict) -> None:
    files, target = _path(spark, f"{root}/manifest/{number}.json")
    _, staged = _path(spark, f"{root}/manifest/.{number}.json.new")
    out = files.create(staged, True)
    out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    out.close()
    if not files.rename(staged, target):
        raise OSError(f"could not publish {target.toString()}")


def _read(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(SNAPSHOT).parquet(*paths) if paths else spark.createDataFrame([], SNAPSHOT)


def _snapshot_paths(root: str, state: dict, buckets) -> list[str]:
    return [f"{root}/atuais/lote={state['buckets'][b]}/balde={b}" for b in sorted(buckets) if b in state["buckets"]]


def _history_paths(root: str, state: dict, days) -> list[str]:
    return [f"{root}/historico/lote={n}/dia={d}" for d in sorted(days) for n in state["days"].get(d, [])]


def snapshot(spark: SparkSession, root: str, number: int) -> DataFrame:
    """Current prices after ``number`` batches."""
    state = manifest(spark, root, number)
    return _read(spark, _snapshot_paths(root, state, state["buckets"]))


def history(spark: SparkSession, root: str, number: int, days: list[str] | None = None) -> DataFrame:
    """The history after ``number`` batches, of some days (``yyyy-mm-dd``) or all."""
    state = manifest(spark, root, number)
    return _read(spark, _history_paths(root, state, state["days"] if days is None else days))


def apply_batch(new: DataFrame, root: str, number: int, buckets: int = BUCKETS) -> dict:
    """Brings the rows of batch ``number`` (from 1; with ``ordinal``) into history and snapshot, and gives the manifest.

    The driver gets the touched buckets and days, not rows: at most ``buckets`` names, and the days of the batch.
    """
    spark = new.sparkSession
    done = manifest(spark, root, number)
    if done is not None:
        return done
    before = manifest(spark, root, number - 1)
    if before is None:
        raise ValueError(f"batch {number - 1} has not been applied")
    fields = [f.strip().split()[0] for f in SNAPSHOT.replace("(10,2)", "").split(",")]
    bucket_of = F.pmod(F.xxhash64("id_produto_loja"), F.lit(buckets)).cast("string")
    day_of = F.date_format("data_recolha", "yyyy-MM-dd")
    dealt = new.select(*fields, "ordinal", bucket_of.alias("balde"), day_of.alias("dia"))
    touched = dealt.select("balde", "dia").distinct()
    of_buckets = sorted(r[0] for r in touched.select("balde").distinct().collect())
    of_days = sorted(r[0] for r in touched.select("dia").distinct().collect())
    old = _read(spark, _history_paths(root, before, of_days))
    added = append_history(old.withColumn("_velho", F.lit(True)), dealt.select(*fields, "ordinal").withColumn("_velho", F.lit(False))).filter("NOT _velho").drop("_velho")
    added.withColumn("dia", day_of).repartition("dia").write.mode("overwrite").partitionBy("dia").parquet(f"{root}/historico/lote={number}")
    current = _read(spark, _snapshot_paths(root, before, of_buckets))
    after = upsert_snapshot(current, dealt.select(*fields)).withColumn("balde", bucket_of)
    after.repartition("balde").write.mode("overwrite").partitionBy("balde").parquet(f"{root}/atuais/lote={number}")
    files, at = _path(spark, f"{root}/historico/lote={number}")
    with_rows = sorted(s.getPath().getName().removeprefix("dia=") for s in files.listStatus(at) if s.getPath().getName().startswith("dia="))
    state = {
        "buckets": {**before["buckets"], **{b: number for b in of_buckets}},
        "days": {**before["days"], **{d: [*before["days"].get(d, []), number] for d in with_rows}},
    }
    _publish(spark, root, number, state)
    return state


def touched_since(spark: SparkSession, root: str, number: int) -> DataFrame:
    """``id_produto_loja`` and the earliest ``dia`` that batch ``number`` added to, for ``panel.refresh``."""
    state = manifest(spark, root, number)
    days = [d for d, batches in state["days"].items() if number in batches]
    rows = _read(spark, [f"{root}/historico/lote={number}/dia={d}" for d in sorted(days)])
    return rows.groupBy("id_produto_loja").agg(F.min(F.to_date("data_recolha")).alias("dia"))
