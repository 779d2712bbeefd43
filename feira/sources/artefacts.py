"""Versions of fitted models in a folder that all machines share.

A version is written whole into a folder of its own and counts from the moment its manifest is there, which is
written last; readers never see half of one, and an attempt that broke off is passed over. Versions are numbered by
creating their folder's claim, which only one writer can. The file system is the one of the path, whatever it is.
"""

from __future__ import annotations

import json

from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import SparkSession

from feira.operators.models import Linear

CLAIM, MANIFEST = "claim", "manifest.json"


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def _put(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a new small file; whether there was none before."""
    files, path_of = _files(spark, path)
    try:
        out = files.create(path_of(path), False)
    except Exception as e:
        if files.exists(path_of(path)):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions, in order."""
    files, path_of = _files(spark, path)
    if not files.exists(path_of(path)):
        return []
    names = [s.getPath().getName() for s in files.listStatus(path_of(path))]
    return sorted(int(n[2:]) for n in names if n.startswith("v=") and files.exists(path_of(f"{path}/{n}/{MANIFEST}")))


def publish(spark: SparkSession, model: Linear | GBTRegressionModel, path: str, **notes: float) -> int:
    """Writes the model as a new version, with ``notes`` in its manifest, and gives the version."""
    files, path_of = _files(spark, path)
    taken = [int(s.getPath().getName()[2:]) for s in files.listStatus(path_of(path)) if s.getPath().getName().startswith("v=")] if files.exists(path_of(path)) else []
    version = max(taken, default=0) + 1
    while not _put(spark, f"{path}/v={version}/{CLAIM}", ""):
        version += 1
    at = f"{path}/v={version}"
    if isinstance(model, Linear):
        kind = "linear"
        spark.createDataFrame([*zip(model.features, model.weights, strict=True), (None, model.intercept)], "feature string, weight double").coalesce(1).write.json(f"{at}/model")
    else:
        kind = "boosted"
        model.save(f"{at}/model")
    order = list(model.features) if isinstance(model, Linear) else []
    staged = f"{at}/{MANIFEST}.new"
    _put(spark, staged, json.dumps({"kind": kind, "features": order, **notes}))
    if not files.rename(path_of(staged), path_of(f"{at}/{MANIFEST}")):
        raise OSError(f"could not publish {at}")
    return version


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/v={version}/{MANIFEST}").collect()))  # one line


def load(spark: SparkSession, path: str, version: int | None = None) -> Linear | GBTRegressionModel | None:
    """The model of a version, else of the newest one; None if there is none."""
    known = versions(spark, path)
    if version is None and not known:
        return None
    if version is not None and version not in known:
        raise ValueError(f"no version {version} in {path}")
    at = version or known[-1]
    said = manifest(spark, path, at)
    if said["kind"] == "boosted":
        return GBTRegressionModel.load(f"{path}/v={at}/model")
    rows = {r["feature"]: r["weight"] for r in spark.read.schema("feature string, weight double").json(f"{path}/v={at}/model").collect()}  # a row per feature
    return Linear(tuple(said["features"]), tuple(rows[f] for f in said["features"]), rows[None])
