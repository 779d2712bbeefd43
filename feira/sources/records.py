"""Readers and writers of raw records, stores, sitemaps and reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.operators.ingest import RAW, RAW_FIELDS


def require_columns(rows: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = sorted(set(names) - set(rows.columns))
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return rows


def read_records(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """Raw records from files of JSON arrays, with the file and an ``ordinal`` that follows file and place.

    A file is read in one go, so within it the running numbers rise in every run; files are told apart by name. Without any file, or with
    one whose text doesn't begin with ``[``, this fails.
    """
    paths = matching_files(spark, patterns)
    if not paths:
        raise FileNotFoundError(", ".join(patterns))
    first = F.regexp_extract("value", r"(\S)", 1)
    heads = spark.read.text(paths).select(F.col("_metadata.file_path").alias("f"), first.alias("c"), F.monotonically_increasing_id().alias("n")).filter("c <> ''")
    wrong = heads.groupBy("f").agg(F.min_by("c", "n").alias("c")).filter("c <> '['").first()
    if wrong is not None:
        raise ValueError(f"{wrong['f']} holds no JSON array")
    rows = spark.read.schema(RAW).option("multiLine", True).json(paths)
    return rows.select(*RAW_FIELDS, F.col("_metadata.file_path").alias("ficheiro"), F.struct(F.col("_metadata.file_path").alias("ficheiro"), F.monotonically_increasing_id().alias("n")).alias("ordinal"))


def matching_files(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The files that any of the patterns names, each once and in order."""
    found = set()
    for pattern in patterns:
        path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found |= {s.getPath().toString() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or [] if s.isFile()}
    return sorted(found)


def newest_file(spark: SparkSession, pattern: str) -> str:
    """The last file by name that matches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if not found:
        raise FileNotFoundError(pattern)
    return max(s.getPath().toString() for s in found)


def read_dataset(spark: SparkSession, path: str, schema: str, required: Iterable[str]) -> DataFrame:
    return require_columns(spark.read.schema(schema).option("header", True).csv(path), required)


def write_records(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """The raw fields in their order, as CSV with a header or JSON lines."""
    kept = rows.select(*RAW_FIELDS)
    kept.write.mode("overwrite").option("header", True).csv(path) if kind == "csv" else kept.write.mode("overwrite").json(path)


def finite(rows: DataFrame) -> DataFrame:
    """Numbers that JSON can't hold (not a number, infinite) as nulls, in arrays too."""
    held = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    kinds = {c: k for c, k in rows.dtypes if k in ("double", "float", "array<double>", "array<float>")}
    return rows.withColumns({c: F.transform(c, held) if k.startswith("array") else held(F.col(c)) for c, k in kinds.items()}) if kinds else rows


def write_anomalies(rows: DataFrame, path: str) -> None:
    """Anomalies by product and day, as CSV with a header."""
    rows.sort("id_produto_loja", "dia", "id_historico").write.mode("overwrite").option("header", True).csv(path)


def write_results(rows: DataFrame, path: str) -> None:
    """A result as JSON lines, nulls included, with the numbers that JSON can hold."""
    finite(rows).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_alerts(rows: DataFrame, path: str, run_date: str) -> None:
    rows.withColumn("execucao", F.lit(run_date)).write.mode("append").partitionBy("execucao").parquet(path)


def sitemap_urls(xml: Column) -> Column:
    """Addresses of a sitemap, in order."""
    return F.regexp_extract_all(xml, F.lit(r"<(?:\w+:)?loc>\s*([^<]+?)\s*</(?:\w+:)?loc>"), F.lit(1))


def json_ld_blocks(html: Column) -> Column:
    """The valid JSON-LD blocks of a page, as text."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    return F.filter(F.transform(found, F.trim), lambda b: F.try_parse_json(b).isNotNull())


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def product_from_json_ld(html: Column) -> Column:
    """Name, price and address of the first product block; null without a name and a price."""
    schema = "`@type` string, name string, sku string, brand struct<name: string>, offers struct<price: string, priceCurrency: string>, url string"
    blocks = F.transform(json_ld_blocks(html), lambda b: F.from_json(b, schema))
    first = F.get(F.filter(blocks, lambda b: (b["@type"] == "Product") & b["name"].isNotNull() & b["offers"]["price"].isNotNull()), F.lit(0))
    return F.when(first.isNotNull(), F.struct(first["name"].alias("nome"), first["offers"]["price"].alias("preco"), first["sku"].alias("id_externo"), first["brand"]["name"].alias("marca")))


def sample(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows at random, the same in every run over the same rows."""
    return rows.withColumn("_k", F.xxhash64(F.lit(seed), *rows.columns)).orderBy("_k", *rows.columns).limit(n).drop("_k")
