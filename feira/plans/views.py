"""The retail tables as views over the test tables, in DataFrames and in SQL.

Chains are regions, physical stores are suppliers, products are parts, the price
history is ``lineitem`` and the dense daily series is ``events``. The joins to regions and
parts are written here only; their sides are dimensions, which Spark broadcasts by size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The total order of a product's observations.
ORDER = ("data_recolha", "l_orderkey", "l_linenumber", "l_suppkey")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id_loja`` and ``insignia`` of every chain."""
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id_loja"), F.col("r_name").alias("insignia"))


def outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lojas_fisicas``: stores with a position that follows from their id."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        F.col("s_suppkey").alias("id_loja_fisica"),
        F.col("r_name").alias("insignia"),
        F.col("s_name").alias("nome_loja"),
        F.col("n_name").alias("cidade"),
        (37.0 + (F.col("s_suppkey") * 7919 % 5000) / 1000.0).alias("latitude"),
        (-9.3 + (F.col("s_suppkey") * 104729 % 3000) / 1000.0).alias("longitude"),
        (F.col("s_suppkey") % 10 != 0).alias("ativa"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price history without product names."""
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    of_chain = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    of_chain = of_chain.select("s_suppkey", F.col("n_regionkey").alias("id_loja"), F.col("r_name").alias("insignia"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    promo = F.col("l_discount") >= 0.05
    rows = table(spark, sf_dir, "lineitem").join(of_chain, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        (F.col("l_partkey") * 10 + F.col("id_loja")).alias("id_produto_loja"),
        F.col("l_partkey").alias("id_produto_mestre"),
        "id_loja",
        "insignia",
        price.alias("preco"),
        F.when(promo, price / (1 - F.col("l_discount"))).alias("preco_original"),
        promo.alias("em_promocao"),
        F.col("l_shipdate").alias("data_recolha"),
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``produtos_mestre``: names, brand, category and quantity."""
    name = F.concat_ws(" ", "p_name", "p_brand", F.concat(F.col("p_size").cast("string"), F.lit("g")))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id_produto_mestre"),
        name.alias("nome"),
        F.col("p_brand").alias("marca"),
        F.col("p_type").alias("categoria"),
        F.col("p_size").cast("double").alias("quantidade_valor"),
        F.lit("g").alias("quantidade_unidade"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price history with product names."""
    return facts(spark, sf_dir).join(products(spark, sf_dir), "id_produto_mestre")


def latest(rows: DataFrame) -> DataFrame:
    """The newest observation of each product of a chain; one pre-aggregated pass without a window."""
    kept = [c for c in rows.columns if c != "id_produto_loja"]
    newest = rows.groupBy("id_produto_loja").agg(F.max_by(F.struct(*kept), F.struct(*ORDER)).alias("n"))
    return newest.select("id_produto_loja", "n.*")


def current(spark: SparkSession, sf_dir: str, wanted: DataFrame | None = None) -> DataFrame:
    """``precos_atuais`` with product names; with ``wanted`` (``id_produto_mestre``), of these products only.

    Other products' observations then go before the newest are looked for.
    """
    rows, named = facts(spark, sf_dir), products(spark, sf_dir)
    if wanted is not None:
        rows = rows.join(wanted.select("id_produto_mestre"), "id_produto_mestre", "left_semi")
    return latest(rows).join(named, "id_produto_mestre")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense observations: ``id_produto_loja``, ``dia``, ``preco``, ``em_promocao``, ``preco_unitario_unidade``."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id_historico"),
        F.col("user_id").alias("id_produto_loja"),
        F.col("ts").cast("date").alias("dia"),
        F.col("value").alias("preco"),
        (F.col("event_type") == "purchase").alias("em_promocao"),
        F.col("event_type").alias("preco_unitario_unidade"),
    )


def series_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of each product of the series, unknown for every sixth."""
    products = table(spark, sf_dir, "events").select(F.col("user_id").alias("id_produto_loja")).distinct()
    named = products.join(chains(spark, sf_dir), F.col("id_loja") == F.col("id_produto_loja") % 6, "left")
    return named.select("id_produto_loja", F.coalesce("insignia", F.lit("?")).alias("cadeia"))


def newest_day(spark: SparkSession, sf_dir: str):
    """The last timestamp of the history, from the files' statistics."""
    return table(spark, sf_dir, "lineitem").agg(F.max("l_shipdate")).first()[0]


SQL = """
WITH RECURSIVE cadeias AS (SELECT s_suppkey, n_regionkey AS id_loja, r_name AS insignia, s_name, n_name
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
lojas_fisicas AS (SELECT s_suppkey AS id_loja_fisica, insignia, s_name AS nome_loja, n_name AS cidade, 37.0::DOUBLE + (s_suppkey * 7919 % 5000)::DOUBLE / 1000.0::DOUBLE AS latitude,
    -9.3::DOUBLE + (s_suppkey * 104729 % 3000)::DOUBLE / 1000.0::DOUBLE AS longitude, s_suppkey % 10 <> 0 AS ativa FROM cadeias),
produtos AS (SELECT p_partkey AS id_produto_mestre, p_name || ' ' || p_brand || ' ' || p_size || 'g' AS nome, p_brand AS marca, p_type AS categoria,
    p_size::DOUBLE AS quantidade_valor, 'g' AS quantidade_unidade FROM part),
factos AS (SELECT l_partkey * 10 + id_loja AS id_produto_loja, l_partkey AS id_produto_mestre, id_loja, insignia, l_extendedprice / l_quantity AS preco,
    CASE WHEN l_discount >= 0.05 THEN l_extendedprice / l_quantity / (1 - l_discount) END AS preco_original, l_discount >= 0.05 AS em_promocao,
    l_shipdate AS data_recolha, l_orderkey, l_linenumber, l_suppkey FROM lineitem JOIN cadeias ON l_suppkey = s_suppkey),
historico AS (SELECT * FROM factos JOIN produtos USING (id_produto_mestre)),
atuais AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_produto_loja ORDER BY data_recolha DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS n FROM factos) WHERE n = 1),
atuais_nomes AS (SELECT * FROM atuais JOIN produtos USING (id_produto_mestre)),
serie AS (SELECT event_id AS id_historico, user_id AS id_produto_loja, CAST(ts AS DATE) AS dia, value AS preco, event_type = 'purchase' AS em_promocao, event_type AS preco_unitario_unidade FROM events)
"""
