"""Counters, coverage, completeness and distribution reports.

All are single grouped aggregates over one scan; counts of distinct values stay exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_CATEGORY = "(sem categoria)"
QUARTILES = (("q1", 0.25), ("mediana", 0.5), ("q3", 0.75))


def _long(row: DataFrame) -> DataFrame:
    """A one-row frame of numbers as rows of ``metrica`` and ``valor``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metrica"), F.col(c).cast("double").alias("valor")) for c in row.columns])
    return row.select(F.explode(pairs).alias("m")).select("m.metrica", "m.valor")


def global_metrics(history: DataFrame, current: DataFrame, stores: DataFrame) -> DataFrame:
    """``metrica`` and ``valor`` of the whole database."""
    of_history = history.agg(F.count(F.lit(1)).alias("linhas_historico"), F.countDistinct(F.to_date("data_recolha")).alias("dias_distintos"), F.countDistinct("id_produto_mestre").alias("produtos_mestre"), F.countDistinct("insignia").alias("lojas"))
    of_current = current.agg(F.count(F.lit(1)).alias("precos_atuais"), F.count_if("em_promocao").alias("em_promocao"))
    of_stores = stores.agg(F.count(F.lit(1)).alias("lojas_fisicas"), F.count_if("ativa").alias("lojas_ativas"))
    return _long(of_history).unionByName(_long(of_current)).unionByName(_long(of_stores))


def coverage_by_chain(history: DataFrame) -> DataFrame:
    """Products, observations, mean price and promotions per chain, weighted by history rows."""
    return history.groupBy("insignia").agg(
        F.countDistinct("id_produto_loja").alias("produtos"),
        F.count(F.lit(1)).alias("observacoes"),
        F.round(F.avg("preco"), 6).alias("preco_medio"),
        F.count_if("em_promocao").alias("promocoes"),
    )


def coverage_by_category(products: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` categories by number of products; products without one count as one category."""
    category = F.coalesce("categoria", F.lit(NO_CATEGORY)).alias("categoria")
    return products.groupBy(category).agg(F.countDistinct("id_produto_mestre").alias("produtos")).orderBy(F.desc("produtos"), "categoria").limit(top)


def completeness(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Per group the percentage of rows in which each column is filled."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *(F.round(100.0 * F.count(c) / F.count(F.lit(1)), 8).alias(f"pct_{c}") for c in columns))


def observations_by_day(history: DataFrame, since: Column) -> DataFrame:
    """Observations and distinct products per day."""
    recent = history.filter(F.col("data_recolha") >= since)
    return recent.groupBy(F.to_date("data_recolha").alias("dia")).agg(F.count(F.lit(1)).alias("observacoes"), F.countDistinct("id_produto_loja").alias("produtos"))


def stores_by_city(stores: DataFrame, chains: list[str], top: int = 20) -> DataFrame:
    """Cities with most stores, with a count per chain."""
    counts = [F.count_if(F.col("insignia") == c).alias(c.lower().replace(" ", "_")) for c in chains]
    return stores.groupBy("cidade").agg(F.count(F.lit(1)).alias("total"), *counts).orderBy(F.desc("total"), "cidade").limit(top)


def diagnostics(current: DataFrame) -> DataFrame:
    """Counters of doubtful rows, among them promotions whose original price is missing or not higher."""
    incoherent = F.col("em_promocao") & (F.col("preco_original").isNull() | (F.col("preco_original") <= F.col("preco")))
    row = current.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("preco") <= 0).alias("preco_invalido"),
        F.count_if(incoherent).alias("promocoes_incoerentes"),
        F.count_if(F.col("preco_original").isNull()).alias("sem_preco_original"),
        F.count_if("em_promocao").alias("em_promocao"),
    )
    return _long(row)


def most_observed(history: DataFrame, top: int = 20) -> DataFrame:
    """Products by distinct days, then observations."""
    per_product = history.groupBy("id_produto_loja").agg(F.countDistinct(F.to_date("data_recolha")).alias("dias"), F.count(F.lit(1)).alias("observacoes"))
    return per_product.orderBy(F.desc("dias"), F.desc("observacoes"), "id_produto_loja").limit(top)


def price_quartiles(rows: DataFrame, by: str = "insignia") -> DataFrame:
    """Smallest, quartiles and largest of positive prices per group, interpolated between neighbours.

    Prices are counted, then ranked in two levels: whole slices of 1/256 of an octave first (their number is bounded by
    the range of doubles), then the distinct prices of those slices only that hold a wanted rank. So no task holds a group.
    """
    slices = F.floor(F.log2("preco") * 256).alias("_fatia")
    counted = rows.filter("preco > 0").groupBy(by, slices, "preco").agg(F.count(F.lit(1)).alias("_n"))
    sizes = counted.groupBy(by, "_fatia").agg(F.sum("_n").alias("_n"), F.min("preco").alias("_min"), F.max("preco").alias("_max"))
    whole, before = Window.partitionBy(by), Window.partitionBy(by).orderBy("_fatia").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumns({"_antes": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_todos": F.sum("_n").over(whole), "minimo": F.min("_min").over(whole), "maximo": F.max("_max").over(whole)})
    place = lambda q: F.lit(q) * (F.col("_todos") - 1)
    ends = [F.struct(F.lit(n).alias("nome"), end(place(q)).alias("lugar"), weight(place(q)).alias("peso")) for n, q in QUARTILES for end, weight in ((F.floor, lambda p: 1 - (p - F.floor(p))), (lambda p: F.floor(p) + 1, lambda p: p - F.floor(p)))]
    held = F.filter(F.array(*ends), lambda e: (e["peso"] > 0) & (e["lugar"] >= F.col("_antes")) & (e["lugar"] < F.col("_antes") + F.col("_n")))
    wanted = ranked.select(by, "_fatia", "_antes", "minimo", "maximo", held.alias("_quer")).filter(F.size("_quer") > 0)
    up_to = F.sum("_n").over(Window.partitionBy(by, "_fatia").orderBy("preco").rowsBetween(Window.unboundedPreceding, 0))
    near = counted.join(wanted, (counted[by].eqNullSafe(wanted[by])) & (counted["_fatia"] == wanted["_fatia"])).drop(wanted[by], wanted["_fatia"]).withColumn("_ate", F.col("_antes") + up_to)
    hit = F.filter("_quer", lambda e: (e["lugar"] < F.col("_ate")) & (e["lugar"] >= F.col("_ate") - F.col("_n")))
    found = near.select(by, "minimo", "maximo", "preco", F.explode(hit).alias("e"))
    quartile = lambda n: F.round(F.sum(F.when(F.col("e.nome") == n, F.col("preco") * F.col("e.peso"))), 8).alias(n)
    return found.groupBy(by).agg(F.min("minimo").alias("minimo"), *(quartile(n) for n, _ in QUARTILES), F.max("maximo").alias("maximo"))


def price_histogram(rows: DataFrame, low: float, high: float, bins: int = 40, log: bool = False) -> DataFrame:
    """Rows per bin of equal width (of the logarithm, if ``log``) between ``low`` and ``high``; what lies outside is in bins 0 and ``bins + 1``.

    By logarithm prices of 0 and less have no bin.
    """
    rows = rows.filter("preco > 0") if log else rows
    scale = F.log10 if log else (lambda x: x)
    return rows.groupBy(F.width_bucket(scale(F.col("preco")), scale(F.lit(low)), scale(F.lit(high)), F.lit(bins)).alias("classe")).agg(F.count(F.lit(1)).alias("n"))


def global_report(chains: DataFrame, products: DataFrame, history: DataFrame, current: DataFrame, stores: DataFrame) -> DataFrame:
    """The ten metrics of the report, as text in their order; days as ``yyyy-mm-dd``."""
    day = F.to_date("data_recolha")
    parts = (
        chains.agg(F.count(F.lit(1)).alias("lojas")),
        stores.agg(F.count_if("ativa").alias("lojas_fisicas")),
        products.agg(F.count(F.lit(1)).alias("produtos_mestre")),
        history.agg(F.count_distinct("id_produto_loja").alias("produtos_loja"), F.count(F.lit(1)).alias("historico_precos"), F.count_distinct(day).alias("dias_distintos"), F.min(day).alias("primeiro_dia"), F.max(day).alias("ultimo_dia")),
        current.agg(F.count(F.lit(1)).alias("precos_atuais"), F.count_if("em_promocao").alias("em_promocao")),
    )
    order = ("lojas", "lojas_fisicas", "produtos_mestre", "produtos_loja", "precos_atuais", "historico_precos", "em_promocao", "dias_distintos", "primeiro_dia", "ultimo_dia")
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(part)  # one row each
    named = F.array(*(F.struct(F.lit(i).alias("ordem"), F.lit(c).alias("metrica"), F.col(c).cast("string").alias("valor")) for i, c in enumerate(order, 1)))
    return row.select(F.explode(named).alias("m")).select("m.*")


def repeated_names(products: DataFrame, top: int = 50) -> DataFrame:
    """Names that several products have."""
    return products.groupBy("nome").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "nome").limit(top)


def multi_store_products(current: DataFrame, top: int = 50) -> DataFrame:
    """Products that several chains sell."""
    return current.groupBy("id_produto_mestre").agg(F.countDistinct("id_loja").alias("num_lojas")).filter("num_lojas > 1").orderBy(F.desc("num_lojas"), "id_produto_mestre").limit(top)


def history_depth(history: DataFrame) -> DataFrame:
    """How many products have 1, 2 and 3 or more days of history."""
    days = history.groupBy("id_produto_loja").agg(F.countDistinct(F.to_date("data_recolha")).alias("d"))
    return days.agg(F.count_if(F.col("d") == 1).alias("um_dia"), F.count_if(F.col("d") == 2).alias("dois_dias"), F.count_if(F.col("d") >= 3).alias("tres_ou_mais"))


def largest_spread(history: DataFrame, top: int = 30) -> DataFrame:
    """Products by the difference of their dearest and cheapest price, over two days at least."""
    per_product = history.groupBy("id_produto_loja").agg(F.min("preco").alias("minimo"), F.max("preco").alias("maximo"), F.countDistinct(F.to_date("data_recolha")).alias("dias")).filter("dias >= 2")
    return per_product.withColumn("amplitude", F.col("maximo") - F.col("minimo")).orderBy(F.desc("amplitude"), "id_produto_loja").limit(top)


def store_kpis(current: DataFrame) -> DataFrame:
    """Products, promotions and prices of each chain's current listing."""
    return current.groupBy("insignia").agg(
        F.count(F.lit(1)).alias("produtos"),
        F.count_if("em_promocao").alias("promocoes"),
        F.round(100.0 * F.count_if("em_promocao") / F.count(F.lit(1)), 8).alias("pct_promocoes"),
        F.round(F.avg("preco"), 6).alias("preco_medio"),
        F.min("preco").alias("preco_minimo"),
    )


def database_counters(chains: DataFrame, products: DataFrame, history: DataFrame, current: DataFrame) -> DataFrame:
    """The twelve counters of the data check; days as text."""
    incoherent = F.col("em_promocao") & (F.col("preco_original").isNull() | (F.col("preco_original") <= F.col("preco")))
    day = F.to_date("data_recolha")
    parts = (
        chains.agg(F.count(F.lit(1)).alias("lojas")),
        products.agg(F.count(F.lit(1)).alias("produtos_mestre"), F.count_if(F.col("quantidade_valor").isNull() | F.col("quantidade_unidade").isNull()).alias("produtos_sem_quantidade")),
        history.agg(F.countDistinct("id_produto_loja").alias("produtos_loja"), F.count(F.lit(1)).alias("historico_precos"), F.countDistinct(day).alias("dias_distintos_historico"), F.min(day).alias("primeiro_dia_historico"), F.max(day).alias("ultimo_dia_historico")),
        current.agg(F.count(F.lit(1)).alias("precos_atuais"), F.count_if("em_promocao").alias("produtos_em_promocao"), F.count_if(incoherent).alias("promocoes_incoerentes"), F.count_if(F.col("preco_unitario").isNull()).alias("produtos_sem_preco_unitario")),
    )
    named = lambda row: row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metrica"), F.col(c).cast("string").alias("valor")) for c in row.columns])).alias("m")).select("m.*")
    first, *rest = map(named, parts)
    for part in rest:
        first = first.unionByName(part)
    return first


def health_counters(history: DataFrame, current: DataFrame, stores: DataFrame) -> DataFrame:
    """One row: products of chains, history rows, active physical stores and the newest collection."""
    of_current = current.agg(F.count(F.lit(1)).alias("produtos_loja"), F.max("data_recolha").alias("ultima_recolha"))
    of_history = history.agg(F.count(F.lit(1)).alias("historico_precos"))
    of_stores = stores.agg(F.count_if("ativa").alias("lojas_fisicas"))
    return of_current.crossJoin(of_history).crossJoin(of_stores)  # one row each


def history_kpis(history: DataFrame, key: str = "id_produto_loja") -> DataFrame:
    """Observations and least, greatest and mean price of each product's history."""
    return history.groupBy(key).agg(F.count(F.lit(1)).alias("observacoes"), F.min("preco").alias("minimo"), F.max("preco").alias("maximo"), F.avg("preco").alias("medio"))


def anomaly_counts(found: DataFrame) -> DataFrame:
    """Anomalies per criterion."""
    return found.groupBy("criterio").agg(F.count(F.lit(1)).alias("n"))


def anomaly_sample(found: DataFrame, top: int = 10, key: str = "id_produto_loja") -> DataFrame:
    """The first ``top`` anomalies by product, day and row."""
    return found.orderBy(key, "dia", "id_historico").limit(top)


def without_quantity(products: DataFrame, top: int = 20) -> DataFrame:
    """The first ``top`` names of products whose quantity is not known."""
    return products.filter("quantidade_valor IS NULL OR quantidade_unidade IS NULL").select("nome").orderBy("nome").limit(top)


def listing_sample(current: DataFrame, top: int = 20) -> DataFrame:
    """The first ``top`` current prices by chain and name."""
    columns = ("insignia", "nome", "id_produto_loja", "quantidade_valor", "quantidade_unidade", "preco", "preco_original", "em_promocao", "data_recolha")
    return current.select(*columns).orderBy("insignia", "nome", "id_produto_loja").limit(top)


def listing(current: DataFrame, by: str = "nome") -> DataFrame:
    """A chain's listing in one of four orders: ``nome``, ``mais_barato``, ``mais_caro``, ``promocoes``; ties by name and id."""
    first = {"nome": [], "mais_barato": [F.asc_nulls_last("preco")], "mais_caro": [F.desc_nulls_last("preco")], "promocoes": [F.desc_nulls_last("em_promocao")]}[by]
    return current.orderBy(*first, "nome", "id_produto_loja")


def coverage_labels(by_chain: DataFrame, items: int, total: str = "total", found: str = "encontrados") -> DataFrame:
    """Per chain how many items of a list it lacks, whether it has all, and a label of its cost; cheapest first, unknown costs last."""
    missing = F.lit(items) - F.col(found)
    cost = F.format_string("%.2f€", F.col(total))
    label = F.when(missing == 0, cost).otherwise(F.concat(cost, F.format_string("  (%d/%d)", F.col(found).cast("long"), F.lit(items))))
    rows = by_chain.withColumns({"itens_em_falta": missing.cast("int"), "completa": missing == 0, "estado": F.when(missing == 0, "Lista completa").otherwise("Cobertura parcial"), "etiqueta": label})
    return rows.orderBy(F.asc_nulls_last(total), "insignia")


def to_markdown(rows: DataFrame) -> str:
    """A small result as a Markdown table; null cells are empty."""
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows.collect()]
    return "\n".join(lines)
