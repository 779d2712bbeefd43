"""Shopping lists: split over chains, in one chain, with travel, and on two-stop routes.

Everything after ``matched_items`` works on at most one row per item and chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feira.functions.geo import haversine, nearest_per_chain, travel_cost
from feira.operators.search import best_per_item, best_store, matched_items


def price_matrix(current: DataFrame, items: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """The best offer of each item in each chain."""
    return best_per_item(matched_items(current, items, products), "insignia")


def split_basket(current: DataFrame, items: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Each item's best offer over all chains; items without one have nulls."""
    return split_of(price_matrix(current, items, products), items)


def split_of(matrix: DataFrame, items: DataFrame) -> DataFrame:
    """Each item's best offer over all chains, from the best ones of each chain; items without one have nulls."""
    row = F.struct((-F.col("semelhanca")).alias("s"), "preco", "nome", "id_produto_loja", "insignia")
    best = matrix.groupBy("item").agg(F.min(row).alias("o"))
    return items.join(best.select("item", "o.nome", "o.preco", "o.id_produto_loja", (-F.col("o.s")).alias("semelhanca"), "o.insignia"), "item", "left")


def missing_items(current: DataFrame, items: DataFrame, products: DataFrame | None = None) -> DataFrame:
    return items.join(matched_items(current, items, products).select("item").distinct(), "item", "left_anti")


def basket_by_chain(matrix: DataFrame, items: DataFrame) -> DataFrame:
    """Total, number of items found and completeness of the list in each chain."""
    wanted = items.agg(F.count(F.lit(1)).alias("pedidos"))
    per_chain = matrix.groupBy("insignia").agg(F.round(F.sum("preco"), 8).alias("total"), F.count(F.lit(1)).alias("encontrados"))
    return per_chain.crossJoin(wanted).withColumn("completa", F.col("encontrados") == F.col("pedidos"))  # one row


def basket_decision(matrix: DataFrame, items: DataFrame, split: DataFrame | None = None) -> DataFrame:
    """One row: split cost, best complete chain, strategy and saving. The split follows from the matrix."""
    parts = (split_of(matrix, items) if split is None else split).agg(F.round(F.sum("preco"), 8).alias("custo_dividido"), F.count_if(F.col("preco").isNull()).alias("em_falta"))
    whole = basket_by_chain(matrix, items).filter("completa").agg(F.min(F.struct("total", "insignia")).alias("m"))
    row = parts.crossJoin(whole).select("custo_dividido", "em_falta", F.col("m.insignia").alias("melhor_cadeia"), F.col("m.total").alias("custo_cadeia"))
    strategy = F.when(F.col("custo_cadeia").isNull(), "dividir_parcial").when(F.col("custo_dividido") < F.col("custo_cadeia"), "dividir").otherwise("loja_unica")
    return row.withColumn("estrategia", strategy).withColumn("poupanca", F.greatest(F.col("custo_cadeia") - F.col("custo_dividido"), F.lit(0.0)))


def basket_geo(matrix: DataFrame, items: DataFrame, stores: DataFrame, lat: float, lon: float, per_km: float, radius_km: float = 30.0) -> DataFrame:
    """Complete chains with a store within reach: products plus the way there and back, cheapest first."""
    near = nearest_per_chain(stores, lat, lon, radius_km)
    complete = basket_by_chain(matrix, items).filter("completa")
    costed = complete.join(near, "insignia").withColumn("custo_viagem", travel_cost(F.col("distancia_km"), per_km))
    return costed.withColumn("custo_total", F.col("total") + F.col("custo_viagem")).orderBy("custo_total", "insignia")


def basket_routes(matrix: DataFrame, items: DataFrame, stores: DataFrame, lat: float, lon: float, per_km: float, radius_km: float = 30.0) -> DataFrame:
    """Pairs of chains in reach: each item from the cheaper one (the first on ties), and the way round both stores.

    A pair counts if it has every item and both chains sell some. Pairs are of chains, of which there are few.
    """
    near = nearest_per_chain(stores, lat, lon, radius_km)
    end = lambda s: near.select(*(F.col(c).alias(f"{c}_{s}") for c in ("insignia", "latitude", "longitude", "distancia_km")))
    pairs = end("a").join(end("b"), F.col("insignia_a") < F.col("insignia_b"))
    pairs = pairs.withColumn("rota_km", F.col("distancia_km_a") + F.col("distancia_km_b") + haversine(F.col("latitude_a"), F.col("longitude_a"), F.col("latitude_b"), F.col("longitude_b")))
    # An item's prices are a map by chain, so the matrix is made once for both ends.
    priced = items.join(matrix.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("insignia", "preco"))).alias("_precos")), "item", "left")
    asked = priced.crossJoin(pairs.select("insignia_a", "insignia_b", "rota_km"))
    met = asked.withColumns({f"preco_{s}": F.try_element_at("_precos", F.col(f"insignia_{s}")) for s in "ab"})
    from_a = F.coalesce(F.col("preco_a") <= F.col("preco_b"), F.col("preco_a").isNotNull())
    met = met.withColumns({"de_a": from_a, "preco": F.when(from_a, F.col("preco_a")).otherwise(F.col("preco_b"))})
    rolled = met.groupBy("insignia_a", "insignia_b", "rota_km").agg(
        F.round(F.sum("preco"), 8).alias("custo_produtos"),
        F.count_if(F.col("preco").isNull()).alias("em_falta"),
        F.count_if(F.col("de_a") & F.col("preco").isNotNull()).alias("n_a"),
        F.count_if(~F.col("de_a") & F.col("preco").isNotNull()).alias("n_b"),
    )
    whole = rolled.filter("em_falta = 0 AND n_a > 0 AND n_b > 0").withColumn("custo_total", F.col("custo_produtos") + F.col("rota_km") * per_km)
    return whole.orderBy("custo_total", "insignia_a", "insignia_b")


def route_decision(chains: DataFrame, routes: DataFrame) -> DataFrame:
    """One row: the best single chain of ``basket_geo``, the best pair of ``basket_routes``, which to take and what the pair saves.

    A pair is recommended if it costs less than the best single chain; without either it is not.
    """
    single = chains.agg(F.min(F.struct(F.col("custo_total").alias("custo"), "insignia")).alias("s"))
    pair = routes.agg(F.min(F.struct(F.col("custo_total").alias("custo"), "insignia_a", "insignia_b")).alias("p"))
    row = single.crossJoin(pair)  # one row each
    better = F.coalesce(F.col("p.custo") < F.col("s.custo"), F.lit(False))
    return row.select(
        F.col("s.insignia").alias("melhor_cadeia"),
        F.col("s.custo").alias("custo_cadeia"),
        F.col("p.insignia_a").alias("insignia_a"),
        F.col("p.insignia_b").alias("insignia_b"),
        F.col("p.custo").alias("custo_par"),
        F.when(better, "par").otherwise("single").alias("recomendacao"),
        F.when(better, F.col("s.custo") - F.col("p.custo")).otherwise(0.0).alias("poupanca_par"),
    )


def near_me(current: DataFrame, stores: DataFrame, term: str, lat: float, lon: float, per_km: float, radius_km: float = 30.0, top: int = 5, by_unit: bool = False) -> DataFrame:
    """The best offer of each chain in reach, by price (or by unit price, see ``best_store``) and travel."""
    ranked = best_store(current, term, 10, by_unit)
    order = [F.coalesce("preco_unitario_valor", F.lit(float("inf"))).alias("_u")] if by_unit else []
    offers = ranked.groupBy("insignia").agg(F.min(F.struct(*order, "preco", "nome", "id_produto_loja")).alias("o"))
    met = offers.select("insignia", "o.preco", "o.nome", "o.id_produto_loja").join(nearest_per_chain(stores, lat, lon, radius_km), "insignia")
    return met.withColumn("custo_total", F.col("preco") + travel_cost(F.col("distancia_km"), per_km)).orderBy("custo_total", "insignia").limit(top)
