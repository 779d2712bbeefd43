"""Operators on small fixtures: texts, ingestion, distances, panels, anomalies, decisions and the stream."""

from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from feira.functions import geo, text
from feira.operators import anomaly, backtest, basket, forecast, ingest, monitor, panel, quality, search
from feira.plans import queries, views
from feira.sources import records
from feira.streaming import prices, state


def value(spark, column, given, kind="string"):
    return spark.createDataFrame([(given,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(("given", "wanted"), [("  a   b\n", "a b"), (None, "")])
def test_clean(spark, given, wanted):
    assert value(spark, text.clean, given) == wanted


def test_titles_slugs_and_numbers(spark):
    assert value(spark, text.title, "COCA-COLA zero") == "Coca-Cola Zero"
    assert value(spark, text.slug, "Pão & Água 50%") == "pao-agua-50-pct"
    assert value(spark, text.category_path, "Frutas & Legumes/Maçãs/") == "frutas-e-legumes/macas"
    assert value(spark, text.decimal, "1.234,56 €") == Decimal("1234.5600")
    assert value(spark, text.decimal, "1.69") == Decimal("1.6900")
    assert value(spark, text.decimal, "grátis") is None
    assert value(spark, text.plain_number, Decimal("500.000"), "decimal(12,3)") == "500"
    assert value(spark, text.plain_number, Decimal("500"), "decimal(12,0)") == "500"


@pytest.mark.parametrize(
    ("name", "price", "per_unit", "wanted"),
    [
        ("Iogurte 3x250g", "1", "", "q:pack-3x250g-total-750g"),
        ("3 Queijos Barreado 200g", "1", "", "q:200g"),
        ("Azeite 1,5L", "1", "", "q:1500ml"),
        ("Arroz", "1.69", "1.69€/kg", "q:1000g"),
        ("Arroz", "1.69", "", "q:desconhecida"),
        ("Café 10 CÁPSULAS", "3", "", "q:10un"),
    ],
)
def test_quantities(spark, name, price, per_unit, wanted):
    row = spark.createDataFrame([(name, price, per_unit)], "n string, p string, u string")
    assert row.select(text.descriptor(text.quantity(F.col("n"), F.col("p"), F.col("u")))).first()[0] == wanted


def test_trigram_similarity_is_the_documented_one(spark):
    row = spark.createDataFrame([("word", "two words")], "a string, b string")
    assert row.select(text.similarity(F.col("a"), F.col("b"))).first()[0] == pytest.approx(4 / 11)


def test_terms_and_noise(spark):
    assert search.parse_term("coca-cola 1.5L") == (["coca-cola"], [(1500.0, "ml")])
    rows = spark.createDataFrame([("Água das Pedras 1500ml", 1500.0, "ml"), ("Pedra", 1.0, "un")], "n string, v double, u string")
    hit = search.matches("agua 1,5L", F.col("n"), F.col("v"), F.col("u"))
    assert [r["n"] for r in rows.filter(hit).collect()] == ["Água das Pedras 1500ml"]
    assert rows.filter(search.not_noise("x", F.lit("a b c d um dois tres quatro cinco"))).count() == 0
    with pytest.raises(ValueError):
        search.search(rows, rows, " ")


def raw(**given):
    return tuple(given.get(c, "") for c in ingest.RAW_FIELDS)


def test_batches_are_deduplicated(spark):
    given = [
        raw(loja="A", id_externo="1", nome="old", data_recolha="2026-01-01"),
        raw(loja="A", id_externo="1", nome="new", data_recolha="2026-01-02"),
        raw(loja="B", id_externo="1", nome="other chain", data_recolha="2026-01-01"),
        raw(loja="A", url="http://x/1", nome="first", data_recolha="2026-01-01"),
        raw(loja="A", url="http://x/1", nome="last", data_recolha="2026-01-01"),
        raw(loja="A", nome="n", preco="1"),
    ]
    rows = spark.createDataFrame([(*r, i) for i, r in enumerate(given)], f"{ingest.RAW}, ordinal int")
    assert [r["nome"] for r in ingest.deduplicate(rows).orderBy("ordinal").collect()] == ["new", "other chain", "last", "n"]
    assert ingest.first_per_id(rows).count() == 4
    assert ingest.deduplicate(rows.limit(0)).count() == 0


def test_records_are_normalised_or_set_aside(spark):
    given = [
        raw(loja="Pingo Doce", nome="Azeite 750ml", preco="8,99", preco_original="10,49", ean="560", data_recolha="2026-07-01 12:00:00", marca="GALLO"),
        raw(loja="A", nome="x", preco="0", data_recolha="2026-01-01"),
        raw(loja="A", nome="", preco="1", data_recolha="2026-01-01"),
        raw(loja="A", nome="x", preco="1", data_recolha="never"),
    ]
    good, bad = ingest.split_valid(ingest.normalise(spark.createDataFrame(given, ingest.RAW)))
    row = good.collect()
    assert len(row) == 1 and row[0]["chave_mestre"] == "ean:560" and row[0]["em_promocao"] and row[0]["recolhido"] == datetime(2026, 7, 1, 11)
    assert row[0]["agente_origem"] == "scraper_pingo_doce" and row[0]["marca_normalizada"] == "Gallo"
    assert sorted(r["erro"] for r in bad.collect()) == ["data invalida", "nome em falta", "preco invalido"]


def test_upserts(spark):
    schema = "chave_mestre string, ean string, nome_padronizado string, marca string"
    old = spark.createDataFrame([("k", "1", "Old", "M"), ("o", None, "Only", None)], schema)
    new = spark.createDataFrame([("k", "2", "New", None), ("n", None, "Fresh", "X")], schema)
    assert {tuple(r) for r in ingest.upsert_master(old, new).collect()} == {("k", "1", "New", "M"), ("o", None, "Only", None), ("n", None, "Fresh", "X")}
    stores = "insignia string, external_id string, telefone string, latitude double"
    merged = ingest.upsert_stores(spark.createDataFrame([("A", "1", "99", 1.0)], stores), spark.createDataFrame([("A", "1", None, 2.0), ("B", "1", None, 3.0)], stores), keep=("telefone",))
    assert {tuple(r) for r in merged.collect()} == {("A", "1", "99", 2.0), ("B", "1", None, 3.0)}
    snap = "id_produto_loja int, data_recolha int, preco double"
    now = ingest.upsert_snapshot(spark.createDataFrame([(1, 5, 1.0), (2, 5, 1.0)], snap), spark.createDataFrame([(1, 4, 9.0), (2, 6, 2.0), (3, 1, 3.0)], snap))
    assert {tuple(r) for r in now.collect()} == {(1, 5, 1.0), (2, 6, 2.0), (3, 1, 3.0)}


def test_alert_labels(spark):
    rows = spark.createDataFrame([(-1.0, False, True), (9.0, True, False), (-5.0, True, True), (5.0, True, True), (-1.0, True, True), (1.0, False, False), (0.0, True, True)], "p double, a boolean, b boolean")
    assert [r[0] for r in rows.select(monitor.alert_type(F.col("p"), F.col("a"), F.col("b"))).collect()] == list(monitor.ALERTS)


def test_distances_and_costs(spark):
    assert geo.cost_per_km("tarifa_at") == 0.36 and geo.cost_per_km("0,5") == 0.5 and geo.cost_per_km(None) == 0.20
    with pytest.raises(ValueError):
        geo.cost_per_km("far")
    km = spark.range(1).select(geo.haversine(F.lit(41.561), F.lit(-8.397), F.lit(38.7223), F.lit(-9.1393))).first()[0]
    assert km == pytest.approx(322, abs=5)
    with pytest.raises(ValueError):
        geo.check_position(91, 0)


def test_nearest_stores_of_many_points(spark):
    """Against all pairs, with equal positions, ties, an unknown chain and stores that don't count; the exploded points are not broadcast."""
    shops = [(i, ("A", "B", None)[i % 3], 38.0 + (i * 37 % 50) / 40, -9.0 + (i * 91 % 60) / 40, i % 7 != 0) for i in range(160)] + [(200, "A", None, -9.0, True)]
    stores = spark.createDataFrame(shops, "id_loja_fisica int, insignia string, latitude double, longitude double, ativa boolean")
    given = [(i, 38.0 + (i * 13 % 90) / 72, -9.0 + (i * 7 % 100) / 66) for i in range(300)] + [(900, None, -9.0)]
    points = spark.createDataFrame(given, "id_ponto int, lat double, lon double")
    met = geo.nearest_for_points(points, stores, 30.0)
    every = points.crossJoin(stores.filter("ativa")).withColumn("km", geo.haversine(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))).filter("km <= 30")
    wanted = every.groupBy("id_ponto", "insignia").agg(F.min(F.struct("km", "id_loja_fisica")).alias("m"))
    found = {(r["id_ponto"], r["insignia"]): (r["distancia_km"], r["id_loja_fisica"]) for r in met.collect()}
    assert len(found) > 600 and found == {(r["id_ponto"], r["insignia"]): tuple(r["m"]) for r in wanted.collect()}
    for rows in (met, geo.stores_within(points, stores, 30.0)):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()


def observed(spark, rows):
    return spark.createDataFrame(rows, "id_historico int, id_produto_loja int, dia date, preco double, em_promocao boolean, preco_unitario_unidade string")


def test_panel_fills_days(spark):
    rows = observed(spark, [(1, 1, date(2026, 1, 1), 1.69, True, "kg"), (2, 1, date(2026, 1, 3), 1.75, False, None), (3, 1, date(2026, 1, 1), 1.99, False, "kg")])
    filled = panel.features(rows).orderBy("dia").collect()
    assert [r["preco"] for r in filled] == [1.84, 1.84, 1.75]
    assert [r["em_promocao"] for r in filled] == [True, False, False]
    assert [r["dias_desde_ultima_obs"] for r in filled] == [0, 1, 0]
    assert filled[1]["lag_1"] == 1.84 and filled[0]["target_t_plus_1"] == 1.84 and filled[0]["desvio_movel_7"] == 0.0


def test_anomalies(spark):
    days = [date(2026, 1, d) for d in range(1, 12)]
    rows = observed(spark, [(i, 1, d, 10.0 if i == 9 else 1.0 + i / 100, False, "kg") for i, d in enumerate(days)] + [(20, 2, days[0], 1.0, False, "kg"), (21, 2, days[1], 5.0, False, "kg"), (22, 3, days[0], 1.0, False, "kg"), (23, 3, days[9], 5.0, False, "kg")])
    assert {(r["id_historico"], r["criterio"]) for r in anomaly.anomalies(rows).collect()} == {(9, "iqr"), (10, "variacao_abrupta"), (21, "variacao_abrupta")}


def test_changes_from_a_price_of_zero_are_abrupt(spark):
    """As SQL has it: the ratio is infinite, or not a number and then above all others; days too far apart and rows without a price don't count."""
    given = [(1, 0.0), (1, 2.0), (2, 0.0), (2, 0.0), (3, 0.0), (3, None), (4, 1.0), (4, 0.0), (5, 0.0)]
    rows = observed(spark, [(i, key, date(2026, 1, 1 + i % 2), price, False, "kg") for i, (key, price) in enumerate(given)] + [(20, 5, date(2026, 1, 9), 3.0, False, "kg")])
    assert {(r["id_historico"], r["criterio"]) for r in anomaly.anomalies(rows).collect()} == {(i, "variacao_abrupta") for i in (1, 3, 7)}


def test_anomalies_are_counted_with_changes_from_zero(spark):
    rows = observed(spark, [(i, 1 + i // 2, date(2026, 1, 1 + i % 2), price, False, "kg") for i, price in enumerate((0.0, 2.0, 1.0, 5.0, 1.0, 1.1))])
    assert {(r["criterio"], r["n"]) for r in quality.anomaly_counts(anomaly.anomalies(rows)).collect()} == {("variacao_abrupta", 2)}


def test_anomalies_of_equal_days_and_numbers_are_counted_alike_in_any_order(spark):
    given = [(1, 1, date(2026, 1, 1), price, False, "kg") for price in (1.0, 2.0)]
    for order in (given, given[::-1]):
        assert [(r["criterio"], r["n"]) for r in quality.anomaly_counts(anomaly.anomalies(observed(spark, order).coalesce(1))).collect()] == [("variacao_abrupta", 1)]


def test_buy_or_wait(spark):
    rows = spark.createDataFrame([(1, date(2026, 1, d), p, 1.69) for d, p in ((1, 1.69), (2, 1.50))] + [(2, date(2026, 1, 1), 1.69, 1.69)], "id_produto_loja int, data date, preco_medio double, agora double")
    assert {r["id_produto_loja"]: r["decisao"] for r in forecast.buy_or_wait(rows, F.col("agora")).collect()} == {1: "aguardar", 2: "comprar_agora"}


def test_of_equal_forecasts_the_first_day_counts(spark):
    days = [date(2026, 1, d) for d in (5, 2, 7, 3)]
    for given in (days, days[::-1]):
        rows = spark.createDataFrame([(1, d, 1.5, 1.69) for d in given], "id_produto_loja int, data date, preco_medio double, agora double").coalesce(1)
        assert [r["melhor_dia"] for r in forecast.buy_or_wait(rows, F.col("agora")).collect()] == [date(2026, 1, 2)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"nome": "x", "preco": "1"}, {"nome": "y"}]))
    (tmp_path / "b.json").write_text(json.dumps([{"nome": "z"}]))
    assert records.read_records(spark, [str(tmp_path / "*.json")]).count() == 3
    assert records.newest_file(spark, f"{tmp_path}/*.json").endswith("b.json")
    with pytest.raises(ValueError):
        records.require_columns(spark.range(1), ["missing"])
    assert value(spark, records.sitemap_urls, "<urlset><url><loc> http://a </loc></url><url><loc>http://b</loc></url></urlset>") == ["http://a", "http://b"]
    page = '<script type="application/ld+json">{"@type":"Product","name":"Arroz","offers":{"price":"1.69"}}</script><script type="application/ld+json">broken</script>'
    assert value(spark, records.product_from_json_ld, page)["preco"] == "1.69"
    assert value(spark, records.product_from_json_ld, "<p>none</p>") is None


def test_stream_equals_batch_and_replays(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "tables"
    source.mkdir()
    rows = [[{"loja": "A", "id_externo": str(i), "nome": "n", "preco": f"{1 + n}", "data_recolha": f"2026-01-0{1 + n}"} for i in range(3)] for n in range(2)]
    for n, batch in enumerate(rows):
        (source / f"{n}.json").write_text(json.dumps(batch))
        prices.ingest_stream(prices.record_stream(spark, str(source)), str(root), str(tmp_path / "checkpoint")).awaitTermination()
    history, snapshot = state.history(spark, str(root), 2), state.snapshot(spark, str(root), 2)
    assert history.count() == 6 and {r["preco"] for r in snapshot.collect()} == {Decimal("2.00")}
    again = ingest.append_history(history, history.withColumn("ordinal", F.lit(1)))
    assert again.count() == 6


def test_ingestion_batches_hold_every_row(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_suppkey"]
    old, new = (rows.select(*keys) for rows in queries._batches(spark, sf_dir))
    every = views.facts(spark, sf_dir).select(*keys)
    assert every.exceptAll(old.unionByName(new)).isEmpty() and not old.intersect(new).isEmpty()
    days = queries.QUERIES["snapshot_upsert_whole"](spark, sf_dir).select("id_produto_loja", "data_recolha")
    newest = views.facts(spark, sf_dir).groupBy("id_produto_loja").agg(F.max("data_recolha").cast("date").cast("string").alias("data_recolha"))
    assert days.exceptAll(newest).isEmpty() and newest.exceptAll(days).isEmpty()


def test_backtest_random_sample_draws_100_times_per_date(spark, sf_dir):
    drawn = queries.QUERIES["backtest_random_sample"](spark, sf_dir)
    assert {r["n"] for r in drawn.groupBy("lista", "dia").agg(F.countDistinct("sorteio").alias("n")).collect()} == {100}
    assert not drawn.filter("dia NOT LIKE '%-01'").isEmpty()


def test_lists_of_any_length(spark):
    offers = spark.createDataFrame([(f"thing{i:05d} pack", "A", i, 1.0 + i) for i in range(1500)], "nome string, insignia string, id_produto_loja long, preco double")
    items = spark.createDataFrame([(f"thing{i:05d} pack",) for i in range(1500)] + [("absent thing",), ("",), (None,)], "item string")
    found = search.matched_items(offers, items)
    assert found.select("item").distinct().count() == 1500
    assert {r["item"] for r in basket.missing_items(offers, items).collect()} == {"absent thing", "", None}
    split = {r["item"]: r["insignia"] for r in basket.split_basket(offers, items).collect()}
    assert split["thing00007 pack"] == "A" and split["absent thing"] is None
    history = offers.select("nome", "insignia", "preco", F.lit("2026-01-01").alias("dia"))
    lists = spark.range(12_000).select(F.lit("a").alias("lista"), F.concat(F.lit("thing"), F.lpad((F.col("id") % 1500).cast("string"), 5, "0"), F.lit(" "), F.lit("pack")).alias("item"))
    lists = lists.withColumn("lista", F.concat(F.lit("l"), F.monotonically_increasing_id().cast("string")))
    assert backtest.matches_by_day(history, lists).count() == 12_000


def test_containing_meets_short_words_and_none(spark):
    names = spark.createDataFrame([("ab c",), ("b",), ("",)], "nome string")
    wanted = spark.createDataFrame([(["b"],), (["b", "ab"],), ([],), (["zz"],), (None,)], "w array<string>")
    found = search.containing(names, wanted, F.col("nome"), F.col("w")).collect()
    assert sorted((r["nome"], tuple(r["w"])) for r in found) == [("", ()), ("ab c", ()), ("ab c", ("b",)), ("ab c", ("b", "ab")), ("b", ()), ("b", ("b",))]


def test_best_store_ranks_by_unit_price_only_if_it_is_coherent(spark):
    kinds = "nome string, insignia string, id_produto_loja long, preco double, em_promocao boolean, quantidade_valor double, quantidade_unidade string, preco_unitario_valor double, preco_unitario_unidade string"

    def ranked(*units):
        rows = [("red widget", chain, i, price, False, 1.0, "kg", value, unit) for i, (chain, price, value, unit) in enumerate(units)]
        return [(r["insignia"], r["poupanca_pct"]) for r in search.best_store(spark.createDataFrame(rows, kinds), "red widget", by_unit=True).collect()]

    assert ranked(("A", 1.0, 10.0, "kg"), ("B", 2.0, 5.0, "kg"), ("C", 0.5, None, None)) == [("B", 50.0), ("A", 0.0), ("C", None)]
    assert ranked(("A", 1.0, 10.0, "kg"), ("B", 2.0, 5.0, "l")) == [("A", 50.0), ("B", 0.0)]
    assert ranked(("A", 1.0, None, None), ("B", 2.0, None, None)) == [("A", 50.0), ("B", 0.0)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_observation_times_do_not_depend_on_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2026-07-01 10:00:00", "2026-07-01T10:00:00", "2026-07-01", "2026-07-01T10:00:00Z", "2026-07-01T10:00:00+02:00", "2026-01-01 10:00:00", "x", None]
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.unix_seconds(ingest.observed_at(F.col("t"))).alias("s")).orderBy("i").collect()
        nine = 1782896400  # 2026-07-01T09:00:00Z
        assert [r["s"] for r in rows] == [nine, nine, nine - 36_000, nine + 3600, nine - 3600, 1767261600, None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_upserts_take_one_row_of_a_key(spark):
    old = spark.createDataFrame([("k", "1", "Old")], "chave_mestre string, ean string, nome_padronizado string")
    new = spark.createDataFrame([("k", "2", "Newer", 2), ("k", "3", "New", 1), ("n", None, "A", 1), ("n", None, "B", 2)], "chave_mestre string, ean string, nome_padronizado string, ordinal int")
    assert {tuple(r) for r in ingest.upsert_master(old, new).collect()} == {("k", "1", "Newer"), ("n", None, "B")}
    stores = "insignia string, external_id string, telefone string, ativa boolean"
    merged = ingest.upsert_stores(spark.createDataFrame([("A", "1", "9", False), ("A", "2", "8", False)], stores), spark.createDataFrame([("A", "1", None, None), ("A", "1", "7", None)], stores))
    assert {tuple(r) for r in merged.collect()} == {("A", "1", "7", True), ("A", "2", "8", False)}
    found = ingest.validate_stores(spark.createDataFrame([("A", "x", "1", None, "1", "1"), ("A", "x", "", "f", "1", "1"), ("A", "x", "1", "f", "1", "1")], "insignia string, nome_loja string, external_id string, fonte string, latitude string, longitude string"))
    assert [r["erro"] for r in found.collect()] == ["fonte em falta", "external_id em falta", None]


def test_quartiles_interpolate_and_take_hot_prices(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("b", 5.0), (None, 1.0), (None, 2.0), ("c", -1.0), *[("d", 7.0)] * 9, ("d", 8.0)]
    found = {r["insignia"]: tuple(r)[1:] for r in quality.price_quartiles(spark.createDataFrame(rows, "insignia string, preco double")).collect()}
    assert found == {"a": (1.0, 1.75, 2.5, 4.75, 10.0), "b": (5.0, 5.0, 5.0, 5.0, 5.0), None: (1.0, 1.25, 1.5, 1.75, 2.0), "d": (7.0, 7.0, 7.0, 7.0, 8.0)}


def test_listings_and_labels(spark):
    rows = spark.createDataFrame([(1, "b", 2.0, False), (2, "a", None, True), (3, "c", 1.0, None)], "id_produto_loja int, nome string, preco double, em_promocao boolean")
    order = lambda by: [r["id_produto_loja"] for r in quality.listing(rows, by).collect()]
    assert [order(by) for by in ("nome", "mais_barato", "mais_caro", "promocoes")] == [[2, 1, 3], [3, 1, 2], [1, 3, 2], [2, 1, 3]]
    chains = spark.createDataFrame([("x", 3.5, 2), ("y", 2.0, 1), ("z", None, 0)], "insignia string, total double, encontrados int")
    found = quality.coverage_labels(chains, 2).collect()
    assert [(r["insignia"], r["itens_em_falta"], r["completa"]) for r in found] == [("y", 1, False), ("x", 0, True), ("z", 2, False)]
    assert [r["etiqueta"] for r in found[:2]] == ["2.00€  (1/2)", "3.50€"]


def test_products_without_quantity(spark):
    rows = spark.createDataFrame([("b", None, "g"), ("a", 1.0, None), ("c", 1.0, "g")], "nome string, quantidade_valor double, quantidade_unidade string")
    assert [r["nome"] for r in quality.without_quantity(rows).collect()] == ["a", "b"]


def test_unknown_promotions_are_none(spark):
    row = spark.createDataFrame([(None, True, 1.0), (True, None, 1.0)], "a boolean, b boolean, p double")
    assert [r[0] for r in row.select(monitor.alert_type(F.col("p"), F.col("a"), F.col("b"))).collect()] == ["PROMOÇÃO_INICIADA", "PROMOÇÃO_TERMINADA"]


def test_alerts_in_the_order_of_the_report(spark):
    rows = spark.createDataFrame([(1, "SUBIDA", 2.0), (2, "DESCIDA", -3.0), (3, "DESCIDA", -4.0)], "id_produto_loja int, tipo_alerta string, variacao_pct double")
    assert [r["id_produto_loja"] for r in monitor.grouped_alerts(rows).collect()] == [3, 2, 1]
    assert [r["id_produto_loja"] for r in monitor.largest_alerts(rows, 2).collect()] == [3, 2]


def test_static_fields_and_kinds(spark):
    rows = spark.createDataFrame([(1, date(2026, 1, d), m) for d, m in ((1, None), (2, "x"), (3, None), (4, "y"), (5, None))] + [(2, date(2026, 1, 1), None)], "id_produto_loja int, dia date, marca string")
    found = panel.fill_static(rows, ("marca",)).orderBy("id_produto_loja", "dia").collect()
    assert [r["marca"] for r in found] == ["x", "x", "x", "y", "y", None]
    kinds = panel.typed(spark.createDataFrame([("1.5", "x")], "preco string, id_loja string"), {"preco": "double", "id_loja": "int", "dia": "date"})
    assert kinds.dtypes == [("preco", "double"), ("id_loja", "int")] and kinds.first()[1] is None


def test_panels_are_written_by_chain(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2.0, "A"), (2, 3.0, "B")], "id_produto_loja int, preco double, cadeia string")
    for kind in ("parquet", "csv"):
        panel.write_panel(rows, str(tmp_path / kind), kind)
        assert spark.read.option("header", True).format(kind).load(str(tmp_path / kind)).filter("cadeia = 'B'").count() == 1


def test_ablation_and_chains(spark):
    scores = spark.createDataFrame([(None, 2.0), ("b", 3.0), ("a", 3.0), ("c", 1.0)], "feature string, rmse double")
    assert [(r["feature"], r["delta_rmse"], r["delta_pct"]) for r in forecast.ablation_summary(scores).collect()] == [("a", 1.0, 50.0), ("b", 1.0, 50.0), ("c", -1.0, -50.0)]
    kinds = "insignia string, formato_loja string, localizacao string, canal string"
    old = spark.createDataFrame([], f"id_loja int, {kinds}, data_atualizacao string")
    new = spark.createDataFrame([("b", "x", "y", "z"), ("a", "x", "y", "z"), ("a", "x", "y", "z")], kinds)
    assert sorted((r["id_loja"], r["insignia"]) for r in ingest.upsert_chains(old, new, F.lit("t")).collect()) == [(1, "a"), (2, "b")]


@pytest.mark.parametrize("name", ["standard_names", "quantity_extraction"])
def test_names_of_one_small_file_are_dealt_to_all_cores(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
