"""Sources, sinks and small operators: errors of readers, JSON results, databases, slugs, units, splits and candidates."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from feira.functions import text
from feira.operators import backtest, basket, ingest, quality, search
from feira.sources import database, records

DERBY = "org.apache.derby.jdbc.EmbeddedDriver"


def test_readers_refuse_what_is_no_array(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        records.read_records(spark, [f"{tmp_path}/*.json"])
    (tmp_path / "b.json").write_text('\n  [{"nome": "b1"}, {"nome": "b2"}]')
    (tmp_path / "a.json").write_text('[{"nome": "a1", "preco": 1.5}]')
    rows = records.read_records(spark, [f"{tmp_path}/*.json", f"{tmp_path}/a.json"])
    assert [r["nome"] for r in rows.orderBy("ordinal").collect()] == ["a1", "b1", "b2"]
    (tmp_path / "c.json").write_text('{"nome": "c"}')
    with pytest.raises(ValueError, match="c.json"):
        records.read_records(spark, [f"{tmp_path}/*.json"])


def test_results_hold_numbers_that_json_can(spark, tmp_path):
    rows = spark.createDataFrame([(1, float("nan"), [1.0, float("inf")], "x"), (2, 2.5, None, None)], "i int, v double, a array<double>, s string")
    records.write_results(rows, f"{tmp_path}/r")
    found = sorted((json.loads(line) for p in (tmp_path / "r").glob("part-*") for line in p.read_text().splitlines()), key=lambda r: r["i"])
    assert found == [{"i": 1, "v": None, "a": [1.0, None], "s": "x"}, {"i": 2, "v": 2.5, "a": None, "s": None}]
    marks = spark.createDataFrame([(2, "2026-01-02", 9, 1.0, "iqr"), (1, "2026-01-03", 8, 2.0, "iqr"), (1, "2026-01-01", 7, 3.0, "iqr")], "id_produto_loja int, dia string, id_historico int, preco double, criterio string")
    records.write_anomalies(marks, f"{tmp_path}/anomalias")
    back = spark.read.option("header", True).csv(f"{tmp_path}/anomalias")
    assert back.columns == marks.columns and back.count() == 3
    records.write_anomalies(marks.limit(0), f"{tmp_path}/anomalias")
    assert spark.read.option("header", True).csv(f"{tmp_path}/anomalias").count() == 0


def test_databases_are_read_in_ranges(spark):
    url = "jdbc:derby:memory:precos;create=true"
    rows = spark.range(100).select(F.when(F.col("id") > 0, F.col("id")).alias("ID"), (F.col("id") % 7).cast("double").alias("PRECO"), F.concat(F.lit("n"), "id").alias("NOME"))
    database.store(rows, url, "PRECOS", "overwrite", 2, DERBY)
    found = database.scan(spark, url, "PRECOS", "ID", 4, DERBY)
    assert found.rdd.getNumPartitions() == 4 and sorted(r["NOME"] for r in found.collect()) == sorted(f"n{i}" for i in range(100))
    kept = found.filter("PRECO = 3.0").select("ID")
    assert "EqualTo(PRECO,3.0)" in kept._jdf.queryExecution().executedPlan().toString() and kept.count() == 14
    assert database.scan(spark, url, "PRECOS", "ID", driver=DERBY, where="ID < 10").count() == 9
    assert database.scan(spark, url, "PRECOS", driver=DERBY).count() == 100
    database.store(rows.limit(0), url, "VAZIA", "overwrite", driver=DERBY)
    assert database.scan(spark, url, "VAZIA", "ID", 4, DERBY).count() == 0


def test_slugs_are_decomposed_and_units_named(spark):
    given = ["Ação Ĉapelo", "ﬀ½ Ⅳ ｆｕｌｌ", "日本 cœur", "Łódź", None]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(text.slug(F.col("t"))).collect()] == ["acao-capelo", "full", "cur", "odz", ""]
    units = spark.createDataFrame([(u,) for u in ("Ltr", "LITROS", "grs", "Cáps", "emb", "kg", "x")], "u string")
    assert [r[0] for r in units.select(text.unit_name(F.col("u"))).collect()] == ["l", "l", "g", "un", "un", "kg", "x"]


def test_records_without_an_id_stay(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("", 3), (None, 4), ("", 5)], "id_externo string, ordinal int")
    assert sorted(r["ordinal"] for r in ingest.first_per_id(rows).collect()) == [1, 3, 4, 5]


OFFER = "nome string, insignia string, id_produto_loja long, preco double, quantidade_valor double, quantidade_unidade string, em_promocao boolean, id_produto_mestre long, marca string"


def test_split_and_candidates(spark):
    rows = [("leite meio gordo", "A", 1, 1.0, 1.0, "l", False, 1, "m"), ("leite meio gordo", "B", 2, 0.9, 1.0, "l", True, 1, "m"), ("pao leite", "A", 3, 2.0, 1.0, "un", False, 2, None)]
    current = spark.createDataFrame(rows, OFFER)
    items = spark.createDataFrame([("leite",), ("queijo",)], "item string")
    split = {r["item"]: (r["nome"], r["preco"], r["insignia"]) for r in basket.split_basket(current, items).collect()}
    assert split == {"leite": ("pao leite", 2.0, "A"), "queijo": (None, None, None)}
    named = [(r["id"], r["etiqueta"]) for r in search.candidates(current, "leite").collect()]
    assert named[0] == (2, "leite meio gordo (B) — 0.90€") and len(named) == 3
    products = current.select("id_produto_mestre", "nome", "marca", "quantidade_valor", "quantidade_unidade").distinct()
    both = search.search(products, current, "leite gordo").collect()
    assert [(r["nome"], r["num_lojas"], r["preco_minimo"]) for r in both] == [("leite meio gordo", 2, 0.9)]
    either = search.search(products, current, "leite azedo").collect()
    assert {r["nome"] for r in either} <= {"leite meio gordo", "pao leite"} and either


def test_lists_of_any_length_find_the_same(spark, monkeypatch):
    names = spark.createDataFrame([(n,) for n in ("leite meio gordo", "pao de leite", "agua", "a b c", "", "queijo da ilha")], "nome string")
    wanted = spark.createDataFrame([("leite",), ("pao leite",), ("gua",), ("b a",), ("zz",), ("",), ("ilha da",), (None,)], "item string")
    found = lambda: sorted((r["item"], r["nome"]) for r in search.containing(names, wanted, F.col("nome"), search.item_words(F.col("item"))).collect())
    short = found()
    monkeypatch.setattr(search, "SHORT_LIST", 2)
    assert found() == short and ("pao leite", "pao de leite") in short and len([n for i, n in short if i == ""]) == 6


def test_decisions_without_choices(spark):
    none = spark.createDataFrame([], "insignia string, custo_total double")
    pairs = spark.createDataFrame([("A", "B", 3.0)], "insignia_a string, insignia_b string, custo_total double")
    one = spark.createDataFrame([("A", 4.0)], "insignia string, custo_total double")
    row = lambda a, b: tuple(basket.route_decision(a, b).select("recomendacao", "poupanca_par").first())
    assert row(none, pairs) == ("single", 0.0) and row(one, pairs) == ("par", 1.0) and row(one, pairs.limit(0)) == ("single", 0.0)


def test_savings_without_a_loyal_chain(spark):
    days = spark.createDataFrame([("a", 1, 2.0, 4.0), ("a", 2, 4.0, 4.0)], "lista string, dia int, custo_minimo double, custo_esperado double")
    none = spark.createDataFrame([], "lista string, insignia string, dias_completos long, fidelidade double, recomendado double, dias long")
    r = backtest.savings(days, none).first()
    assert (r["n_dias"], r["melhor_cadeia"], r["poupanca_aleatorio_eur"], r["poupanca_aleatorio_pct"], r["poupanca_fidelidade_pct"]) == (2, None, 1.0, 25.0, 0.0)
    assert tuple(backtest.overall(backtest.savings(days, none)).first()) == (1, 1.0, 25.0, 0.0)


def test_bins_of_logarithms(spark):
    rows = spark.createDataFrame([(p,) for p in (-1.0, 0.0, 0.5, 1.0, 9.0, 10.0, 99.0, 100.0)], "preco double")
    assert {r["classe"]: r["n"] for r in quality.price_histogram(rows, 1.0, 100.0, 2, log=True).collect()} == {0: 1, 1: 2, 2: 2, 3: 1}
