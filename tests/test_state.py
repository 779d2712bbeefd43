"""Keyed state of the incremental path, the refreshed panel, and runs of steps."""

from __future__ import annotations

import time
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from feira.operators import panel
from feira.streaming import state, steps

NEW = state.SNAPSHOT + ", ordinal long"


def batch(spark, *rows):
    made = [(k, datetime(2026, 1, day, 12), Decimal(price), None, False, agent, i) for i, (k, day, price, agent) in enumerate(rows)]
    return spark.createDataFrame(made, NEW)


def files(root):
    return {p.relative_to(root): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def prices(rows):
    return {r["id_produto_loja"]: (r["data_recolha"].day, str(r["preco"])) for r in rows.collect()}


def test_batches_touch_their_buckets_and_days_only(spark, tmp_path):
    root, at = tmp_path / "t", f"file://{tmp_path}/t"
    first = batch(spark, *((f"k{i}", 1, "1.00", "a") for i in range(40)))
    state.apply_batch(first, at, 1, buckets=8)
    before = files(root)
    late = batch(spark, ("k1", 3, "2.00", "a"), ("k1", 3, "9.00", "a"), ("k2", 1, "5.00", "b"), ("k3", 1, "7.00", "a"))
    said = state.apply_batch(late, at, 2, buckets=8)
    assert {p: t for p, t in files(root).items() if p in before} == before
    touched = [b for b, n in said["buckets"].items() if n == 2]
    assert 0 < len(touched) <= 3 and said["days"] == {"2026-01-01": [1, 2], "2026-01-03": [2]}
    now = prices(state.snapshot(spark, at, 2))
    assert len(now) == 40 and now["k1"] == (3, "9.00") and now["k2"] == (1, "5.00") and now["k3"] == (1, "7.00") and now["k4"] == (1, "1.00")
    history = state.history(spark, at, 2)
    assert history.count() == 42 and sorted(str(r[0]) for r in history.filter("id_produto_loja = 'k1'").select("preco").collect()) == ["1.00", "2.00"]
    assert state.history(spark, at, 2, ["2026-01-03"]).count() == 1 and prices(state.snapshot(spark, at, 1))["k1"] == (1, "1.00")
    assert [tuple(r) for r in state.touched_since(spark, at, 2).orderBy("id_produto_loja").collect()] == [("k1", date(2026, 1, 3)), ("k2", date(2026, 1, 1))]


def test_late_rows_reach_the_history_only(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    state.apply_batch(batch(spark, ("k", 5, "1.00", "a")), at, 1)
    state.apply_batch(batch(spark, ("k", 2, "8.00", "a")), at, 2)
    assert prices(state.snapshot(spark, at, 2)) == {"k": (5, "1.00")} and state.history(spark, at, 2).count() == 2


def test_batches_are_applied_once_and_whole(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    state.apply_batch(batch(spark, ("k", 1, "1.00", "a")), at, 1)
    broken = tmp_path / "t" / "atuais" / "lote=2" / "balde=0"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"half")
    assert prices(state.snapshot(spark, at, 1)) == {"k": (1, "1.00")} and state.manifest(spark, at, 2) is None
    second = batch(spark, ("k", 2, "2.00", "a"), ("l", 2, "3.00", "a"))
    assert state.apply_batch(second, at, 2) == state.apply_batch(batch(spark, ("k", 9, "9.00", "a")), at, 2)
    assert prices(state.snapshot(spark, at, 2)) == {"k": (2, "2.00"), "l": (2, "3.00")}
    state.apply_batch(batch(spark).limit(0), at, 3)
    assert state.snapshot(spark, at, 3).count() == 2 and state.history(spark, at, 3).count() == 3
    with pytest.raises(ValueError):
        state.apply_batch(second, at, 9)


def test_refreshed_panel_equals_a_rebuilt_one(spark):
    start = date(2026, 1, 1)
    rows = [(p, start + timedelta(d), float(10 + (d * p) % 7), d % 4 == 0, "kg" if d % 3 else "un") for p in (1, 2, 3) for d in (0, 1, 2, 4, 5, 9, 10, 11, 14, 20, 26) if not (p == 3 and d < 20)]
    schema = "id_produto_loja long, dia date, preco double, em_promocao boolean, preco_unitario_unidade string"
    every = spark.createDataFrame(rows, schema)
    for name, late in (("tail", F.col("dia") > "2026-01-18"), ("middle", (F.col(panel.KEY) == 2) & (F.col("dia") == "2026-01-06")), ("product", F.col(panel.KEY) == 3), ("first", F.col("dia") == "2026-01-01"), ("none", F.lit(False))):
        old, since = panel.features(every.filter(~late)), every.filter(late).groupBy(panel.KEY).agg(F.min("dia").alias("dia"))
        found = panel.refresh(old, panel.daily(every.join(since.select(panel.KEY, F.col("dia").alias("d")), panel.KEY).filter("dia >= d")), since)
        columns = sorted(old.columns)
        assert sorted(map(str, found.select(*columns).collect())) == sorted(map(str, panel.features(every).select(*columns).collect())), name


def test_steps_go_on_after_a_failure(spark):
    def slow(session):
        session.range(0, 4, 1, 4).rdd.map(lambda _: time.sleep(30)).count()

    found = steps.run_steps(spark, [("a", lambda s: s.range(3).count()), ("b", lambda s: 1 / 0), ("c", slow), ("d", lambda s: s.range(2).collect())], limit_seconds=6)
    assert [(r["passo"], r["estado"]) for r in found.orderBy("ordem").collect()] == [("a", "ok"), ("b", "erro"), ("c", "tempo_esgotado"), ("d", "ok")]
    assert "ZeroDivisionError" in found.filter("passo = 'b'").first()["erro"]
