"""Models, forecasts over many days, simulations, importance, ablation, and stored versions, against plain versions."""

from __future__ import annotations

import hashlib
import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from feira.operators import forecast, models, panel
from feira.sources import artefacts

KEY = "id_produto_loja"
START = date(2026, 1, 5)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """The features of 12 products over 60 days; the next price falls back to the mean of the week."""
    rng, rows = np.random.default_rng(2), []
    for p in range(12):
        prices = [5.0 + p]
        for d in range(59):
            week = prices[-7:]
            prices.append(max(0.5, round(0.4 * prices[-1] + 0.6 * sum(week) / len(week) + rng.normal(0, 0.4), 2)))
        rows += [(p, START + timedelta(d), v, d % 9 == 0, "kg") for d, v in enumerate(prices) if (p + d) % 11]
    observed = spark.createDataFrame(rows, "id_produto_loja long, dia date, preco double, em_promocao boolean, preco_unitario_unidade string")
    chain_of = spark.createDataFrame([(p, p % 3) for p in range(11)], "id_produto_loja long, cadeia_id int")
    path = str(tmp_path_factory.mktemp("features"))
    panel.features(observed, chain_of=chain_of).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def fitted(table):
    rows = models.complete(table).cache()
    return rows, models.fit_linear(rows.filter("NOT validacao"))


def of_row(model, x) -> float:
    return model.intercept + sum(a * b for a, b in zip(x, model.weights, strict=True))


def rolled(h, day, since, chain) -> list[float]:
    return [h[-1], 0.0, day.weekday(), day.isocalendar().week, day.month, day.day, chain, since, h[-1], h[-2], h[-3], h[-7], float(np.mean(h[-3:])), float(np.mean(h)), float(np.std(h, ddof=1))]


def path_of(model, start, horizon=7, shocks=None) -> list[float]:
    h, x, out = list(start["h"]), list(start["x"]), []
    for i in range(1, horizon + 1):
        p = max(0.01, round(of_row(model, x) + (shocks[i - 1] if shocks else 0.0), 2))
        out.append(p)
        h = [*h[1:], p]
        x = rolled(h, start["ultimo_dia"] + timedelta(i + 1), i + 1, x[6])
    return out


def test_features_are_the_fifteen_in_order(table):
    assert panel.FEATURES[6] == "cadeia_id" and len(panel.FEATURES) == 15
    assert {r[0] for r in table.filter(F.col(KEY) == 11).select("cadeia_id").distinct().collect()} == {-1}


def test_linear_fit_equals_least_squares(fitted):
    rows, model = fitted
    got = rows.filter("NOT validacao").select("x", models.TARGET).collect()
    x, y = np.array([r[0] for r in got]), np.array([r[1] for r in got])
    cx, cy = x - x.mean(axis=0), y - y.mean()
    left = cx.T @ cx / len(y)
    own = np.diag(left).copy()
    left[np.diag_indices(len(own))] = np.where(own <= 1e-9, 1, own * 1.001)
    assert np.allclose(model.weights, np.linalg.solve(left, cx.T @ cy / len(y)), atol=1e-5)
    naive = rows.filter("validacao").select(F.avg((F.col(models.TARGET) - F.col("preco")) ** 2)).first()[0]
    mine = rows.filter("validacao").select(F.avg((F.col(models.TARGET) - model.predict(F.col("x"))) ** 2)).first()[0]
    assert mine < naive


def test_nothing_to_fit_on(table):
    with pytest.raises(ValueError):
        models.fit_linear(models.complete(table.limit(0)))


def test_recursive_forecast_equals_a_loop(table, fitted):
    model, points = fitted[1], models.starting_points(table)
    found: dict[int, list] = {}
    for r in models.recursive_forecast(points, model.predict, 9).orderBy(KEY, "data").collect():
        found.setdefault(r[KEY], []).append((r["data"], r["preco_previsto"]))
    for start in points.collect():
        days = [start["ultimo_dia"] + timedelta(i) for i in range(1, 10)]
        assert found[start[KEY]] == list(zip(days, path_of(model, start, 9), strict=True))


def test_forecast_stays_above_a_cent_and_needs_a_week(spark, table):
    falls = models.Linear(panel.FEATURES, tuple([1.0] + [0.0] * 14), -100.0)
    assert {r[0] for r in models.recursive_forecast(models.starting_points(table), falls.predict).select("preco_previsto").collect()} == {0.01}
    short = table.filter((F.col(KEY) == 3) & (F.col("dia") < F.lit(START + timedelta(12))))
    assert models.starting_points(short).count() == 0


def test_simulations_equal_a_loop(table, fitted):
    rows, model = fitted
    points, errors = models.starting_points(table), models.residuals(rows.filter("NOT validacao"), model.predict, 10)
    held = {r[KEY]: r["erros"] for r in errors.filter(F.col(KEY) != 4).collect()}
    found = {(r[KEY], r["data"]): r for r in models.simulated_forecast(points, errors.filter(F.col(KEY) != 4), model.predict, 3, 20, seed=7).collect()}
    for start in points.collect():
        mine = held.get(start[KEY], [])
        draw = lambda s, i: mine[int(hashlib.md5(f"7:{start[KEY]}:{s}:{i}".encode()).hexdigest()[:8], 16) % len(mine)] if mine else 0.0  # noqa: B023, E731
        paths = np.array([path_of(model, start, 3, [draw(s, i) for i in (1, 2, 3)]) for s in range(1, 21)])
        for i in range(3):
            r = found[(start[KEY], start["ultimo_dia"] + timedelta(i + 1))]
            wanted = (paths[:, i].mean(), paths[:, i].std(), *np.percentile(paths[:, i], [5, 95]))
            assert np.allclose((r["preco_medio"], r["preco_std"], r["ic_5pct"], r["ic_95pct"]), wanted, atol=1e-9)
    assert forecast.buy_or_wait(models.simulated_forecast(points, errors, model.predict), F.col("preco_atual")).count() == 12


def test_features_that_matter(fitted):
    rows, model = fitted
    scores = {r["feature"]: r["rmse"] for r in models.ablation_scores(rows, model.predict).collect()}
    base = scores.pop(None)
    assert len(scores) == 15 and math.isclose(scores["promo_flag"], base, rel_tol=0.3) and max(scores, key=scores.get) in {"preco", "media_movel_7", "lag_1"}
    gains = {r["feature"]: r["importancia"] for r in models.permutation_importance(rows, model.predict, repeats=2, letters=1).collect()}
    assert len(gains) == 15 and max(gains, key=gains.get) in {"preco", "media_movel_7", "lag_1"} and gains["media_movel_7"] > 10 * abs(gains["dayofmonth"])


def test_permuted_values_are_all_dealt(spark):
    rows = spark.createDataFrame([(i, START, float(i), [float(i)]) for i in range(40)], "id_produto_loja long, dia date, target_t_plus_1 double, x array<double>")
    order = sorted(range(40), key=lambda i: hashlib.md5(f"1:1:{i}:{START}".encode()).hexdigest())
    after = {a: b for a, b in zip(order, [*order[1:], order[0]], strict=True)}
    wanted = math.sqrt(sum((a - b) ** 2 for a, b in after.items()) / 40)
    got = models.permutation_importance(rows, lambda x: x[0], ("f",), repeats=1, seed=1).first()["importancia"]
    assert math.isclose(got, wanted)


def plain_arima(prices, horizon):
    w = np.diff(prices)

    def score(phi, theta):
        e = total = 0.0
        for t in range(1, len(w)):
            e = w[t] - phi * w[t - 1] - theta * e
            total += e * e
        return total, e

    best = min((score(p / 10, q / 10)[0], p / 10, q / 10) for p in range(-9, 10) for q in range(-9, 10))
    near = [(best[1] + i / 100, best[2] + j / 100) for i in range(-10, 11) for j in range(-10, 11)]
    _, phi, theta = min((score(p, q)[0], p, q) for p, q in near if abs(p) < 0.995 and abs(q) < 0.995)
    change, out = phi * w[-1] + theta * score(phi, theta)[1], []
    for _ in range(horizon):
        out.append((out[-1] if out else prices[-1]) + change)
        change *= phi
    return phi, theta, out


def test_arima_equals_a_loop_and_finds_the_coefficients(spark):
    rng = np.random.default_rng(4)
    e = rng.normal(size=900)
    w = np.zeros(900)
    for t in range(1, 900):
        w[t] = 0.6 * w[t - 1] + e[t] + 0.3 * e[t - 1]
    long = 50 + np.cumsum(w)
    phi, theta, _ = plain_arima(long[:400], 1)
    assert abs(phi - 0.6) < 0.15 and abs(theta - 0.3) < 0.2
    series = {1: long[:60], 2: np.array([3.0, 3.0, 3.0, 3.0, 3.0]), 3: np.array([1.0, 2.0, 1.5]), 4: long[100:117], 5: np.array([1.0, 2.0, 1.5, 4.0])}
    rows = [(k, START + timedelta(i), float(v)) for k, s in series.items() for i, v in enumerate(s)]
    got: dict[int, list] = {}
    for r in models.arima(spark.createDataFrame(rows, "id_produto_loja long, dia date, preco double"), 4).orderBy(KEY, "passo").collect():
        got.setdefault(r[KEY], []).append(r["previsao"])
    assert got[3] == [None] * 4 and got[2] == [3.0] * 4
    for k in (1, 4, 5):
        assert np.allclose(got[k], plain_arima(series[k], 4)[2])


def test_boosted_trees_beat_the_last_price(spark):
    rng = np.random.default_rng(8)
    rows = [(p, START + timedelta(d), float(5 + p + 3 * (d % 7 == 3) + rng.normal(0, 0.1)), False, "kg") for p in range(30) for d in range(70)]
    observed = spark.createDataFrame(rows, "id_produto_loja long, dia date, preco double, em_promocao boolean, preco_unitario_unidade string")
    known = models.complete(panel.features(observed)).cache()
    model = models.fit_boosted(known.filter("NOT validacao"), rounds=30)
    found = models.boosted_metrics(known.filter("validacao"), model)
    assert set(found.columns) == {KEY, "modelo", "n_amostras", "rmse_euros", "mae_euros", "mape_pct"}
    naive = models.one_step_metrics(known.filter("validacao"), lambda x: x[0], "naive")
    mean = lambda m: m.agg(F.avg("rmse_euros")).first()[0]
    assert found.count() == 30 and mean(found) < 0.7 * mean(naive)


def test_versions_are_published_whole(spark, table, fitted, tmp_path):
    path, model = f"file://{tmp_path}/models", fitted[1]
    assert artefacts.load(spark, path) is None and artefacts.versions(spark, path) == []
    first = models.retrain(table, path)
    assert first["version"] == 1 and first["published"] and first["rmse_before"] is None
    assert artefacts.load(spark, path) == model
    (tmp_path / "models" / "v=2" / "model").mkdir(parents=True)
    assert artefacts.versions(spark, path) == [1]
    worse = models.Linear(model.features, tuple(0.0 for _ in model.weights), 0.0)
    assert artefacts.publish(spark, worse, path, rmse=9.0) == 3 and artefacts.load(spark, path) == worse
    assert artefacts.manifest(spark, path, 3)["rmse"] == 9.0 and artefacts.load(spark, path, 1) == model
    again = models.retrain(table, path)
    assert again["published"] and again["version"] == 4 and again["rmse"] < again["rmse_before"]
    early = models.retrain(table.filter((F.col(KEY) > 8) | (F.col("dia") > F.lit(START + timedelta(45)))), f"{path}")
    assert early["version"] == (5 if early["published"] else 4)
    with pytest.raises(ValueError):
        artefacts.load(spark, path, 2)
