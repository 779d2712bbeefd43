"""Models of the next day's price, and what is built on one: forecasts over many days, simulations, importance, ablation.

A model is fitted once for all products on the feature table (``panel.features``), from sums over its rows, and
is then a column expression over a row's features. So scoring, forecasting and simulating stay in one stage
by product: a product's state (its last prices and its features) is a row, folded over the days to come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feira.operators import forecast
from feira.operators.panel import FEATURES, KEY, split_last

TARGET = "target_t_plus_1"
RIDGE = 1e-3
LEAST_PRICE = 0.01
HELD = 7
RESIDUALS = 28

Predict = Callable[[Column], Column]


def complete(table: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Rows with all features and the target, marked ``validacao`` if among the last 7 of a product; ``x`` has the features in order.

    Products with fewer than 15 such rows are left out.
    """
    return with_vector(split_last(table.na.drop(subset=[*features, TARGET])), features)


def with_vector(table: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    return table.withColumn("x", F.array(*(F.col(c).cast("double") for c in features)))


# The linear model


@dataclass(frozen=True)
class Linear:
    """The next day's price as a weighted sum of the features."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def predict(self, x: Column) -> Column:
        total = F.lit(self.intercept)
        for i, w in enumerate(self.weights):
            total = total + x[i] * F.lit(w)
        return total


def fit_linear(rows: DataFrame, features: tuple[str, ...] = FEATURES, digits: int = 6) -> Linear:
    """Ridge regression of the target on ``x``, from one pass of sums; weights are rounded to ``digits``.

    The driver gets one row of sums, whose number depends on the features alone. A feature without variance weighs nothing.
    """
    k = len(features)
    z = [*(F.col("x")[i] for i in range(k)), F.col(TARGET).cast("double")]
    means = [F.avg(c).alias(f"m{i}") for i, c in enumerate(z)]
    products = [F.avg(z[i] * z[j]).alias(f"p{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
    got = rows.agg(*means, *products).first()
    if got["m0"] is None:
        raise ValueError("no rows to fit on")
    mean = np.array([got[f"m{i}"] for i in range(k + 1)])
    spread = np.array([[got[f"p{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) - np.outer(mean, mean)
    own = np.diag(spread)[:k]
    left = spread[:k, :k].copy()
    left[np.diag_indices(k)] = np.where(own <= 1e-9, 1.0, own * (1 + RIDGE))
    weights = np.round(np.linalg.solve(left, spread[:k, k]), digits)
    return Linear(tuple(features), tuple(float(w) for w in weights), round(float(mean[k] - weights @ mean[:k]), digits))


def one_step_metrics(validation: DataFrame, predict: Predict, name: str) -> DataFrame:
    """Errors per product of the next-day forecasts on ``validation``, in the form of ``forecast.evaluate_baselines``."""
    rows = validation.select(KEY, F.col(TARGET).alias("real"), predict(F.col("x")).alias("previsao"))
    return forecast.errors(rows, KEY).withColumn("modelo", F.lit(name))


# Forecasts over many days


def starting_points(table: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Per product with 7 or more complete rows: its last day, last price, last 7 prices in order (``h``) and features (``x``)."""
    rows = with_vector(table.na.drop(subset=list(features)), features)
    place = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("dia")))
    held = F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= HELD, F.struct("dia", F.col("preco").cast("double").alias("preco"))))), lambda v: v["preco"])
    known = rows.withColumn("_n", place).groupBy(KEY).agg(F.max("dia").alias("ultimo_dia"), F.max_by("preco", "dia").alias("preco_atual"), held.alias("h"), F.max_by("x", "dia").alias("x"))
    return known.filter(F.size("h") == HELD)


def rolled_features(h: Column, price: Column, day: Column, days_since: Column, chain: Column, features: tuple[str, ...] = FEATURES) -> Column:
    """The features of a day to come from the last 7 prices ``h``, the newest among them: no promotion, and as many days since the last observation."""
    mean = lambda n: F.aggregate(F.slice(h, HELD - n + 1, n), F.lit(0.0), lambda a, v: a + v) / n
    off = F.aggregate(h, F.lit(0.0), lambda a, v: a + (v - mean(HELD)) * (v - mean(HELD)))
    made = {
        "preco": price,
        "promo_flag": F.lit(0.0),
        "weekday": F.weekday(day),
        "month": F.month(day),
        "weekofyear": F.weekofyear(day),
        "dayofmonth": F.dayofmonth(day),
        "cadeia_id": chain,
        "dias_desde_ultima_obs": days_since,
        **{f"lag_{n}": h[HELD - n] for n in range(1, HELD + 1)},
        "media_movel_3": mean(3),
        "media_movel_7": mean(7),
        "desvio_movel_7": F.sqrt(off / (HELD - 1)),
    }
    return F.array(*(made[c].cast("double") for c in features))


def _with(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _fold(predict: Predict, horizon: int, features: tuple[str, ...], shock: Callable[[Column], Column]) -> Column:
    """The forecasts of ``horizon`` days, each from the ones before."""
    chain = F.col("x")[features.index("cadeia_id")] if "cadeia_id" in features else F.lit(0.0)

    def step(state: Column, i: Column) -> Column:
        def roll(p: Column) -> Column:
            return _with(
                F.concat(F.slice(state["h"], 2, HELD - 1), F.array(p)),
                lambda h: F.struct(h.alias("h"), rolled_features(h, p, F.date_add("ultimo_dia", i + 1), i + 1, chain, features).alias("x"), F.concat(state["out"], F.array(p)).alias("out")),
            )

        return _with(F.greatest(F.lit(LEAST_PRICE), F.round(predict(state["x"]) + shock(i), 2)), roll)

    start = F.struct(F.col("h").alias("h"), F.col("x").alias("x"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda s: s["out"])


def recursive_forecast(points: DataFrame, predict: Predict, horizon: int = 7, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """``data`` and ``preco_previsto`` (two decimals, a cent at least) for ``horizon`` days per product of ``starting_points``.

    Each forecast is the next day's price and newest lag. No shuffle: a product's days are folded in its row.
    """
    days = points.select(KEY, "ultimo_dia", "preco_atual", F.posexplode(_fold(predict, horizon, features, lambda i: F.lit(0.0))).alias("_i", "preco_previsto"))
    return days.select(KEY, F.date_add("ultimo_dia", F.col("_i") + 1).alias("data"), "preco_previsto", "preco_atual")


def residuals(training: DataFrame, predict: Predict, last: int = RESIDUALS) -> DataFrame:
    """Per product the errors of its ``last`` training rows, in order of days."""
    place = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("dia")))
    rows = training.select(KEY, "dia", (F.col(TARGET) - predict(F.col("x"))).alias("erro")).withColumn("_n", place).filter(F.col("_n") <= last)
    return rows.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("dia", "erro"))), lambda v: v["erro"]).alias("erros"))


def simulated_forecast(points: DataFrame, errors: DataFrame, predict: Predict, horizon: int = 7, samples: int = 50, seed: int = 42, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Per product and day the mean, population deviation and 5th and 95th percentile of ``samples`` simulated paths.

    A path adds to each forecast one of the product's own ``errors``, drawn by a digest of seed, product, sample and day; a
    product without errors has equal paths. The samples of a product stay in its partition.
    """

    def shock(i: Column) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(KEY).cast("string"), F.col("amostra").cast("string"), i.cast("string")))
        place = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.size("erros")
        return F.when(F.size("erros") > 0, F.get(F.col("erros"), place.cast("int"))).otherwise(0.0)

    known = points.join(errors, KEY, "left").withColumn("erros", F.coalesce("erros", F.array().cast("array<double>")))
    drawn = known.withColumn("amostra", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    paths = drawn.select(KEY, "ultimo_dia", "preco_atual", F.posexplode(_fold(predict, horizon, features, shock)).alias("_i", "preco"))
    return paths.groupBy(KEY, F.date_add("ultimo_dia", F.col("_i") + 1).alias("data")).agg(
        F.max("preco_atual").alias("preco_atual"),
        F.avg("preco").alias("preco_medio"),
        F.stddev_pop("preco").alias("preco_std"),
        F.percentile("preco", F.lit(0.05)).alias("ic_5pct"),
        F.percentile("preco", F.lit(0.95)).alias("ic_95pct"),
    )


# What the features are worth


def _ablated(x: Column, low: Column, feature: Column) -> Column:
    return F.when(feature.isNull(), x).otherwise(F.transform(x, lambda v, i: F.when(i == feature, low[i]).otherwise(v)))


def ablation_scores(rows: DataFrame, predict: Predict, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """``feature`` (null: none) and ``rmse``, the mean over products of the validation error with the feature held at its lowest.

    The lowest value is that of the product's training rows, 0 on the scale of ``panel.scaled``. All variants are scored in one pass.
    """
    known = F.when(~F.col("validacao"), F.col("x"))
    low = rows.select("*", *(F.min(known[i]).over(Window.partitionBy(KEY)).alias(f"_low{i}") for i in range(len(features)))).filter("validacao")
    low = low.withColumn("low", F.array(*(F.col(f"_low{i}") for i in range(len(features)))))
    names = F.array(F.lit(None).cast("string"), *(F.lit(c) for c in features))
    stacked = low.select(KEY, TARGET, "x", "low", F.posexplode(names).alias("_i", "feature"))
    scored = stacked.withColumn("_x", _ablated(F.col("x"), F.col("low"), F.when(F.col("feature").isNotNull(), F.col("_i") - 1)))
    off = F.col(TARGET) - predict(F.col("_x"))
    per_product = scored.groupBy(KEY, "feature").agg(F.sqrt(F.avg(off * off)).alias("rmse"))
    return per_product.groupBy("feature").agg(F.avg("rmse").alias("rmse"))


def permutation_importance(rows: DataFrame, predict: Predict, features: tuple[str, ...] = FEATURES, repeats: int = 5, seed: int = 42, letters: int = 2) -> DataFrame:
    """``feature`` and ``importancia``: by how much the error of the target grows, on average over ``repeats``, when the feature's values are dealt anew.

    In each repeat rows are ordered by a digest, and each takes the feature of the one after it (the last of the first). A task
    orders the rows whose digests share their first ``letters``; the last of them takes from the head of the next part, of
    which there are 16 ** ``letters`` a repeat. All features of all repeats are scored in one pass over the stacked rows.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("volta").cast("string"), F.col(KEY).cast("string"), F.col("dia").cast("string")))
    repeated = rows.select(KEY, "dia", TARGET, "x", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("volta"))
    keyed = repeated.withColumn("_by", digest).withColumn("_part", F.substring("_by", 1, letters))
    heads = keyed.groupBy("volta", "_part").agg(F.min_by("x", F.struct("_by", KEY, "dia")).alias("_head"))
    parts = Window.partitionBy("volta").orderBy("_part")
    first = F.first("_head").over(parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = heads.select("volta", "_part", F.coalesce(F.lead("_head").over(parts), first).alias("_next"))
    within = F.lead("x").over(Window.partitionBy("volta", "_part").orderBy("_by", KEY, "dia"))
    met = keyed.withColumn("_other", within).join(following, ["volta", "_part"]).withColumn("_other", F.coalesce("_other", "_next"))
    names = F.array(F.lit(None).cast("string"), *(F.lit(c) for c in features))
    stacked = met.select("volta", TARGET, "x", "_other", F.posexplode(names).alias("_i", "feature"))
    scored = stacked.withColumn("_x", _ablated(F.col("x"), F.col("_other"), F.when(F.col("feature").isNotNull(), F.col("_i") - 1)))
    off = F.col(TARGET) - predict(F.col("_x"))
    per_repeat = scored.groupBy("volta", "feature").agg(F.sqrt(F.avg(off * off)).alias("rmse"))
    base = per_repeat.filter("feature IS NULL").select("volta", F.col("rmse").alias("base"))
    return per_repeat.filter("feature IS NOT NULL").join(base, "volta").groupBy("feature").agg(F.avg(F.col("rmse") - F.col("base")).alias("importancia"))


# ARIMA(1,1,1)


def _sums_of_squares(series: list[np.ndarray], phi: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Conditional sums of squares and last errors of many series of first differences, each at its own row of candidates."""
    longest = max(len(s) for s in series)
    w = np.zeros((len(series), longest))
    start = np.array([longest - len(s) for s in series])
    for row, s in zip(w, series, strict=True):
        row[longest - len(s) :] = s
    error, total = np.zeros_like(phi), np.zeros_like(phi)
    for t in range(1, longest):
        now = w[:, t, None] - phi * w[:, t - 1, None] - theta * error
        error = np.where((t > start)[:, None], now, 0.0)
        total += error * error
    return total, error


def arima_forecasts(prices: list[np.ndarray], horizon: int) -> list[np.ndarray | None]:
    """ARIMA(1,1,1) forecasts of many series at once: both coefficients to a hundredth by least conditional squares, ten steps of 0.1 first.

    A series of fewer than 4 prices has none.
    """
    out: list[np.ndarray | None] = [None] * len(prices)
    use = [i for i, p in enumerate(prices) if p is not None and len(p) >= 4 and np.isfinite(p).all()]
    if not use:
        return out
    series = [np.diff(prices[i]) for i in use]
    coarse = np.arange(-9, 10) / 10.0
    phi, theta = (np.tile(g.ravel(), (len(use), 1)) for g in np.meshgrid(coarse, coarse, indexing="ij"))
    for fine in (False, True):
        if fine:
            near = np.arange(-10, 11) / 100.0
            step_phi, step_theta = (g.ravel() for g in np.meshgrid(near, near, indexing="ij"))
            phi, theta = best[0][:, None] + step_phi, best[1][:, None] + step_theta  # noqa: F821
        total, error = _sums_of_squares(series, phi, theta)
        total = np.where((np.abs(phi) < 0.995) & (np.abs(theta) < 0.995), total, np.inf)
        pick = total.argmin(axis=1)[:, None]
        best = [np.take_along_axis(a, pick, axis=1)[:, 0] for a in (phi, theta, error)]
    for i, s, p, q, e in zip(use, series, *best, strict=True):
        change, made = p * s[-1] + q * e, []
        level = prices[i][-1]
        for _ in range(horizon):
            level = level + change
            made.append(level)
            change = p * change
        out[i] = np.array(made)
    return out


def arima(observed: DataFrame, horizon: int = 7) -> DataFrame:
    """The ARIMA(1,1,1) forecast for each day of the horizon, null for products of fewer than 4 days.

    A product's prices are an array, one per day; the fit runs over the products of an Arrow batch together.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("dia", F.col("preco").cast("double").alias("preco")))), lambda v: v["preco"])
    series = observed.groupBy(KEY).agg(ordered.alias("precos"))
    return series.select(KEY, F.posexplode(arima_column(horizon)(F.col("precos"))).alias("_i", "previsao")).select(KEY, (F.col("_i") + 1).alias("passo"), "previsao")


def arima_column(horizon: int):
    """A function of a column of price arrays to a column of forecasts."""

    @F.pandas_udf("array<double>")
    def forecasts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            made: list = []
            for k in range(0, len(batch), 128):
                part = arima_forecasts([np.asarray(p, dtype=float) for p in batch.iloc[k : k + 128]], horizon)
                made += [[None] * horizon if f is None else f for f in part]
            yield pd.Series(made)

    return forecasts


# Gradient boosting


def fit_boosted(training: DataFrame, features: tuple[str, ...] = FEATURES, rounds: int = 300, seed: int = 42) -> GBTRegressionModel:
    """Boosted trees for the ratio of the next day's price to the day's; a tenth of the rows, chosen by digest, ends the fit when they stop gaining."""
    held_out = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(KEY).cast("string"), F.col("dia").cast("string"))), 1, 8), 16, 10).cast("long") % 10 == 0
    rows = training.filter(F.col("preco") > LEAST_PRICE).select(KEY, "dia", *(F.col(c).cast("double").alias(c) for c in features), (F.col(TARGET) / F.col("preco")).alias("racio"), held_out.alias("_parar"))
    table = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows)
    booster = GBTRegressor(
        featuresCol="_x", labelCol="racio", predictionCol="_racio", validationIndicatorCol="_parar", maxIter=rounds, stepSize=0.05, maxDepth=5, minInstancesPerNode=20, seed=seed
    )
    return booster.fit(table)


def boosted_metrics(validation: DataFrame, model: GBTRegressionModel, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """Errors per product of the boosted trees' next-day forecasts."""
    rows = validation.select(KEY, TARGET, *(F.col(c).cast("double").alias(c) for c in features))
    scored = model.transform(VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows))
    return forecast.errors(scored.select(KEY, F.col(TARGET).alias("real"), (F.col("preco") * F.col("_racio")).alias("previsao")), KEY).withColumn("modelo", F.lit("gbm"))


# Retraining


def retrain(table: DataFrame, path: str, features: tuple[str, ...] = FEATURES) -> dict:
    """Fits on all rows before each product's last 7 and publishes a version if its mean error there is not above the newest one's.

    Both models are held against the same rows. Gives ``version`` (that in force), ``published``, ``rmse`` and ``rmse_before``.
    """
    from feira.sources import artefacts

    spark, rows = table.sparkSession, complete(table, features)
    model, before = fit_linear(rows.filter("NOT validacao"), features), artefacts.load(spark, path)
    compared = {"rmse": model, **({"rmse_before": before} if isinstance(before, Linear) and before.features == tuple(features) else {})}
    off = {name: F.col(TARGET) - m.predict(F.col("x")) for name, m in compared.items()}
    per_product = rows.filter("validacao").groupBy(KEY).agg(*(F.sqrt(F.avg(x * x)).alias(name) for name, x in off.items()))
    found = per_product.agg(*(F.avg(name).alias(name) for name in compared)).first().asDict()
    better = found.get("rmse_before") is None or found["rmse"] <= found["rmse_before"]
    version = artefacts.publish(spark, model, path, rmse=found["rmse"]) if better else artefacts.versions(spark, path)[-1]
    return {"version": version, "published": better, "rmse": found["rmse"], "rmse_before": found.get("rmse_before")}
