"""Baseline forecasts, their errors, and the comparison of models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "id_produto_loja"


def naive(observed: DataFrame, horizon: int = 7) -> DataFrame:
    """The last price for each day of the horizon."""
    last = observed.groupBy(KEY).agg(F.max_by("preco", "dia").alias("previsao"))
    return last.withColumn("passo", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


def moving_average(observed: DataFrame, width: int, horizon: int = 7) -> DataFrame:
    """The mean of the last ``width`` rows for each day of the horizon."""
    place = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("dia")))
    last = observed.withColumn("_n", place).filter(F.col("_n") <= width).groupBy(KEY).agg(F.round(F.avg("preco"), 8).alias("previsao"))
    return last.withColumn("passo", F.explode(F.sequence(F.lit(1), F.lit(horizon))))


BASELINES = {
    "naive": naive,
    "media_movel_3d": lambda observed, horizon=7: moving_average(observed, 3, horizon),
    "media_movel_7d": lambda observed, horizon=7: moving_average(observed, 7, horizon),
}


def errors(rows: DataFrame, *by: str) -> DataFrame:
    """``n_amostras``, ``rmse_euros``, ``mae_euros`` and ``mape_pct`` of ``real`` against ``previsao`` per group.

    Real prices of a cent or less are left out of the percentage. A group with a missing forecast has null errors.
    """
    off = F.col("previsao") - F.col("real")
    whole = F.count("previsao") == F.count(F.lit(1))
    guarded = lambda x: F.when(whole, F.round(x, 8))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_amostras"),
        guarded(F.sqrt(F.avg(off * off))).alias("rmse_euros"),
        guarded(F.avg(F.abs(off))).alias("mae_euros"),
        guarded(100 * F.avg(F.when(F.col("real") > 0.01, F.abs(F.try_divide(off, F.col("real")))))).alias("mape_pct"),
    )


def evaluate_baselines(observed: DataFrame, window: int = 7, more: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Errors of every baseline on each product's last ``window`` rows, forecast from the rows before.

    One aggregate per product gives all forecasts and the rows to test. ``more`` names models that turn the array of the
    prices before into an array of ``window`` forecasts.
    """
    whole = Window.partitionBy(KEY)
    placed = observed.withColumns({"_n": F.row_number().over(whole.orderBy(F.desc("dia"))), "_all": F.count(F.lit(1)).over(whole)}).filter(F.col("_all") >= 2 * window + 1)
    before = F.col("_n") > window
    mean = lambda width: F.round(F.avg(F.when(before & (F.col("_n") <= window + width), F.col("preco"))), 8)
    series = F.transform(F.array_sort(F.collect_list(F.when(before, F.struct("dia", F.col("preco").cast("double").alias("preco"))))), lambda v: v["preco"])
    tests = F.collect_list(F.when(~before, F.struct((window + 1 - F.col("_n")).alias("passo"), F.col("preco").alias("real"))))
    found = {"naive": F.max_by("preco", F.when(before, F.col("dia"))), "media_movel_3d": mean(3), "media_movel_7d": mean(7)}
    wanted = [*([series.alias("_serie")] if more else []), tests.alias("_testes"), *(x.alias(name) for name, x in found.items())]
    known = placed.groupBy(KEY).agg(*wanted)
    forecasts = {name: F.array_repeat(F.col(name), window) for name in found}
    if more:
        known = known.withColumns({name: model(F.col("_serie")) for name, model in more.items()})
        forecasts |= {name: F.col(name) for name in more}
    models = F.array(*(F.struct(F.lit(name).alias("modelo"), values.alias("valores")) for name, values in forecasts.items()))
    scored = known.select(KEY, "_testes", F.explode(models).alias("_m")).select(KEY, F.col("_m.modelo").alias("modelo"), F.col("_m.valores").alias("_v"), F.explode("_testes").alias("_t"))
    return errors(scored.select(KEY, "modelo", F.col("_t.real").alias("real"), F.get(F.col("_v"), F.col("_t.passo") - 1).alias("previsao")), KEY, "modelo")


def common_products(metrics: DataFrame) -> DataFrame:
    """Metrics of the products that every model was evaluated on."""
    models = metrics.agg(F.countDistinct("modelo").alias("modelos"))
    whole = metrics.groupBy(KEY).agg(F.countDistinct("modelo").alias("n")).crossJoin(models).filter("n = modelos").select(KEY)  # one row
    return metrics.join(whole, KEY, "left_semi")


def model_summary(metrics: DataFrame) -> DataFrame:
    """Products, mean and deviation of the errors per model."""
    return metrics.groupBy("modelo").agg(
        F.count("rmse_euros").alias("n"),
        F.round(F.avg("rmse_euros"), 6).alias("rmse_medio"),
        F.round(F.stddev_samp("rmse_euros"), 6).alias("rmse_desvio"),
        F.round(F.avg("mae_euros"), 6).alias("mae_medio"),
        F.round(F.avg("mape_pct"), 6).alias("mape_medio"),
    )


def win_rate(metrics: DataFrame, digits: int = 4) -> DataFrame:
    """Share of the products on which a model has the least error, rounded; ties go to the first name."""
    best = metrics.filter("rmse_euros IS NOT NULL").groupBy(KEY).agg(F.min(F.struct(F.round("rmse_euros", digits), "modelo")).alias("m"))
    counted = best.groupBy(F.col("m.modelo").alias("modelo")).agg(F.count(F.lit(1)).alias("vitorias"))
    total = counted.agg(F.sum("vitorias").alias("total"))
    return counted.crossJoin(total).select("modelo", "vitorias", (100.0 * F.col("vitorias") / F.col("total")).alias("pct"))  # one row


def gain_over(metrics: DataFrame, base: str = "naive") -> DataFrame:
    """Per model the mean errors of the products that it and ``base`` were both evaluated on, and what it gains on ``base``."""
    fields = ("rmse_euros", "mae_euros", "mape_pct")
    other = metrics.filter(F.col("modelo") == base).select(KEY, *(F.col(c).alias(f"_{c}") for c in fields))
    met = metrics.filter(F.col("modelo") != base).join(other, KEY)
    means = met.groupBy("modelo").agg(F.count(F.lit(1)).alias("produtos"), *(F.avg(c).alias(c) for c in fields), *(F.avg(f"_{c}").alias(f"_{c}") for c in fields))
    return means.select("modelo", "produtos", *fields, *((F.col(f"_{c}") - F.col(c)).alias(f"ganho_{c}") for c in fields))


def ablation_summary(scores: DataFrame) -> DataFrame:
    """``feature`` and ``rmse`` without it (null feature: with all) to the rise in euros and percent, the largest first."""
    base = scores.filter("feature IS NULL").select(F.col("rmse").alias("rmse_base"))
    off = scores.filter("feature IS NOT NULL").crossJoin(base)  # one row
    rise = F.col("rmse") - F.col("rmse_base")
    return off.withColumns({"delta_rmse": rise, "delta_pct": F.try_divide(rise, F.col("rmse_base")) * 100}).orderBy(F.desc("delta_rmse"), "feature")


def buy_or_wait(forecast: DataFrame, now: Column, threshold_pct: float = 2.0) -> DataFrame:
    """Per product, whether the least forecast mean is far enough below the price of today to wait for it; of equal means the first day counts."""
    rolled = forecast.groupBy(KEY).agg(F.min("preco_medio").alias("minimo"), F.min_by("data", F.struct("preco_medio", "data")).alias("melhor_dia"), F.max(now).alias("preco_atual"))
    drop = F.greatest(F.try_divide(F.col("preco_atual") - F.col("minimo"), F.col("preco_atual")) * 100, F.lit(0.0))
    return rolled.withColumn("queda_pct", drop).withColumn("decisao", F.when(F.col("queda_pct") >= threshold_pct, "aguardar").otherwise("comprar_agora"))
