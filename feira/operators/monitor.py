"""Price changes inside a trailing window, and the alerts made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The alert labels, in the order of the report.
ALERTS = (
    "PROMOÇÃO_INICIADA",
    "PROMOÇÃO_TERMINADA",
    "DESCIDA_SIGNIFICATIVA",
    "SUBIDA_SIGNIFICATIVA",
    "DESCIDA",
    "SUBIDA",
    "SEM_ALTERAÇÃO",
)
SIGNIFICANT_PCT = 5.0


def price_changes(rows: DataFrame, since: Column, order: Sequence[str], key: str = "id_produto_loja") -> DataFrame:
    """Products whose price or promotion differs between the oldest and the newest row from ``since`` on.

    ``order`` is a total order of a product's rows. Both ends come from one pre-aggregated pass.
    """
    ends = F.struct("preco", "em_promocao", "data_recolha")
    seen = rows.filter(F.col("data_recolha") >= since).groupBy(key).agg(F.min_by(ends, F.struct(*order)).alias("o"), F.max_by(ends, F.struct(*order)).alias("n"))
    flat = seen.select(
        key,
        F.col("o.preco").alias("preco_antigo"),
        F.col("n.preco").alias("preco_novo"),
        F.col("o.em_promocao").alias("promo_antiga"),
        F.col("n.em_promocao").alias("promo_nova"),
        F.col("o.data_recolha").alias("data_antiga"),
        F.col("n.data_recolha").alias("data_nova"),
    )
    changed = flat.filter(~F.col("preco_antigo").eqNullSafe(F.col("preco_novo")) | ~F.col("promo_antiga").eqNullSafe(F.col("promo_nova")))
    difference = F.col("preco_novo") - F.col("preco_antigo")
    return changed.withColumn("variacao_abs", difference).withColumn("variacao_pct", F.try_divide(difference, F.col("preco_antigo")) * 100)


def alert_type(pct: Column, before: Column, after: Column) -> Column:
    """The label of a change: promotions that begin or end come before the size of the change; an unknown one is none."""
    before, after = F.coalesce(before, F.lit(False)), F.coalesce(after, F.lit(False))
    return (
        F.when(~before & after, ALERTS[0])
        .when(before & ~after, ALERTS[1])
        .when(pct <= -SIGNIFICANT_PCT, ALERTS[2])
        .when(pct >= SIGNIFICANT_PCT, ALERTS[3])
        .when(pct < 0, ALERTS[4])
        .when(pct > 0, ALERTS[5])
        .otherwise(ALERTS[6])
    )


def alerts(changes: DataFrame, threshold_pct: float = 2.0) -> DataFrame:
    """Changes of at least the threshold, and all that begin or end a promotion, labelled."""
    labelled = changes.withColumn("tipo_alerta", alert_type(F.col("variacao_pct"), F.col("promo_antiga"), F.col("promo_nova")))
    return labelled.filter((F.abs("variacao_pct") >= threshold_pct) | F.col("tipo_alerta").isin(*ALERTS[:2]))


def alert_report(found: DataFrame) -> DataFrame:
    """Number and largest change of each alert type, in the report's order."""
    place = F.array_position(F.array(*[F.lit(a) for a in ALERTS]), F.col("tipo_alerta")).cast("int")
    return found.groupBy("tipo_alerta").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("variacao_pct")).alias("maior")).withColumn("lugar", place).orderBy("lugar")


def largest_alerts(found: DataFrame, top: int = 5, key: str = "id_produto_loja") -> DataFrame:
    """The ``top`` alerts by the size of the change, in either direction."""
    return found.orderBy(F.desc_nulls_last(F.abs("variacao_pct")), key).limit(top)


def grouped_alerts(found: DataFrame, key: str = "id_produto_loja") -> DataFrame:
    """All alerts with the ``lugar`` of their type in the report, in its order, the largest change of a type first."""
    kind = F.array_position(F.array(*[F.lit(a) for a in ALERTS]), F.col("tipo_alerta")).cast("int")
    return found.withColumn("lugar", kind).orderBy("lugar", F.desc_nulls_last(F.abs("variacao_pct")), key)


def product_history(rows: DataFrame, product: int, order: Sequence[str], since: Column | None = None) -> DataFrame:
    """One product's rows in order, with the direction of each change (-1, 0, 1; null for the first)."""
    own = rows.filter(F.col("id_produto_loja") == product)
    own = own.filter(F.col("data_recolha") >= since) if since is not None else own
    before = F.lag("preco").over(Window.partitionBy("id_produto_loja").orderBy(*order))
    return own.withColumn("sentido", F.signum(F.col("preco") - before).cast("int"))
