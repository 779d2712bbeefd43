"""Daily aggregates, the gap-free panel and its features.

Series are partitioned by product, so a task holds a product's days, never a day's
products. The calendar is bounded by a product's own first and last day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = "id_produto_loja"
STATIC = ("id_produto_mestre", "id_loja", "cadeia", "canal", "nome_produto", "marca", "categoria_geral", "quantidade_valor", "quantidade_unidade")
LAGS = (1, 2, 3, 7)
FEATURES = ("preco", "promo_flag", "weekday", "weekofyear", "month", "dayofmonth", "cadeia_id", "dias_desde_ultima_obs", *(f"lag_{n}" for n in LAGS), "media_movel_3", "media_movel_7", "desvio_movel_7")


def _days() -> WindowSpec:
    """A product's days in order; made on use, as it needs a session."""
    return Window.partitionBy(KEY).orderBy("dia")


def daily(rows: DataFrame) -> DataFrame:
    """Mean price, most frequent unit (the least on ties), whether any row was a promotion, and row count, per product and day."""
    return rows.groupBy(KEY, "dia").agg(
        F.round(F.avg("preco"), 8).alias("preco"),
        F.mode("preco_unitario_unidade", True).alias("preco_unitario_unidade"),
        F.max("em_promocao").alias("em_promocao"),
        F.count(F.lit(1)).alias("num_obs"),
    )


def daily_wide(rows: DataFrame, keys: tuple[str, ...] = STATIC) -> DataFrame:
    """One row per day, product and static fields (null counts as a value): mean price, greatest original price, mean
    and most frequent unit (the least on ties), whether any row was a promotion, and row count."""
    return rows.groupBy("dia", KEY, *keys).agg(
        F.avg("preco").alias("preco"),
        F.max("preco_original").alias("preco_original"),
        F.avg("preco_unitario_valor").alias("preco_unitario_valor"),
        F.mode("preco_unitario_unidade", True).alias("preco_unitario_unidade"),
        F.coalesce(F.max("em_promocao"), F.lit(False)).alias("promo_flag"),
        F.count(F.lit(1)).alias("observacoes_no_dia"),
    )


def fill_static(panel: DataFrame, columns: tuple[str, ...] = STATIC) -> DataFrame:
    """Fields of a product on days without a row: the last known value, else the next known one."""
    so_far, from_here = _days().rowsBetween(Window.unboundedPreceding, 0), _days().rowsBetween(0, Window.unboundedFollowing)
    return panel.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.first(c, ignorenulls=True).over(from_here)) for c in columns})


def scaled(table: DataFrame, columns: tuple[str, ...] = FEATURES, window: int = 7) -> DataFrame:
    """``columns`` brought to 0..1 by the least and greatest value of each product's rows before the last ``window``.

    A column without a range there is divided by 1. Rows of series too short to be split are left out.
    """
    ranges = split_last(table, window)
    whole = Window.partitionBy(KEY)
    known = lambda f, c: f(F.when(~F.col("validacao"), F.col(c).cast("double"))).over(whole)
    span = lambda c: known(F.max, c) - known(F.min, c)
    return ranges.withColumns({f"{c}_norm": (F.col(c) - known(F.min, c)) / F.when(span(c) == 0, F.lit(1.0)).otherwise(span(c)) for c in columns})


def context(table: DataFrame, prices: int = 7) -> DataFrame:
    """Per product what a forecast starts from: first and last day, last price, and the last ``prices`` prices in order."""
    place = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc("dia")))
    last = F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= prices, F.struct("dia", "preco")))), lambda x: x["preco"])
    return table.withColumn("_n", place).groupBy(KEY).agg(F.min("dia").alias("primeiro_dia"), F.max("dia").alias("ultimo_dia"), F.max_by("preco", "dia").alias("preco_atual"), last.alias("ultimos_precos"))


def typed(rows: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns in their kinds; what can't be read as one is null. Columns that are missing are left out."""
    return rows.withColumns({c: F.col(c).try_cast(k) for c, k in kinds.items() if c in rows.columns})


def write_panel(panel: DataFrame, path: str, kind: str = "parquet") -> None:
    """The panel in folders by chain (``cadeia``), as Parquet or CSV with a header."""
    panel.write.mode("overwrite").option("header", True).partitionBy("cadeia").format(kind).save(path)


def expand(observed: DataFrame) -> DataFrame:
    """Every day from a product's first to its last; prices and units are carried forward, promotions are not."""
    spans = observed.groupBy(KEY).agg(F.min("dia").alias("first"), F.max("dia").alias("last"))
    calendar = spans.select(KEY, F.explode(F.sequence("first", "last")).alias("dia"))
    known = observed.withColumn("foi_observado", F.lit(1))
    met = calendar.join(known, [KEY, "dia"], "left")
    so_far = _days().rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda c: F.last(c, ignorenulls=True).over(so_far)
    return met.select(
        KEY,
        "dia",
        carried("preco").alias("preco"),
        carried("preco_unitario_unidade").alias("preco_unitario_unidade"),
        F.coalesce("em_promocao", F.lit(False)).alias("em_promocao"),
        F.coalesce("num_obs", F.lit(0)).cast("long").alias("num_obs"),
        F.coalesce("foi_observado", F.lit(0)).alias("foi_observado"),
        F.datediff("dia", F.last(F.when(F.col("foi_observado") == 1, F.col("dia")), ignorenulls=True).over(so_far)).alias("dias_desde_ultima_obs"),
    )


def calendar_features(panel: DataFrame) -> DataFrame:
    """Weekday (Monday 0), month, ISO week and day of the month."""
    return panel.withColumns({"weekday": F.weekday("dia"), "month": F.month("dia"), "weekofyear": F.weekofyear("dia"), "dayofmonth": F.dayofmonth("dia"), "promo_flag": F.col("em_promocao").cast("int")})


def lag_features(panel: DataFrame, lags: tuple[int, ...] = LAGS) -> DataFrame:
    return panel.withColumns({f"lag_{n}": F.lag("preco", n).over(_days()) for n in lags})


def rolling_features(panel: DataFrame) -> DataFrame:
    """Means of the 3 and 7 rows before, and their deviation (0 if fewer than two)."""
    before = lambda n: _days().rowsBetween(-n, -1)
    return panel.withColumns(
        {
            "media_movel_3": F.round(F.avg("preco").over(before(3)), 10),
            "media_movel_7": F.round(F.avg("preco").over(before(7)), 10),
            "desvio_movel_7": F.round(F.coalesce(F.stddev_samp("preco").over(before(7)), F.lit(0.0)), 6),
        }
    )


def target(panel: DataFrame, horizon: int = 1) -> DataFrame:
    return panel.withColumn(f"target_t_plus_{horizon}", F.lead("preco", horizon).over(_days()))


def chain_ids(panel: DataFrame, chains: DataFrame) -> DataFrame:
    """``cadeia_id`` of each row's chain, -1 for unknown ones."""
    return panel.join(chains.select(F.col("insignia").alias("cadeia"), F.col("id_loja").alias("cadeia_id")), "cadeia", "left").withColumn("cadeia_id", F.coalesce("cadeia_id", F.lit(-1)))


def features(rows: DataFrame, horizon: int = 1, chain_of: DataFrame | None = None) -> DataFrame:
    """From observations to the whole feature table. ``chain_of`` has the ``cadeia_id`` of products; without one it is -1."""
    table = target(rolling_features(lag_features(calendar_features(expand(daily(rows))))), horizon)
    known = table.withColumn("cadeia_id", F.lit(-1)) if chain_of is None else table.join(chain_of.select(KEY, "cadeia_id"), KEY, "left")
    return known.withColumn("cadeia_id", F.coalesce("cadeia_id", F.lit(-1)))


def refresh(old: DataFrame, observed: DataFrame, since: DataFrame) -> DataFrame:
    """The feature table ``old`` brought up to date: per product of ``since``, only the days from its earliest changed ``dia`` on are made anew.

    ``observed`` has the daily rows (``daily``) of the touched products from that day on; others are not read. The 8 days before lend
    their prices to carry, lags and means; the day before gets its new target. The result is what ``features`` of all rows gives.
    """
    ends = old.groupBy(KEY).agg(F.max("dia").alias("_fim"))
    # The days between a product's last one and the change are made too.
    since = since.join(ends, KEY, "left").select(KEY, F.least("dia", F.date_add("_fim", 1)).alias("_desde"), "_fim")
    marked = old.join(since.drop("_fim"), KEY, "left")
    kept = marked.filter(F.col("_desde").isNull() | (F.col("dia") < F.date_sub("_desde", 1))).select(*old.columns)
    lent = marked.filter((F.col("dia") < F.col("_desde")) & (F.col("dia") >= F.date_sub("_desde", 8)))
    last = lent.filter(F.col("dia") == F.date_sub("_desde", 1))
    seed = last.select(KEY, "dia", "preco", "preco_unitario_unidade", F.col("dias_desde_ultima_obs").alias("_dias"), F.lit(True).alias("_semente"))
    fresh = observed.join(since.drop("_fim"), KEY).filter(F.col("dia") >= F.col("_desde"))
    known = fresh.select(KEY, "dia", "preco", "preco_unitario_unidade", "em_promocao", "num_obs", F.lit(0).alias("_dias"), F.lit(False).alias("_semente"))
    anchors = known.unionByName(seed, allowMissingColumns=True)
    spans = anchors.groupBy(KEY).agg(F.min("dia").alias("first"), F.max("dia").alias("last"))
    spans = spans.join(since.drop("_desde"), KEY).withColumn("last", F.greatest("last", F.coalesce("_fim", "last")))
    met = spans.select(KEY, F.explode(F.sequence("first", "last")).alias("dia")).join(anchors, [KEY, "dia"], "left")
    so_far = _days().rowsBetween(Window.unboundedPreceding, 0)
    carried = lambda c: F.last(c, ignorenulls=True).over(so_far)
    anchor_day, anchor_gap = carried("_ancora"), carried("_dias")
    made = met.withColumn("_ancora", F.when(F.col("_dias").isNotNull(), F.col("dia"))).select(
        KEY,
        "dia",
        carried("preco").alias("preco"),
        carried("preco_unitario_unidade").alias("preco_unitario_unidade"),
        F.coalesce("em_promocao", F.lit(False)).alias("em_promocao"),
        F.coalesce("num_obs", F.lit(0)).cast("long").alias("num_obs"),
        F.coalesce(~F.col("_semente"), F.lit(False)).cast("int").alias("foi_observado"),
        (F.datediff("dia", anchor_day) + anchor_gap).alias("dias_desde_ultima_obs"),
        F.coalesce("_semente", F.lit(False)).alias("_semente"),
    )
    chains = marked.filter(F.col("_desde").isNotNull()).groupBy(KEY).agg(F.max("cadeia_id").alias("cadeia_id"))
    base = [KEY, "dia", "preco", "preco_unitario_unidade", "em_promocao", "num_obs", "foi_observado", "dias_desde_ultima_obs"]
    joined = lent.select(*base, F.lit(True).alias("_antes")).unionByName(made.filter("NOT _semente").select(*base, F.lit(False).alias("_antes")))
    remade = target(rolling_features(lag_features(calendar_features(joined)))).join(chains, KEY, "left").withColumn("cadeia_id", F.coalesce("cadeia_id", F.lit(-1)))
    targets = remade.filter(F.col("_antes")).select(KEY, "dia", F.col("target_t_plus_1").alias("_novo"))
    before = last.drop("_desde").join(targets, [KEY, "dia"]).withColumn("target_t_plus_1", F.col("_novo")).select(*old.columns)
    return kept.unionByName(before).unionByName(remade.filter(~F.col("_antes")).select(*old.columns))


def supervised_windows(table: DataFrame, columns: tuple[str, ...] = FEATURES, width: int = 7, kind: str = "float") -> DataFrame:
    """For each observed day, the features of the ``width`` days before (as numbers of ``kind``) and the day's price."""
    frame = _days().rowsBetween(-width, -1)
    whole = F.collect_list(F.array(*[F.col(c).cast(kind) for c in columns])).over(frame)
    return table.na.drop(subset=list(columns)).withColumn("janela", whole).filter((F.size("janela") == width) & (F.col("foi_observado") == 1)).select(KEY, "dia", "janela", F.col("preco").alias("alvo"))


def split_last(table: DataFrame, window: int = 7) -> DataFrame:
    """``validacao``: whether a row is among the last ``window`` of its product; short series are left out."""
    whole = Window.partitionBy(KEY)
    place = F.row_number().over(whole.orderBy(F.desc("dia")))
    return table.withColumns({"validacao": place <= window, "_n": F.count(F.lit(1)).over(whole)}).filter(F.col("_n") >= 2 * window + 1).drop("_n")
