"""The registered queries of the retail analytics, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feira.functions import display, geo, text
from feira.operators import anomaly, backtest, basket, forecast, ingest, models, monitor, panel, quality, search
from feira.plans import views
from feira.plans.registry import ORACLE_SQL, QUERIES, Query
from feira.sources import pages, tree, web
from feira.streaming.prices import trailing_changes

LAT, LON, PER_KM, RADIUS = 39.5, -8.0, 0.2, 150.0
ITEMS = ("red widget", "blue bolt", "small ring")
WITH_UNKNOWN = (*ITEMS, "purple unicorn")
CHAINS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def _flat(rows: DataFrame) -> DataFrame:
    """Days and times as text, to the day."""
    kinds = dict(rows.dtypes)
    return rows.select(*(F.col(c).cast("date").cast("string").alias(c) if kinds[c] in ("date", "timestamp", "timestamp_ntz") else F.col(c) for c in rows.columns))


def _spread(rows: DataFrame) -> DataFrame:
    """Rows for costly expressions, dealt evenly to all cores: a small file of many rows is few splits, or one."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL over the views."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = lambda spark, sf_dir: _flat(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = f"{views.SQL}{sql}"
        return f

    return register


def _since(spark: SparkSession, sf_dir: str, days: int):
    return F.lit(str(views.newest_day(spark, sf_dir))).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")


def _items(spark: SparkSession, items: tuple[str, ...] = ITEMS) -> DataFrame:
    return spark.createDataFrame([(i,) for i in items], "item string")


def _sql_items(items: tuple[str, ...] = ITEMS) -> str:
    return f"itens AS (SELECT unnest({list(items)!r}) AS item)"


def _sql_grams(x: str) -> str:
    return f"list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _sql_similarity(a: str, b: str) -> str:
    return f"(len(list_intersect({_sql_grams(a)}, {_sql_grams(b)}))::DOUBLE / len(list_distinct({_sql_grams(a)} || {_sql_grams(b)})))"


def _sql_km(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"(2 * 6371.0088::DOUBLE * asin(sqrt(least(power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2), 1.0::DOUBLE))))"


def _day(c: str) -> str:
    return f"CAST(CAST({c} AS DATE) AS VARCHAR)"


# Price changes

CHANGES_SQL = """, recentes AS (SELECT * FROM factos WHERE data_recolha >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 365 DAY),
pontas AS (SELECT *, row_number() OVER (PARTITION BY id_produto_loja ORDER BY data_recolha, l_orderkey, l_linenumber, l_suppkey) AS a,
    row_number() OVER (PARTITION BY id_produto_loja ORDER BY data_recolha DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS z FROM recentes),
mudancas AS (SELECT o.id_produto_loja, o.preco AS preco_antigo, n.preco AS preco_novo, o.em_promocao AS promo_antiga, n.em_promocao AS promo_nova, o.data_recolha AS da, n.data_recolha AS dn,
    n.preco - o.preco AS variacao_abs, (n.preco - o.preco) / o.preco * 100 AS variacao_pct
    FROM (SELECT * FROM pontas WHERE a = 1) o JOIN (SELECT * FROM pontas WHERE z = 1) n USING (id_produto_loja)
    WHERE o.preco IS DISTINCT FROM n.preco OR o.em_promocao IS DISTINCT FROM n.em_promocao),
alertas AS (SELECT * FROM (SELECT *, CASE WHEN NOT promo_antiga AND promo_nova THEN 'PROMOÇÃO_INICIADA' WHEN promo_antiga AND NOT promo_nova THEN 'PROMOÇÃO_TERMINADA'
    WHEN variacao_pct <= -5 THEN 'DESCIDA_SIGNIFICATIVA' WHEN variacao_pct >= 5 THEN 'SUBIDA_SIGNIFICATIVA' WHEN variacao_pct < 0 THEN 'DESCIDA' WHEN variacao_pct > 0 THEN 'SUBIDA' ELSE 'SEM_ALTERAÇÃO' END AS tipo_alerta FROM mudancas)
    WHERE abs(variacao_pct) >= 2 OR tipo_alerta IN ('PROMOÇÃO_INICIADA', 'PROMOÇÃO_TERMINADA'))
"""


@query(CHANGES_SQL + f"SELECT * EXCLUDE (da, dn), {_day('da')} AS data_antiga, {_day('dn')} AS data_nova FROM mudancas")
def price_changes(spark, sf_dir):
    return monitor.price_changes(views.facts(spark, sf_dir), _since(spark, sf_dir, 365), views.ORDER)


@query(CHANGES_SQL + f"SELECT id_produto_mestre, nome, a.* EXCLUDE (da, dn), {_day('da')} AS data_antiga, {_day('dn')} AS data_nova FROM alertas a JOIN produtos ON id_produto_mestre = id_produto_loja // 10")
def price_alerts(spark, sf_dir):
    found = monitor.alerts(price_changes(spark, sf_dir)).withColumn("id_produto_mestre", F.floor(F.col("id_produto_loja") / 10))
    return found.join(views.products(spark, sf_dir).select("id_produto_mestre", "nome"), "id_produto_mestre")


@query(CHANGES_SQL + """SELECT tipo_alerta, count(*) AS n, max(abs(variacao_pct)) AS maior,
list_position(['PROMOÇÃO_INICIADA', 'PROMOÇÃO_TERMINADA', 'DESCIDA_SIGNIFICATIVA', 'SUBIDA_SIGNIFICATIVA', 'DESCIDA', 'SUBIDA', 'SEM_ALTERAÇÃO'], tipo_alerta)::INT AS lugar FROM alertas GROUP BY tipo_alerta""")
def alert_report(spark, sf_dir):
    return monitor.alert_report(monitor.alerts(price_changes(spark, sf_dir)))


@query(f""", h AS (SELECT *, lag(preco) OVER (ORDER BY data_recolha, l_orderkey, l_linenumber, l_suppkey) AS antes FROM factos WHERE id_produto_loja = 1003)
SELECT id_produto_loja, insignia, preco, {_day('data_recolha')} AS data_recolha, l_orderkey, sign(preco - antes)::DOUBLE AS sentido FROM h""")
def product_history(spark, sf_dir):
    return monitor.product_history(views.facts(spark, sf_dir), 1003, views.ORDER).select("id_produto_loja", "insignia", "preco", "data_recolha", "l_orderkey", F.col("sentido").cast("double").alias("sentido"))


# Reports


@query(f"SELECT id_produto_loja, nome, preco, em_promocao, {_day('data_recolha')} AS data_recolha FROM atuais_nomes WHERE insignia = 'EUROPE'")
def current_prices_by_chain(spark, sf_dir):
    rows = views.latest(views.facts(spark, sf_dir).filter("insignia = 'EUROPE'")).join(views.products(spark, sf_dir), "id_produto_mestre")
    return rows.select("id_produto_loja", "nome", "preco", "em_promocao", "data_recolha")


@query("""SELECT unnest(['linhas_historico', 'dias_distintos', 'produtos_mestre', 'lojas']) AS metrica, unnest([count(*), count(DISTINCT CAST(data_recolha AS DATE)), count(DISTINCT id_produto_mestre), count(DISTINCT insignia)])::DOUBLE AS valor FROM factos
UNION ALL SELECT unnest(['precos_atuais', 'em_promocao']), unnest([count(*), count(*) FILTER (WHERE em_promocao)])::DOUBLE FROM atuais
UNION ALL SELECT unnest(['lojas_fisicas', 'lojas_ativas']), unnest([count(*), count(*) FILTER (WHERE ativa)])::DOUBLE FROM lojas_fisicas""")
def global_metrics(spark, sf_dir):
    facts = views.facts(spark, sf_dir)
    return quality.global_metrics(facts, views.latest(facts), views.outlets(spark, sf_dir))


@query("SELECT insignia, count(DISTINCT id_produto_loja) AS produtos, count(*) AS observacoes, round(avg(preco), 6) AS preco_medio, count(*) FILTER (WHERE em_promocao) AS promocoes FROM factos GROUP BY insignia")
def coverage_by_chain(spark, sf_dir):
    return quality.coverage_by_chain(views.facts(spark, sf_dir))


@query("SELECT categoria, count(*) AS produtos FROM produtos GROUP BY categoria ORDER BY produtos DESC, categoria LIMIT 10")
def coverage_by_category(spark, sf_dir):
    return quality.coverage_by_category(views.products(spark, sf_dir))


@query("SELECT insignia, count(*) AS total, round(100.0::DOUBLE * count(preco) / count(*), 8) AS pct_preco, round(100.0::DOUBLE * count(preco_original) / count(*), 8) AS pct_preco_original FROM atuais GROUP BY insignia")
def completeness_by_chain(spark, sf_dir):
    return quality.completeness(views.latest(views.facts(spark, sf_dir)), "insignia", ["preco", "preco_original"])


@query(f"SELECT {_day('data_recolha')} AS dia, count(*) AS observacoes, count(DISTINCT id_produto_loja) AS produtos FROM factos WHERE data_recolha >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 30 DAY GROUP BY ALL")
def observations_by_day(spark, sf_dir):
    return quality.observations_by_day(views.facts(spark, sf_dir), _since(spark, sf_dir, 30))


@query("SELECT cidade, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE insignia = '{c}') AS {c.lower().replace(' ', '_')}" for c in CHAINS) + " FROM lojas_fisicas GROUP BY cidade ORDER BY total DESC, cidade LIMIT 20")
def stores_by_city(spark, sf_dir):
    return quality.stores_by_city(views.outlets(spark, sf_dir), list(CHAINS))


@query("""SELECT unnest(['total', 'preco_invalido', 'promocoes_incoerentes', 'sem_preco_original', 'em_promocao']) AS metrica, unnest([count(*), count(*) FILTER (WHERE preco <= 0),
count(*) FILTER (WHERE em_promocao AND (preco_original IS NULL OR preco_original <= preco)), count(*) FILTER (WHERE preco_original IS NULL), count(*) FILTER (WHERE em_promocao)])::DOUBLE AS valor FROM atuais""")
def diagnostics(spark, sf_dir):
    return quality.diagnostics(views.latest(views.facts(spark, sf_dir)))


@query("SELECT id_produto_loja, count(DISTINCT CAST(data_recolha AS DATE)) AS dias, count(*) AS observacoes FROM factos GROUP BY id_produto_loja ORDER BY dias DESC, observacoes DESC, id_produto_loja LIMIT 20")
def most_observed(spark, sf_dir):
    return quality.most_observed(views.facts(spark, sf_dir))


@query("SELECT insignia, min(preco) AS minimo, round(quantile_cont(preco, 0.25), 8) AS q1, round(quantile_cont(preco, 0.5), 8) AS mediana, round(quantile_cont(preco, 0.75), 8) AS q3, max(preco) AS maximo FROM factos WHERE preco > 0 GROUP BY insignia")
def price_quartiles(spark, sf_dir):
    return quality.price_quartiles(views.facts(spark, sf_dir))


@query("SELECT CASE WHEN preco < 0 THEN 0 WHEN preco >= 4000 THEN 41 ELSE CAST(floor(preco * 40 / 4000.0::DOUBLE) AS BIGINT) + 1 END AS classe, count(*) AS n FROM factos GROUP BY classe")
def price_histogram(spark, sf_dir):
    return quality.price_histogram(views.facts(spark, sf_dir), 0.0, 4000.0)


@query("SELECT CASE WHEN preco < 1 THEN 0 WHEN preco >= 10000 THEN 21 ELSE CAST(floor(log10(preco) * 20 / 4.0::DOUBLE) AS BIGINT) + 1 END AS classe, count(*) AS n FROM factos WHERE preco > 0 GROUP BY classe")
def price_histogram_log(spark, sf_dir):
    return quality.price_histogram(views.facts(spark, sf_dir), 1.0, 10_000.0, 20, log=True)


@query("""SELECT unnest(range(1, 11))::INT AS ordem, unnest(['lojas', 'lojas_fisicas', 'produtos_mestre', 'produtos_loja', 'precos_atuais', 'historico_precos', 'em_promocao', 'dias_distintos', 'primeiro_dia', 'ultimo_dia']) AS metrica,
unnest([(SELECT count(*) FROM region)::VARCHAR, (SELECT count(*) FROM lojas_fisicas WHERE ativa)::VARCHAR, (SELECT count(*) FROM produtos)::VARCHAR, (SELECT count(DISTINCT id_produto_loja) FROM factos)::VARCHAR, (SELECT count(*) FROM atuais)::VARCHAR, (SELECT count(*) FROM factos)::VARCHAR,
    (SELECT count(*) FROM atuais WHERE em_promocao)::VARCHAR, (SELECT count(DISTINCT data_recolha::DATE) FROM factos)::VARCHAR, (SELECT min(data_recolha::DATE) FROM factos)::VARCHAR, (SELECT max(data_recolha::DATE) FROM factos)::VARCHAR]) AS valor""")
def global_report(spark, sf_dir):
    facts = views.facts(spark, sf_dir)
    return quality.global_report(views.chains(spark, sf_dir), views.products(spark, sf_dir), facts, views.latest(facts), views.outlets(spark, sf_dir))


@query("SELECT nome, count(*) AS n FROM produtos GROUP BY nome HAVING count(*) > 1 ORDER BY n DESC, nome LIMIT 50")
def repeated_names(spark, sf_dir):
    return quality.repeated_names(views.products(spark, sf_dir))


@query("SELECT id_produto_mestre, count(DISTINCT id_loja) AS num_lojas FROM factos GROUP BY id_produto_mestre HAVING num_lojas > 1 ORDER BY num_lojas DESC, id_produto_mestre LIMIT 50")
def multi_store_products(spark, sf_dir):
    return quality.multi_store_products(views.facts(spark, sf_dir))


@query(", d AS (SELECT count(DISTINCT CAST(data_recolha AS DATE)) AS d FROM factos GROUP BY id_produto_loja) SELECT count(*) FILTER (WHERE d = 1) AS um_dia, count(*) FILTER (WHERE d = 2) AS dois_dias, count(*) FILTER (WHERE d >= 3) AS tres_ou_mais FROM d")
def history_depth(spark, sf_dir):
    return quality.history_depth(views.facts(spark, sf_dir))


@query("SELECT *, maximo - minimo AS amplitude FROM (SELECT id_produto_loja, min(preco) AS minimo, max(preco) AS maximo, count(DISTINCT CAST(data_recolha AS DATE)) AS dias FROM factos GROUP BY id_produto_loja) WHERE dias >= 2 ORDER BY amplitude DESC, id_produto_loja LIMIT 30")
def largest_spread(spark, sf_dir):
    return quality.largest_spread(views.facts(spark, sf_dir))


@query("SELECT insignia, count(*) AS produtos, count(*) FILTER (WHERE em_promocao) AS promocoes, round(100.0::DOUBLE * count(*) FILTER (WHERE em_promocao) / count(*), 8) AS pct_promocoes, round(avg(preco), 6) AS preco_medio, min(preco) AS preco_minimo FROM atuais GROUP BY insignia")
def store_kpis(spark, sf_dir):
    return quality.store_kpis(views.latest(views.facts(spark, sf_dir)))


# Panels

DAILY_SQL = """, unidades AS (SELECT id_produto_loja, dia, preco_unitario_unidade, row_number() OVER (PARTITION BY id_produto_loja, dia ORDER BY count(*) DESC, preco_unitario_unidade) AS n FROM serie GROUP BY id_produto_loja, dia, preco_unitario_unidade),
diario AS (SELECT s.id_produto_loja, s.dia, round(avg(preco), 8) AS preco, any_value(u.preco_unitario_unidade) AS preco_unitario_unidade, bool_or(em_promocao) AS em_promocao, count(*) AS num_obs
    FROM serie s JOIN unidades u ON s.id_produto_loja = u.id_produto_loja AND s.dia = u.dia AND u.n = 1 GROUP BY s.id_produto_loja, s.dia),
calendario AS (SELECT id_produto_loja, CAST(unnest(generate_series(min(dia)::TIMESTAMP, max(dia)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS dia FROM diario GROUP BY id_produto_loja),
painel AS (SELECT c.id_produto_loja, c.dia, last_value(d.preco IGNORE NULLS) OVER w AS preco, last_value(d.preco_unitario_unidade IGNORE NULLS) OVER w AS preco_unitario_unidade, coalesce(d.em_promocao, FALSE) AS em_promocao,
    coalesce(d.num_obs, 0) AS num_obs, (d.dia IS NOT NULL)::INT AS foi_observado, (c.dia - last_value(d.dia IGNORE NULLS) OVER w)::INT AS dias_desde_ultima_obs
    FROM calendario c LEFT JOIN diario d ON c.id_produto_loja = d.id_produto_loja AND c.dia = d.dia WINDOW w AS (PARTITION BY c.id_produto_loja ORDER BY c.dia ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


def _panel(spark, sf_dir):
    return panel.expand(panel.daily(views.series(spark, sf_dir)))


@query(DAILY_SQL + f"SELECT * REPLACE ({_day('dia')} AS dia) FROM diario")
def daily_aggregate(spark, sf_dir):
    return panel.daily(views.series(spark, sf_dir))


@query(DAILY_SQL + f"SELECT * REPLACE ({_day('dia')} AS dia) FROM painel")
def daily_panel(spark, sf_dir):
    return _panel(spark, sf_dir)


@query(DAILY_SQL + f"SELECT id_produto_loja, {_day('dia')} AS dia, (isodow(dia) - 1)::INT AS weekday, month(dia)::INT AS month, week(dia)::INT AS weekofyear, day(dia)::INT AS dayofmonth, em_promocao::INT AS promo_flag FROM painel")
def calendar_features(spark, sf_dir):
    return panel.calendar_features(_panel(spark, sf_dir)).select("id_produto_loja", "dia", "weekday", "month", "weekofyear", "dayofmonth", "promo_flag")


@query(DAILY_SQL + f"SELECT id_produto_loja, {_day('dia')} AS dia, preco, " + ", ".join(f"lag(preco, {n}) OVER w AS lag_{n}" for n in panel.LAGS) + " FROM painel WINDOW w AS (PARTITION BY id_produto_loja ORDER BY painel.dia)")
def lag_features(spark, sf_dir):
    return panel.lag_features(_panel(spark, sf_dir)).select("id_produto_loja", "dia", "preco", *(f"lag_{n}" for n in panel.LAGS))


@query(DAILY_SQL + f"""SELECT id_produto_loja, {_day('dia')} AS dia, round(avg(preco) OVER (PARTITION BY id_produto_loja ORDER BY painel.dia ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 10) AS media_movel_3,
round(avg(preco) OVER s, 10) AS media_movel_7, round(coalesce(stddev_samp(preco) OVER s, 0), 6) AS desvio_movel_7 FROM painel WINDOW s AS (PARTITION BY id_produto_loja ORDER BY painel.dia ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""")
def rolling_features(spark, sf_dir):
    return panel.rolling_features(_panel(spark, sf_dir)).select("id_produto_loja", "dia", "media_movel_3", "media_movel_7", "desvio_movel_7")


@query(DAILY_SQL + f"SELECT id_produto_loja, {_day('dia')} AS dia, preco, lead(preco) OVER (PARTITION BY id_produto_loja ORDER BY painel.dia) AS target_t_plus_1 FROM painel")
def target_lead(spark, sf_dir):
    return panel.target(_panel(spark, sf_dir)).select("id_produto_loja", "dia", "preco", "target_t_plus_1")


TABLE_SQL = DAILY_SQL + """, tabela AS (SELECT id_produto_loja, painel.dia, foi_observado, preco, em_promocao::INT AS promo_flag, isodow(painel.dia) - 1 AS weekday, week(painel.dia) AS weekofyear, month(painel.dia) AS month, day(painel.dia) AS dayofmonth,
    coalesce(r_regionkey, -1) AS cadeia_id, dias_desde_ultima_obs, lag(preco, 1) OVER w AS lag_1, lag(preco, 2) OVER w AS lag_2, lag(preco, 3) OVER w AS lag_3, lag(preco, 7) OVER w AS lag_7,
    round(avg(preco) OVER (PARTITION BY id_produto_loja ORDER BY painel.dia ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 10) AS media_movel_3, round(avg(preco) OVER s, 10) AS media_movel_7, round(coalesce(stddev_samp(preco) OVER s, 0), 6) AS desvio_movel_7,
    lead(preco) OVER w AS target_t_plus_1
    FROM painel LEFT JOIN region ON r_regionkey = id_produto_loja % 6 WINDOW w AS (PARTITION BY id_produto_loja ORDER BY painel.dia), s AS (PARTITION BY id_produto_loja ORDER BY painel.dia ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
linhas AS (SELECT *, [""" + ", ".join(f"{c}::DOUBLE" for c in panel.FEATURES) + """] AS x FROM tabela WHERE lag_7 IS NOT NULL)
"""


def _feature_table(spark, sf_dir):
    chain_of = panel.chain_ids(views.series_chains(spark, sf_dir), views.chains(spark, sf_dir))
    return panel.features(views.series(spark, sf_dir), chain_of=chain_of)


@query(TABLE_SQL + f""", j AS (SELECT id_produto_loja, dia, foi_observado, preco AS alvo, list(x) OVER (PARTITION BY id_produto_loja ORDER BY linhas.dia ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS janela FROM linhas)
SELECT id_produto_loja, {_day('dia')} AS dia, alvo, array_to_string(list_transform(flatten(janela), lambda v: CAST(CAST(round(v * 1000) AS BIGINT) AS VARCHAR)), ' ') AS janela FROM j WHERE len(janela) = 7 AND foi_observado = 1""")
def feature_windows(spark, sf_dir):
    rows = panel.supervised_windows(_feature_table(spark, sf_dir), kind="double")
    return rows.withColumn("janela", F.array_join(F.transform(F.flatten("janela"), lambda v: F.round(v * 1000).cast("long").cast("string")), " "))


@query(f""", limites AS (SELECT id_produto_loja, round(q1 - 3.0::DOUBLE * (q3 - q1), 8) AS inferior, round(q3 + 3.0::DOUBLE * (q3 - q1), 8) AS superior FROM
    (SELECT id_produto_loja, quantile_cont(preco, 0.25) AS q1, quantile_cont(preco, 0.75) AS q3 FROM serie GROUP BY id_produto_loja) WHERE q3 > q1),
m AS (SELECT s.*, inferior, superior, abs(preco / lag(preco) OVER w - 1) AS variacao, coalesce(s.dia - lag(s.dia) OVER w, 0)::INT AS gap
    FROM serie s LEFT JOIN limites l USING (id_produto_loja) WINDOW w AS (PARTITION BY s.id_produto_loja ORDER BY s.dia, s.id_historico))
SELECT id_historico, id_produto_loja, {_day('dia')} AS dia, preco, gap, CASE WHEN preco < inferior OR preco > superior THEN 'iqr' ELSE 'variacao_abrupta' END AS criterio FROM m
WHERE preco < inferior OR preco > superior OR (variacao > 0.5 AND gap <= 3)""")
def anomalies(spark, sf_dir):
    return anomaly.anomalies(views.series(spark, sf_dir)).select("id_historico", "id_produto_loja", "dia", "preco", "gap", "criterio")


# Search


def _offers_for(spark, sf_dir, term):
    """Current prices of the products that the term finds."""
    found = views.products(spark, sf_dir)
    found = found.filter(search.matches(term, F.col("nome"), F.col("quantidade_valor"), F.col("quantidade_unidade"), any_word=True))
    return views.current(spark, sf_dir, found)


def _list_offers(spark, sf_dir, items):
    """Current prices of the products whose names hold a list item, and all products."""
    known = views.products(spark, sf_dir)
    return views.current(spark, sf_dir, search.named_like(known, items)), known


NEAR_SQL = _sql_similarity("nome", "'red widget'")


@query(f""", r AS (SELECT nome, max(marca) AS marca, count(DISTINCT insignia) AS num_lojas, min(preco) AS preco_minimo, max(preco) AS preco_maximo
    FROM produtos p LEFT JOIN (SELECT id_produto_mestre, insignia, preco FROM atuais) a USING (id_produto_mestre) WHERE contains(nome, 'red') AND contains(nome, 'widget') GROUP BY nome)
SELECT *, {NEAR_SQL} AS semelhanca FROM r ORDER BY semelhanca DESC, nome LIMIT 20""")
def search_and(spark, sf_dir):
    return search.search(views.products(spark, sf_dir), _offers_for(spark, sf_dir, "red widget"), "red widget", 20)


@query(f""", r AS (SELECT nome, max(marca) AS marca, count(DISTINCT insignia) AS num_lojas, min(preco) AS preco_minimo, max(preco) AS preco_maximo
    FROM produtos p LEFT JOIN (SELECT id_produto_mestre, insignia, preco FROM atuais) a USING (id_produto_mestre) WHERE contains(nome, 'red') OR contains(nome, 'gizmos') GROUP BY nome)
SELECT * FROM (SELECT *, {_sql_similarity('nome', "'red gizmos'")} AS semelhanca FROM r) WHERE semelhanca > 0.2 ORDER BY semelhanca DESC, nome LIMIT 20""")
def search_or(spark, sf_dir):
    return search.search(views.products(spark, sf_dir), _offers_for(spark, sf_dir, "red gizmos"), "red gizmos", 20)


BEST_SQL = f""", o AS (SELECT *, row_number() OVER (PARTITION BY nome, insignia ORDER BY preco, id_produto_loja) AS k FROM (SELECT *, {NEAR_SQL} AS semelhanca FROM atuais_nomes WHERE contains(nome, 'red') AND contains(nome, 'widget')) WHERE semelhanca > 0.2),
melhores AS (SELECT nome, insignia, preco, id_produto_loja, semelhanca, em_promocao FROM o WHERE k = 1 ORDER BY preco, nome, insignia LIMIT :top)
"""


@query(BEST_SQL.replace(":top", "5") + "SELECT *, (max(preco) OVER () - preco) / max(preco) OVER () * 100 AS poupanca_pct FROM melhores")
def best_store(spark, sf_dir):
    return search.best_store(_offers_for(spark, sf_dir, "red widget"), "red widget", 5)


@query(f""", o AS (SELECT *, preco / (quantidade_valor / 1000.0::DOUBLE) AS u, row_number() OVER (PARTITION BY nome, insignia ORDER BY preco, id_produto_loja) AS k
    FROM (SELECT *, {NEAR_SQL} AS semelhanca FROM atuais_nomes WHERE contains(nome, 'red') AND contains(nome, 'widget')) WHERE semelhanca > 0.2),
m AS (SELECT nome, insignia, preco, id_produto_loja, semelhanca, em_promocao, u AS preco_unitario_valor, 'kg' AS preco_unitario_unidade FROM o WHERE k = 1 ORDER BY u, preco, nome, insignia LIMIT 5)
SELECT *, (max(preco_unitario_valor) OVER () - preco_unitario_valor) / max(preco_unitario_valor) OVER () * 100 AS poupanca_pct FROM m""")
def best_store_by_unit(spark, sf_dir):
    offers = _offers_for(spark, sf_dir, "red widget").withColumns({"preco_unitario_valor": F.col("preco") / (F.col("quantidade_valor") / 1000), "preco_unitario_unidade": F.lit("kg")})
    return search.best_store(offers, "red widget", 5, by_unit=True)


@query(f"SELECT id_produto_mestre, nome, {_sql_similarity('nome', chr(39) + 'blue gizmo brand' + chr(39))} AS semelhanca FROM produtos")
def trigram_similarity(spark, sf_dir):
    return views.products(spark, sf_dir).select("id_produto_mestre", "nome", text.similarity(F.col("nome"), F.lit("blue gizmo brand")).alias("semelhanca"))


# Baskets

OFFERS_SQL = f""", ofertas AS (SELECT * FROM (SELECT item, insignia, nome, id_produto_loja, preco, {_sql_similarity('nome', 'item')} AS semelhanca FROM atuais_nomes JOIN itens
    ON len(list_filter(string_split(item, ' '), lambda w: NOT contains(lower(nome), w))) = 0) WHERE semelhanca >= 0.2),
matriz AS (SELECT item, insignia, nome, preco, id_produto_loja, semelhanca FROM (SELECT *, row_number() OVER (PARTITION BY item, insignia ORDER BY semelhanca DESC, preco, nome, id_produto_loja) AS k FROM ofertas) WHERE k = 1),
por_item AS (SELECT item, nome, preco, id_produto_loja, semelhanca, insignia FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY semelhanca DESC, preco, nome, id_produto_loja) AS k FROM ofertas) WHERE k = 1),
por_cadeia AS (SELECT insignia, round(sum(preco), 8) AS total, count(*) AS encontrados, (SELECT count(*) FROM itens) AS pedidos, count(*) = (SELECT count(*) FROM itens) AS completa FROM matriz GROUP BY insignia)
"""
LIST_SQL, UNKNOWN_SQL = f", {_sql_items()}" + OFFERS_SQL, f", {_sql_items(WITH_UNKNOWN)}" + OFFERS_SQL
REACH_SQL = f""", perto AS (SELECT insignia, id_loja_fisica, nome_loja, latitude, longitude, distancia_km FROM (SELECT *, row_number() OVER (PARTITION BY insignia ORDER BY distancia_km, id_loja_fisica) AS k
    FROM (SELECT *, {_sql_km(f'{LAT}::DOUBLE', f'{LON}::DOUBLE', 'latitude', 'longitude')} AS distancia_km FROM lojas_fisicas WHERE ativa) WHERE distancia_km <= {RADIUS}) WHERE k = 1)
"""


@query(LIST_SQL + "SELECT * FROM matriz")
def price_matrix(spark, sf_dir):
    offers, known = _list_offers(spark, sf_dir, _items(spark))
    return basket.price_matrix(offers, _items(spark), known)


@query(UNKNOWN_SQL + "SELECT item, nome, preco, CAST(id_produto_loja AS VARCHAR) AS id_produto_loja, semelhanca, insignia FROM itens LEFT JOIN por_item USING (item)")
def basket_split(spark, sf_dir):
    offers, known = _list_offers(spark, sf_dir, _items(spark, WITH_UNKNOWN))
    return basket.split_basket(offers, _items(spark, WITH_UNKNOWN), known).select("item", "nome", "preco", F.col("id_produto_loja").cast("string").alias("id_produto_loja"), "semelhanca", "insignia")


@query(LIST_SQL + "SELECT * FROM por_cadeia")
def basket_by_chain(spark, sf_dir):
    return basket.basket_by_chain(price_matrix(spark, sf_dir), _items(spark))


@query(UNKNOWN_SQL + "SELECT item FROM itens WHERE item NOT IN (SELECT item FROM ofertas)")
def basket_missing_items(spark, sf_dir):
    offers, known = _list_offers(spark, sf_dir, _items(spark, WITH_UNKNOWN))
    return basket.missing_items(offers, _items(spark, WITH_UNKNOWN), known)


@query(LIST_SQL + """SELECT custo_dividido, em_falta, melhor_cadeia, custo_cadeia, CASE WHEN custo_cadeia IS NULL THEN 'dividir_parcial' WHEN custo_dividido < custo_cadeia THEN 'dividir' ELSE 'loja_unica' END AS estrategia,
greatest(custo_cadeia - custo_dividido, 0.0::DOUBLE) AS poupanca FROM (SELECT round(sum(preco), 8) AS custo_dividido, count(*) FILTER (WHERE preco IS NULL) AS em_falta FROM itens LEFT JOIN por_item USING (item))
LEFT JOIN (SELECT insignia AS melhor_cadeia, total AS custo_cadeia FROM por_cadeia WHERE completa ORDER BY total, insignia LIMIT 1) ON TRUE""")
def basket_decision(spark, sf_dir):
    return basket.basket_decision(price_matrix(spark, sf_dir), _items(spark))


@query(LIST_SQL + REACH_SQL + f"SELECT insignia, total, round(distancia_km, 8) AS distancia_km, round(total + distancia_km * {PER_KM} * 2, 6) AS custo_total FROM por_cadeia JOIN perto USING (insignia) WHERE completa")
def basket_geo(spark, sf_dir):
    found = basket.basket_geo(price_matrix(spark, sf_dir), _items(spark), views.outlets(spark, sf_dir), LAT, LON, PER_KM, RADIUS)
    return found.select("insignia", "total", F.round("distancia_km", 8).alias("distancia_km"), F.round("custo_total", 6).alias("custo_total"))


@query(LIST_SQL + REACH_SQL + f""", pares AS (SELECT a.insignia AS insignia_a, b.insignia AS insignia_b, a.distancia_km + b.distancia_km + {_sql_km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS rota FROM perto a JOIN perto b ON a.insignia < b.insignia),
x AS (SELECT insignia_a, insignia_b, rota, a.preco AS pa, b.preco AS pb, coalesce(a.preco <= b.preco, a.preco IS NOT NULL) AS de_a FROM pares CROSS JOIN itens LEFT JOIN matriz a ON a.item = itens.item AND a.insignia = insignia_a LEFT JOIN matriz b ON b.item = itens.item AND b.insignia = insignia_b)
SELECT insignia_a, insignia_b, round(rota, 6) AS rota_km, round(sum(CASE WHEN de_a THEN pa ELSE pb END), 8) AS custo_produtos, count(*) FILTER (WHERE de_a) AS n_a, count(*) FILTER (WHERE NOT de_a AND pb IS NOT NULL) AS n_b
FROM x GROUP BY insignia_a, insignia_b, rota HAVING count(*) FILTER (WHERE pa IS NULL AND pb IS NULL) = 0 AND n_a > 0 AND n_b > 0""")
def basket_routes(spark, sf_dir):
    found = basket.basket_routes(price_matrix(spark, sf_dir), _items(spark), views.outlets(spark, sf_dir), LAT, LON, PER_KM, RADIUS)
    return found.select("insignia_a", "insignia_b", F.round("rota_km", 6).alias("rota_km"), "custo_produtos", "n_a", "n_b")


@query(BEST_SQL.replace(":top", "10") + REACH_SQL + f", c AS (SELECT *, row_number() OVER (PARTITION BY insignia ORDER BY preco, nome, id_produto_loja) AS k FROM melhores) SELECT insignia, nome, preco, round(distancia_km, 8) AS distancia_km, round(preco + distancia_km * {PER_KM} * 2, 6) AS custo_total FROM c JOIN perto USING (insignia) WHERE k = 1")
def near_me(spark, sf_dir):
    found = basket.near_me(_offers_for(spark, sf_dir, "red widget"), views.outlets(spark, sf_dir), "red widget", LAT, LON, PER_KM, RADIUS)
    return found.select("insignia", "nome", "preco", F.round("distancia_km", 8).alias("distancia_km"), F.round("custo_total", 6).alias("custo_total"))


@query(LIST_SQL + REACH_SQL + f""", so AS (SELECT insignia, total + distancia_km * {PER_KM} * 2 AS custo FROM por_cadeia JOIN perto USING (insignia) WHERE completa),
pares AS (SELECT a.insignia AS insignia_a, b.insignia AS insignia_b, a.distancia_km + b.distancia_km + {_sql_km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS rota FROM perto a JOIN perto b ON a.insignia < b.insignia),
x AS (SELECT insignia_a, insignia_b, rota, a.preco AS pa, b.preco AS pb, coalesce(a.preco <= b.preco, a.preco IS NOT NULL) AS de_a FROM pares CROSS JOIN itens LEFT JOIN matriz a ON a.item = itens.item AND a.insignia = insignia_a LEFT JOIN matriz b ON b.item = itens.item AND b.insignia = insignia_b),
dois AS (SELECT insignia_a, insignia_b, round(sum(CASE WHEN de_a THEN pa ELSE pb END), 8) + rota * {PER_KM} AS custo FROM x GROUP BY insignia_a, insignia_b, rota HAVING count(*) FILTER (WHERE pa IS NULL AND pb IS NULL) = 0 AND count(*) FILTER (WHERE de_a) > 0 AND count(*) FILTER (WHERE NOT de_a AND pb IS NOT NULL) > 0),
m AS (SELECT (SELECT min(custo) FROM so) AS s, (SELECT min(custo) FROM dois) AS p)
SELECT (SELECT arg_min(insignia, (custo, insignia)) FROM so) AS melhor_cadeia, round(s, 6) AS custo_cadeia, (SELECT arg_min(insignia_a, (custo, insignia_a, insignia_b)) FROM dois) AS insignia_a, (SELECT arg_min(insignia_b, (custo, insignia_a, insignia_b)) FROM dois) AS insignia_b,
round(p, 6) AS custo_par, CASE WHEN p < s THEN 'par' ELSE 'single' END AS recomendacao, round(CASE WHEN p < s THEN s - p ELSE 0 END, 6) AS poupanca_par FROM m""")
def route_decision(spark, sf_dir):
    matrix, stores = price_matrix(spark, sf_dir), views.outlets(spark, sf_dir)
    found = basket.route_decision(basket.basket_geo(matrix, _items(spark), stores, LAT, LON, PER_KM, RADIUS), basket.basket_routes(matrix, _items(spark), stores, LAT, LON, PER_KM, RADIUS))
    return found.withColumns({c: F.round(c, 6) for c in ("custo_cadeia", "custo_par", "poupanca_par")})


@query(BEST_SQL.replace(":top", "10") + "SELECT id_produto_loja AS id, nome, insignia AS loja, preco, printf('%s (%s) — %.2f€', nome, insignia, preco) AS etiqueta FROM melhores")
def candidates(spark, sf_dir):
    return search.candidates(_offers_for(spark, sf_dir, "red widget"), "red widget")


@query(f""", o AS (SELECT *, preco / (quantidade_valor / 1000.0::DOUBLE) AS u, row_number() OVER (PARTITION BY nome, insignia ORDER BY preco, id_produto_loja) AS k
    FROM (SELECT *, {NEAR_SQL} AS semelhanca FROM atuais_nomes WHERE contains(nome, 'red') AND contains(nome, 'widget')) WHERE semelhanca > 0.2),
m AS (SELECT * EXCLUDE (k) FROM o WHERE k = 1 ORDER BY u, preco, nome, insignia LIMIT 10)
""" + REACH_SQL + f", c AS (SELECT *, row_number() OVER (PARTITION BY insignia ORDER BY u, preco, nome, id_produto_loja) AS k FROM m) SELECT c.insignia, nome, preco, round(distancia_km, 8) AS distancia_km, round(preco + distancia_km * {PER_KM} * 2, 6) AS custo_total FROM c JOIN perto USING (insignia) WHERE k = 1")
def near_me_by_unit(spark, sf_dir):
    offers = _offers_for(spark, sf_dir, "red widget").withColumns({"preco_unitario_valor": F.col("preco") / (F.col("quantidade_valor") / 1000), "preco_unitario_unidade": F.lit("kg")})
    found = basket.near_me(offers, views.outlets(spark, sf_dir), "red widget", LAT, LON, PER_KM, RADIUS, by_unit=True)
    return found.select("insignia", "nome", "preco", F.round("distancia_km", 8).alias("distancia_km"), F.round("custo_total", 6).alias("custo_total"))


# Places

KM_SQL = _sql_km(f"{LAT}::DOUBLE", f"{LON}::DOUBLE", "latitude", "longitude")


@query(f"SELECT id_loja_fisica, insignia, round(d, 8) AS distancia_km, round(d * 0.36 * 2, 8) AS custo FROM (SELECT *, {KM_SQL} AS d FROM lojas_fisicas WHERE ativa) WHERE d <= {RADIUS}")
def nearby_stores(spark, sf_dir):
    near = geo.nearby_stores(views.outlets(spark, sf_dir), LAT, LON, RADIUS)
    return near.select("id_loja_fisica", "insignia", F.round("distancia_km", 8).alias("distancia_km"), F.round(geo.travel_cost(F.col("distancia_km"), geo.cost_per_km("tarifa_at")), 8).alias("custo"))


@query(REACH_SQL + "SELECT insignia, id_loja_fisica, round(distancia_km, 8) AS distancia_km FROM perto")
def nearest_store_per_chain(spark, sf_dir):
    return geo.nearest_per_chain(views.outlets(spark, sf_dir), LAT, LON, RADIUS).select("insignia", "id_loja_fisica", F.round("distancia_km", 8).alias("distancia_km"))


@query(f""", pontos AS (SELECT c_custkey AS id_ponto, 37.0::DOUBLE + (c_custkey * 31 % 5000)::DOUBLE / 1000.0::DOUBLE AS lat, -9.3::DOUBLE + (c_custkey * 17 % 3000)::DOUBLE / 1000.0::DOUBLE AS lon FROM customer),
x AS (SELECT id_ponto, insignia, id_loja_fisica, {_sql_km('lat', 'lon', 'latitude', 'longitude')} AS d FROM pontos, lojas_fisicas WHERE ativa)
SELECT id_ponto, insignia, id_loja_fisica, round(d, 8) AS distancia_km FROM (SELECT *, row_number() OVER (PARTITION BY id_ponto, insignia ORDER BY d, id_loja_fisica) AS k FROM x WHERE d <= 30) WHERE k = 1""")
def nearest_stores_of_customers(spark, sf_dir):
    key = F.col("c_custkey")
    points = views.table(spark, sf_dir, "customer").select(key.alias("id_ponto"), (37.0 + (key * 31 % 5000) / 1000.0).alias("lat"), (-9.3 + (key * 17 % 3000) / 1000.0).alias("lon"))
    return geo.nearest_for_points(points, views.outlets(spark, sf_dir), 30.0).select("id_ponto", "insignia", "id_loja_fisica", F.round("distancia_km", 8).alias("distancia_km"))


# Ingestion

HALVES_SQL = ", velho AS (SELECT * FROM factos WHERE l_orderkey % 2 = 0), novo AS (SELECT * FROM factos WHERE l_orderkey % 2 = 1 OR l_orderkey % 3 = 0)"


def _halves(spark, sf_dir):
    """Two batches that overlap and hold every row between them."""
    rows = views.facts(spark, sf_dir)
    return rows.filter("l_orderkey % 2 = 0"), rows.filter("l_orderkey % 2 = 1 OR l_orderkey % 3 = 0")


def _upserted(*batches):
    old, new = (r.select("id_produto_loja", "data_recolha", "preco") for r in batches)
    empty = old.filter("false")
    return ingest.upsert_snapshot(ingest.upsert_snapshot(empty, old), new)


def _appended(*batches):
    agent = F.when(F.col("l_suppkey") % 2 == 0, "a").alias("agente_origem")
    old, new = (r.select("id_produto_loja", "data_recolha", agent, "preco", F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("ordinal")) for r in batches)
    return ingest.append_history(old.drop("ordinal"), new)


@query(HALVES_SQL + f""", a AS (SELECT id_produto_loja, arg_max(preco, row(data_recolha, preco)) AS preco, max(data_recolha) AS d FROM velho GROUP BY 1), b AS (SELECT id_produto_loja, arg_max(preco, row(data_recolha, preco)) AS preco, max(data_recolha) AS d FROM novo GROUP BY 1)
SELECT id_produto_loja, CASE WHEN b.d IS NOT NULL AND (a.d IS NULL OR b.d >= a.d) THEN b.preco ELSE a.preco END AS preco, {_day('CASE WHEN b.d IS NOT NULL AND (a.d IS NULL OR b.d >= a.d) THEN b.d ELSE a.d END')} AS data_recolha FROM a FULL JOIN b USING (id_produto_loja)""")
def snapshot_upsert(spark, sf_dir):
    return _upserted(*_halves(spark, sf_dir))


@query(HALVES_SQL + f""", v AS (SELECT id_produto_loja, data_recolha, CASE WHEN l_suppkey % 2 = 0 THEN 'a' END AS agente_origem, preco, l_orderkey, l_linenumber, l_suppkey FROM velho), n AS (SELECT *, row_number() OVER (PARTITION BY id_produto_loja, data_recolha, coalesce(agente_origem, '') ORDER BY l_orderkey, l_linenumber, l_suppkey) AS k
    FROM (SELECT id_produto_loja, data_recolha, CASE WHEN l_suppkey % 2 = 0 THEN 'a' END AS agente_origem, preco, l_orderkey, l_linenumber, l_suppkey FROM novo))
SELECT id_produto_loja, {_day('data_recolha')} AS data_recolha, agente_origem, preco FROM v UNION ALL SELECT id_produto_loja, {_day('data_recolha')}, agente_origem, preco FROM n WHERE k = 1 AND NOT EXISTS
    (SELECT 1 FROM v WHERE v.id_produto_loja = n.id_produto_loja AND v.data_recolha = n.data_recolha AND coalesce(v.agente_origem, '') = coalesce(n.agente_origem, ''))""")
def history_append(spark, sf_dir):
    return _appended(*_halves(spark, sf_dir))


# The same over two overlapping batches that hold every row between them.

BATCHES_SQL = ", velho AS (SELECT * FROM factos WHERE l_linenumber <= 4), novo AS (SELECT * FROM factos WHERE l_linenumber >= 4 OR l_linenumber IS NULL)"


def _batches(spark, sf_dir):
    rows = views.facts(spark, sf_dir)
    return rows.filter("l_linenumber <= 4"), rows.filter("l_linenumber >= 4 OR l_linenumber IS NULL")


@query(BATCHES_SQL + f""", a AS (SELECT id_produto_loja, arg_max(preco, row(data_recolha, preco)) AS preco, max(data_recolha) AS d FROM velho GROUP BY 1), b AS (SELECT id_produto_loja, arg_max(preco, row(data_recolha, preco)) AS preco, max(data_recolha) AS d FROM novo GROUP BY 1)
SELECT id_produto_loja, CASE WHEN b.d IS NOT NULL AND (a.d IS NULL OR b.d >= a.d) THEN b.preco ELSE a.preco END AS preco, {_day('CASE WHEN b.d IS NOT NULL AND (a.d IS NULL OR b.d >= a.d) THEN b.d ELSE a.d END')} AS data_recolha FROM a FULL JOIN b USING (id_produto_loja)""")
def snapshot_upsert_whole(spark, sf_dir):
    return _upserted(*_batches(spark, sf_dir))


@query(BATCHES_SQL + f""", v AS (SELECT id_produto_loja, data_recolha, CASE WHEN l_suppkey % 2 = 0 THEN 'a' END AS agente_origem, preco, l_orderkey, l_linenumber, l_suppkey FROM velho), n AS (SELECT *, row_number() OVER (PARTITION BY id_produto_loja, data_recolha, coalesce(agente_origem, '') ORDER BY l_orderkey, l_linenumber, l_suppkey) AS k
    FROM (SELECT id_produto_loja, data_recolha, CASE WHEN l_suppkey % 2 = 0 THEN 'a' END AS agente_origem, preco, l_orderkey, l_linenumber, l_suppkey FROM novo))
SELECT id_produto_loja, {_day('data_recolha')} AS data_recolha, agente_origem, preco FROM v UNION ALL SELECT id_produto_loja, {_day('data_recolha')}, agente_origem, preco FROM n WHERE k = 1 AND NOT EXISTS
    (SELECT 1 FROM v WHERE v.id_produto_loja = n.id_produto_loja AND v.data_recolha = n.data_recolha AND coalesce(v.agente_origem, '') = coalesce(n.agente_origem, ''))""")
def history_append_whole(spark, sf_dir):
    return _appended(*_batches(spark, sf_dir))


@query(""", r AS (SELECT o_orderkey AS ordinal, o_orderpriority AS loja, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS id_externo, 'http://x/' || o_custkey AS url, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS data_recolha FROM orders),
k AS (SELECT *, loja || chr(31) || CASE WHEN id_externo <> '' THEN 'sku:' || id_externo ELSE 'url:' || replace(replace(url, '://', '-'), '/', '-') END AS chave FROM r)
SELECT chave, min(ordinal) AS ordinal, max(data_recolha) AS data_recolha, arg_max(url, row(data_recolha, ordinal)) AS url FROM k GROUP BY chave""")
def batch_dedup(spark, sf_dir):
    empty = [F.lit("").alias(c) for c in ("nome", "categoria", "preco")]
    key = F.col("o_custkey").cast("string")
    rows = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_orderpriority").alias("loja"), F.when(F.col("o_custkey") % 3 == 0, "").otherwise(key).alias("id_externo"), F.concat(F.lit("http://x/"), key).alias("url"), F.col("o_orderdate").cast("date").cast("string").alias("data_recolha"), *empty)
    return ingest.deduplicate(rows).select("chave", "ordinal", "data_recolha", "url")


@query("SELECT id_produto_mestre, nome, quantidade_valor AS valor, 'g' AS unidade, 'q:' || CAST(quantidade_valor AS INT) || 'g' AS descritor FROM produtos")
def quantity_extraction(spark, sf_dir):
    rows = _spread(views.products(spark, sf_dir)).withColumn("q", text.quantity(F.col("nome")))
    return rows.select("id_produto_mestre", "nome", F.col("q.total").cast("double").alias("valor"), F.col("q.unidade").alias("unidade"), text.descriptor(F.col("q")).alias("descritor"))


def _sql_plain(x: str) -> str:
    """The text of an HTML fragment."""
    bare = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for entity, character in web.ENTITIES:
        doubled = character.replace("'", "''")
        bare = f"replace({bare}, '{entity}', '{doubled}')"
    return f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"


TITLE_SQL, HEADING_SQL, LINK_SQL = (f"'(?is)<{tag}>(.*?)</{name}>'" for tag, name in (("title", "title"), ("h1", "h1"), ("a [^>]*", "a")))


@query(f"SELECT page_id, {_sql_plain(f'regexp_extract(html, {TITLE_SQL}, 1)')} AS titulo FROM pages")
def html_titles(spark, sf_dir):
    rows = tree.page_trees(views.table(spark, sf_dir, "pages").select("page_id", "html"))
    return rows.select("page_id", F.coalesce(tree.text_of(F.col("texto"), F.get(tree.named(F.col("nos"), "title"), F.lit(0))), F.lit("")).alias("titulo"))


@query(f""", p AS (SELECT page_id, coalesce(html, '') AS html, regexp_extract(html, '(?is)<nav>(.*?)</nav>', 1) AS nav, regexp_extract(html, '(?is)<article>(.*?)</article>', 1) AS artigo FROM pages),
l AS (SELECT page_id, string_agg({_sql_plain('x')}, '|' ORDER BY k) AS ligacoes, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(nav, {LINK_SQL}, 1)) AS x, generate_subscripts(regexp_extract_all(nav, {LINK_SQL}, 1), 1) AS k FROM p) GROUP BY page_id)
SELECT page_id, {_sql_plain(f'regexp_extract(html, {HEADING_SQL}, 1)')} AS cabecalho, coalesce(ligacoes, '') AS ligacoes, coalesce(n, 0)::INT AS n_ligacoes, len(regexp_extract_all(artigo, '<p>'))::INT AS n_paragrafos, md5({_sql_plain('artigo')}) AS artigo FROM p LEFT JOIN l USING (page_id)""")
def page_outline(spark, sf_dir):
    rows = tree.page_trees(views.table(spark, sf_dir, "pages").select("page_id", "html"))
    nodes, words = F.col("nos"), F.col("texto")
    article, links = tree.named(nodes, "article"), tree.inside(tree.named(nodes, "a"), tree.named(nodes, "nav"))
    first = lambda found: F.coalesce(tree.text_of(words, F.get(found, F.lit(0))), F.lit(""))
    return rows.select(
        "page_id",
        first(tree.named(nodes, "h1")).alias("cabecalho"),
        F.array_join(F.transform(links, lambda a: tree.text_of(words, a)), "|").alias("ligacoes"),
        F.size(links).alias("n_ligacoes"),
        F.size(tree.inside(tree.named(nodes, "p"), article)).alias("n_paragrafos"),
        F.md5(first(article)).alias("artigo"),
    )

# Forecasts

EVAL_SQL = DAILY_SQL + """, p AS (SELECT *, row_number() OVER (PARTITION BY id_produto_loja ORDER BY dia DESC) AS n, count(*) OVER (PARTITION BY id_produto_loja) AS t FROM diario),
prev AS (SELECT id_produto_loja, 'naive' AS modelo, arg_max(preco, dia) AS previsao FROM p WHERE t >= 15 AND n > 7 GROUP BY 1
    UNION ALL SELECT id_produto_loja, 'media_movel_3d', round(avg(preco), 8) FROM p WHERE t >= 15 AND n > 7 AND n <= 10 GROUP BY 1
    UNION ALL SELECT id_produto_loja, 'media_movel_7d', round(avg(preco), 8) FROM p WHERE t >= 15 AND n > 7 AND n <= 14 GROUP BY 1),
erros AS (SELECT id_produto_loja, modelo, count(*) AS n_amostras, round(sqrt(avg((previsao - preco) * (previsao - preco))), 8) AS rmse_euros, round(avg(abs(previsao - preco)), 8) AS mae_euros,
    round(100 * avg(abs((previsao - preco) / preco)) FILTER (WHERE preco > 0.01), 8) AS mape_pct FROM p JOIN prev USING (id_produto_loja) WHERE n <= 7 GROUP BY 1, 2)
"""


def _metrics(spark, sf_dir):
    return forecast.evaluate_baselines(panel.daily(views.series(spark, sf_dir)))


@query(DAILY_SQL + ", u AS (SELECT id_produto_loja, arg_max(preco, dia) AS previsao FROM diario GROUP BY 1) SELECT *, unnest(range(1, 8))::INT AS passo FROM u")
def baseline_naive(spark, sf_dir):
    return forecast.naive(panel.daily(views.series(spark, sf_dir)))


@query(DAILY_SQL + ", p AS (SELECT *, row_number() OVER (PARTITION BY id_produto_loja ORDER BY dia DESC) AS n FROM diario), u AS (SELECT id_produto_loja, round(avg(preco), 8) AS previsao FROM p WHERE n <= 7 GROUP BY 1) SELECT *, unnest(range(1, 8))::INT AS passo FROM u")
def baseline_ma7(spark, sf_dir):
    return forecast.moving_average(panel.daily(views.series(spark, sf_dir)), 7)


@query(EVAL_SQL + "SELECT * FROM erros")
def forecast_metrics(spark, sf_dir):
    return _metrics(spark, sf_dir)


@query(EVAL_SQL + "SELECT modelo, count(*) AS n, round(avg(rmse_euros), 6) AS rmse_medio, round(stddev_samp(rmse_euros), 6) AS rmse_desvio, round(avg(mae_euros), 6) AS mae_medio, round(avg(mape_pct), 6) AS mape_medio FROM erros GROUP BY modelo")
def model_summary(spark, sf_dir):
    return forecast.model_summary(forecast.common_products(_metrics(spark, sf_dir)))


@query(EVAL_SQL + ", m AS (SELECT modelo, row_number() OVER (PARTITION BY id_produto_loja ORDER BY round(rmse_euros, 4), modelo) AS k FROM erros), c AS (SELECT modelo, count(*) AS vitorias FROM m WHERE k = 1 GROUP BY modelo) SELECT *, 100.0::DOUBLE * vitorias / (SELECT sum(vitorias) FROM c) AS pct FROM c")
def win_rate(spark, sf_dir):
    return forecast.win_rate(_metrics(spark, sf_dir))


# Models

K = len(panel.FEATURES)
FIT_SQL = TABLE_SQL + f""", completos AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id_produto_loja ORDER BY dia DESC) <= 7 AS validacao, count(*) OVER (PARTITION BY id_produto_loja) AS todos FROM linhas WHERE target_t_plus_1 IS NOT NULL) WHERE todos >= 15),
z AS (SELECT list_append(x, target_t_plus_1) AS z FROM completos WHERE NOT validacao),
medias AS (SELECT i, avg(z[i]) AS m FROM z, (SELECT unnest(range(1, {K + 2})) AS i) GROUP BY i),
cov AS (SELECT i, j, avg(z[i] * z[j]) - any_value(a.m) * any_value(b.m) AS c FROM z, medias a, (SELECT i AS j, m FROM medias) b WHERE i <= {K} GROUP BY i, j),
matriz AS (SELECT list(l ORDER BY i) AS g FROM (SELECT i, list(CASE WHEN i <> j THEN c WHEN c <= 1e-9 THEN 1.0 ELSE c * 1.001::DOUBLE END ORDER BY j) AS l FROM cov GROUP BY i)),
passos AS (SELECT 1 AS k, g FROM matriz UNION ALL SELECT k + 1, list_transform(g, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / r[k]) ELSE list_transform(r, lambda v, j: v - r[k] / g[k][k] * g[k][j]) END) FROM passos WHERE k <= {K}),
pesos AS (SELECT list_transform(g, lambda r: round(r[{K + 1}], 6)) AS w FROM passos WHERE k = {K + 1}),
modelo AS (SELECT w, round((SELECT m FROM medias WHERE i = {K + 1}) - (SELECT sum(m * w[i]) FROM medias WHERE i <= {K}), 6) AS b FROM pesos)
"""


def _sql_predict(x: str) -> str:
    return f"(b + list_sum(list_transform(range(1, {K + 1}), lambda i: {x}[i] * w[i])))"


def _fitted(spark, sf_dir):
    rows = models.complete(_feature_table(spark, sf_dir))
    return rows, models.fit_linear(rows.filter("NOT validacao"))


@query(TABLE_SQL + f"SELECT id_produto_loja, {_day('dia')} AS dia, foi_observado, preco, promo_flag, cadeia_id::INT AS cadeia_id, dias_desde_ultima_obs, lag_1, lag_7, media_movel_7, desvio_movel_7, target_t_plus_1 FROM tabela")
def panel_refresh(spark, sf_dir):
    """The table of a first load, to which the rest is added: the last ten days, and late rows of every seventh product."""
    rows = views.series(spark, sf_dir)
    chain_of = panel.chain_ids(views.series_chains(spark, sf_dir), views.chains(spark, sf_dir))
    late = (F.col("dia") > F.lit("2024-01-20").cast("date")) | ((F.col("id_produto_loja") % 7 == 0) & (F.day("dia") % 5 == 0))
    old = panel.features(rows.filter(~late), chain_of=chain_of)
    since = rows.filter(late).groupBy("id_produto_loja").agg(F.min("dia").alias("dia"))
    found = panel.refresh(old, panel.daily(rows.join(since.select("id_produto_loja", F.col("dia").alias("_d")), "id_produto_loja").filter("dia >= _d")), since)
    return found.select("id_produto_loja", "dia", "foi_observado", "preco", "promo_flag", "cadeia_id", "dias_desde_ultima_obs", "lag_1", "lag_7", "media_movel_7", "desvio_movel_7", "target_t_plus_1")


@query(FIT_SQL + f"SELECT unnest({[*panel.FEATURES, 'constante']}) AS feature, unnest(list_append(w, b)) AS peso FROM modelo")
def linear_model(spark, sf_dir):
    model = _fitted(spark, sf_dir)[1]
    return spark.createDataFrame([*zip(model.features, model.weights, strict=True), ("constante", model.intercept)], "feature string, peso double")


@query(FIT_SQL + f""", p AS (SELECT id_produto_loja, target_t_plus_1 AS alvo, {_sql_predict('x')} AS previsao FROM completos, modelo WHERE validacao)
SELECT id_produto_loja, 'linear' AS modelo, count(*) AS n_amostras, round(round(sqrt(avg((previsao - alvo) ** 2)), 8), 6) AS rmse_euros, round(round(avg(abs(previsao - alvo)), 8), 6) AS mae_euros, round(round(100 * avg(abs((previsao - alvo) / alvo)) FILTER (WHERE alvo > 0.01), 8), 6) AS mape_pct FROM p GROUP BY 1""")
def linear_metrics(spark, sf_dir):
    rows, model = _fitted(spark, sf_dir)
    found = models.one_step_metrics(rows.filter("validacao"), model.predict, "linear")
    return found.select(models.KEY, "modelo", "n_amostras", *(F.round(c, 6).alias(c) for c in ("rmse_euros", "mae_euros", "mape_pct")))


POINTS_SQL = FIT_SQL + f""", pontos AS (SELECT id_produto_loja, max(dia) AS ultimo_dia, arg_max(preco, dia) AS preco_atual, list(preco ORDER BY dia) FILTER (WHERE n <= 7) AS h, arg_max(x, dia) AS x
    FROM (SELECT *, row_number() OVER (PARTITION BY id_produto_loja ORDER BY dia DESC) AS n FROM linhas) GROUP BY id_produto_loja HAVING count(*) >= 7)
"""


def _sql_paths(start: str, shock: str) -> str:
    """Seven recursive steps from the rows of ``start``, which have ``amostra`` and ``erros`` too."""
    return f""", caminhos AS (SELECT id_produto_loja, amostra, erros, ultimo_dia, preco_atual, 0 AS passo, h, x, NULL::DOUBLE AS p FROM ({start}) UNION ALL
    SELECT id_produto_loja, amostra, erros, ultimo_dia, preco_atual, passo, h, [p, 0, isodow(d) - 1, week(d), month(d), day(d), x[7], passo + 1, h[7], h[6], h[5], h[1], (h[5] + h[6] + h[7]) / 3, media, sqrt(list_sum(list_transform(h, lambda v: (v - media) ** 2)) / 6)]::DOUBLE[], p
    FROM (SELECT *, list_sum(h) / 7 AS media, ultimo_dia + passo + 1 AS d FROM (SELECT * REPLACE (h[2:7] || [p] AS h) FROM (SELECT * REPLACE (passo + 1 AS passo, greatest(0.01::DOUBLE, round({_sql_predict('x')} + {shock}, 2)) AS p) FROM caminhos, modelo WHERE passo < 7))))
"""


@query(POINTS_SQL + _sql_paths("SELECT *, 0 AS amostra, NULL::DOUBLE[] AS erros FROM pontos", "0") + f"SELECT id_produto_loja, {_day('ultimo_dia + passo')} AS data, p AS preco_previsto, preco_atual FROM caminhos WHERE passo > 0")
def recursive_forecast(spark, sf_dir):
    model = _fitted(spark, sf_dir)[1]
    return models.recursive_forecast(models.starting_points(_feature_table(spark, sf_dir)), model.predict)


MONTE_CARLO_SQL = POINTS_SQL + f""", erros AS (SELECT id_produto_loja, list(erro ORDER BY dia) AS erros FROM (SELECT id_produto_loja, dia, target_t_plus_1 - {_sql_predict('x')} AS erro, row_number() OVER (PARTITION BY id_produto_loja ORDER BY dia DESC) AS n FROM completos, modelo WHERE NOT validacao) WHERE n <= 28 GROUP BY 1)
""" + _sql_paths(
    "SELECT p.*, unnest(range(1, 51)) AS amostra, e.erros FROM pontos p LEFT JOIN erros e USING (id_produto_loja)",
    "coalesce(erros[1 + CAST('0x' || substr(md5('42:' || id_produto_loja || ':' || amostra || ':' || (passo + 1)), 1, 8) AS BIGINT) % len(erros)], 0)",
) + ", previsoes AS (SELECT id_produto_loja, CAST(ultimo_dia + passo AS DATE) AS data, max(preco_atual) AS preco_atual, avg(p) AS preco_medio, stddev_pop(p) AS preco_std, quantile_cont(p, 0.05) AS ic_5pct, quantile_cont(p, 0.95) AS ic_95pct FROM caminhos WHERE passo > 0 GROUP BY 1, 2)\n"


def _simulated(spark, sf_dir):
    rows, model = _fitted(spark, sf_dir)
    errors = models.residuals(rows.filter("NOT validacao"), model.predict)
    return models.simulated_forecast(models.starting_points(_feature_table(spark, sf_dir)), errors, model.predict)


@query(MONTE_CARLO_SQL + f"SELECT id_produto_loja, {_day('data')} AS data, preco_atual, round(preco_medio, 6) AS preco_medio, round(preco_std, 6) AS preco_std, round(ic_5pct, 6) AS ic_5pct, round(ic_95pct, 6) AS ic_95pct FROM previsoes")
def monte_carlo_forecast(spark, sf_dir):
    found = _simulated(spark, sf_dir)
    return found.select(models.KEY, "data", "preco_atual", *(F.round(c, 6).alias(c) for c in ("preco_medio", "preco_std", "ic_5pct", "ic_95pct")))


@query(MONTE_CARLO_SQL + f""", m AS (SELECT id_produto_loja, round(min(preco_medio), 6) AS minimo, arg_min(data, (round(preco_medio, 6), data)) AS d, max(preco_atual) AS preco_atual FROM previsoes GROUP BY 1), q AS (SELECT *, greatest((preco_atual - minimo) / preco_atual * 100, 0) AS queda FROM m)
SELECT id_produto_loja, minimo, {_day('d')} AS melhor_dia, preco_atual, round(queda, 6) AS queda_pct, CASE WHEN queda >= 2 THEN 'aguardar' ELSE 'comprar_agora' END AS decisao FROM q""")
def buy_or_wait(spark, sf_dir):
    found = _simulated(spark, sf_dir).withColumn("preco_medio", F.round("preco_medio", 6))
    return forecast.buy_or_wait(found, F.col("preco_atual")).withColumn("queda_pct", F.round("queda_pct", 6))


@query(FIT_SQL + f""", baixos AS (SELECT id_produto_loja, list(v ORDER BY i) AS low FROM (SELECT id_produto_loja, i, min(x[i]) AS v FROM completos, (SELECT unnest(range(1, {K + 1})) AS i) WHERE NOT validacao GROUP BY 1, 2) GROUP BY 1),
v AS (SELECT id_produto_loja, f, sqrt(avg((target_t_plus_1 - {_sql_predict('y')}) ** 2)) AS rmse FROM (SELECT c.id_produto_loja, target_t_plus_1, f, list_transform(x, lambda v, i: CASE WHEN i = f THEN low[i] ELSE v END) AS y FROM completos c JOIN baixos USING (id_produto_loja), (SELECT unnest(range(0, {K + 1})) AS f) WHERE validacao), modelo GROUP BY 1, 2),
s AS (SELECT f, avg(rmse) AS rmse FROM v GROUP BY f), base AS (SELECT rmse AS rmse_base FROM s WHERE f = 0)
SELECT {list(panel.FEATURES)}[f] AS feature, round(rmse, 6) AS rmse, round(rmse_base, 6) AS rmse_base, round(rmse - rmse_base, 6) + 0.0::DOUBLE AS delta_rmse, round((rmse - rmse_base) / rmse_base * 100, 6) + 0.0::DOUBLE AS delta_pct FROM s, base WHERE f > 0""")
def feature_ablation(spark, sf_dir):
    rows, model = _fitted(spark, sf_dir)
    found = forecast.ablation_summary(models.ablation_scores(rows, model.predict))
    return found.select("feature", *((F.round(c, 6) + 0.0).alias(c) for c in ("rmse", "rmse_base", "delta_rmse", "delta_pct")))


@query(FIT_SQL + f""", voltas AS (SELECT id_produto_loja, dia, target_t_plus_1, x, r, row_number() OVER (PARTITION BY r ORDER BY md5('42:' || r || ':' || id_produto_loja || ':' || CAST(dia AS VARCHAR)), id_produto_loja, dia) - 1 AS lugar FROM completos, (SELECT unnest(range(1, 6)) AS r) WHERE NOT validacao),
pares AS (SELECT a.r, a.target_t_plus_1, a.x, b.x AS outro FROM voltas a JOIN voltas b ON a.r = b.r AND b.lugar = (a.lugar + 1) % (SELECT count(*) FROM voltas WHERE r = 1)),
s AS (SELECT r, f, sqrt(avg((target_t_plus_1 - {_sql_predict('y')}) ** 2)) AS rmse FROM (SELECT r, f, target_t_plus_1, list_transform(x, lambda v, i: CASE WHEN i = f THEN outro[i] ELSE v END) AS y FROM pares, (SELECT unnest(range(0, {K + 1})) AS f)), modelo GROUP BY r, f)
SELECT {list(panel.FEATURES)}[a.f] AS feature, round(avg(a.rmse - b.rmse), 6) + 0.0::DOUBLE AS importancia FROM s a JOIN s b ON a.r = b.r AND b.f = 0 WHERE a.f > 0 GROUP BY a.f""")
def permutation_importance(spark, sf_dir):
    rows, model = _fitted(spark, sf_dir)
    return models.permutation_importance(rows.filter("NOT validacao"), model.predict).withColumn("importancia", F.round("importancia", 6) + 0.0)


def _sql_arima(source: str) -> str:
    """``ajustes``: per product of ``source`` (with ``precos``) the best coefficients, the last difference and the last error."""
    walk = """list_reduce(list_transform(range(1, len(w) + 1), lambda i: {'w': w[i], 'p': CASE WHEN i > 1 THEN w[i - 1] ELSE 0 END, 'e': 0.0::DOUBLE, 's': 0.0::DOUBLE}),
        lambda a, c: {'w': c.w, 'p': c.p, 'e': c.w - phi * c.p - theta * a.e, 's': a.s + (c.w - phi * c.p - theta * a.e) * (c.w - phi * c.p - theta * a.e)})"""
    pick = "SELECT id_produto_loja, arg_min({'phi': phi, 'theta': theta, 'e': r.e}, (r.s, phi, theta)) AS m, any_value(w) AS w, any_value(ultimo) AS ultimo FROM (SELECT *, " + walk + " AS r FROM :rows) GROUP BY id_produto_loja"
    grid = lambda n, by: f"(SELECT unnest(range(-{n}, {n + 1})) / {by}.0::DOUBLE AS g1), (SELECT unnest(range(-{n}, {n + 1})) / {by}.0::DOUBLE AS g2)"
    return f""", difs AS (SELECT id_produto_loja, list_transform(range(2, len(precos) + 1), lambda i: precos[i] - precos[i - 1]) AS w, precos[-1] AS ultimo FROM {source} WHERE len(precos) >= 4),
grosso AS ({pick.replace(":rows", f"(SELECT *, g1 AS phi, g2 AS theta FROM difs, {grid(9, 10)})")}),
ajustes AS ({pick.replace(":rows", f"(SELECT * FROM (SELECT id_produto_loja, w, ultimo, m.phi + g1 AS phi, m.theta + g2 AS theta FROM grosso, {grid(10, 100)}) WHERE abs(phi) < 0.995 AND abs(theta) < 0.995)")}),
arima AS (SELECT id_produto_loja, list_transform(range(1, 8), lambda k: ultimo + (m.phi * w[-1] + m.theta * m.e) * list_sum(list_transform(range(0, k), lambda j: m.phi ** j))) AS previsoes FROM ajustes)
"""


@query(DAILY_SQL + ", s AS (SELECT id_produto_loja, list(preco ORDER BY dia) AS precos FROM diario GROUP BY 1)" + _sql_arima("s") + """SELECT id_produto_loja, k::INT AS passo, round(previsoes[k], 6) AS previsao FROM arima, (SELECT unnest(range(1, 8)) AS k)
UNION ALL SELECT id_produto_loja, unnest(range(1, 8))::INT, NULL FROM s WHERE len(precos) < 4""")
def arima_forecast(spark, sf_dir):
    return models.arima(panel.daily(views.series(spark, sf_dir))).withColumn("previsao", F.round("previsao", 6))


COMPARED_SQL = EVAL_SQL + ", s AS (SELECT id_produto_loja, list(preco ORDER BY dia) FILTER (WHERE n > 7) AS precos FROM p WHERE t >= 15 GROUP BY 1)" + _sql_arima("s") + """, todos AS (SELECT * FROM erros UNION ALL
    SELECT id_produto_loja, 'arima', count(*), sqrt(avg((f - preco) ** 2)), avg(abs(f - preco)), 100 * avg(abs((f - preco) / preco)) FILTER (WHERE preco > 0.01) FROM (SELECT id_produto_loja, preco, previsoes[8 - n] AS f FROM p JOIN arima USING (id_produto_loja) WHERE n <= 7) GROUP BY 1)
"""


def _compared(spark, sf_dir):
    return forecast.evaluate_baselines(panel.daily(views.series(spark, sf_dir)), more={"arima": models.arima_column(7)})


@query(COMPARED_SQL + "SELECT modelo, count(*) AS n, round(avg(rmse_euros), 5) AS rmse_medio, round(stddev_samp(rmse_euros), 5) AS rmse_desvio, round(avg(mae_euros), 5) AS mae_medio, round(avg(mape_pct), 5) AS mape_medio FROM todos GROUP BY modelo")
def model_comparison(spark, sf_dir):
    found = forecast.model_summary(forecast.common_products(_compared(spark, sf_dir)))
    return found.select("modelo", "n", *(F.round(c, 5).alias(c) for c in ("rmse_medio", "rmse_desvio", "mae_medio", "mape_medio")))


@query(COMPARED_SQL + ", m AS (SELECT modelo, row_number() OVER (PARTITION BY id_produto_loja ORDER BY round(rmse_euros, 4), modelo) AS k FROM todos), c AS (SELECT modelo, count(*) AS vitorias FROM m WHERE k = 1 GROUP BY modelo) SELECT *, 100.0::DOUBLE * vitorias / (SELECT sum(vitorias) FROM c) AS pct FROM c")
def model_win_rate(spark, sf_dir):
    return forecast.win_rate(_compared(spark, sf_dir))


def boosted_metrics(spark, sf_dir):
    """Rows only: boosted trees, fitted on all rows before each product's last 7."""
    rows = models.complete(_feature_table(spark, sf_dir))
    return models.boosted_metrics(rows.filter("validacao"), models.fit_boosted(rows.filter("NOT validacao")))


QUERIES["boosted_metrics"] = boosted_metrics

# Back-test

LISTS = (("a", ITEMS), ("b", ("cold gear", "blue plate")))
BACKTEST_SQL = f""", listas AS (SELECT * FROM (VALUES {', '.join(f"('{n}', '{i}')" for n, items in LISTS for i in items)}) t(lista, item)),
c AS (SELECT lista, item, date_trunc('month', data_recolha)::DATE AS dia, insignia, min(preco) AS preco FROM historico JOIN listas ON len(list_filter(string_split(item, ' '), lambda w: NOT contains(lower(nome), w))) = 0 GROUP BY ALL),
i AS (SELECT lista, dia, item, min(preco) AS minimo, avg(preco) AS media FROM c GROUP BY ALL),
dias AS (SELECT lista, dia, round(sum(minimo), 8) AS custo_minimo, round(sum(media), 8) AS custo_esperado, count(*) AS encontrados, any_value(pedidos) AS pedidos FROM i JOIN (SELECT lista, count(*) AS pedidos FROM listas GROUP BY lista) USING (lista) GROUP BY lista, dia HAVING count(*) >= ceil(any_value(pedidos) / 2.0)),
fiel AS (SELECT c.lista, c.dia, insignia, round(sum(preco), 8) AS custo, any_value(custo_minimo) AS custo_minimo FROM c JOIN dias d ON c.lista = d.lista AND c.dia = d.dia GROUP BY c.lista, c.dia, insignia HAVING count(*) = any_value(encontrados))
"""


def _backtest(spark, sf_dir):
    lists = spark.createDataFrame([(n, i) for n, items in LISTS for i in items], "lista string, item string")
    rows = views.history(spark, sf_dir).withColumn("dia", F.trunc("data_recolha", "month"))
    matched = backtest.matches_by_day(rows, lists, views.products(spark, sf_dir))
    return matched, backtest.simulate(matched, lists)


@query(BACKTEST_SQL + f"SELECT * REPLACE ({_day('dia')} AS dia) FROM dias")
def backtest_daily(spark, sf_dir):
    return _backtest(spark, sf_dir)[1]


@query(BACKTEST_SQL + "SELECT lista, insignia, count(*) AS dias_completos, round(avg(custo), 6) AS fidelidade, round(avg(custo_minimo), 6) AS recomendado, any_value(t) AS dias FROM fiel JOIN (SELECT lista, count(*) AS t FROM dias GROUP BY lista) USING (lista) GROUP BY lista, insignia HAVING count(*) >= 0.5 * any_value(t)")
def backtest_summary(spark, sf_dir):
    matched, days = _backtest(spark, sf_dir)
    return backtest.summary(days, backtest.loyalty(matched, days))


# By date, as the reference simulates; the two above are by month. Items of one word are found on most days.

FREQUENT = (("a", ("red", "blue", "small")), ("b", ("cold", "plate")))
BY_DATE_SQL = f""", listas AS (SELECT * FROM (VALUES {', '.join(f"('{n}', '{i}')" for n, items in FREQUENT for i in items)}) t(lista, item)),
c AS (SELECT lista, item, data_recolha::DATE AS dia, insignia, min(preco) AS preco FROM historico JOIN listas ON len(list_filter(string_split(item, ' '), lambda w: NOT contains(lower(nome), w))) = 0 GROUP BY ALL),
i AS (SELECT lista, dia, item, min(preco) AS minimo, avg(preco) AS media FROM c GROUP BY ALL),
dias AS (SELECT lista, dia, round(sum(minimo), 8) AS custo_minimo, round(sum(media), 8) AS custo_esperado, count(*) AS encontrados, any_value(pedidos) AS pedidos FROM i JOIN (SELECT lista, count(*) AS pedidos FROM listas GROUP BY lista) USING (lista) GROUP BY lista, dia HAVING count(*) >= ceil(any_value(pedidos) / 2.0)),
fiel AS (SELECT c.lista, c.dia, insignia, round(sum(preco), 8) AS custo, any_value(custo_minimo) AS custo_minimo FROM c JOIN dias d ON c.lista = d.lista AND c.dia = d.dia GROUP BY c.lista, c.dia, insignia HAVING count(*) = any_value(encontrados))
"""


def _backtest_by_date(spark, sf_dir):
    lists = spark.createDataFrame([(n, i) for n, items in FREQUENT for i in items], "lista string, item string")
    rows = views.history(spark, sf_dir).withColumn("dia", F.col("data_recolha").cast("date"))
    matched = backtest.matches_by_day(rows, lists, views.products(spark, sf_dir))
    return matched, backtest.simulate(matched, lists)


@query(BY_DATE_SQL + f"SELECT * REPLACE ({_day('dia')} AS dia) FROM dias")
def backtest_by_date(spark, sf_dir):
    return _backtest_by_date(spark, sf_dir)[1]


@query(BY_DATE_SQL + "SELECT lista, insignia, count(*) AS dias_completos, round(avg(custo), 6) AS fidelidade, round(avg(custo_minimo), 6) AS recomendado, any_value(t) AS dias FROM fiel JOIN (SELECT lista, count(*) AS t FROM dias GROUP BY lista) USING (lista) GROUP BY lista, insignia HAVING count(*) >= 0.5 * any_value(t)")
def backtest_by_date_summary(spark, sf_dir):
    matched, days = _backtest_by_date(spark, sf_dir)
    return backtest.summary(days, backtest.loyalty(matched, days))


@query(BY_DATE_SQL + f""", o AS (SELECT lista, dia, item, list(preco ORDER BY insignia) AS p FROM c GROUP BY ALL), s AS (SELECT *, unnest(range(1, 101)) AS sorteio FROM o)
SELECT lista, {_day('dia')} AS dia, sorteio::INT AS sorteio, round(sum(p[1 + CAST('0x' || substr(md5('42:' || sorteio || ':' || lista || ':' || CAST(dia AS VARCHAR) || ':' || item), 1, 8) AS BIGINT) % len(p)]), 8) AS custo FROM s GROUP BY lista, dia, sorteio""")
def backtest_random_sample(spark, sf_dir):
    return backtest.random_draws(_backtest_by_date(spark, sf_dir)[0]).withColumn("custo", F.round("custo", 8))


SAVED_SQL = BY_DATE_SQL + """, r AS (SELECT lista, insignia, count(*) AS n, round(avg(custo), 6) AS fidelidade, round(avg(custo_minimo), 6) AS mesmos, any_value(t) AS t FROM fiel JOIN (SELECT lista, count(*) AS t FROM dias GROUP BY lista) USING (lista) GROUP BY lista, insignia HAVING count(*) >= 0.5 * any_value(t)),
b AS (SELECT lista, min(fidelidade) AS fidelidade, arg_min(insignia, (fidelidade, insignia)) AS melhor_cadeia, arg_min(mesmos, (fidelidade, insignia)) AS mesmos FROM r GROUP BY lista),
m AS (SELECT lista, count(*) AS n_dias, avg(custo_minimo) AS recomendado, avg(custo_esperado) AS aleatorio FROM dias GROUP BY lista),
poupancas AS (SELECT lista, n_dias, recomendado, aleatorio, fidelidade, melhor_cadeia, aleatorio - recomendado AS poupanca_aleatorio_eur, (aleatorio - recomendado) / aleatorio * 100 AS poupanca_aleatorio_pct,
    coalesce(fidelidade - mesmos, 0) AS poupanca_fidelidade_eur, coalesce((fidelidade - mesmos) / fidelidade * 100, 0) AS poupanca_fidelidade_pct FROM m LEFT JOIN b USING (lista))
"""


def _saved(spark, sf_dir):
    matched, days = _backtest_by_date(spark, sf_dir)
    return backtest.savings(days, backtest.summary(days, backtest.loyalty(matched, days)))


@query(SAVED_SQL + "SELECT lista, n_dias, melhor_cadeia, round(recomendado, 6) AS recomendado, round(aleatorio, 6) AS aleatorio, round(fidelidade, 6) AS fidelidade, round(poupanca_aleatorio_eur, 6) AS poupanca_aleatorio_eur, round(poupanca_aleatorio_pct, 6) AS poupanca_aleatorio_pct, round(poupanca_fidelidade_eur, 6) AS poupanca_fidelidade_eur, round(poupanca_fidelidade_pct, 6) AS poupanca_fidelidade_pct FROM poupancas")
def backtest_savings(spark, sf_dir):
    saved = _saved(spark, sf_dir)
    return saved.withColumns({c: F.round(c, 6) for c, kind in saved.dtypes if kind == "double"})


@query(SAVED_SQL + "SELECT count(*) AS n_listas, round(avg(poupanca_aleatorio_eur), 6) AS poupanca_aleatorio_eur, round(avg(poupanca_aleatorio_pct), 6) AS poupanca_aleatorio_pct, round(coalesce(avg(poupanca_fidelidade_pct) FILTER (WHERE melhor_cadeia IS NOT NULL), 0), 6) AS poupanca_fidelidade_pct FROM poupancas")
def backtest_overall(spark, sf_dir):
    found = backtest.overall(_saved(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c, kind in found.dtypes if kind == "double"})


@query(""", w AS (SELECT *, unnest([0, 6, 12, 18]) AS recuo FROM (SELECT event_id, user_id, ts, value, CAST(floor(epoch(ts) / 21600) AS BIGINT) AS b FROM events)),
j AS (SELECT user_id AS id_produto_loja, b * 6 - recuo AS hora, arg_min(value, row(ts, event_id)) AS preco_antigo, arg_max(value, row(ts, event_id)) AS preco_novo, count(*) AS n FROM w GROUP BY ALL)
SELECT hora, id_produto_loja, preco_antigo, preco_novo, n FROM j WHERE preco_antigo <> preco_novo""")
def sliding_window_monitor(spark, sf_dir):
    rows = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("id_produto_loja"), "ts", F.col("event_id").alias("ordem"), F.col("value").alias("preco"))
    hours = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', inicio)")
    return trailing_changes(rows).select(hours.alias("hora"), "id_produto_loja", "preco_antigo", "preco_novo", "n")


# Labels and addresses


_CAPITALS = "list_aggregate(list_transform(string_split(lower(p_name || ' ' || p_brand), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')"


@query(f"SELECT p_partkey AS id_produto_mestre, {_CAPITALS} || ' ' || p_size || 'g' AS nome_padronizado FROM part")
def standard_names(spark, sf_dir):
    named = _spread(views.products(spark, sf_dir))
    return named.select("id_produto_mestre", display.standard_name(F.col("nome"), F.col("marca")).alias("nome_padronizado"))


@query("""SELECT id_loja_fisica, CASE insignia WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE insignia[1] || lower(insignia[2:]) END AS titulo,
CASE WHEN length(nome_loja || ' | ' || cidade || ' | ' || insignia || ' | loja fisica e online') > 55 THEN left(nome_loja || ' | ' || cidade || ' | ' || insignia || ' | loja fisica e online', 52) || '...'
    ELSE nome_loja || ' | ' || cidade || ' | ' || insignia || ' | loja fisica e online' END AS etiqueta FROM lojas_fisicas""")
def store_labels(spark, sf_dir):
    shops = views.outlets(spark, sf_dir)
    whole = F.concat_ws(" | ", "nome_loja", "cidade", "insignia", F.lit("loja fisica e online"))
    return shops.select("id_loja_fisica", display.store_title(F.col("insignia")).alias("titulo"), display.short_label(whole).alias("etiqueta"))


ADDRESSES_SQL = """, m AS (SELECT *, 'https://p.pt/home/produtos/' || lower(p_type) || '/g' || p_size % 10 || '/' || lower(replace(p_name, ' ', '-')) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '-' || p_partkey END || '.html' AS url FROM part)"""


@query(ADDRESSES_SQL + """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'p-' || left(sha1(url), 16) ELSE CAST(p_partkey AS VARCHAR) END AS id_externo,
lower(p_type) || '/g' || p_size % 10 AS categoria, p_type = 'ECONOMY' AND p_size % 10 = 3 AS na_categoria FROM m""")
def product_addresses(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    own = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("-"), F.col("p_partkey").cast("string")))
    folders = F.concat_ws("/", F.lit("https://p.pt/home/produtos"), F.lower("p_type"), F.concat(F.lit("g"), (F.col("p_size") % 10).cast("string")), F.lower(F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))))
    rows = part.select("p_partkey", F.concat(folders, own, F.lit(".html")).alias("url"))
    return rows.select("p_partkey", web.id_from_url(F.col("url"), "p").alias("id_externo"), web.category_from_url(F.col("url")).alias("categoria"), web.in_category(F.col("url"), "ECONOMY", "g3").alias("na_categoria"))


@query("SELECT p_partkey, p_size >= 20 AS numero_no_nome FROM part")
def prices_in_names(spark, sf_dir):
    part = views.table(spark, sf_dir, "part")
    name = F.concat_ws(" ", "p_name", F.concat(F.col("p_size").cast("string"), F.lit("g")))
    return part.select("p_partkey", display.price_in_name(F.col("p_size").cast("string"), name).alias("numero_no_nome"))


# Reports, continued


def _priced(rows: DataFrame) -> DataFrame:
    return rows.withColumn("preco_unitario", F.when(F.col("l_suppkey") % 4 != 0, F.col("preco")))


@query(f"""SELECT 'lojas' AS metrica, CAST(count(*) AS VARCHAR) AS valor FROM region
UNION ALL SELECT unnest(['produtos_mestre', 'produtos_sem_quantidade']), unnest([CAST(count(*) AS VARCHAR), '0']) FROM produtos
UNION ALL SELECT unnest(['produtos_loja', 'historico_precos', 'dias_distintos_historico', 'primeiro_dia_historico', 'ultimo_dia_historico']), unnest([CAST(count(DISTINCT id_produto_loja) AS VARCHAR), CAST(count(*) AS VARCHAR),
    CAST(count(DISTINCT CAST(data_recolha AS DATE)) AS VARCHAR), CAST(min(CAST(data_recolha AS DATE)) AS VARCHAR), CAST(max(CAST(data_recolha AS DATE)) AS VARCHAR)]) FROM factos
UNION ALL SELECT unnest(['precos_atuais', 'produtos_em_promocao', 'promocoes_incoerentes', 'produtos_sem_preco_unitario']), unnest([CAST(count(*) AS VARCHAR), CAST(count(*) FILTER (WHERE em_promocao) AS VARCHAR),
    CAST(count(*) FILTER (WHERE em_promocao AND (preco_original IS NULL OR preco_original <= preco)) AS VARCHAR), CAST(count(*) FILTER (WHERE l_suppkey % 4 = 0) AS VARCHAR)]) FROM atuais""")
def database_counters(spark, sf_dir):
    rows = views.facts(spark, sf_dir)
    return quality.database_counters(views.chains(spark, sf_dir), views.products(spark, sf_dir), rows, _priced(views.latest(rows)))


@query(f"""SELECT (SELECT count(*) FROM atuais) AS produtos_loja, {_day('max(data_recolha)')} AS ultima_recolha, count(*) AS historico_precos, (SELECT count(*) FROM lojas_fisicas WHERE ativa) AS lojas_fisicas FROM factos""")
def health_counters(spark, sf_dir):
    rows = views.facts(spark, sf_dir)
    return quality.health_counters(rows, views.latest(rows), views.outlets(spark, sf_dir))


@query("SELECT id_produto_loja, count(*) AS observacoes, min(preco) AS minimo, max(preco) AS maximo, round(avg(preco), 8) AS medio FROM factos GROUP BY id_produto_loja")
def history_kpis(spark, sf_dir):
    return quality.history_kpis(views.facts(spark, sf_dir)).withColumn("medio", F.round("medio", 8))


ANOMALIES_SQL = ORACLE_SQL["anomalies"].removeprefix(views.SQL)
ANOMALIES_SQL = ANOMALIES_SQL.replace("SELECT id_historico, id_produto_loja,", ", achadas AS (SELECT id_historico, id_produto_loja,") + ")"


@query(ANOMALIES_SQL + "SELECT criterio, count(*) AS n FROM achadas GROUP BY criterio")
def anomaly_counts(spark, sf_dir):
    return quality.anomaly_counts(anomalies(spark, sf_dir))


@query(ANOMALIES_SQL + "SELECT * FROM achadas ORDER BY id_produto_loja, dia, id_historico LIMIT 10")
def anomaly_sample(spark, sf_dir):
    return quality.anomaly_sample(anomalies(spark, sf_dir))


@query(f"SELECT insignia, nome, id_produto_loja, quantidade_valor, quantidade_unidade, preco, preco_original, em_promocao, {_day('data_recolha')} AS data_recolha FROM atuais_nomes ORDER BY insignia, nome, id_produto_loja LIMIT 20")
def listing_sample(spark, sf_dir):
    return quality.listing_sample(views.current(spark, sf_dir))


@query(CHANGES_SQL + f"SELECT * EXCLUDE (da, dn), {_day('da')} AS data_antiga, {_day('dn')} AS data_nova FROM alertas ORDER BY abs(variacao_pct) DESC NULLS LAST, id_produto_loja LIMIT 5")
def largest_alerts(spark, sf_dir):
    return monitor.largest_alerts(monitor.alerts(price_changes(spark, sf_dir)))


@query(LIST_SQL + f"""SELECT insignia, total, encontrados, completa, ({len(ITEMS)} - encontrados)::INT AS itens_em_falta, CASE WHEN completa THEN 'Lista completa' ELSE 'Cobertura parcial' END AS estado FROM por_cadeia""")
def basket_coverage(spark, sf_dir):
    rows = quality.coverage_labels(basket_by_chain(spark, sf_dir), len(ITEMS))
    return rows.select("insignia", "total", "encontrados", "completa", "itens_em_falta", "estado")


# Panels, continued


@query(f"""SELECT {_day('data_recolha')} AS dia, id_produto_loja, id_produto_mestre, id_loja, insignia AS cadeia, round(avg(preco), 8) AS preco, max(preco_original) AS preco_original,
bool_or(em_promocao) AS promo_flag, count(*) AS observacoes_no_dia FROM factos GROUP BY ALL""")
def daily_wide(spark, sf_dir):
    rows = views.facts(spark, sf_dir).select("*", F.to_date("data_recolha").alias("dia"), F.col("insignia").alias("cadeia"), F.col("preco").alias("preco_unitario_valor"), F.lit("g").alias("preco_unitario_unidade"))
    wide = panel.daily_wide(rows, ("id_produto_mestre", "id_loja", "cadeia"))
    return wide.withColumn("preco", F.round("preco", 8)).drop("preco_unitario_valor", "preco_unitario_unidade")


@query(DAILY_SQL + f""", e AS (SELECT *, CASE WHEN foi_observado = 1 AND day(dia) % 2 = 0 THEN preco_unitario_unidade END AS marca FROM painel)
SELECT id_produto_loja, {_day('dia')} AS dia, coalesce(last_value(marca IGNORE NULLS) OVER (PARTITION BY id_produto_loja ORDER BY e.dia ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(marca IGNORE NULLS) OVER (PARTITION BY id_produto_loja ORDER BY e.dia ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS marca FROM e""")
def static_fields(spark, sf_dir):
    known = F.when((F.col("foi_observado") == 1) & (F.day("dia") % 2 == 0), F.col("preco_unitario_unidade"))
    return panel.fill_static(_panel(spark, sf_dir).withColumn("marca", known), ("marca",)).select("id_produto_loja", "dia", "marca")


@query(DAILY_SQL + f""", p AS (SELECT *, row_number() OVER (PARTITION BY id_produto_loja ORDER BY dia DESC) <= 7 AS validacao, count(*) OVER (PARTITION BY id_produto_loja) AS todos FROM diario),
r AS (SELECT *, min(preco) FILTER (WHERE NOT validacao) OVER (PARTITION BY id_produto_loja) AS a, max(preco) FILTER (WHERE NOT validacao) OVER (PARTITION BY id_produto_loja) AS z FROM p WHERE todos >= 15)
SELECT id_produto_loja, {_day('dia')} AS dia, validacao, round((preco - a) / CASE WHEN z = a THEN 1 ELSE z - a END, 8) AS preco_norm FROM r""")
def scaled_prices(spark, sf_dir):
    rows = panel.scaled(panel.daily(views.series(spark, sf_dir)), ("preco",))
    return rows.select("id_produto_loja", "dia", "validacao", F.round("preco_norm", 8).alias("preco_norm"))


@query(DAILY_SQL + f""", p AS (SELECT *, row_number() OVER (PARTITION BY id_produto_loja ORDER BY dia DESC) AS n FROM diario)
SELECT id_produto_loja, {_day('min(dia)')} AS primeiro_dia, {_day('max(dia)')} AS ultimo_dia, arg_max(preco, dia) AS preco_atual, string_agg(CAST(CAST(round(preco * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY dia) FILTER (WHERE n <= 7) AS ultimos_centimos FROM p GROUP BY id_produto_loja""")
def forecast_context(spark, sf_dir):
    rows = panel.context(panel.daily(views.series(spark, sf_dir)))
    cents = F.array_join(F.transform("ultimos_precos", lambda p: F.round(p * 100).cast("long").cast("string")), ",")
    return rows.withColumn("ultimos_centimos", cents).drop("ultimos_precos")


@query(EVAL_SQL + """, b AS (SELECT * FROM erros WHERE modelo = 'naive') SELECT e.modelo, count(*) AS produtos, round(avg(e.rmse_euros), 6) AS rmse_euros, round(avg(b.rmse_euros) - avg(e.rmse_euros), 6) AS ganho_rmse_euros
FROM erros e JOIN b USING (id_produto_loja) WHERE e.modelo <> 'naive' GROUP BY e.modelo""")
def gain_over_naive(spark, sf_dir):
    rows = forecast.gain_over(_metrics(spark, sf_dir))
    return rows.select("modelo", "produtos", F.round("rmse_euros", 6).alias("rmse_euros"), F.round("ganho_rmse_euros", 6).alias("ganho_rmse_euros"))


# Ingestion, continued


@query(""", v AS (SELECT r_regionkey::INT + 1 AS id_loja, r_name AS insignia FROM region WHERE r_regionkey < 3), n AS (SELECT DISTINCT n_name AS insignia FROM nation UNION SELECT r_name FROM region WHERE r_regionkey >= 1)
SELECT id_loja, insignia, CASE WHEN insignia IN (SELECT insignia FROM n) THEN '2026-01-02' ELSE '2026-01-01' END AS data_atualizacao FROM v
UNION ALL SELECT (3 + row_number() OVER (ORDER BY insignia))::INT, insignia, '2026-01-02' FROM n WHERE insignia NOT IN (SELECT insignia FROM v)""")
def chain_upsert(spark, sf_dir):
    rest = [F.lit("Online").alias("formato_loja"), F.lit("Nacional").alias("localizacao"), F.lit("online").alias("canal")]
    region, nation = views.table(spark, sf_dir, "region"), views.table(spark, sf_dir, "nation")
    old = region.filter("r_regionkey < 3").select((F.col("r_regionkey") + 1).cast("int").alias("id_loja"), F.col("r_name").alias("insignia"), *rest, F.lit("2026-01-01").alias("data_atualizacao"))
    new = nation.select(F.col("n_name").alias("insignia"), *rest).unionByName(region.filter("r_regionkey >= 1").select(F.col("r_name").alias("insignia"), *rest))
    return ingest.upsert_chains(old, new, F.lit("2026-01-02")).select("id_loja", "insignia", "data_atualizacao")


@query("SELECT page_id, p_name || ' ' || page_id AS nome, CAST(page_id % 7 + 1 AS VARCHAR) || '.5' AS preco, '' AS preco_original FROM pages JOIN part ON p_partkey = page_id % 50 + 1 ORDER BY page_id")
def page_records(spark, sf_dir):
    """The pages have no products of their own: each gets a heading and a price in front."""
    made = views.table(spark, sf_dir, "pages").join(views.table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("page_id") % 50 + 1)
    name = F.concat_ws(" ", "p_name", F.col("page_id").cast("string"))
    price = F.concat((F.col("page_id") % 7 + 1).cast("string"), F.lit(",5"))
    front = F.concat(F.lit("<h1>"), name, F.lit('</h1><p class="current-price">'), price, F.lit(" €</p>"))
    rows = made.select(F.concat(F.lit("https://p.pt/p-"), F.col("page_id").cast("string"), F.lit(".html")).alias("url"), F.concat(front, F.coalesce("html", F.lit(""))).alias("html"))
    return pages.page_records(rows, "Loja", "2026-01-01").select(F.col("id_externo").cast("long").alias("page_id"), "nome", "preco", "preco_original")
