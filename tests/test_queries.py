"""Every registered query with SQL against DuckDB on the small tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from feira.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(f"{sf_dir}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if path.is_file() else f'{path}/*.parquet'}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    found = QUERIES[name](spark, sf_dir)
    columns = sorted(found.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_anomaly_counts_equal_sql_on_odd_rows(spark, sf_dir, tmp_path):
    """Rows without a day or number come last in a product; equal quartiles make no fence, infinite ones and those that are no numbers among them."""
    inf, nan, days = math.inf, math.nan, (None, 1, 2, 3, 4)
    given = [("day", days, (1.0, 0.6, 0.6, 0.6, 0.6)), ("infinite", days[1:], (inf, inf, inf, inf)), ("not numbers", days[1:], (1.0, nan, nan, nan, nan)), ("number", (1, 1), (1.0, 0.6))]
    rows = [(None if key == "number" and n == 0 else 10 * user + n, day and f"2024-01-0{day} 08:00:00", user, "view", price) for user, (key, at, prices) in enumerate(given) for n, (day, price) in enumerate(zip(at, prices))]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for t in set(TABLES) - {"events"}:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("anomaly_counts", "anomalies"):
        mine = [tuple(plain(v) for v in r) for r in QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(mine, key=str) == sorted((tuple(plain(v) for v in r) for r in con.execute(ORACLE_SQL[name]).fetchall()), key=str)
