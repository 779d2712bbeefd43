"""Tables of a relational database, read in partitions and written in batches over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rows fetched at once, and rows that a partition holds, about.
FETCHED = 10_000
PER_PARTITION = 1_000_000


def _options(url: str, driver: str | None, **more: str) -> dict[str, str]:
    return {"url": url, **({"driver": driver} if driver else {}), **more}


def scan(spark: SparkSession, url: str, table: str, by: str | None = None, partitions: int | None = None, driver: str | None = None, where: str = "", **properties: str) -> DataFrame:
    """A table, or the rows ``where`` says, in ranges of the numeric or date column ``by``, each its own query.

    The ranges run from the least to the greatest value, which the database is asked for; rows without a value are in the first. There are
    as many as ``partitions``, else one for about ``PER_PARTITION`` rows. Filters and columns of later steps are pushed to the database.
    Without ``by`` one task reads the table.
    """
    source = f"(SELECT * FROM {table} WHERE {where}) lido" if where else table
    base = spark.read.format("jdbc").options(**_options(url, driver, fetchsize=str(FETCHED), **properties))
    if by is None:
        return base.option("dbtable", source).load()
    asked = f"(SELECT MIN({by}) AS MENOR, MAX({by}) AS MAIOR, COUNT(*) AS LINHAS FROM {source}) limites"
    low, high, rows = base.option("dbtable", asked).load().first()
    n = partitions or max(1, -(-rows // PER_PARTITION))
    if low is None or n == 1:
        return base.option("dbtable", source).load()
    bounds = {"partitionColumn": by, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(n)}
    return base.option("dbtable", source).options(**bounds).load()


def store(rows: DataFrame, url: str, table: str, mode: str = "append", connections: int = 8, driver: str | None = None, **properties: str) -> None:
    """Writes rows in batches, over at most so many connections."""
    options = _options(url, driver, dbtable=table, numPartitions=str(connections), batchsize=str(FETCHED), **properties)
    rows.write.format("jdbc").options(**options).mode(mode).save()
