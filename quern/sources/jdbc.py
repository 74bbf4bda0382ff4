"""JDBC in and out: arbitrary queries, one partition a key range, batched writes with retries.

A database in the driver's own process goes through :mod:`.embedded` where executors can't reach it.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.splitter import KeyRange
from . import embedded


def query_source(spark: SparkSession, url: str, query: str, fetch: int = 100, **options: str) -> DataFrame:
    out = spark.read.format("jdbc").options(url=url, query=query, fetchsize=str(fetch), **options).load()
    return embedded.read(out, url, [query], {"fetchsize": fetch, **options}) if embedded.out_of_reach(spark, url) else out


def ranged_source(spark: SparkSession, url: str, table: str, column: str, ranges: list[KeyRange], fetch: int = 100, **properties: str) -> DataFrame:
    """All ranges of a table in one DataFrame, one partition each; filters and columns are pushed to the source."""
    out = spark.read.jdbc(url, table, predicates=[r.sql(column) for r in ranges], properties={"fetchsize": str(fetch), **properties})
    if embedded.out_of_reach(spark, url):
        return embedded.read(out, url, [f"SELECT * FROM {table} WHERE {r.sql(column)}" for r in ranges], {"fetchsize": fetch, **properties})
    return out


def table_sink(df: DataFrame, url: str, table: str, batch: int = 100, tries: int = 3, wait: float = 30, **properties: str) -> None:
    """Append in batches; a connection that fails is tried again. Rows must be idempotent in the target, as with a key."""
    if embedded.out_of_reach(df.sparkSession, url):
        retried(lambda: embedded.append(df, url, table, batch, properties), tries, wait)
    else:
        rows = df.coalesce(1) if embedded.embedded(url) else df  # many rows lock a whole table there, so writers would wait for each other
        retried(lambda: rows.write.mode("append").option("batchsize", batch).jdbc(url, table, properties=properties), tries, wait)


def retried(action: Callable, tries: int = 3, wait: float = 30, sleep: Callable[[float], None] = time.sleep):
    """``action()``, tried up to ``tries`` times with a pause between; the last error is raised."""
    for left in range(tries - 1, -1, -1):
        try:
            return action()
        except Exception:
            if not left:
                raise
            sleep(wait)
