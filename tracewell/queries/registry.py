"""Registration and the readers shared by all queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators.ordered import add_index
from tracewell.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, folder, name)


def r6(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, digits) for c in cols})


def event_samples(spark: SparkSession, folder: str, key: str = "user_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """Events as samples: one trace per user (or per type), in time order."""
    rows = table(spark, folder, "events").select(key, "ts", "event_id", F.col("value").alias("v"), *extra)
    return add_index(rows, [key], ["ts", "event_id"])


# the same numbering in SQL
USER_SAMPLES = """s AS (SELECT user_id, event_id, event_type, ts, value AS v,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"""
TYPE_SAMPLES = """s AS (SELECT event_type, event_id, user_id, ts, value AS v,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events)"""


def supplier_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as samples: one trace per supplier in shipping order, scaled price as value."""
    rows = table(spark, folder, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / 1000).alias("v")
    )
    return add_index(rows, ["l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "v"])


SUPPLIER_SAMPLES = """s AS (SELECT l_suppkey, l_extendedprice / 1000 AS v,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice / 1000) - 1 AS i
  FROM lineitem)"""
