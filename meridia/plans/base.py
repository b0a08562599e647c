"""Tables as the panels that the operators work on, with the SQL of the same panels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions.compile import Panel
from meridia.plans.registry import ORACLES, QUERIES

BARS = Panel(("product", "day"), ("bob",), ("bob",))
SERIES = Panel(("product",), ("bob",), ("bob",))
MONTHS = Panel(("instrument",), ("date",), ("date",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query and its SQL."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def r5(c):
    """Rounded for comparison, off decimal ties, without negative zero."""
    return F.round(c + F.lit(3.1e-7), 5) + F.lit(0.0)


def sql5(x: str, name: str) -> str:
    return f"round(({x}) + 3.1e-7, 5) + 0.0 AS {name}"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bars: product, bob, day (the segment), close, volume."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id"), F.col("user_id").alias("product"), F.col("ts").cast("timestamp_ntz").alias("bob"), F.to_date("ts").alias("day"), F.col("value").alias("close"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("volume"), "event_type",
    )


BARS_SQL = """bars AS (SELECT event_id, user_id AS product, ts AS bob, CAST(ts AS DATE) AS day, value AS close,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS volume, event_type FROM events)"""


def months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as monthly prices of twelve instruments."""
    li = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / 1000
    r4 = lambda c: F.round(c + F.lit(3.17e-6), 4)  # noqa: E731  off decimal ties
    out = li.groupBy(F.trunc("l_shipdate", "month").alias("date"), (F.col("l_suppkey") % 12).alias("instrument")).agg(
        r4(F.avg(price)).alias("close"), r4(F.avg(price * (1 - F.col("l_discount")))).alias("open"), r4(F.max(price)).alias("high"),
        r4(F.min(price)).alias("low"), r4(F.sum("l_quantity") / 100).alias("volume"),
    )
    return out


MONTHS_SQL = """months AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, l_suppkey % 12 AS instrument,
  round(avg(l_extendedprice / 1000) + 3.17e-6, 4) AS close, round(avg(l_extendedprice / 1000 * (1 - l_discount)) + 3.17e-6, 4) AS open,
  round(max(l_extendedprice / 1000) + 3.17e-6, 4) AS high, round(min(l_extendedprice / 1000) + 3.17e-6, 4) AS low, round(sum(l_quantity) / 100 + 3.17e-6, 4) AS volume
  FROM lineitem GROUP BY ALL)"""


def over_bars(n: int) -> str:
    return f"OVER (PARTITION BY product, day ORDER BY bob ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def over_months(n: int) -> str:
    return f"OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
