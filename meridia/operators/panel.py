"""Cuts of panels: stretches of days with margins, warm-up days, tails, dense frames, row patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def day_places(df: DataFrame, day: str) -> DataFrame:
    """(day, __place) of the distinct days, from 0; the window runs over days alone."""
    return df.select(day).distinct().withColumn("__place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(day)) - 1)


def panel_slice(df: DataFrame, start, end, before: int = 0, after: int = 0, day: str = "date", instrument: str = "instrument", fields: list[str] | None = None) -> DataFrame:
    """Rows of the panel's days from start to end with ``before`` and ``after`` more of its days on either side; instruments
    that have no value of any field there are left out."""
    days = day_places(df, day)
    ends = days.where(F.col(day).between(F.lit(start), F.lit(end))).agg(F.min("__place").alias("__lo"), F.max("__place").alias("__hi"))
    kept = days.crossJoin(F.broadcast(ends)).where(F.col("__place").between(F.col("__lo") - before, F.col("__hi") + after)).select(day)
    rows = df.join(kept, day)
    fields = fields or [c for c in df.columns if c not in (day, instrument)]
    known = rows.where(F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull()).select(instrument).distinct()
    return rows.join(known, instrument, "left_semi").select(df.columns)


def with_warm_up(df: DataFrame, start, by: list[str], day: str = "day", days: int = 130) -> DataFrame:
    """Rows from ``start`` on and of the last ``days`` days before it that each key has; ``warm`` tells these."""
    early = F.col(day) < F.lit(start)
    place = F.dense_rank().over(Window.partitionBy(*by, early).orderBy(F.desc(day)))
    return df.withColumn("warm", early).withColumn("__r", place).where(~F.col("warm") | (F.col("__r") <= days)).drop("__r")


def tail(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The last n rows of each key in an order given from the end."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def dense(df: DataFrame, field: str, instruments: list, day: str = "date", instrument: str = "instrument") -> DataFrame:
    """A row per day and a column per instrument, null where there is no value."""
    return df.groupBy(day).pivot(instrument, instruments).agg(F.first(field, ignorenulls=True))


def commonest_pattern(df: DataFrame, by: list[str], row: list[str], item: str) -> DataFrame:
    """(by, pattern, n): of each key the set of items, sorted, that most of its rows (named by ``row``) have; ties go to the lesser set."""
    each = df.groupBy(*by, *row).agg(F.sort_array(F.collect_set(item)).alias("pattern"))
    counts = each.groupBy(*by, "pattern").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "pattern")
    return counts.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
