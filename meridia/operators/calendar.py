"""Trading calendars: session tables with overrides, trading days, neighbours of days, dates of sessions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators.bars import day_template, relative_minute, session_runs, supported_days

#: Relative minutes: from here on a bar belongs to the day's side, and before the other to the evening before midnight.
DAY_SIDE, MIDNIGHT = 390, 210


class CalendarError(ValueError):
    """A calendar that contradicts what is known."""


def calendar_date(trading_date: Column, previous: Column, rel: Column) -> Column:
    """Calendar date of a bar of a trading date: the date itself on the day's side; in the night session the previous
    trading day before midnight and the day after that from then on."""
    return F.when(rel >= DAY_SIDE, trading_date).when(rel < MIDNIGHT, previous).otherwise(F.date_add(previous, 1))


def neighbours(days: DataFrame, day: str = "day") -> DataFrame:
    """(day, previous, following, place) of a calendar; the window runs over days alone."""
    w = Window.partitionBy(F.lit(0)).orderBy(day)
    one = days.select(day).distinct()
    return one.select(day, F.lag(day).over(w).alias("previous"), F.lead(day).over(w).alias("following"), (F.row_number().over(w) - 1).alias("place"))


class TradeCalendar:
    """Lookups in a calendar, and its cache: a Parquet table of ``trade_date``."""

    def __init__(self, days: DataFrame, day: str = "trade_date"):
        self.days = days.select(F.to_date(day).alias("trade_date")).where("trade_date is not null").distinct()

    def is_trading_day(self, date: datetime.date) -> bool:
        return not self.days.where(F.col("trade_date") == F.lit(date)).isEmpty()

    def _one(self, date: datetime.date, after: bool) -> datetime.date:
        side = self.days.where(F.col("trade_date") > F.lit(date) if after else F.col("trade_date") < F.lit(date))
        found = side.agg((F.min if after else F.max)("trade_date").alias("d")).first().d
        if found is None:
            raise IndexError(f"no trading day {'after' if after else 'before'} {date}")
        return found

    def following(self, date: datetime.date) -> datetime.date:
        """First trading day strictly after a date."""
        return self._one(date, True)

    def previous(self, date: datetime.date) -> datetime.date:
        """Last trading day strictly before a date."""
        return self._one(date, False)

    def between(self, start: datetime.date, end: datetime.date) -> DataFrame:
        """Trading days from start to end, both included; none where start is later."""
        return self.days.where(F.col("trade_date").between(F.lit(start), F.lit(end))).orderBy("trade_date")

    def save(self, path: str) -> None:
        self.days.coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str, max_age_days: int = 7) -> TradeCalendar | None:
        """The cached calendar; None where there is none or its files are older than ``max_age_days`` whole days."""
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(target):
            return None
        age = jvm.java.lang.System.currentTimeMillis() - fs.getFileStatus(target).getModificationTime()
        return None if age // 86_400_000 > max_age_days else cls(spark.read.parquet(path))


def _minutes(clock: str) -> int:
    hour, minute = clock.split(":")[:2]
    return (int(hour) * 60 + int(minute) - 1230) % 1440


def template_of(intervals: list[tuple[str, str]]) -> str:
    """Wall-clock intervals as a template, by start; an end at or before its start is a day later."""
    spans = sorted((lo, hi if hi > lo else hi + 1440) for lo, hi in ((_minutes(a), _minutes(b)) for a, b in intervals))
    return ",".join(f"{lo}-{hi}" for lo, hi in spans)


def override(runs: DataFrame, product: str, start: datetime.date, end: datetime.date, template: str) -> DataFrame:
    """Session runs (product, date_start, date_end, template) with one product's template set from start to end; runs that
    overlap keep what lies outside."""
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    own = (F.col("product") == F.lit(product)) & (F.col("date_start") <= hi) & (F.col("date_end") >= lo)
    left = F.when(F.col("date_start") < lo, F.struct(F.col("date_start").alias("a"), F.date_sub(lo, 1).alias("b")))
    right = F.when(F.col("date_end") > hi, F.struct(F.date_add(hi, 1).alias("a"), F.col("date_end").alias("b")))
    whole = F.struct(F.col("date_start").alias("a"), F.col("date_end").alias("b"))
    pieces = F.when(own, F.array_compact(F.array(left, right))).otherwise(F.array(whole))
    cut = runs.withColumn("__p", F.explode(pieces)).select("product", F.col("__p.a").alias("date_start"), F.col("__p.b").alias("date_end"), "template")
    kind = runs.schema["product"].dataType
    new = runs.sparkSession.range(1).select(F.lit(product).cast(kind).alias("product"), lo.alias("date_start"), hi.alias("date_end"), F.lit(template).alias("template"))
    return cut.unionByName(new)


def build_calendar(bars: DataFrame, anchors: list[str], required: int, shortest: int = 5, overrides: list[tuple[str, datetime.date, datetime.date, str]] | None = None, known_days: DataFrame | None = None) -> dict[str, DataFrame]:
    """Four tables of bars (product, trading_date, wall): ``templates`` (template_id, seq, start, end, bars), numbered
    in order of their sessions; ``sessions`` (product, date_start, date_end, template_id); ``exceptions`` (product,
    trading_date): days of a product whose run has a night session and that have none; and ``days`` (day).

    ``overrides`` are (product, start, end, template), applied in turn. An inferred trading day within the range of
    ``known_days`` (day) that isn't among them is an error."""
    runs = session_runs(day_template(bars), shortest)
    for one in overrides or []:
        runs = override(runs, *one)
    days = supported_days(bars, anchors, required)
    if known_days is not None:
        ends = known_days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
        strange = days.where(F.col("day").between(F.lit(ends.lo), F.lit(ends.hi))).join(known_days, "day", "left_anti").orderBy("day").limit(5).collect()
        if strange:
            raise CalendarError(f"inferred trading days that aren't known: {[str(r.day) for r in strange]}")
    # sessions compare as numbers, not as text
    parts = F.transform(F.split("template", ","), lambda p: F.struct(F.split(p, "-")[0].cast("int").alias("a"), F.split(p, "-")[1].cast("int").alias("b")))
    numbered = runs.select("template").distinct().withColumn("template_id", F.dense_rank().over(Window.orderBy(parts)) - 1)
    templates = _sessions_of(numbered)
    sessions = runs.join(numbered, "template").select("product", "date_start", "date_end", "template_id")
    night = F.split(F.split("template", ",")[0], "-")[0].cast("int") < DAY_SIDE
    with_night = runs.where(night).select("product", "date_start", "date_end")
    seen = bars.groupBy("product", "trading_date").agg(F.min(relative_minute(F.col("wall"))).alias("first"))
    months = with_night.withColumn("__m", F.explode(F.sequence(F.trunc("date_start", "month"), F.trunc("date_end", "month"), F.expr("interval 1 month"))))
    met = seen.where(F.col("first") >= DAY_SIDE).withColumn("__m", F.trunc("trading_date", "month")).join(months, ["product", "__m"]).where("trading_date between date_start and date_end")
    return {"templates": templates, "sessions": sessions, "exceptions": met.select("product", "trading_date").distinct(), "days": days}


def _sessions_of(numbered: DataFrame) -> DataFrame:
    part = numbered.select("template_id", F.posexplode(F.split("template", ",")).alias("seq", "part"))
    lo, hi = F.split("part", "-")[0].cast("int"), F.split("part", "-")[1].cast("int")
    return part.select("template_id", "seq", lo.alias("start"), hi.alias("end"), (hi - lo).alias("bars"))


def developer_universe(liquidity: DataFrame, candidates: list[str], size: int = 10) -> list[str]:
    """The ``size`` candidates of greatest latest turnover (product, day, adv), or the first candidates where none has
    any. A convenience: it knows later days."""
    known = liquidity.where(F.col("product").isin(candidates) & F.col("adv").isNotNull())
    ranked = known.groupBy("product").agg(F.max_by("adv", "day").alias("adv")).orderBy(F.desc("adv"), "product").limit(size).collect()
    return [r.product for r in ranked] or candidates[:size]


def resolve_splits(start: datetime.date, end: datetime.date, train: tuple[datetime.date, datetime.date], validation: tuple[datetime.date, datetime.date], share: float = 0.7) -> tuple[tuple[datetime.date, datetime.date], tuple[datetime.date, datetime.date]]:
    """Configured training and validation spans within start to end; where either is empty there, a cut at ``share``."""
    inside = [(max(a, start), min(b, end)) for a, b in (train, validation)]
    if all(a < b for a, b in inside):
        return inside[0], inside[1]
    cut = start + datetime.timedelta(days=int((end - start).days * share))
    return (start, cut), (cut + datetime.timedelta(days=1), end)
