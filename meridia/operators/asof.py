"""As-of, interval, lagged and point-in-time joins without nested-loop plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def backward(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], strict: bool = False) -> DataFrame:
    """left with each value of the last right row at or before (strictly before) its time, by key.

    Both sides are merged in one sort per key and carried forward, so neither side is broadcast and
    no pair is made. Of right rows at one time the greatest values win.
    """
    names = left.columns
    tag = F.lit(0 if strict else 1)
    l = left.select(*[F.col(c) for c in names], F.col(left_on).alias("__t"), tag.alias("__side"), F.lit(True).alias("__left"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__v"))
    r = right.groupBy(*by, F.col(right_on).alias("__t")).agg(F.max(F.struct(*values)).alias("__v"))
    r = r.select(*[F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names], "__t", (F.lit(1) - tag).alias("__side"), F.lit(False).alias("__left"), "__v")
    w = Window.partitionBy(*by).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    carried = l.unionByName(r).withColumn("__v", F.last("__v", ignorenulls=True).over(w))
    return carried.where("__left").select(*names, *[F.col(f"__v.{v}").alias(v) for v in values])


def next_days(dates: DataFrame, days: DataFrame, date_col: str = "date", day_col: str = "day") -> DataFrame:
    """dates with ge (first day at or after) and gt (first day after). The calendar bounds the number
    of dates, so it is one small window over distinct dates, then an equi-join."""
    d = days.select(F.col(day_col).alias("__d"), F.lit(True).alias("__day"))
    q = dates.select(F.col(date_col).alias("__d"), F.lit(False).alias("__day")).distinct()
    merged = d.union(q).groupBy("__d").agg(F.max("__day").alias("__day"), F.count_if(~F.col("__day")).alias("n"))
    own = F.when(F.col("__day"), F.col("__d"))
    w = Window.partitionBy(F.lit(0)).orderBy("__d")
    ahead = merged.withColumn("ge", F.first(own, True).over(w.rowsBetween(0, Window.unboundedFollowing))).withColumn("gt", F.first(own, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return dates.join(ahead.where("n > 0").select(F.col("__d").alias(date_col), "ge", "gt"), date_col)


def disjoint_spans(spans: DataFrame, by: list[str], start: str, end: str, values: list[str]) -> DataFrame:
    """(by, start, end, values): what is left of each span beside those of its key that start earlier (ties: the lesser
    values). A span that starts earlier wins wherever it reaches, so of a later one the part behind all ends before
    counts: a running maximum. A null end is open."""
    far = F.lit("9999-12-31").cast("date")
    known = spans.select(*by, F.col(start).alias("__s"), F.coalesce(end, far).alias("__e"), *values).where("__s <= __e")
    before = Window.partitionBy(*by).orderBy("__s", *values, "__e").rowsBetween(Window.unboundedPreceding, -1)
    lo = F.greatest(F.col("__s"), F.coalesce(F.date_add(F.max("__e").over(before), 1), F.col("__s")))
    return known.withColumn("__s", lo).where("__s <= __e")


def interval(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str, values: list[str], unit: int = 32) -> DataFrame:
    """points with the values of the span start <= at <= end of the same key that starts first.

    Spans are made disjoint first, so a point meets one at most and nothing needs to be grouped. Both sides meet by
    equality of key and stretch of ``unit`` days; a null end is open and reaches to the last point.
    """
    last = points.agg(F.max(at).alias("__last"))
    bucket = lambda c: F.floor(F.unix_date(c) / unit)
    s = disjoint_spans(spans, by, start, end, values).crossJoin(F.broadcast(last)).withColumn("__e", F.least("__e", "__last")).where("__s <= __e")
    s = s.withColumn("__b", F.explode(F.sequence(bucket(F.col("__s")), bucket(F.col("__e"))))).drop("__last")
    p = points.withColumn("__b", bucket(F.col(at)))
    same = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in by] + [F.col("p.__b") == F.col("s.__b"), F.col(f"p.{at}").between(F.col("s.__s"), F.col("s.__e"))]
    met = p.alias("p").join(s.alias("s"), same, "left")
    return met.select(*[F.col(f"p.{c}") for c in points.columns], *[F.col(f"s.{v}") for v in values])


def members_on(log: DataFrame, day: Column) -> DataFrame:
    """Members of a log of (stock_code, in_date, out_date) on a day; the out date is excluded."""
    return log.where((F.col("in_date") <= day) & (F.col("out_date").isNull() | (F.col("out_date") > day))).select("stock_code").distinct()


def latest_edges(edges: DataFrame, day: Column, max_age: int = 45, q_max: float = 0.1, least_stability: float = 0.0) -> DataFrame:
    """Edges as known before a day: of each pair the latest no older than max_age days (ties: the
    greater config hash), and only then those that pass the cuts. A newer failing row hides an
    older passing one."""
    fresh = edges.where((F.col("asof_date") < day) & (F.col("asof_date") >= F.date_sub(day, max_age)))
    w = Window.partitionBy("leader", "follower").orderBy(F.desc("asof_date"), F.desc("config_hash"))
    newest = fresh.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return newest.where((F.col("q_value") <= q_max) & (F.coalesce("stability", F.lit(0.0)) >= least_stability))


def top_leaders(edges: DataFrame, k: int = 3) -> DataFrame:
    """The k leaders of each follower by strength of a_stat (ties: the leader's name)."""
    w = Window.partitionBy("follower").orderBy(F.desc(F.abs("a_stat")), "leader")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def full_outer(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Columns of all frames side by side by key; a column of the same name is taken from the last."""
    out = frames[0]
    for f in frames[1:]:
        clash = [c for c in out.columns if c in f.columns and c not in keys]
        out = out.drop(*clash).join(f, keys, "full_outer")
    return out


def fill_forward(df: DataFrame, by: list[str], order: list[str], columns: list[str], default: float | None = None) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for c in columns:
        filled = F.last(c, ignorenulls=True).over(w)
        df = df.withColumn(c, filled if default is None else F.coalesce(filled, F.lit(default)))
    return df


def reindex(df: DataFrame, days: DataFrame, key: str, day: str) -> DataFrame:
    """A row per key and calendar day between the key's own first and last day; missing values are null."""
    ends = df.groupBy(key).agg(F.min(day).alias("__lo"), F.max(day).alias("__hi"))
    d = days.select(F.col(day).alias("__d"), F.trunc(day, "month").alias("__m"))
    e = ends.withColumn("__m", F.explode(F.sequence(F.trunc("__lo", "month"), F.trunc("__hi", "month"), F.expr("interval 1 month"))))
    grid = e.join(d, "__m").where("__d between __lo and __hi").select(key, F.col("__d").alias(day))
    return grid.join(df, [key, day], "left")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).union(b.exceptAll(a)).distinct()


def monthly_edges(edges: DataFrame, k: int = 3, max_age: int = 45, q_max: float = 0.1, least_stability: float = 0.0) -> DataFrame:
    """(month, follower, rank, leader, lag_bars, strength): the k leaders of each follower as known
    before each month's first day. An edge is copied to the few months it is fresh in, so months and
    edges meet by equality."""
    days = F.sequence(F.trunc(F.add_months("asof_date", 1), "month"), F.trunc(F.date_add("asof_date", max_age), "month"), F.expr("interval 1 month"))
    reach = F.trunc(F.date_add("asof_date", max_age), "month") > F.trunc("asof_date", "month")
    fresh = edges.where(reach).withColumn("month", F.explode(days)).where((F.col("asof_date") < F.col("month")) & (F.col("asof_date") >= F.date_sub("month", max_age)))
    newest = Window.partitionBy("month", "leader", "follower").orderBy(F.desc("asof_date"), F.desc("config_hash"))
    known = fresh.withColumn("__r", F.row_number().over(newest)).where("__r = 1").where((F.col("q_value") <= q_max) & (F.coalesce("stability", F.lit(0.0)) >= least_stability))
    place = Window.partitionBy("month", "follower").orderBy(F.desc(F.abs("a_stat")), "leader")
    return known.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("month", "follower", "rank", "leader", "lag_bars", "strength")


def leader_terminals(panel: DataFrame, edges: DataFrame, rank: int) -> DataFrame:
    """panel (product, row, month, x, oi_chg, stale) with the columns of its leader of a rank: lead_ret
    (sum of the leader's x over its last lag_bars rows, 0 until there are as many), lead_oi_chg,
    lead_stale and ll_strength; 0 without a leader. Sums are prefix sums met on the row they start from."""
    w = Window.partitionBy("product").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    sums = panel.select(F.col("product").alias("leader"), "row", F.sum(F.coalesce("x", F.lit(0.0))).over(w).alias("__s"), F.col("oi_chg").alias("lead_oi_chg"), F.col("stale").alias("lead_stale"))
    own = edges.where(F.col("rank") == rank).select("month", F.col("follower").alias("product"), "leader", "lag_bars", F.col("strength").alias("ll_strength"))
    met = panel.join(own, ["month", "product"], "left").join(sums, ["leader", "row"], "left")
    start = sums.select("leader", (F.col("row")).alias("__row0"), F.col("__s").alias("__s0"))
    met = met.withColumn("__row0", F.col("row") - F.col("lag_bars")).join(start, ["leader", "__row0"], "left")
    total = F.when(F.col("row") + 1 == F.col("lag_bars"), F.col("__s")).when(F.col("row") + 1 > F.col("lag_bars"), F.col("__s") - F.coalesce("__s0", F.lit(0.0)))
    out = met.withColumn("lead_ret", total)
    return out.select(*panel.columns, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("lead_ret", "lead_oi_chg", "lead_stale", "ll_strength")])
