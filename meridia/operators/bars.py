"""Trading days, sessions, dominant contracts, continuous series, grids and features of minute bars."""

from __future__ import annotations

import datetime
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, NumericType

from meridia.functions.compile import Panel
from meridia.operators.asof import next_days
from meridia.operators.sequential import ewm_halflife, ewm_varying, per_series
from meridia.session import written

NIGHT_START = 20 * 60 + 30


def minute_of_day(wall: Column) -> Column:
    return F.hour(wall) * 60 + F.minute(wall)


def relative_minute(wall: Column) -> Column:
    """Minutes since 20:30, so that a night session comes before its day's."""
    return F.pmod(minute_of_day(wall) - NIGHT_START, F.lit(1440))


def wall_minute(rel: Column) -> Column:
    return F.pmod(rel + NIGHT_START, F.lit(1440))


def trading_dates(bars: DataFrame, days: DataFrame, wall: str = "wall", day_col: str = "day") -> DataFrame:
    """Adds trading_date: from 21:00 the next trading day, before 03:00 this or the next, else its own
    date. Bars without one are dropped; count them by the difference."""
    dated = bars.withColumn("date", F.to_date(wall))
    met = dated.join(next_days(dated.select("date").distinct(), days, "date", day_col), "date")
    hour = F.hour(wall)
    own = F.when(F.col("ge") == F.col("date"), F.col("date"))
    out = met.withColumn("trading_date", F.when(hour >= 21, F.col("gt")).when(hour < 3, F.col("ge")).otherwise(own))
    return out.where("trading_date is not null").drop("ge", "gt", "date")


def supported_days(bars: DataFrame, anchors: list[str], required: int, wall: str = "wall") -> DataFrame:
    """Days on which enough anchor products have a bar between 08:30 and 16:00."""
    minute = minute_of_day(F.col(wall))
    seen = bars.where(F.col("product").isin(anchors) & (minute >= 510) & (minute < 960))
    return seen.groupBy(F.to_date(wall).alias("day")).agg(F.countDistinct("product").alias("n")).where(F.col("n") >= required).select("day")


def top_contracts(daily: DataFrame, k: int = 2) -> DataFrame:
    """The k contracts of most volume of each product and day (ties: the name)."""
    w = Window.partitionBy("product", "trading_date").orderBy(F.desc("day_volume"), "contract")
    return daily.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def daily_stats(bars: DataFrame) -> DataFrame:
    """Per contract and trading date: delivery, volume, last position, and last close of the day session."""
    minute = minute_of_day(F.col("wall"))
    day = (minute >= 510) & (minute < 915)
    return bars.groupBy("product", "contract", "trading_date").agg(
        F.min("delivery_ym").alias("delivery_ym"), F.sum("volume").alias("day_volume"), F.max_by("position", "bob").alias("last_position"), F.max_by(F.when(day, F.col("close")), F.when(day, F.col("bob"))).alias("day_close")
    )


def islands(df: DataFrame, by: list[str], order: str, gap: Column, name: str) -> DataFrame:
    """Numbers stretches of rows: a new one where ``gap`` holds or a key begins."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(name, F.sum(F.when(gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def running_majority(df: DataFrame, by: list[str], order: str, flag: str, days: int = 15) -> Column:
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(days - 1), 0)
    return F.sum(F.col(flag).cast("int")).over(w) * 2 > F.count(F.lit(1)).over(w)


def merge_runs(values: list[str], shortest: int) -> list[tuple[int, int, str]]:
    """Run lengths as (first, last, value); a run shorter than ``shortest`` joins the one before it, and
    neighbours that are equal afterwards join."""
    runs: list[list] = []
    for i, v in enumerate(values):
        if runs and runs[-1][2] == v:
            runs[-1][1] = i
        else:
            runs.append([i, i, v])
    out: list[list] = []
    for lo, hi, v in runs:
        if out and (hi - lo + 1 < shortest or out[-1][2] == v):
            out[-1][1] = hi
        else:
            out.append([lo, hi, v])
    return [tuple(r) for r in out]


def session_runs(days: DataFrame, shortest: int = 5) -> DataFrame:
    """(product, date_start, date_end, template) of rows (product, trading_date, template): runs of equal templates, where a run
    of fewer than ``shortest`` days joins the one before it, and neighbours that are equal afterwards join (see ``merge_runs``).
    A short run never changes what holds, so a new one starts with each long run that differs from the last long one."""
    w = Window.partitionBy("product").orderBy("trading_date")
    change = F.coalesce(F.lag("template").over(w) != F.col("template"), F.lit(True))
    runs = islands(days.select("product", "trading_date", "template").withColumn("__c", change), ["product"], "trading_date", F.col("__c"), "__run")
    runs = runs.groupBy("product", "__run").agg(F.min("trading_date").alias("lo"), F.max("trading_date").alias("hi"), F.count("*").alias("n"), F.first("template").alias("v"))
    of = Window.partitionBy("product").orderBy("__run")
    holds = (F.col("n") >= shortest) | (F.col("__run") == 1)
    held = F.last(F.when(holds, F.col("v")), ignorenulls=True).over(of.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("__new", holds & F.coalesce(held != F.col("v"), F.lit(True)))
    spans = islands(runs, ["product"], "__run", F.col("__new"), "__span")
    return spans.groupBy("product", "__span").agg(F.min("lo").alias("date_start"), F.max("hi").alias("date_end"), F.min_by("v", "__run").alias("template")).drop("__span")


def day_template(bars: DataFrame) -> DataFrame:
    """(product, trading_date, template): a day's sessions as first-last relative minutes of stretches
    without a gap of more than 15 minutes."""
    b = bars.select("product", "trading_date", relative_minute(F.col("wall")).alias("rel")).distinct()
    w = Window.partitionBy("product", "trading_date").orderBy("rel")
    gap = (F.col("rel") - F.lag("rel").over(w)) > 15
    blocks = islands(b.withColumn("__gap", F.coalesce(gap, F.lit(True))), ["product", "trading_date"], "rel", F.col("__gap"), "block")
    ends = blocks.groupBy("product", "trading_date", "block").agg(F.min("rel").alias("lo"), (F.max("rel") + 1).alias("hi"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("lo", "hi"))), lambda s: F.concat_ws("-", s["lo"], s["hi"]))
    return ends.groupBy("product", "trading_date").agg(F.array_join(parts, ",").alias("template"))


def session_table(runs: DataFrame) -> DataFrame:
    """(template_id, seq, start, end, bars): templates numbered in order of their text."""
    t = runs.select("template").distinct().withColumn("template_id", F.dense_rank().over(Window.orderBy("template")) - 1)
    part = t.select("template_id", F.posexplode(F.split("template", ",")).alias("seq", "part"))
    lo, hi = F.split("part", "-")[0].cast("int"), F.split("part", "-")[1].cast("int")
    return part.select("template_id", "seq", lo.alias("start"), hi.alias("end"), (hi - lo).alias("bars"))


def grid_rows(sessions: DataFrame, days: DataFrame) -> DataFrame:
    """(trading_date, rel_min, seg_session): every minute of every day's sessions; days holds
    trading_date and template_id, any number of products' templates a day."""
    wide = days.select("trading_date", "template_id").distinct().join(sessions, "template_id")
    minutes = wide.select("trading_date", F.explode(F.sequence("start", F.col("end") - 1)).alias("rel_min")).distinct()
    w = Window.partitionBy("trading_date").orderBy("rel_min")
    gap = F.coalesce(F.col("rel_min") - F.lag("rel_min").over(w) > 1, F.lit(True))
    return islands(minutes.withColumn("__gap", gap), ["trading_date"], "rel_min", F.col("__gap"), "seg_session").drop("__gap")


def dominance(stats: DataFrame, confirm: int = 2, holes: tuple[datetime.date, ...] = ()) -> DataFrame:
    """(product, trading_date, segment, contract, factor): the contract that leads, day by day.

    A segment ends with each day of ``holes``; nothing is carried over to the next, which starts with its first
    day's contract of most volume (ties: more open interest, then the nearer delivery). Within a segment a
    challenger that delivers no earlier than the holder and has had more volume on ``confirm`` days running leads
    from the day after. ``factor`` is there, on its first day, its close over the holder's at
    confirmation, each the last of three days; 1 without both, and on all other days. One product's daily rows, a few
    thousand, are read in order by one task."""
    ends = sorted(holes)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        by_day: dict[datetime.date, dict[str, dict]] = {}
        for r in sorted(table.to_pylist(), key=lambda r: (r["trading_date"], r["contract"])):
            by_day.setdefault(r["trading_date"], {})[r["contract"]] = r
        days, out = list(by_day), []

        def best(there: dict[str, dict], least: int, besides: str | None) -> str | None:
            names = [c for c, r in there.items() if c != besides and r["delivery_ym"] >= least]
            return max(names, key=lambda c: (there[c]["day_volume"] or 0, there[c]["last_position"] or 0, -there[c]["delivery_ym"]), default=None)

        def close(contract: str, i: int) -> float | None:
            known = (by_day[d].get(contract, {}).get("day_close") for d in days[max(0, i - 2) : i + 1][::-1])
            return next((float(c) for c in known if c is not None), None)

        segment, held, delivery, rival, streak, following = None, None, -1, None, 0, None
        for i, day in enumerate(days):
            there, factor = by_day[day], 1.0
            own = bisect_left(ends, day)
            if own != segment:
                segment, held, rival, streak, following = own, best(there, -1, None), None, 0, None
                delivery = there[held]["delivery_ym"]
                out.append((day, segment, held, factor))
                continue
            if following is not None:
                held, delivery, factor = following
                following = None
            out.append((day, segment, held, factor))
            against = there[held]["day_volume"] or 0 if held in there else 0
            candidate = best(there, delivery, held)
            if candidate is not None and (there[candidate]["day_volume"] or 0) > against:
                streak = streak + 1 if candidate == rival else 1
                rival = candidate
            else:
                rival, streak = None, 0
            if rival is not None and streak >= confirm:
                old, new = close(held, i), close(rival, i)
                following = (rival, there[rival]["delivery_ym"], new / old if old is not None and new is not None and old > 0 else 1.0)
                rival, streak = None, 0
        return pa.table({"product": pa.array([key[0].as_py()] * len(out)).cast(table["product"].type), "trading_date": pa.array([o[0] for o in out], pa.date32()), "segment": pa.array([o[1] for o in out], pa.int32()), "contract": pa.array([o[2] for o in out], pa.string()), "factor": pa.array([o[3] for o in out], pa.float64())})

    kind = stats.schema["product"].dataType.simpleString()
    need = stats.select("product", F.col("contract").cast("string").alias("contract"), "trading_date", F.col("delivery_ym").cast("bigint").alias("delivery_ym"), F.col("day_volume").cast("double").alias("day_volume"), F.col("last_position").cast("double").alias("last_position"), F.col("day_close").cast("double").alias("day_close"))
    return need.groupBy("product").applyInArrow(run, f"product {kind}, trading_date date, segment int, contract string, factor double")


def dominance_spans(held: DataFrame) -> DataFrame:
    """(product, segment, contract, date_start, date_end, adj_factor, rolled): stretches of one contract. Prices times
    adj_factor are continuous within a segment: 1 at its start, divided by the factor of each roll so far, so
    no later roll changes an earlier price. ``rolled`` tells stretches that a roll began."""
    w = Window.partitionBy("product", "segment").orderBy("trading_date")
    change = F.coalesce(F.lag("contract").over(w) != F.col("contract"), F.lit(True))
    runs = islands(held.withColumn("__c", change), ["product", "segment"], "trading_date", F.col("__c"), "span")
    spans = runs.groupBy("product", "segment", "span", "contract").agg(F.min("trading_date").alias("date_start"), F.max("trading_date").alias("last_seen"), F.min_by("factor", "trading_date").alias("factor"))
    of = Window.partitionBy("product", "segment").orderBy("span")
    # a stretch lasts to the eve of the next, days without a bar included
    until = F.coalesce(F.date_sub(F.lead("date_start").over(of), 1), F.col("last_seen"))
    so_far = of.rowsBetween(Window.unboundedPreceding, 0)
    adjust = F.exp(-F.sum(F.when(F.col("span") > 1, F.ln("factor")).otherwise(0.0)).over(so_far))
    return spans.select("product", "segment", "contract", "date_start", until.alias("date_end"), adjust.alias("adj_factor"), (F.col("span") > 1).alias("rolled"))


def continuous(bars: DataFrame, spans: DataFrame) -> DataFrame:
    """Bars of the leading contract with segment, adj_factor and roll_flag, which is on the first bar of a day from
    which a roll holds."""
    s = spans.withColumn("trading_date", F.explode(F.sequence("date_start", "date_end"))).select("product", "segment", "contract", "trading_date", "adj_factor", "date_start", "rolled")
    met = bars.join(s, ["product", "contract", "trading_date"])
    first = F.min("bob").over(Window.partitionBy("product", "trading_date"))
    flag = F.col("rolled") & (F.col("trading_date") == F.col("date_start")) & (F.col("bob") == first)
    return met.withColumn("roll_flag", flag).withColumn("close_adj", (F.col("close").cast("double") * F.col("adj_factor")).cast("float")).drop("rolled")


def limit_mask(df: DataFrame, product: str = "product", day: str = "trading_date", order: str = "bob", close: str = "close", least: int = 30, causal: bool = False) -> DataFrame:
    """Adds m_limit: bars at the day's running extreme in a stretch of unchanged closes of ``least`` bars
    or more; the whole stretch, or with ``causal`` only from its least-th bar on."""
    w = Window.partitionBy(product, day).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    extreme = (F.col(close) >= F.max(close).over(so_far)) | (F.col(close) <= F.min(close).over(so_far))
    moved = F.coalesce(F.col(close) != F.lag(close).over(w), F.lit(True))
    runs = islands(df.withColumn("__x", extreme).withColumn("__m", moved | ~extreme), [product, day], order, F.col("__m"), "__run")
    run = Window.partitionBy(product, day, "__run")
    size = F.row_number().over(run.orderBy(order)) if causal else F.count(F.lit(1)).over(run)
    return runs.withColumn("m_limit", F.col("__x") & (size >= least)).drop("__x", "__m", "__run")


def returns(df: DataFrame, panel: Panel, close: str = "close") -> Column:
    return F.ln(F.col(close)) - F.ln(F.lag(close).over(panel.rows()))


def strict_sum(x: Column, panel: Panel, n: int) -> Column:
    w = panel.last(n)
    return F.when(F.count(x).over(w) == n, F.sum(x).over(w))


def daily_sigma(df: DataFrame, product: str, day: str, r: str, days: int = 60, least: int = 100) -> DataFrame:
    """(product, day, sigma): deviation of the returns of the ``days`` days strictly before."""
    d = df.groupBy(product, day).agg(F.sum(r).alias("s1"), F.sum(F.col(r) * F.col(r)).alias("s2"), F.count(r).alias("n"))
    w = Window.partitionBy(product).orderBy(day).rowsBetween(-days, -1)
    n, s1, s2 = F.sum("n").over(w), F.sum("s1").over(w), F.sum("s2").over(w)
    var = s2 / n - (s1 / n) * (s1 / n)
    return d.select(product, day, F.when(n >= least, F.sqrt(F.greatest(F.when(n > 0, var), F.lit(0.0)))).alias("sigma"))


def seasonal_profile(df: DataFrame, keys: list[str], day: str, slot: str, x: str, days: int = 60, least: int = 5, floor: float = 0.25) -> DataFrame:
    """(keys, day, slot, profile): median |x| of a slot over the days strictly before, as a share of the
    day's mean of such medians, not under ``floor``; null with fewer than ``least`` days."""
    each = df.groupBy(*keys, day, slot).agg(F.avg(F.abs(x)).alias("a"))
    numbered = each.select(*keys, day).distinct().withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(day)))
    each = each.join(numbered, [*keys, day])
    w = Window.partitionBy(*keys, slot).orderBy("__k").rangeBetween(-days, -1)
    med = each.withColumn("m", F.when(F.count("a").over(w) >= least, F.percentile("a", 0.5).over(w)))
    mean = F.avg("m").over(Window.partitionBy(*keys, day))
    return med.select(*keys, day, slot, F.when(F.col("m").isNotNull() & (mean > 0), F.greatest(F.lit(floor), F.col("m") / F.when(mean > 0, mean))).alias("profile"))


def variable_lag_sum(df: DataFrame, panel: Panel, x: str, lag: str, name: str) -> DataFrame:
    """Adds the sum of the last ``lag`` values of x, a number of rows of its own on each row, where all
    are known: prefix sums and one equi-join on the row they start from."""
    w = panel.rows()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    pre = df.withColumn("__i", F.row_number().over(w)).withColumn("__s", F.coalesce(F.sum(x).over(so_far), F.lit(0.0))).withColumn("__n", F.count(x).over(so_far))
    past = pre.select(*panel.series, F.col("__i").alias("__j"), F.col("__s").alias("__s0"), F.col("__n").alias("__n0"))
    met = pre.withColumn("__j", F.col("__i") - F.col(lag)).join(past, [*panel.series, "__j"], "left")
    start = F.col("__j") == 0
    s0, n0 = F.when(start, 0.0).otherwise(F.col("__s0")), F.when(start, 0).otherwise(F.col("__n0"))
    return met.withColumn(name, F.when(F.col("__n") - n0 == F.col(lag), F.col("__s") - s0)).drop("__i", "__j", "__s", "__n", "__s0", "__n0")


def series_features(day: np.ndarray, segment: np.ndarray, close: np.ndarray, high: np.ndarray, low: np.ndarray, volume: np.ndarray, position: np.ndarray, near: np.ndarray) -> dict[str, np.ndarray]:
    """Of one series in order, what needs no other day's deviation or profile: r, the windowed features, and ``before``, the
    vol_ewma of the bar before. Rolling sums, extremes and deviations cost the same whatever the width of their window."""
    n = len(close)
    same = np.concatenate([[False], segment[1:] == segment[:-1]])
    logs = np.log(close)
    r = np.where(same, logs - np.concatenate([[np.nan], logs[:-1]]), np.nan)
    _, which, count = np.unique(day, return_inverse=True, return_counts=True)
    per_day = count[which]
    vol_ewma = np.sqrt(ewm_varying(r * r, per_day.astype(float)))
    short, long = ewm_halflife(volume, 60), ewm_halflife(volume, 1200)
    out = {"r": r, "vol_ewma": vol_ewma, "before": np.concatenate([[np.nan], vol_ewma[:-1]]), "vol_ratio": np.divide(short, long, out=np.full(n, np.nan), where=long > 0)}
    prices = pd.Series(close)
    for w in (5, 15, 60):
        out[f"ret_{w}m"] = pd.Series(r).rolling(w).sum().to_numpy()
    for w in (60, 240, 1200):
        rolled = prices.rolling(w)
        spread = rolled.std(ddof=0).to_numpy()
        out[f"z_{w}"] = np.divide(close - rolled.mean().to_numpy(), spread, out=np.full(n, np.nan), where=spread > 0)
    for w in (1, 15, 60):
        reach = (pd.Series(high).rolling(w).max() - pd.Series(low).rolling(w).min()).to_numpy()
        out[f"range_{w}"] = np.divide(reach, close, out=np.full(n, np.nan), where=(close != 0) & ~np.isnan(prices.rolling(w).sum().to_numpy()))
    # a day back is as many bars back as the day has
    start = np.arange(n) - per_day
    sums, known = np.concatenate([[0.0], np.cumsum(np.nan_to_num(r))]), np.concatenate([[0], np.cumsum(~np.isnan(r))])
    first = np.maximum(start + 1, 0)
    whole = (start >= -1) & (known[1:] - known[first] == per_day)
    out["ret_1d"] = np.where(whole, sums[1:] - sums[first], np.nan)
    past = np.maximum(start, 0)
    there = (start >= 0) & (segment[past] == segment) & (position[past] > 0) & ~(near > 0)
    out["oi_chg_1d"] = np.divide(position, position[past], out=np.full(n, np.nan), where=there) - 1
    return out


def features(bars: DataFrame, product: str = "product", day: str = "day", segment: str = "segment", order: str = "bob", close: str = "close", high: str = "close", low: str = "close", volume: str = "volume", position: str = "volume", slot: str = "slot", template: str = "template", breaks: dict[str, datetime.date] | None = None) -> DataFrame:
    """The fourteen panel features of traded bars: x_std, vol_ewma, ret_5m, ret_15m, ret_60m, ret_1d,
    oi_chg_1d, z_60, z_240, z_1200, vol_ratio, range_1, range_15, range_60. Windows count traded bars.
    A day's bar count is the half-life of vol_ewma and the reach of the daily changes.

    ``breaks`` are days on which an exchange changed how it counts, by product: oi_chg_1d is null on bars within three days of
    one, and on the bar behind the last of these. One pass over each product's series, written once, gives all but x_std, whose
    deviations and profiles are aggregates of days."""
    p = Panel((product,), (order,), (order,))
    near = F.lit(0.0)
    if breaks:
        at = F.create_map(*[F.lit(v) for k, b in breaks.items() for v in (k, b)])[F.col(product).cast("string")]
        near = F.coalesce(F.abs(F.datediff(day, at)) <= 3, F.lit(False)).cast("double")
    # which day and which segment, as numbers
    label = lambda c: F.col(c).cast("double") if isinstance(bars.schema[c].dataType, NumericType) else F.xxhash64(c).cast("double")
    staged = bars.withColumn("__day", label(day)).withColumn("__seg", label(segment)).withColumn("__near", near)
    names = ["r", "vol_ewma", "before", "vol_ratio", "ret_5m", "ret_15m", "ret_60m", "z_60", "z_240", "z_1200", "range_1", "range_15", "range_60", "ret_1d", "oi_chg_1d"]

    def run(day, segment, close, high, low, volume, position, near):
        near = np.maximum(near, np.concatenate([[0.0], near[:-1]]))
        found = series_features(day, segment, close, high, low, volume, position, near)
        return [found[name] for name in names]

    inputs = ["__day", "__seg", close, high, low, volume, position, "__near"]
    targets = {("__before" if name == "before" else name): DoubleType() for name in names}
    df = written(per_series(staged, p, inputs, targets, run).drop("__day", "__seg", "__near"), "features")
    out = df.join(daily_sigma(df, product, day, "r"), [product, day], "left").join(seasonal_profile(df, [product, template], day, slot, "r"), [product, template, day, slot], "left")
    # greatest and least pass over nulls: a bar without a return has none
    cut = F.when(F.col("r").isNotNull(), F.greatest(-5 * F.col("sigma"), F.least(5 * F.col("sigma"), F.col("r"))))
    scale = F.col("__before") * F.coalesce("profile", F.lit(1.0))
    return out.withColumn("x_std", F.when(scale > 0, F.coalesce(cut, F.col("r")) / F.when(scale > 0, scale))).drop("__before")
