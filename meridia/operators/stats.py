"""Lagged correlation and its inference; information coefficients; score tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lagged_gram(panel: DataFrame, lags: list[int], series: str = "product", segment: str = "segment", pos: str = "pos", value: str = "x", by: list[str] | None = None) -> DataFrame:
    """(by, leader, follower, lag, s_xy, s_x2m, s_mx2, n) over pairs of rows of one segment, the leader's
    ``lag`` places before the follower's. Null values count for nothing. The lag is exploded on the
    leader's side and the pair meets by equality; sums are partial before they are shuffled."""
    by = by or []
    known = panel.where(F.col(value).isNotNull()).select(*by, series, segment, pos, value)
    lead = known.select(*by, F.col(series).alias("leader"), segment, F.col(value).alias("x"), F.explode(F.array(*map(F.lit, lags))).alias("lag"), F.col(pos).alias("__p")).withColumn("__at", F.col("__p") + F.col("lag"))
    follow = known.select(*by, F.col(series).alias("follower"), F.col(segment), F.col(value).alias("y"), F.col(pos).alias("__at"))
    met = lead.join(follow, [*by, segment, "__at"])
    return met.groupBy(*by, "leader", "follower", "lag").agg(F.sum(F.col("x") * F.col("y")).alias("s_xy"), F.sum(F.col("x") * F.col("x")).alias("s_x2m"), F.sum(F.col("y") * F.col("y")).alias("s_mx2"), F.count("*").alias("n"))


def correlations(gram: DataFrame, least: int = 1) -> DataFrame:
    bottom = F.sqrt(F.col("s_x2m") * F.col("s_mx2"))
    return gram.withColumn("rho", F.when((F.col("n") >= least) & (bottom > 0), F.col("s_xy") / F.when(bottom > 0, bottom)))


def pair_statistics(rho: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of ordered pairs of different products, for each value of ``by``: a_stat = sum over lags of |rho ij| - |rho ji|, the
    greatest |rho| with its lag (ties: the smallest) and sign, and the fewest rows of any lag."""
    size = F.coalesce(F.abs("rho"), F.lit(0.0))
    by = by or []
    one = rho.where("leader <> follower").groupBy(*by, "leader", "follower").agg(
        F.sum(size).alias("total"), F.max(size).alias("det"), F.max_by(F.struct("lag", "rho"), F.struct(size, -F.col("lag"))).alias("best"), F.min("n").alias("n_eff")
    )
    other = one.select(*by, F.col("leader").alias("follower"), F.col("follower").alias("leader"), F.col("total").alias("reverse"))
    met = one.join(other, [*by, "leader", "follower"], "left")
    return met.select(*by, "leader", "follower", (F.col("total") - F.coalesce("reverse", F.lit(0.0))).alias("a_stat"), "det", F.col("best.lag").alias("lag_bars"), F.col("best.rho").alias("strength"), F.signum("best.rho").alias("sign"), "n_eff")


def permutation_p(observed: DataFrame, draws: DataFrame, keys: list[str], stat: str = "a_stat", drawn: int | None = None) -> DataFrame:
    """p = (1 + draws as large in size as the observed) / (draws + 1). Keys that a draw lacks count as 0; ``drawn``
    is the number of draws, where it isn't the number of rows of a key."""
    null = draws.select(*keys, F.abs(F.col(stat)).alias("__null"))
    met = observed.join(null, keys, "left")
    n = F.lit(drawn) if drawn is not None else F.count("__null")
    # sums in another order may differ in the last places
    reached = F.count_if(F.col("__null") >= F.abs(F.col(stat)) - 1e-12)
    if drawn is not None:
        reached = reached + F.when(F.first(F.abs(F.col(stat))) <= 0, F.lit(drawn) - F.count("__null")).otherwise(0)
    return met.groupBy(*keys, stat).agg(((reached + 1) / (n + 1)).alias("p_value"))


def shift_draws(strata: DataFrame, draws: int = 200, min_shift: int = 5, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """(by, draw, stratum, days, offset) of rows (by, stratum, days): for each draw and stratum a number of days to shift by,
    any of min_shift to days - min_shift with equal chance, from a hash of seed, draw, stratum and ``by``; 0 where a stratum
    has fewer than 2 min_shift days."""
    by = by or []
    each = strata.select(*by, "stratum", "days", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    chance = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "draw", "stratum", *[F.col(c).cast("string") for c in by])), 1, 12), 16, 10).cast("bigint")
    offset = F.when(F.col("days") >= 2 * min_shift, min_shift + F.pmod(chance, F.col("days") - 2 * min_shift + 1)).otherwise(0)
    return each.select(*by, "draw", "stratum", "days", offset.cast("int").alias("offset"))


def permutation_null(panel: DataFrame, lags: list[int], draws: int = 200, min_shift: int = 5, seed: int = 42, series: str = "product", segment: str = "segment", pos: str = "pos", value: str = "x", by: list[str] | None = None) -> DataFrame:
    """(by, draw, leader, follower, a_stat): pair statistics of panels whose leaders' days, values and gaps together, are
    shifted in circles within strata of days of equal length (see ``day_strata`` and ``shift_draws``), for each value of ``by``.

    What a shift does depends on the stratum and its offset alone, and sums of products of two days serve every
    offset that puts one on the other. So these are made once, and draws add up sums: rows aren't copied by draw."""
    by = by or []
    known = panel.where(F.col(value).isNotNull()).select(*by, F.col(series).alias("s"), F.col(segment).alias("d"), F.col(pos).alias("at"), F.col(value).alias("v"))
    days = day_strata(panel.select(*by, F.col(segment).alias("d"), F.col(pos).alias("at")).distinct(), "d", by)
    days = days.withColumn("k", F.row_number().over(Window.partitionBy(*by, "stratum").orderBy("d")) - 1)
    sizes = days.groupBy(*by, "stratum").agg(F.count("*").alias("days"))
    chosen = shift_draws(sizes, draws, min_shift, seed, by)
    moved = days.join(chosen.select(*by, "stratum", "days", "offset").distinct(), [*by, "stratum"]).withColumn("k", F.pmod(F.col("k") + F.col("offset"), F.col("days")))
    pairs = moved.select(*by, "stratum", "offset", "k", F.col("d").alias("from_day")).join(days.select(*by, "stratum", "k", F.col("d").alias("to_day")), [*by, "stratum", "k"])
    lead = known.select(*by, F.col("s").alias("leader"), F.col("d").alias("from_day"), F.col("v").alias("x"), F.explode(F.array(*map(F.lit, lags))).alias("lag"), "at").withColumn("at", F.col("at") + F.col("lag"))
    follow = known.select(*by, F.col("s").alias("follower"), F.col("d").alias("to_day"), F.col("v").alias("y"), "at")
    wanted = pairs.select(*by, "from_day", "to_day").distinct()
    met = lead.join(wanted, [*by, "from_day"]).join(follow, [*by, "to_day", "at"]).where("leader <> follower")
    x, y = F.col("x"), F.col("y")
    by_days = met.groupBy(*by, "from_day", "to_day", "leader", "follower", "lag").agg(F.sum(x * y).alias("s_xy"), F.sum(x * x).alias("s_x2m"), F.sum(y * y).alias("s_mx2"), F.count("*").alias("n"))
    sums = [F.sum(c).alias(c) for c in ("s_xy", "s_x2m", "s_mx2", "n")]
    shifted = by_days.join(pairs, [*by, "from_day", "to_day"]).groupBy(*by, "stratum", "offset", "leader", "follower", "lag").agg(*sums)
    drawn = shifted.join(chosen.select(*by, "draw", "stratum", "offset"), [*by, "stratum", "offset"]).groupBy(*by, "draw", "leader", "follower", "lag").agg(*sums)
    return pair_statistics(correlations(drawn), [*by, "draw"]).select(*by, "draw", "leader", "follower", "a_stat")


def validated_edges(panel: DataFrame, windows: DataFrame, lags: list[int], priors: DataFrame, draws: int = 50, min_shift: int = 5, seed: int = 42, q_a: float = 0.05, q_b: float = 0.1, lookback: int = 12) -> DataFrame:
    """Edges of each window (window_start, window_end) of days ``segment``: pair statistics, a null of its own, q-values by family, and
    stability from the windows that end earlier alone: the share of the last ``lookback`` of them that agree in sign and pass q_b.

    Pairs of ``priors`` (leader, follower), in both directions, are family A with the cut q_a, all others B with
    q_b. The window is a dimension of one plan: a day goes to each window that holds it."""
    by = ["window_start", "window_end"]
    listed = priors.select("leader", "follower").union(priors.select("follower", "leader")).distinct().withColumn("__listed", F.lit(True))
    # windows and days are calendars: their pairs are made by month, as an equality
    months = F.sequence(F.trunc("window_start", "month"), F.trunc("window_end", "month"), F.expr("interval 1 month"))
    spans = windows.select(*by).distinct().withColumn("__m", F.explode(months))
    days = panel.select("segment").distinct().withColumn("__m", F.trunc("segment", "month"))
    inside = days.join(spans, "__m").where("segment between window_start and window_end").select("segment", *by)
    own = panel.join(inside, "segment")
    observed = pair_statistics(correlations(lagged_gram(own, lags, by=by)), by)
    p = permutation_p(observed, permutation_null(own, lags, draws, min_shift, seed, by=by), [*by, "leader", "follower"], drawn=draws)
    found = observed.join(p.drop("a_stat"), [*by, "leader", "follower"]).join(listed, ["leader", "follower"], "left")
    edges = false_discovery(found.withColumn("family", F.when(F.col("__listed"), "A").otherwise("B")).drop("__listed"), "p_value", [*by, "family"])
    edges = edges.withColumn("validated", ((F.col("family") == "A") & (F.col("q_value") <= q_a)) | ((F.col("family") == "B") & (F.col("q_value") <= q_b)))
    # windows that end on one day don't see each other
    before = Window.partitionBy("leader", "follower").orderBy("window_end", "window_start").rowsBetween(Window.unboundedPreceding, -1)
    past = F.filter(F.collect_list(F.struct("window_end", "a_stat", "q_value")).over(before), lambda e: e["window_end"] < F.col("window_end"))
    recent = F.slice(F.col("__past"), F.greatest(F.lit(1), F.size("__past") - lookback + 1), F.lit(lookback))
    agree = F.filter(recent, lambda e: (F.signum(e["a_stat"]) == F.signum(F.col("a_stat"))) & (e["q_value"] <= q_b))
    n = F.least(F.size("__past"), F.lit(lookback))
    return edges.withColumn("__past", past).withColumn("stability", F.when(n > 0, F.size(agree) / F.when(n > 0, n)).otherwise(0.0)).drop("__past")


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: added up to 64 terms, beyond them by the asymptotic series, as exact as doubles are."""
    n = m.cast("double")
    added = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(64)).cast("int")), F.lit(0.0), lambda a, k: a + F.lit(1.0) / k)
    series = F.ln(n) + 0.5772156649015329 + 1 / (2 * n) - 1 / (12 * n * n) + 1 / (120 * n * n * n * n) - 1 / (252 * n * n * n * n * n * n)
    return F.when(m <= 64, added).otherwise(series)


def false_discovery(df: DataFrame, p: str = "p_value", family: list[str] | None = None, dependent: bool = False, name: str = "q_value") -> DataFrame:
    """Step-up q-values in each family: p m / rank, from the largest down the least so far, at most 1.
    ``dependent`` multiplies by the harmonic sum. A family is a table of pairs, not of raw rows: those have
    ``false_discovery_by_parts``. A null p counts in m, comes last and has 1."""
    family = family or []
    all_rows = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    w = all_rows.orderBy(F.col(p).asc_nulls_last())
    m = F.count(F.lit(1)).over(all_rows)
    factor = harmonic(m) if dependent else F.lit(1.0)
    raw = F.col(p) * m * factor / F.row_number().over(w)
    staged = df.withColumn("__raw", raw).withColumn("__rank", F.row_number().over(w))
    # from the end: a frame to the end of the group would read the rest of it again for every row
    least = F.min("__raw").over(all_rows.orderBy(F.desc("__rank")).rowsBetween(Window.unboundedPreceding, 0))
    return staged.withColumn(name, F.least(F.lit(1.0), least)).drop("__raw", "__rank")


def false_discovery_by_parts(df: DataFrame, p: str = "p_value", family: list[str] | None = None, name: str = "q_value", dependent_name: str | None = None, parts: int = 128) -> DataFrame:
    """As ``false_discovery``, for families of any size; ``dependent_name`` adds the dependent q-values. df is read several times.

    A q-value depends on p alone, so distinct p are ranked, with their numbers of rows, in stretches between cuts that
    all families share (the distinct p of the smallest hashes, the same on every reading). A table of families and
    stretches tells how many rows lie before each and the least value behind it."""
    family = family or []
    every, place = family or [F.lit(0)], [*family, "__part"]

    def met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        found = right.select(*[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
        on = F.lit(True)
        for i, k in enumerate(keys):
            on = on & left[k].eqNullSafe(found[f"__r{i}"])
        return left.join(found, on, "left").drop(*[f"__r{i}" for i in range(len(keys))])

    cuts = df.select(p).where(F.col(p).isNotNull()).distinct().orderBy(F.xxhash64(p), p).limit(parts - 1).agg(F.array_sort(F.collect_list(p)).alias("__cuts"))
    part = F.when(F.col(p).isNull(), parts).otherwise(F.size(F.filter("__cuts", lambda c: c < F.col(p))))
    seen = df.groupBy(*family, p).agg(F.count(F.lit(1)).alias("__n")).crossJoin(F.broadcast(cuts)).withColumn("__part", part).drop("__cuts")
    rising = Window.partitionBy(*every).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = seen.groupBy(*place).agg(F.sum("__n").alias("__rows"))
    sizes = sizes.select(*place, F.coalesce(F.sum("__rows").over(rising), F.lit(0)).alias("__before"), F.sum("__rows").over(Window.partitionBy(*every)).alias("__m"))
    inside = Window.partitionBy(*place).orderBy(F.col(p).asc_nulls_last())
    ranked = met(seen, sizes, place).withColumn("__rank", F.col("__before") + F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("__raw", F.col(p) * F.col("__m") / F.col("__rank"))
    falling = Window.partitionBy(*every).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    lows = ranked.groupBy(*place).agg(F.min("__raw").alias("__low"))
    lows = lows.select(*place, F.min("__low").over(falling).alias("__behind"))
    back = Window.partitionBy(*place).orderBy(F.col(p).desc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    least = F.least(F.min("__raw").over(back), F.col("__behind"))
    values = met(ranked, lows, place).withColumn("__least", least)
    wanted = [F.least(F.lit(1.0), F.col("__least")).alias(name)]
    if dependent_name:
        wanted.append(F.least(F.lit(1.0), F.col("__least") * harmonic(F.col("__m"))).alias(dependent_name))
    return met(df, values.select(*family, p, *wanted), [*family, p])


def stability(history: DataFrame, windows: int = 12, q_max: float = 0.1) -> DataFrame:
    """(leader, follower, stability, half_life) of rows (leader, follower, asof_date, a_stat, q_value):
    the share of the last windows that agree in sign with the newest and pass, and ln 2 / -ln phi of
    an AR(1) fit without intercept where there are six or more and 0 < phi < 1."""
    w = Window.partitionBy("leader", "follower").orderBy(F.desc("asof_date"))
    recent = history.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= windows)
    newest = F.first("a_stat").over(w.rowsBetween(Window.unboundedPreceding, 0))
    recent = recent.withColumn("__agree", ((F.signum("a_stat") == F.signum(newest)) & (F.col("q_value") <= q_max)).cast("double")).withColumn("__before", F.lead("a_stat").over(w))
    sums = recent.groupBy("leader", "follower").agg(F.avg("__agree").alias("stability"), F.sum(F.col("a_stat") * F.col("__before")).alias("xy"), F.sum(F.when(F.col("__before").isNotNull(), F.col("__before") * F.col("__before"))).alias("xx"), F.count("*").alias("n"))
    phi = F.when(F.col("xx") > 0, F.col("xy") / F.when(F.col("xx") > 0, F.col("xx")))
    fits = (F.col("n") >= 6) & (phi > 0) & (phi < 1)
    return sums.select("leader", "follower", "stability", F.when(fits, F.lit(math.log(2)) / -F.ln(F.when(fits, phi))).alias("half_life"))


def daily_correlation(df: DataFrame, x: str, y: str, day: str = "date", ranked: bool = False) -> DataFrame:
    """(day, ic): cross-sectional correlation of each day, of average ranks if ``ranked``; rows with a
    null in either count for nothing; a side that doesn't vary gives no value."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(day, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    if ranked:
        for c in ("x", "y"):
            ties = F.count(F.lit(1)).over(Window.partitionBy(day, c))
            rows = rows.withColumn(f"r{c}", F.rank().over(Window.partitionBy(day).orderBy(c)) + (ties - 1) / 2)
        rows = rows.select(day, F.col("rx").alias("x"), F.col("ry").alias("y"))
    g = rows.groupBy(day).agg(F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    vary = (F.col("sx") > 1e-9) & (F.col("sy") > 1e-9)
    return g.select(day, F.when(vary, F.col("c") / F.when(vary, F.col("sx") * F.col("sy"))).alias("ic"))


def distinct_factors(df: DataFrame, old: list[str], new: list[str], day: str = "date", most: float = 0.99) -> list[str]:
    """Those of the new factor columns whose mean daily correlation with every old one is below ``most``. All pairs are
    aggregates of one grouping by day; days on which a pair has no correlation count for nothing."""
    from meridia.functions.kernels import correlation

    if not old or not new:
        return list(new)
    pairs = [(o, n) for o in old for n in new]
    daily = df.groupBy(day).agg(*[correlation(F.col(o).cast("double"), F.col(n).cast("double")).alias(f"__c{i}") for i, (o, n) in enumerate(pairs)])
    row = daily.agg(*[F.avg(f"__c{i}").alias(f"m{i}") for i in range(len(pairs))]).first()
    top = {n: max((row[f"m{i}"] for i, (_, b) in enumerate(pairs) if b == n and row[f"m{i}"] is not None), default=None) for n in new}
    return [n for n in new if top[n] is not None and top[n] < most]


def ic_summary(ic: DataFrame) -> DataFrame:
    m, s = F.avg("ic"), F.stddev_samp("ic")
    return ic.agg(m.alias("ic"), F.when(s > 0, m / F.when(s > 0, s)).alias("icir"), F.count("ic").alias("days"))


def normalise_by_day(df: DataFrame, x: str, day: str = "date") -> Column:
    w = Window.partitionBy(day)
    s = F.stddev_pop(x).over(w)
    return F.coalesce(F.when(s > 0, (F.col(x) - F.avg(x).over(w)) / F.when(s > 0, s)), F.lit(0.0))


def regression_scores(df: DataFrame, y: str, p: str, weight: str | None = None) -> DataFrame:
    """Weighted fit measures of predictions: mae, mse, rmse, nmse, nrmse, inverse and negative forms, r."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    yy, pp = F.col(y).cast("double"), F.col(p).cast("double")
    s = df.agg(F.sum(w).alias("w"), F.sum(w * F.abs(yy - pp)).alias("ae"), F.sum(w * (yy - pp) * (yy - pp)).alias("se"), F.sum(w * yy).alias("y1"), F.sum(w * yy * yy).alias("y2"), F.sum(w * pp).alias("p1"), F.sum(w * pp * pp).alias("p2"), F.sum(w * yy * pp).alias("yp"))
    mse = F.col("se") / F.col("w")
    vy = F.col("y2") / F.col("w") - F.pow(F.col("y1") / F.col("w"), F.lit(2.0))
    vp = F.col("p2") / F.col("w") - F.pow(F.col("p1") / F.col("w"), F.lit(2.0))
    cov = F.col("yp") / F.col("w") - F.col("y1") * F.col("p1") / (F.col("w") * F.col("w"))
    return s.select(
        (F.col("ae") / F.col("w")).alias("mae"), mse.alias("mse"), F.sqrt(mse).alias("rmse"), (-mse).alias("neg_mse"), (-F.sqrt(mse)).alias("neg_rmse"), (-mse / vy).alias("neg_nmse"), (-F.sqrt(mse / vy)).alias("neg_nrmse"),
        (-F.ln(1 + mse)).alias("neglog_mse"), (1 / (1 + mse)).alias("inv_mse"), (1 / (1 + mse / vy)).alias("inv_nmse"), (1 / (1 + F.sqrt(mse / vy))).alias("inv_nrmse"), (cov / F.sqrt(vy * vp)).alias("pearson"),
    )


def log_loss(df: DataFrame, y: str, p: str, tiny: float = 1e-15) -> DataFrame:
    q = F.least(F.lit(1 - tiny), F.greatest(F.lit(tiny), F.col(p)))
    return df.agg(F.avg(-(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))).alias("log_loss"))


def entropy(df: DataFrame, column: str) -> DataFrame:
    """One row: -sum p ln p of the shares of the column's values, as ln N - (sum n ln n) / N: partial sums alone."""
    n = df.groupBy(column).count()
    total = n.agg(F.sum("count").alias("t"), F.sum(F.col("count") * F.ln("count")).alias("s"))
    return total.select((F.ln("t") - F.col("s") / F.col("t")).alias("entropy"))


def pareto_front(df: DataFrame, low: str, high: str, parts: int = 256) -> DataFrame:
    """Rows that no other beats: less of ``low`` with as much of ``high``, or as little with more. Each of ``parts``
    parts keeps its own front in a sorted pass, and the fronts, as short as runs of maxima are, meet in a last one."""
    best = df.groupBy(low).agg(F.max(high).alias(high))

    def front(rows: DataFrame, by: Column) -> DataFrame:
        w = Window.partitionBy(by).orderBy(low).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("__before", F.max(high).over(w)).where(F.col("__before").isNull() | (F.col(high) > F.col("__before"))).drop("__before")

    return front(front(best, F.pmod(F.xxhash64(low), F.lit(parts))), F.lit(0))


def ordered_sums(df: DataFrame, keys: list[str], order: list[str], x: str) -> DataFrame:
    """(keys, x): sums of doubles added in ``order``, whatever the partitions. Values that cancel leave 0 or a last place,
    by the order in which they are added, and a count of results above or other than 0 tells these apart."""
    w = Window.partitionBy(*keys).orderBy(*order)
    path = df.select(*keys, F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(x), F.lead(F.lit(1)).over(w).alias("__more"))
    return path.where(F.col("__more").isNull()).drop("__more")


def daily_metrics(df: DataFrame, key: str, day: str, pnl: str, periods: float = 252.0) -> DataFrame:
    """Per key: n, total, mean, volatility, sharpe, sortino, max_drawdown, calmar, hit_rate,
    profit_factor, skew, excess_kurtosis. Undefined ratios are 0; a profit factor without losses 999."""
    w = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    path = df.select(key, day, F.col(pnl).alias("r")).withColumn("cum", F.sum("r").over(w)).withColumn("peak", F.greatest(F.max("cum").over(w), F.lit(0.0)))
    s = path.groupBy(key).agg(
        F.count("*").alias("n"), F.sum("r").alias("total"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.stddev_pop(F.least("r", F.lit(0.0))).alias("down"), F.max(F.col("peak") - F.col("cum")).alias("max_drawdown"),
        F.count_if(F.col("r") > 0).alias("up"), F.count_if(F.col("r") != 0).alias("active"), F.sum(F.greatest("r", F.lit(0.0))).alias("gain"), F.sum(F.least("r", F.lit(0.0))).alias("loss"),
        F.avg(F.pow("r", F.lit(2.0))).alias("e2"), F.avg(F.pow("r", F.lit(3.0))).alias("e3"), F.avg(F.pow("r", F.lit(4.0))).alias("e4"),
    )
    ratio = lambda a, b: F.coalesce(F.when(F.abs(b) > 1e-12, a / F.when(F.abs(b) > 1e-12, b)), F.lit(0.0))
    m, root = F.col("mean"), math.sqrt(periods)
    m2 = F.col("e2") - m * m
    m3 = F.col("e3") - 3 * m * F.col("e2") + 2 * m * m * m
    m4 = F.col("e4") - 4 * m * F.col("e3") + 6 * m * m * F.col("e2") - 3 * m * m * m * m
    return s.select(
        key, "n", "total", (ratio(m, F.col("sd")) * root).alias("sharpe"), (ratio(m, F.col("down")) * root).alias("sortino"), "max_drawdown", ratio(m * periods, F.col("max_drawdown")).alias("calmar"), ratio(F.col("up").cast("double"), F.col("active")).alias("hit_rate"),
        F.when(F.col("loss") < 0, -F.col("gain") / F.when(F.col("loss") < 0, F.col("loss"))).when(F.col("gain") > 0, 999.0).otherwise(0.0).alias("profit_factor"),
        ratio(m3, F.pow(m2, F.lit(1.5))).alias("skew"), (ratio(m4, m2 * m2) - F.when(m2 > 1e-12, 3.0).otherwise(0.0)).alias("excess_kurtosis"),
    )


def portfolio(df: DataFrame, key: str, day: str, pnl: str) -> DataFrame:
    """(day, pnl): the mean of the keys' results of each day, those that are null left out."""
    return df.groupBy(day).agg(F.avg(pnl).alias(pnl)).where(F.col(pnl).isNotNull())


def probabilistic_sharpe(sr: Column, n: Column, skew: Column, excess: Column, benchmark: float = 0.0) -> Column:
    """Chance that the true ratio exceeds the benchmark, of a per-period ratio sr over n periods."""
    from meridia.functions.kernels import normal_cdf

    spread = F.greatest(1 - skew * sr + (excess + 2) / 4 * sr * sr, F.lit(1e-12)) / (n - 1)
    return F.when(n > 1, normal_cdf((sr - benchmark) / F.sqrt(F.when(n > 1, spread))))


def day_strata(panel: DataFrame, day: str = "segment", by: list[str] | None = None) -> DataFrame:
    """(by, day, bars, stratum): runs of days of equal length, within which a permutation may shift days. The window
    runs over a calendar of days, not over rows."""
    by = by or []
    days = panel.groupBy(*by, day).agg(F.count("*").alias("bars"))
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(day)
    new = F.coalesce((F.lag("bars").over(w) != F.col("bars")).cast("int"), F.lit(0))
    return days.withColumn("__new", new).withColumn("stratum", F.sum("__new").over(w)).drop("__new")
