"""Queries of lead-lag inference, features, state machines, vectors, graphs, search and streams."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridia.functions import kernels as K
from meridia.functions.compile import Panel, compile_formulas
from meridia.functions.expr import Space, parse_sexpr, point_mutate
from meridia.operators import backtest, bars as B, stats, vector
from meridia.operators.sequential import per_series
from meridia.plans.base import BARS_SQL, bars, query, r5, sql5, table
from meridia.session import scratch
from meridia.streaming import bars as stream

# --- lagged correlation ----------------------------------------------------------------------------

_PANEL_SQL = f"{BARS_SQL}, pn AS (SELECT product % 8 AS product, day AS segment, row_number() OVER (PARTITION BY product % 8, day ORDER BY bob, event_id) AS pos, close / 100 - 0.5 AS x FROM bars)"
_GRAM_SQL = f"""{_PANEL_SQL}, gram AS (SELECT a.product AS leader, b.product AS follower, lag, sum(a.x * b.x) AS s_xy, sum(a.x * a.x) AS s_x2m, sum(b.x * b.x) AS s_mx2, count(*) AS n
  FROM pn a CROSS JOIN (VALUES (1), (2), (3)) t(lag) JOIN pn b ON a.segment = b.segment AND b.pos = a.pos + lag GROUP BY ALL), rho AS (SELECT *, s_xy / nullif(sqrt(s_x2m * s_mx2), 0) AS rho FROM gram)"""
_STATS_SQL = f"""{_GRAM_SQL}, one AS (SELECT leader, follower, sum(coalesce(abs(rho), 0)) AS total, max(coalesce(abs(rho), 0)) AS det, min(n) AS n_eff,
  first(lag ORDER BY coalesce(abs(rho), 0) DESC, lag) AS lag_bars, first(rho ORDER BY coalesce(abs(rho), 0) DESC, lag) AS strength FROM rho WHERE leader <> follower GROUP BY ALL),
st AS (SELECT a.leader, a.follower, a.total - b.total AS a_stat, a.det, a.lag_bars, a.strength, a.n_eff FROM one a JOIN one b ON a.leader = b.follower AND a.follower = b.leader)"""


def _lag_panel(spark, sf_dir):
    w = Window.partitionBy("product", "segment").orderBy("bob", "event_id")
    b = bars(spark, sf_dir).select((F.col("product") % 8).alias("product"), F.col("day").alias("segment"), "bob", "event_id", (F.col("close") / 100 - 0.5).alias("x"))
    return b.withColumn("pos", F.row_number().over(w))


@query("leadlag_gram", f"WITH {_GRAM_SQL} SELECT leader, follower, CAST(lag AS BIGINT) AS lag, {sql5('s_xy', 's_xy')}, {sql5('s_x2m', 's_x2m')}, {sql5('s_mx2', 's_mx2')}, CAST(n AS BIGINT) AS n, {sql5('rho', 'rho')} FROM rho")
def leadlag_gram(spark, sf_dir):
    g = stats.correlations(stats.lagged_gram(_lag_panel(spark, sf_dir), [1, 2, 3]))
    return g.select("leader", "follower", F.col("lag").cast("bigint").alias("lag"), *[r5(F.col(c)).alias(c) for c in ("s_xy", "s_x2m", "s_mx2")], "n", r5(F.col("rho")).alias("rho"))


@query("leadlag_pair_statistics", f"WITH {_STATS_SQL} SELECT leader, follower, {sql5('a_stat', 'a_stat')}, {sql5('det', 'det')}, CAST(lag_bars AS BIGINT) AS lag_bars, {sql5('strength', 'strength')}, CAST(n_eff AS BIGINT) AS n_eff FROM st")
def leadlag_pair_statistics(spark, sf_dir):
    s = stats.pair_statistics(stats.correlations(stats.lagged_gram(_lag_panel(spark, sf_dir), [1, 2, 3])))
    return s.select("leader", "follower", r5(F.col("a_stat")).alias("a_stat"), r5(F.col("det")).alias("det"), F.col("lag_bars").cast("bigint").alias("lag_bars"), r5(F.col("strength")).alias("strength"), "n_eff")


# hourly means on a grid of days; draws shift the leaders' days in circles within strata of days of equal length
_GRID_SQL = f"{BARS_SQL}, pn AS (SELECT product % 8 AS product, day AS segment, CAST(hour(bob) AS INTEGER) AS pos, avg(close) / 100 - 0.5 AS x FROM bars GROUP BY ALL)"
_A_SQL = "sum(coalesce(abs(s_xy / nullif(sqrt(s_x2m * s_mx2), 0)), 0)) AS total"
_NULL_SQL = f"""{_GRID_SQL}, dl AS (SELECT segment, count(DISTINCT pos) AS n FROM pn GROUP BY segment), ch AS (SELECT segment, CASE WHEN lag(n) OVER (ORDER BY segment) <> n THEN 1 ELSE 0 END AS c FROM dl),
st AS (SELECT segment, sum(c) OVER (ORDER BY segment) AS stratum FROM ch), dy AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY segment) - 1 AS k, count(*) OVER (PARTITION BY stratum) AS days FROM st),
dr AS (SELECT draw, stratum, days, CASE WHEN days >= 10 THEN 5 + CAST('0x' || substr(md5(concat_ws(':', 42, draw, CAST(stratum AS BIGINT))), 1, 12) AS BIGINT) % (days - 9) ELSE 0 END AS o FROM (SELECT DISTINCT stratum, days FROM dy), (SELECT unnest(range(1, 201)) AS draw)),
pr AS (SELECT DISTINCT a.stratum, o, a.segment AS d1, b.segment AS d2 FROM dy a JOIN dr USING (stratum) JOIN dy b ON b.stratum = a.stratum AND b.k = (a.k + o) % a.days),
g2 AS (SELECT stratum, o, a.product AS leader, b.product AS follower, lag, sum(a.x * b.x) AS s_xy, sum(a.x * a.x) AS s_x2m, sum(b.x * b.x) AS s_mx2 FROM pr JOIN pn a ON a.segment = d1 CROSS JOIN (VALUES (1), (2), (3)) t(lag) JOIN pn b ON b.segment = d2 AND b.pos = a.pos + lag WHERE a.product <> b.product GROUP BY ALL),
gd AS (SELECT draw, leader, follower, lag, sum(s_xy) AS s_xy, sum(s_x2m) AS s_x2m, sum(s_mx2) AS s_mx2 FROM dr JOIN g2 USING (stratum, o) GROUP BY ALL),
one AS (SELECT draw, leader, follower, {_A_SQL} FROM gd GROUP BY ALL), nul AS (SELECT a.draw, a.leader, a.follower, a.total - coalesce(b.total, 0) AS a_stat FROM one a LEFT JOIN one b ON a.draw = b.draw AND a.leader = b.follower AND a.follower = b.leader)"""
_P_SQL = f"""{_NULL_SQL}, go AS (SELECT a.product AS leader, b.product AS follower, lag, sum(a.x * b.x) AS s_xy, sum(a.x * a.x) AS s_x2m, sum(b.x * b.x) AS s_mx2 FROM pn a CROSS JOIN (VALUES (1), (2), (3)) t(lag) JOIN pn b ON b.segment = a.segment AND b.pos = a.pos + lag WHERE a.product <> b.product GROUP BY ALL),
oo AS (SELECT leader, follower, {_A_SQL} FROM go GROUP BY ALL), ob AS (SELECT a.leader, a.follower, a.total - coalesce(b.total, 0) AS a_stat FROM oo a LEFT JOIN oo b ON a.leader = b.follower AND a.follower = b.leader)"""


def _lag_grid(spark, sf_dir):
    b = bars(spark, sf_dir)
    return b.groupBy((F.col("product") % 8).alias("product"), F.col("day").alias("segment"), F.hour("bob").alias("pos")).agg((F.avg("close") / 100 - 0.5).alias("x"))


@query("leadlag_null", f"WITH {_NULL_SQL} SELECT CAST(draw AS BIGINT) AS draw, leader, follower, {sql5('a_stat', 'a_stat')} FROM nul")
def leadlag_null(spark, sf_dir):
    """The rows of 200 draws."""
    null = stats.permutation_null(_lag_grid(spark, sf_dir), [1, 2, 3])
    return null.select(F.col("draw").cast("bigint").alias("draw"), "leader", "follower", r5(F.col("a_stat")).alias("a_stat"))


@query("leadlag_permutation", f"WITH {_P_SQL} SELECT o.leader, o.follower, {sql5('o.a_stat', 'a_stat')}, {sql5('(1 + count(*) FILTER (WHERE abs(n.a_stat) >= abs(o.a_stat) - 1e-12)) / 201.0', 'p_value')} FROM ob o JOIN nul n ON n.leader = o.leader AND n.follower = o.follower GROUP BY o.leader, o.follower, o.a_stat")
def leadlag_permutation(spark, sf_dir):
    """p-values of the asymmetry of every pair."""
    grid = _lag_grid(spark, sf_dir)
    observed = stats.pair_statistics(stats.correlations(stats.lagged_gram(grid, [1, 2, 3])))
    p = stats.permutation_p(observed, stats.permutation_null(grid, [1, 2, 3]), ["leader", "follower"], drawn=200)
    return p.select("leader", "follower", r5(F.col("a_stat")).alias("a_stat"), r5(F.col("p_value")).alias("p_value"))


_SPANS = [("2024-01-01", "2024-01-16"), ("2024-01-05", "2024-01-21"), ("2024-01-10", "2024-01-26"), ("2024-01-01", "2024-01-30")]
_GRAM = "sum(a.x * b.x) AS s_xy, sum(a.x * a.x) AS s_x2m, sum(b.x * b.x) AS s_mx2"
_VALIDATE_SQL = f"""{_GRID_SQL}, w(ws, we) AS (VALUES {', '.join(f"(DATE '{a}', DATE '{b}')" for a, b in _SPANS)}), own AS (SELECT ws, we, pn.* FROM pn JOIN w ON segment BETWEEN ws AND we),
dl AS (SELECT ws, we, segment, count(DISTINCT pos) AS n FROM own GROUP BY ALL), ch AS (SELECT *, CASE WHEN lag(n) OVER (PARTITION BY ws, we ORDER BY segment) <> n THEN 1 ELSE 0 END AS c FROM dl), st AS (SELECT ws, we, segment, sum(c) OVER (PARTITION BY ws, we ORDER BY segment) AS stratum FROM ch),
dy AS (SELECT *, row_number() OVER (PARTITION BY ws, we, stratum ORDER BY segment) - 1 AS k, count(*) OVER (PARTITION BY ws, we, stratum) AS days FROM st),
dr AS (SELECT ws, we, draw, stratum, days, CASE WHEN days >= 4 THEN 2 + CAST('0x' || substr(md5(concat_ws(':', 42, draw, CAST(stratum AS BIGINT), ws, we)), 1, 12) AS BIGINT) % (days - 3) ELSE 0 END AS o FROM (SELECT DISTINCT ws, we, stratum, days FROM dy), (SELECT unnest(range(1, 51)) AS draw)),
pr AS (SELECT DISTINCT ws, we, a.stratum, o, a.segment AS d1, b.segment AS d2 FROM dy a JOIN dr USING (ws, we, stratum) JOIN dy b USING (ws, we) WHERE b.stratum = a.stratum AND b.k = (a.k + o) % a.days),
g2 AS (SELECT pr.ws, pr.we, stratum, o, a.product AS leader, b.product AS follower, lag, {_GRAM} FROM pr JOIN pn a ON a.segment = d1 CROSS JOIN (VALUES (1), (2), (3)) t(lag) JOIN pn b ON b.segment = d2 AND b.pos = a.pos + lag WHERE a.product <> b.product GROUP BY ALL),
gd AS (SELECT ws, we, draw, leader, follower, lag, sum(s_xy) AS s_xy, sum(s_x2m) AS s_x2m, sum(s_mx2) AS s_mx2 FROM dr JOIN g2 USING (ws, we, stratum, o) GROUP BY ALL),
one AS (SELECT ws, we, draw, leader, follower, {_A_SQL} FROM gd GROUP BY ALL), nul AS (SELECT a.ws, a.we, a.draw, a.leader, a.follower, a.total - coalesce(b.total, 0) AS a_stat FROM one a LEFT JOIN one b ON a.ws = b.ws AND a.we = b.we AND a.draw = b.draw AND a.leader = b.follower AND a.follower = b.leader),
go AS (SELECT a.ws, a.we, a.product AS leader, b.product AS follower, lag, {_GRAM} FROM own a CROSS JOIN (VALUES (1), (2), (3)) t(lag) JOIN own b ON b.ws = a.ws AND b.we = a.we AND b.segment = a.segment AND b.pos = a.pos + lag WHERE a.product <> b.product GROUP BY ALL),
oo AS (SELECT ws, we, leader, follower, {_A_SQL} FROM go GROUP BY ALL), ob AS (SELECT a.ws, a.we, a.leader, a.follower, a.total - coalesce(b.total, 0) AS a_stat FROM oo a LEFT JOIN oo b ON a.ws = b.ws AND a.we = b.we AND a.leader = b.follower AND a.follower = b.leader),
pv AS (SELECT o.ws, o.we, o.leader, o.follower, o.a_stat, (1 + count(*) FILTER (WHERE abs(n.a_stat) >= abs(o.a_stat) - 1e-12)) / 51.0 AS p, CASE WHEN (o.leader, o.follower) IN ((0, 1), (1, 0), (2, 3), (3, 2)) THEN 'A' ELSE 'B' END AS family FROM ob o JOIN nul n USING (ws, we, leader, follower) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY ws, we, family ORDER BY p) AS i, count(*) OVER (PARTITION BY ws, we, family) AS m FROM pv),
ed AS (SELECT *, least(1, min(p * m / i) OVER (PARTITION BY ws, we, family ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM rk),
sb AS (SELECT e.ws, e.we, e.leader, e.follower, avg(CASE WHEN sign(b.a_stat) = sign(e.a_stat) AND b.q <= 0.1 THEN 1.0 ELSE 0.0 END) AS stability FROM ed e JOIN ed b ON b.leader = e.leader AND b.follower = e.follower AND b.we < e.we GROUP BY ALL)"""


@query("leadlag_validate", f"WITH {_VALIDATE_SQL} SELECT e.ws AS window_start, e.we AS window_end, e.leader, e.follower, family, {sql5('a_stat', 'a_stat')}, {sql5('p', 'p_value')}, {sql5('q', 'q_value')}, {sql5('coalesce(stability, 0)', 'stability')}, (family = 'A' AND q <= 0.05) OR (family = 'B' AND q <= 0.1) AS validated FROM ed e LEFT JOIN sb USING (ws, we, leader, follower)")
def leadlag_validate(spark, sf_dir):
    """Edges of three overlapping windows and of the whole month, each with its own null."""
    grid = _lag_grid(spark, sf_dir)
    windows = spark.createDataFrame(_SPANS, "a string, b string").select(F.to_date("a").alias("window_start"), F.to_date("b").alias("window_end"))
    priors = spark.createDataFrame([(0, 1), (2, 3)], "leader bigint, follower bigint")
    e = stats.validated_edges(grid, windows, [1, 2, 3], priors, 50, 2)
    return e.select("window_start", "window_end", "leader", "follower", "family", *[r5(F.col(c)).alias(c) for c in ("a_stat", "p_value", "q_value", "stability")], "validated")


_Q_SRC = "t AS (SELECT o_orderkey AS k, ((o_orderkey * 7919) % 10007) / 10007.0 AS p, CASE WHEN o_custkey % 3 = 0 THEN 'A' ELSE 'B' END AS family FROM orders)"
_FDR_SQL = f"""r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS i, count(*) OVER (PARTITION BY family) AS m FROM t),
b AS (SELECT k, family, least(1, min(p * m / i) OVER (PARTITION BY family ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q, m, i, p FROM r),
h AS (SELECT family, sum(1.0 / i) AS hs FROM r GROUP BY family) SELECT k, family, {sql5('q', 'bh')}, {sql5('least(1, min(p * m * hs / i) OVER (PARTITION BY family ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'by_q')},
(family = 'A' AND q <= 0.05) OR (family = 'B' AND q <= 0.10) AS validated FROM b JOIN h USING (family)"""


@query("leadlag_false_discovery", f"WITH {_Q_SRC}, {_FDR_SQL}")
def leadlag_false_discovery(spark, sf_dir):
    return _discoveries(table(spark, sf_dir, "orders"))


def _discoveries(o):
    t = o.select(F.col("o_orderkey").alias("k"), (((F.col("o_orderkey") * 7919) % 10007) / 10007.0).alias("p"), F.when(F.col("o_custkey") % 3 == 0, "A").otherwise("B").alias("family"))
    q = stats.false_discovery_by_parts(t, "p", ["family"], name="bh", dependent_name="by_q")
    ok = ((F.col("family") == "A") & (F.col("bh") <= 0.05)) | ((F.col("family") == "B") & (F.col("bh") <= 0.10))
    return q.select("k", "family", r5(F.col("bh")).alias("bh"), r5(F.col("by_q")).alias("by_q"), ok.alias("validated"))


_H_SQL = "h AS (SELECT 'P' || (o_custkey % 5) AS leader, 'P' || (o_custkey % 4) AS follower, CAST(date_trunc('month', o_orderdate) AS DATE) AS asof_date, avg(o_totalprice) / 1000 - 140 AS a_stat, min(o_orderkey % 100) / 100.0 AS q_value FROM orders GROUP BY ALL)"


@query("leadlag_stability", f"""WITH {_H_SQL}, r AS (SELECT *, row_number() OVER w AS i, first_value(a_stat) OVER w AS newest, lead(a_stat) OVER w AS prev FROM h WINDOW w AS (PARTITION BY leader, follower ORDER BY asof_date DESC)),
x AS (SELECT *, CASE WHEN i = 12 THEN NULL ELSE prev END AS before FROM r WHERE i <= 12),
s AS (SELECT leader, follower, avg(CASE WHEN sign(a_stat) = sign(newest) AND q_value <= 0.1 THEN 1.0 ELSE 0.0 END) AS stability, sum(a_stat * before) AS xy, sum(before * before) AS xx, count(*) AS n FROM x GROUP BY ALL)
SELECT leader, follower, {sql5('stability', 'stability')}, {sql5('CASE WHEN n >= 6 AND xy / xx > 0 AND xy / xx < 1 THEN ln(2) / -ln(xy / xx) END', 'half_life')} FROM s""")
def leadlag_stability(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    h = o.groupBy(F.concat(F.lit("P"), F.col("o_custkey") % 5).alias("leader"), F.concat(F.lit("P"), F.col("o_custkey") % 4).alias("follower"), F.trunc("o_orderdate", "month").alias("asof_date")).agg((F.avg("o_totalprice") / 1000 - 140).alias("a_stat"), (F.min(F.col("o_orderkey") % 100) / 100.0).alias("q_value"))
    s = stats.stability(h, 12, 0.1)
    return s.select("leader", "follower", r5(F.col("stability")).alias("stability"), r5(F.col("half_life")).alias("half_life"))


_LEAD_SQL = """e AS (SELECT DISTINCT ON (leader, follower, asof_date) o_custkey % 6 AS leader, o_custkey % 5 AS follower, CAST(o_orderdate AS DATE) AS asof_date, o_totalprice / 1000 - 150 AS a_stat, 1 + o_orderkey % 4 AS lag_bars, (o_orderkey % 100) / 100.0 AS strength
  FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' ORDER BY leader, follower, asof_date, o_orderkey),
m AS (SELECT CAST(unnest(range(DATE '1996-01-01', DATE '1996-07-01', INTERVAL 1 MONTH)) AS DATE) AS month),
l AS (SELECT month, e.*, row_number() OVER (PARTITION BY month, leader, follower ORDER BY asof_date DESC) AS r FROM m JOIN e ON asof_date < month AND asof_date >= month - 45),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY month, follower ORDER BY abs(a_stat) DESC, leader) AS rank FROM l WHERE r = 1) WHERE rank = 1),
p AS (SELECT product, row, month, ((product * 7 + row * 13) % 11) / 10.0 - 0.5 AS x FROM range(0, 6) a(product), (SELECT month, i + 20 * (month(month) - 1) AS row FROM m, range(0, 20) t(i)))"""


@query("g_lead_terminals", f"""WITH {_LEAD_SQL} SELECT p.product, CAST(p.row AS BIGINT) AS row, {sql5('coalesce(CASE WHEN p.row + 1 >= k.lag_bars THEN (SELECT sum(q.x) FROM p q WHERE q.product = k.leader AND q.row <= p.row AND q.row > p.row - k.lag_bars) END, 0)', 'lead_ret')},
{sql5('coalesce(k.strength, 0)', 'll_strength')} FROM p LEFT JOIN k ON k.month = p.month AND k.follower = p.product""")
def g_lead_terminals(spark, sf_dir):
    from meridia.operators import asof
    from meridia.sources.raw import first_of

    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))
    e = o.select((F.col("o_custkey") % 6).alias("leader"), (F.col("o_custkey") % 5).alias("follower"), F.to_date("o_orderdate").alias("asof_date"), F.lit("h").alias("config_hash"), F.lit(0.0).alias("q_value"), F.lit(1.0).alias("stability"), (F.col("o_totalprice") / 1000 - 150).alias("a_stat"), (1 + F.col("o_orderkey") % 4).alias("lag_bars"), ((F.col("o_orderkey") % 100) / 100.0).alias("strength"), "o_orderkey")
    e = first_of(e, ["leader", "follower", "asof_date"], [F.col("o_orderkey")])
    month = F.explode(F.sequence(F.lit("1996-01-01").cast("date"), F.lit("1996-06-01").cast("date"), F.expr("interval 1 month")))
    p = spark.range(6).select(F.col("id").alias("product"), month.alias("month")).select("product", "month", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    p = p.withColumn("row", (F.col("i") + 20 * (F.month("month") - 1)).cast("bigint")).withColumn("x", ((F.col("product") * 7 + F.col("row") * 13) % 11) / 10.0 - 0.5)
    p = p.select("product", "row", "month", "x", F.lit(0.0).alias("oi_chg"), F.lit(0.0).alias("stale"))
    out = asof.leader_terminals(p, asof.monthly_edges(e, 1), 1)
    return out.select("product", "row", r5(F.col("lead_ret")).alias("lead_ret"), r5(F.col("ll_strength")).alias("ll_strength"))


# --- features -----------------------------------------------------------------------------------

_P = Panel(("product",), ("bob",), ("bob",))
_PW = "PARTITION BY product ORDER BY bob"


@query("feat_returns", f"WITH {BARS_SQL}, r AS (SELECT event_id, product, bob, CASE WHEN lag(day) OVER ({_PW}) = day THEN ln(close) - ln(lag(close) OVER ({_PW})) END AS r FROM bars WHERE close > 0) SELECT event_id, {sql5('r', 'r')}, {sql5(f'CASE WHEN count(r) OVER (PARTITION BY product ORDER BY bob ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 THEN sum(r) OVER (PARTITION BY product ORDER BY bob ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END', 'ret_3')} FROM r")
def feat_returns(spark, sf_dir):
    b = bars(spark, sf_dir).where("close > 0")
    w = _P.rows()
    r = b.withColumn("r", F.when(F.lag("day").over(w) == F.col("day"), F.ln("close") - F.ln(F.lag("close").over(w))))
    return r.select("event_id", r5(F.col("r")).alias("r"), r5(B.strict_sum(F.col("r"), _P, 3)).alias("ret_3"))


@query("feat_zscore_range", f"""WITH {BARS_SQL} SELECT event_id, {sql5('CASE WHEN count(close) OVER w = 12 AND stddev_pop(close) OVER w > 0 THEN (close - avg(close) OVER w) / stddev_pop(close) OVER w END', 'z')},
{sql5('CASE WHEN count(close) OVER w = 12 AND close <> 0 THEN (max(close) OVER w - min(close) OVER w) / close END', 'rng')} FROM bars WINDOW w AS ({_PW} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def feat_zscore_range(spark, sf_dir):
    w = _P.last(12)
    sd, full = F.stddev_pop("close").over(w), F.count("close").over(w) == 12
    z = F.when(full & (sd > 0), (F.col("close") - F.avg("close").over(w)) / F.when(sd > 0, sd))
    rng = F.when(full & (F.col("close") != 0), (F.max("close").over(w) - F.min("close").over(w)) / F.when(F.col("close") != 0, F.col("close")))
    return bars(spark, sf_dir).select("event_id", r5(z).alias("z"), r5(rng).alias("rng"))


@query("feat_daily_sigma", f"WITH {BARS_SQL}, d AS (SELECT product, day, sum(close) AS s1, sum(close * close) AS s2, count(close) AS n FROM bars GROUP BY ALL) SELECT product, day, {sql5('CASE WHEN sum(n) OVER w >= 10 THEN sqrt(greatest(0, sum(s2) OVER w / sum(n) OVER w - pow(sum(s1) OVER w / sum(n) OVER w, 2))) END', 'sigma')} FROM d WINDOW w AS (PARTITION BY product ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)")
def feat_daily_sigma(spark, sf_dir):
    return B.daily_sigma(bars(spark, sf_dir), "product", "day", "close", 10, 10).select("product", "day", r5(F.col("sigma")).alias("sigma"))


@query("feat_seasonal_profile", f"""WITH {BARS_SQL}, e AS (SELECT product % 10 AS product, day, hour(bob) AS slot, avg(abs(close)) AS a FROM bars GROUP BY ALL), k AS (SELECT product, day, row_number() OVER (PARTITION BY product ORDER BY day) AS k FROM (SELECT DISTINCT product, day FROM e)),
j AS (SELECT * FROM e JOIN k USING (product, day)), m AS (SELECT *, CASE WHEN count(a) OVER w >= 3 THEN quantile_cont(a, 0.5) OVER w END AS m FROM j WINDOW w AS (PARTITION BY product, slot ORDER BY k RANGE BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT product, day, CAST(slot AS BIGINT) AS slot, {sql5('greatest(0.25, m / avg(m) OVER (PARTITION BY product, day))', 'raw')}, m IS NOT NULL AS known FROM m""")
def feat_seasonal_profile(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("product", F.col("product") % 10).withColumn("slot", F.hour("bob").cast("bigint"))
    p = B.seasonal_profile(b, ["product"], "day", "slot", "close", 10, 3)
    # without enough days the share is unknown; the SQL's greatest() then gives the floor
    return p.select("product", "day", "slot", r5(F.coalesce("profile", F.lit(0.25))).alias("raw"), F.col("profile").isNotNull().alias("known"))


@query("feat_variable_lag", f"""WITH {BARS_SQL}, n AS (SELECT event_id, product, bob, close, row_number() OVER ({_PW}) AS i, count(*) OVER (PARTITION BY product, day) AS b FROM bars)
SELECT n.event_id, {sql5('CASE WHEN i >= b THEN (SELECT sum(m.close) FROM n m WHERE m.product = n.product AND m.i > n.i - n.b AND m.i <= n.i) END', 'ret_1d')} FROM n""")
def feat_variable_lag(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("b", F.count("*").over(Window.partitionBy("product", "day")))
    return B.variable_lag_sum(b, _P, "close", "b", "s").select("event_id", r5(F.col("s")).alias("ret_1d"))


@query("feat_ewma", f"""WITH RECURSIVE {BARS_SQL}, n AS (SELECT *, row_number() OVER ({_PW}) AS k FROM bars), r AS (SELECT event_id, product, k, volume AS y FROM n WHERE k = 1
  UNION ALL SELECT n.event_id, n.product, n.k, (1 - pow(0.5, 1.0 / 60)) * n.volume + pow(0.5, 1.0 / 60) * r.y FROM r JOIN n ON n.product = r.product AND n.k = r.k + 1) SELECT event_id, {sql5('y', 'y')} FROM r""")
def feat_ewma(spark, sf_dir):
    from meridia.operators.sequential import exponential

    return exponential(bars(spark, sf_dir), "volume", "y", _P, "halflife", 60).select("event_id", r5(F.col("y")).alias("y"))


_FEATURES_SQL = f"""WITH RECURSIVE {BARS_SQL}, b AS (SELECT event_id, product, day, close, volume, month(day) AS seg, hour(bob) AS slot, row_number() OVER (PARTITION BY product ORDER BY bob) AS k, count(*) OVER (PARTITION BY product, day) AS bpd FROM bars WHERE close > 0),
rr AS (SELECT *, CASE WHEN lag(seg) OVER w = seg THEN ln(close) - ln(lag(close) OVER w) END AS r FROM b WINDOW w AS (PARTITION BY product ORDER BY k)),
e AS (SELECT product, k, r * r AS y, volume AS s, volume AS l FROM rr WHERE k = 1
 UNION ALL SELECT n.product, n.k, CASE WHEN n.r IS NULL THEN e.y WHEN e.y IS NULL THEN n.r * n.r ELSE (1 - pow(0.5, 1.0 / n.bpd)) * n.r * n.r + pow(0.5, 1.0 / n.bpd) * e.y END,
  (1 - pow(0.5, 1.0 / 60)) * n.volume + pow(0.5, 1.0 / 60) * e.s, (1 - pow(0.5, 1.0 / 1200)) * n.volume + pow(0.5, 1.0 / 1200) * e.l FROM e JOIN rr n ON n.product = e.product AND n.k = e.k + 1),
d AS (SELECT product, day, sum(r) AS s1, sum(r * r) AS s2, count(r) AS n FROM rr GROUP BY ALL),
sg AS (SELECT product, day, CASE WHEN sum(n) OVER w >= 100 THEN sqrt(greatest(0, sum(s2) OVER w / sum(n) OVER w - pow(sum(s1) OVER w / sum(n) OVER w, 2))) END AS sigma FROM d WINDOW w AS (PARTITION BY product ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
sl AS (SELECT product, day, slot, avg(abs(r)) AS a, dense_rank() OVER (PARTITION BY product ORDER BY day) AS dk FROM rr GROUP BY product, day, slot),
md AS (SELECT *, CASE WHEN count(a) OVER w >= 5 THEN quantile_cont(a, 0.5) OVER w END AS m FROM sl WINDOW w AS (PARTITION BY product, slot ORDER BY dk RANGE BETWEEN 60 PRECEDING AND 1 PRECEDING)),
pf AS (SELECT product, day, slot, CASE WHEN m IS NOT NULL AND avg(m) OVER v > 0 THEN greatest(0.25, m / avg(m) OVER v) END AS profile FROM md WINDOW v AS (PARTITION BY product, day)),
j AS (SELECT rr.*, sqrt(e.y) AS ewma, e.s, e.l, sigma, profile, lag(sqrt(e.y)) OVER (PARTITION BY rr.product ORDER BY rr.k) AS before FROM rr JOIN e USING (product, k) LEFT JOIN sg USING (product, day) LEFT JOIN pf USING (product, day, slot))"""


def _rolled(n, test, value):
    return f"CASE WHEN {test} THEN {value} END".replace("$w", f"OVER (PARTITION BY j.product ORDER BY j.k ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")


_FEATURES = {
    "x_std": "CASE WHEN before * coalesce(profile, 1) > 0 AND r IS NOT NULL THEN CASE WHEN sigma IS NULL THEN r ELSE greatest(-5 * sigma, least(5 * sigma, r)) END / (before * coalesce(profile, 1)) END",
    "vol_ewma": "ewma",
    **{f"ret_{n}m": _rolled(n, f"count(r) $w = {n}", "sum(r) $w") for n in (5, 15, 60)},
    "ret_1d": "(SELECT CASE WHEN count(m.r) = j.bpd THEN sum(m.r) END FROM rr m WHERE m.product = j.product AND m.k > j.k - j.bpd AND m.k <= j.k)",
    "oi_chg_1d": "(SELECT CASE WHEN m.seg = j.seg AND m.volume > 0 THEN j.volume / m.volume - 1 END FROM rr m WHERE m.product = j.product AND m.k = j.k - j.bpd)",
    **{f"z_{n}": _rolled(n, f"count(close) $w = {n} AND stddev_pop(close) $w > 0", "(close - avg(close) $w) / stddev_pop(close) $w") for n in (60, 240, 1200)},
    "vol_ratio": "CASE WHEN l > 0 THEN s / l END",
    **{f"range_{n}": _rolled(n, f"count(close) $w = {n}", "(max(close) $w - min(close) $w) / close") for n in (1, 15, 60)},
}


@query("feat_panel", f"{_FEATURES_SQL} SELECT event_id, {', '.join(sql5(v, k) for k, v in _FEATURES.items())} FROM j")
def feat_panel(spark, sf_dir):
    """All fourteen features of the bars."""
    b = bars(spark, sf_dir).where("close > 0").withColumn("segment", F.month("day")).withColumn("slot", F.hour("bob")).withColumn("template", F.lit(0))
    names = ["x_std", "vol_ewma", "ret_5m", "ret_15m", "ret_60m", "ret_1d", "oi_chg_1d", "z_60", "z_240", "z_1200", "vol_ratio", "range_1", "range_15", "range_60"]
    return B.features(b).select("event_id", *[r5(F.col(c)).alias(c) for c in names])


# --- state machines --------------------------------------------------------------------------------

@query("state_positions", f"""WITH RECURSIVE {BARS_SQL}, n AS (SELECT event_id, day, row_number() OVER (PARTITION BY product ORDER BY bob) AS k, product, close, event_type = 'error' AS lock FROM bars),
r AS (SELECT event_id, product, k, day, 0 AS pos, 0 AS kept, CASE WHEN close > 80 THEN 1 WHEN close < 20 THEN -1 ELSE 0 END AS nxt FROM n WHERE k = 1
 UNION ALL SELECT event_id, product, k, day, pos, kept, CASE WHEN want = pos AND kept >= 3 THEN 0 ELSE want END FROM (
  SELECT *, CASE WHEN close > 80 THEN 1 WHEN close < 20 THEN -1 ELSE pos END AS want FROM (SELECT *, CASE WHEN pos <> 0 AND pos = before THEN age + 1 ELSE 0 END AS kept FROM (
   SELECT n.event_id, n.product, n.k, n.day, n.close, r.pos AS before, r.kept AS age, CASE WHEN n.day <> r.day THEN 0 WHEN n.lock THEN r.pos ELSE r.nxt END AS pos FROM r JOIN n ON n.product = r.product AND n.k = r.k + 1))))
SELECT event_id, CAST(pos AS BIGINT) AS pos FROM r""")
def state_positions(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("lo", F.lit(20.0)).withColumn("hi", F.lit(80.0)).withColumn("lock", (F.col("event_type") == "error").cast("int")).withColumn("seg", F.unix_date("day"))
    p = backtest.with_positions(b, _P, "close", "lo", "hi", "lock", "seg", 3)
    return p.select("event_id", F.col("position").cast("bigint").alias("pos"))


_BACKTEST_SQL = f"""WITH RECURSIVE {BARS_SQL}, q AS (SELECT product, day, close, -close AS sig, close + 1 AS open, row_number() OVER w AS k, count(close) OVER b AS known, quantile_cont(-close, 0.1) OVER b AS lo, quantile_cont(-close, 0.9) OVER b AS hi
  FROM bars WINDOW w AS (PARTITION BY product ORDER BY bob), b AS (PARTITION BY product ORDER BY bob ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, CASE WHEN known < 10 THEN NULL WHEN sig > hi THEN 1 WHEN sig < lo THEN -1 END AS wish FROM q),
r AS (SELECT product, k, day, 0 AS pos, 0 AS kept, coalesce(wish, 0) AS nxt FROM n WHERE k = 1
 UNION ALL SELECT product, k, day, pos, kept, CASE WHEN want = pos AND kept >= 100 THEN 0 ELSE want END FROM (
  SELECT *, coalesce(wish, pos) AS want FROM (SELECT *, CASE WHEN pos <> 0 AND pos = before THEN age + 1 ELSE 0 END AS kept FROM (
   SELECT n.product, n.k, n.day, n.wish, r.pos AS before, r.kept AS age, CASE WHEN n.day <> r.day THEN 0 ELSE r.nxt END AS pos FROM r JOIN n ON n.product = r.product AND n.k = r.k + 1)))),
m AS (SELECT n.product, n.day, r.pos, coalesce(CASE WHEN lead(n.day) OVER w = n.day THEN lead(n.open) OVER w / n.open - 1 END, 0) AS move, abs(r.pos - coalesce(lag(r.pos) OVER w, 0)) AS turn, n.open FROM r JOIN n USING (product, k) WINDOW w AS (PARTITION BY n.product ORDER BY n.k))"""


@query("state_backtest", f"{_BACKTEST_SQL} SELECT product, day, {sql5('sum(pos * move - turn * (0.0001 + 0.01 / open))', 'net')}, CAST(sum(turn) AS BIGINT) AS turnover, {sql5('avg(CASE WHEN pos <> 0 THEN 1.0 ELSE 0.0 END)', 'time_in')} FROM m GROUP BY product, day")
def state_backtest(spark, sf_dir):
    """Quantile bands, positions, costs and daily profit of a mean-reversion signal."""
    b = bars(spark, sf_dir).withColumn("signal", -F.col("close")).withColumn("open", F.col("close") + 1)
    lo, hi = backtest.bands("signal", _P, 20, 10, 0.1, 0.9)
    b = b.withColumn("lo", lo).withColumn("hi", hi).withColumn("lock", F.lit(0)).withColumn("seg", F.unix_date("day"))
    costs = b.select("product").distinct().withColumn("fee", F.lit(1.0)).withColumn("slippage", F.lit(0.01))
    p = backtest.profit(backtest.with_costs(backtest.with_positions(b, _P, "signal", "lo", "hi", "lock", "seg", 100), costs), _P, "open", "seg")
    return p.groupBy("product", "day").agg(r5(F.sum("net")).alias("net"), F.sum("turn").cast("bigint").alias("turnover"), r5(F.avg((F.col("position") != 0).cast("double"))).alias("time_in"))


def _contract_days(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_suppkey") % 10).alias("product"), F.format_string("C%02d", F.col("l_partkey") % 12).alias("contract"), F.to_date("l_shipdate").alias("trading_date"), (200001 + F.col("l_partkey") % 12).alias("delivery_ym"), F.col("l_quantity").alias("volume"), F.col("l_extendedprice").alias("close"), F.col("l_quantity").alias("position"), F.col("l_shipdate").alias("bob"))


_DOMINANT_SQL = """cd AS (SELECT l_suppkey % 10 AS product, 'C' || lpad(CAST(l_partkey % 12 AS VARCHAR), 2, '0') AS contract, CAST(l_shipdate AS DATE) AS d, min(200001 + l_partkey % 12) AS dym, sum(l_quantity) AS vol, max(l_quantity) AS oi, max(l_extendedprice) AS price FROM lineitem GROUP BY ALL),
days AS (SELECT product, d, CASE WHEN d <= DATE '1998-06-30' THEN 0 ELSE 1 END AS seg, list({'c': contract, 'v': vol, 'dy': dym, 'p': price} ORDER BY vol DESC, oi DESC, dym, contract) AS l FROM cd GROUP BY product, d),
dd AS (SELECT *, row_number() OVER w AS k, lag(l, 1) OVER w AS l1, lag(l, 2) OVER w AS l2 FROM days WINDOW w AS (PARTITION BY product ORDER BY d)),
r AS (SELECT product, k, d, seg, l[1].c AS held, l[1].dy AS dy, 1.0::DOUBLE AS factor, NULL::VARCHAR AS rival, 0 AS streak, NULL::VARCHAR AS fc, NULL::BIGINT AS fd, NULL::DOUBLE AS ff FROM dd WHERE k = 1
 UNION ALL SELECT product, k, d, seg, held, dy, factor, CASE WHEN streak < 2 THEN rival END, CASE WHEN streak < 2 THEN streak ELSE 0 END, CASE WHEN streak >= 2 THEN rival END, CASE WHEN streak >= 2 THEN rdy END,
  CASE WHEN streak >= 2 THEN coalesce(CASE WHEN old > 0 THEN new / old END, 1.0) END FROM (
  SELECT *, coalesce(list_filter(l, lambda x: x.c = held)[1].p, list_filter(l1, lambda x: x.c = held)[1].p, list_filter(l2, lambda x: x.c = held)[1].p) AS old,
   coalesce(list_filter(l, lambda x: x.c = rival)[1].p, list_filter(l1, lambda x: x.c = rival)[1].p, list_filter(l2, lambda x: x.c = rival)[1].p) AS new FROM (
   SELECT *, CASE WHEN ok THEN cand.c END AS rival, cand.dy AS rdy, CASE WHEN NOT ok THEN 0 WHEN cand.c = before THEN age + 1 ELSE 1 END AS streak FROM (
    SELECT *, NOT fresh AND coalesce(cand.v > coalesce(list_filter(l, lambda x: x.c = held)[1].v, 0), false) AS ok FROM (
     SELECT *, list_filter(l, lambda x: x.c <> held AND x.dy >= dy)[1] AS cand FROM (
      SELECT b.product, b.k, b.d, b.seg, b.l, b.l1, b.l2, b.seg <> a.seg AS fresh, CASE WHEN b.seg <> a.seg THEN b.l[1].c ELSE coalesce(a.fc, a.held) END AS held, CASE WHEN b.seg <> a.seg THEN b.l[1].dy ELSE coalesce(a.fd, a.dy) END AS dy,
       CASE WHEN b.seg <> a.seg THEN 1.0 ELSE coalesce(a.ff, 1.0) END AS factor, a.rival AS before, a.streak AS age FROM r a JOIN dd b ON b.product = a.product AND b.k = a.k + 1)))))),
ru AS (SELECT *, sum(CASE WHEN before = held THEN 0 ELSE 1 END) OVER (PARTITION BY product, seg ORDER BY d) AS span FROM (SELECT *, lag(held) OVER (PARTITION BY product, seg ORDER BY d) AS before FROM r)),
sp AS (SELECT product, seg, span, held AS contract, min(d) AS date_start, max(d) AS seen, arg_min(factor, d) AS f FROM ru GROUP BY ALL)"""


@query("state_dominant_contract", f"""WITH RECURSIVE {_DOMINANT_SQL} SELECT product, CAST(seg AS BIGINT) AS segment, contract, date_start, coalesce(CAST(lead(date_start) OVER w - 1 AS DATE), seen) AS date_end, {sql5('exp(-sum(CASE WHEN span > 1 THEN ln(f) ELSE 0 END) OVER w)', 'adj_factor')}, span > 1 AS rolled
FROM sp WINDOW w AS (PARTITION BY product, seg ORDER BY span)""")
def state_dominant_contract(spark, sf_dir):
    """Leading contracts of two segments, with factors that start at 1 in each."""
    d = _contract_days(spark, sf_dir).groupBy("product", "contract", "trading_date").agg(F.min("delivery_ym").alias("delivery_ym"), F.sum("volume").alias("day_volume"), F.max("position").alias("last_position"), F.max("close").alias("day_close"))
    spans = B.dominance_spans(B.dominance(d, holes=(datetime.date(1998, 6, 30),)))
    return spans.select("product", F.col("segment").cast("bigint").alias("segment"), "contract", "date_start", "date_end", r5(F.col("adj_factor")).alias("adj_factor"), "rolled")


_SESSIONS_SQL = f"""WITH {BARS_SQL}, m AS (SELECT DISTINCT product % 5 AS product, day, (hour(bob) * 60 - 1230 + 1440) % 1440 AS rel FROM bars), g AS (SELECT *, CASE WHEN rel - lag(rel) OVER w <= 15 THEN 0 ELSE 1 END AS brk FROM m WINDOW w AS (PARTITION BY product, day ORDER BY rel)),
bl AS (SELECT *, sum(brk) OVER (PARTITION BY product, day ORDER BY rel) AS block FROM g), e AS (SELECT product, day, block, min(rel) AS lo, max(rel) + 1 AS hi FROM bl GROUP BY ALL), t AS (SELECT product, day, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS v FROM e GROUP BY ALL),
c AS (SELECT *, CASE WHEN lag(v) OVER (PARTITION BY product ORDER BY day) = v THEN 0 ELSE 1 END AS ch FROM t), r AS (SELECT *, sum(ch) OVER (PARTITION BY product ORDER BY day) AS run FROM c), u AS (SELECT product, run, min(day) AS lo, max(day) AS hi, count(*) AS n, any_value(v) AS v FROM r GROUP BY ALL),
h AS (SELECT *, last_value(CASE WHEN n >= 2 OR run = 1 THEN v END IGNORE NULLS) OVER (PARTITION BY product ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM u),
s AS (SELECT *, sum(CASE WHEN (n >= 2 OR run = 1) AND held IS DISTINCT FROM v THEN 1 ELSE 0 END) OVER (PARTITION BY product ORDER BY run) AS span FROM h)
SELECT product, min(lo) AS date_start, max(hi) AS date_end, arg_min(v, run) AS template FROM s GROUP BY product, span"""


@query("state_sessions", _SESSIONS_SQL)
def state_sessions(spark, sf_dir):
    b = bars(spark, sf_dir).select((F.col("product") % 5).alias("product"), F.col("day").alias("trading_date"), F.col("bob").alias("wall"))
    days = B.day_template(b.withColumn("wall", F.date_trunc("hour", "wall").cast("timestamp_ntz")))
    return B.session_runs(days, 2)


@query("state_day_grid", f"""WITH {BARS_SQL}, t AS (SELECT DISTINCT day, (hour(bob) * 60 + minute(bob) - 1230 + 1440) % 1440 AS rel FROM bars), g AS (SELECT *, CASE WHEN rel - lag(rel) OVER (PARTITION BY day ORDER BY rel) = 1 THEN 0 ELSE 1 END AS brk FROM t)
SELECT day, CAST(rel AS BIGINT) AS rel, CAST(sum(brk) OVER (PARTITION BY day ORDER BY rel) AS BIGINT) AS seg FROM g""")
def state_day_grid(spark, sf_dir):
    return _day_grid(bars(spark, sf_dir))


def _day_grid(b):
    rel = B.relative_minute(F.col("bob"))
    b = b.select(F.col("day").alias("trading_date"), rel.alias("start"), (rel + 1).alias("end")).distinct()
    sessions = b.withColumn("template_id", F.unix_date("trading_date"))
    grid = B.grid_rows(sessions.select("template_id", "start", "end"), sessions.select("trading_date", "template_id"))
    return grid.select(F.col("trading_date").alias("day"), F.col("rel_min").cast("bigint").alias("rel"), F.col("seg_session").cast("bigint").alias("seg"))


# --- vectors, graphs, text ----------------------------------------------------------------------------

@query("vec_search", "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id, " + sql5("list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v)", "score") + " FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), q.v) DESC, vec_id LIMIT 10")
def vec_search(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    first = e.where("vec_id = 0").select("embedding").first()
    return vector.search(e, first.embedding if first else [], 10).select("vec_id", r5(F.col("score")).alias("score"))


@query("vec_chunks", "SELECT doc_id, CAST(k AS BIGINT) AS chunk_no, substr(text, CAST(k * 500 + 1 AS BIGINT), 500) AS chunk FROM documents, range(0, 400) t(k) WHERE k * 500 < length(text)")
def vec_chunks(spark, sf_dir):
    c = vector.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 500)
    return c.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk")


@query("vec_kmeans", None)
def vec_kmeans(spark, sf_dir):
    return vector.cosine_kmeans(table(spark, sf_dir, "embeddings"), 8, 20).groupBy("cluster").agg(F.count("*").alias("n"))


@query("graph_neighbours", """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey * 31 % 1500 AS b FROM orders), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, d) AS (SELECT 1::BIGINT, 0 UNION SELECT u.b, d + 1 FROM r JOIN u ON u.a = r.node WHERE d < 3) SELECT node, CAST(min(d) AS BIGINT) AS distance FROM r GROUP BY node""")
def graph_neighbours(spark, sf_dir):
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_custkey") * 31 % 1500).alias("b")).distinct()
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("label", F.lit("customer"))
    return vector.neighbours_within(nodes, e, [1], 3).select("node", F.col("distance").cast("bigint").alias("distance"))


# --- search --------------------------------------------------------------------------------------

def _generation():
    """A seed and its mutations, without repeats."""
    rng = random.Random(7)
    space = Space(("close", "volume"), windows=(3, 5, 8))
    seed = parse_sexpr("(sub (ts_mean :3 close) (ts_mean :8 close))")
    trees = [seed] + [point_mutate(seed, space, rng) for _ in range(7)]
    return list({str(t): t for t in trees}.values())


def _in_sql(n) -> str:
    """The formulas of the generation in SQL: sums and differences of windows, each value bounded."""
    if n.op in ("ts_mean", "ts_std"):
        w = f"OVER (PARTITION BY product ORDER BY bob ROWS BETWEEN {n.params[0] - 1} PRECEDING AND CURRENT ROW)"
        x = n.children[0].params[0]
        value = f"CASE WHEN count({x}) {w} = {n.params[0]} THEN {'avg' if n.op == 'ts_mean' else 'stddev_pop'}({x}) {w} END"
    else:
        value = f" {'+' if n.op == 'add' else '-'} ".join(map(_in_sql, n.children))
    return f"greatest(-1e6, least(1e6, coalesce({value}, 0)))"


def _generation_sql() -> str:
    trees = _generation()
    columns = ", ".join(f"{_in_sql(t)} AS c{i}" for i, t in enumerate(trees))
    ic = lambda i: sql5(f"CASE WHEN stddev_pop(c{i}) FILTER (WHERE y IS NOT NULL) > 1e-9 THEN corr(c{i}, y) END", "ic")
    rows = " UNION ALL ".join(f"SELECT '{t}' AS formula, {ic(i)}, CAST(count(y) AS BIGINT) AS n FROM x" for i, t in enumerate(trees))
    return f"WITH {BARS_SQL}, x AS (SELECT lead(close) OVER (PARTITION BY product ORDER BY bob) - close AS y, {columns} FROM bars) {rows}"


@query("search_generation", _generation_sql())
def search_generation(spark, sf_dir):
    """A generation of mutated seeds scored in one plan: its correlation with the next close."""
    trees = {f"c{i}": t for i, t in enumerate(_generation())}
    out = compile_formulas(bars(spark, sf_dir), trees, K.MINING, Panel(("product",), ("bob",))).withColumn("y", F.lead("close").over(_P.rows()) - F.col("close"))
    both = out.select("y", F.explode(F.array(*[F.struct(F.lit(str(t)).alias("formula"), F.col(k).alias("x")) for k, t in trees.items()])).alias("f")).select("y", "f.*")
    return both.groupBy("formula").agg(r5(K.correlation(F.col("x"), F.col("y"))).alias("ic"), F.count("y").alias("n"))


@query("search_pool_correlation", f"WITH {BARS_SQL}, s AS (SELECT close AS a, volume AS b, close * volume AS c FROM bars) SELECT {sql5('corr(a, b)', 'ab')}, {sql5('corr(a, c)', 'ac')}, {sql5('corr(b, c)', 'bc')} FROM s")
def search_pool_correlation(spark, sf_dir):
    return _pool_correlation(bars(spark, sf_dir))


def _pool_correlation(b):
    s = b.select(F.col("close").alias("a"), F.col("volume").alias("b"), (F.col("close") * F.col("volume")).alias("c"))
    return s.agg(*[r5(K.correlation(F.col(x), F.col(y))).alias(x + y) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))])


@query("search_regression_data", "SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, " + sql5("pow(-1 + i * 0.1, 3) + sin(-1 + j * 0.1)", "y") + " FROM range(0, 21) a(i), range(0, 21) b(j)")
def search_regression_data(spark, sf_dir):
    grid = spark.range(21).select(F.col("id").alias("i")).crossJoin(spark.range(21).select(F.col("id").alias("j")))
    return grid.select("i", "j", r5(F.pow(-1 + F.col("i") * 0.1, F.lit(3)) + F.sin(-1 + F.col("j") * 0.1)).alias("y"))


# --- streams (an extension), run to completion --------------------------------------------------------

def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    s = stream.event_stream(spark, sf_dir, schema, "events.parquet")
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_ohlcv", "SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS bar_start, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL")
def stream_ohlcv(spark, sf_dir):
    build = lambda e: stream.ohlcv(e, "1 day", "0 seconds").select("user_id", F.col("bar_start").cast("timestamp_ntz").alias("bar_start"), "open", "high", "low", "close", "n")
    return stream.drain_all(_stream(spark, sf_dir), build, scratch(spark, "stream"))


@query("stream_unique", "SELECT event_id, user_id FROM events")
def stream_unique(spark, sf_dir):
    return stream.drain(stream.unique(_stream(spark, sf_dir), ["event_id"]).select("event_id", "user_id"), scratch(spark, "stream"))


@query("stream_sessions_batch", """WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS brk FROM events), s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY user_id, k""")
def stream_sessions_batch(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = stream.sessions(e)
    return s.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n")
