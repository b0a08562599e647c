"""Queries of calendars, equity tables, continuous bars, pools, programs and factor gates."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from meridia.functions import kernels as K
from meridia.functions.compile import compile_formulas
from meridia.functions.expr import lift_parameters, parse_infix, parse_sexpr
from meridia.operators import bars as B, calendar, panel, program, search, stats
from meridia.plans.base import BARS_SQL, MONTHS, MONTHS_SQL, SERIES, bars, months, query, r5, sql5, table
from meridia.plans.research import _DOMINANT_SQL, _contract_days
from meridia.session import scratch
from meridia.sources import equity

# --- calendars ------------------------------------------------------------------------------------

_DAYS_SQL = "d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"


@query("calendar_neighbours", f"WITH {_DAYS_SQL} SELECT day, lag(day) OVER w AS previous, lead(day) OVER w AS following, CAST(row_number() OVER w - 1 AS BIGINT) AS place FROM d WINDOW w AS (ORDER BY day)")
def calendar_neighbours(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    return calendar.neighbours(days).withColumn("place", F.col("place").cast("bigint"))


@query("calendar_session_dates", f"""WITH {BARS_SQL}, d AS (SELECT day, lag(day) OVER (ORDER BY day) AS previous FROM (SELECT DISTINCT day FROM bars)), k AS (SELECT event_id, b.day, previous, (hour(bob) * 60 + minute(bob) - 1230 + 1440) % 1440 AS rel FROM bars b JOIN d USING (day))
SELECT event_id, CASE WHEN rel >= 390 THEN day WHEN rel < 210 THEN previous ELSE previous + 1 END AS date FROM k""")
def calendar_session_dates(spark, sf_dir):
    """Calendar dates of bars whose trading date is their day."""
    b = bars(spark, sf_dir)
    met = b.join(calendar.neighbours(b.select("day")), "day")
    return met.select("event_id", calendar.calendar_date(F.col("day"), F.col("previous"), B.relative_minute(F.col("bob"))).alias("date"))


@query("calendar_overrides", """WITH r AS (SELECT o_custkey % 40 AS product, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q FROM orders GROUP BY ALL),
t AS (SELECT product, a, b, 'x' || month(q) AS template FROM r), o AS (SELECT DATE '1996-02-10' AS lo, DATE '1997-05-20' AS hi)
SELECT product, date_start, date_end, template FROM (
 SELECT product, a AS date_start, CASE WHEN product = 7 AND a <= hi AND b >= lo THEN lo - 1 ELSE b END AS date_end, template FROM t, o WHERE product <> 7 OR a < lo OR a > hi
 UNION ALL SELECT product, hi + 1, b, template FROM t, o WHERE product = 7 AND a <= hi AND b > hi
 UNION ALL SELECT 7, lo, hi, '30-270,750-825' FROM o) WHERE date_start <= date_end""")
def calendar_overrides(spark, sf_dir):
    """Quarterly runs of every product, with one product's template set by hand for a span."""
    o = table(spark, sf_dir, "orders")
    runs = o.groupBy((F.col("o_custkey") % 40).alias("product"), F.date_trunc("quarter", "o_orderdate").alias("q")).agg(F.min(F.to_date("o_orderdate")).alias("date_start"), F.max(F.to_date("o_orderdate")).alias("date_end"))
    runs = runs.select("product", "date_start", "date_end", F.concat(F.lit("x"), F.month("q")).alias("template"))
    template = calendar.template_of([("09:00", "10:15"), ("21:00", "01:00")])
    return calendar.override(runs, 7, datetime.date(1996, 2, 10), datetime.date(1997, 5, 20), template)


# --- continuous bars ------------------------------------------------------------------------------


@query("bars_continuous", f"""WITH RECURSIVE {_DOMINANT_SQL}, w AS (SELECT *, coalesce(CAST(lead(date_start) OVER w - 1 AS DATE), seen) AS date_end, exp(-sum(CASE WHEN span > 1 THEN ln(f) ELSE 0 END) OVER w) AS adj FROM sp WINDOW w AS (PARTITION BY product, seg ORDER BY span)),
b AS (SELECT c.product, c.contract, c.d, c.price, w.seg, w.adj, w.span, w.date_start FROM cd c JOIN w ON w.product = c.product AND w.contract = c.contract AND c.d BETWEEN w.date_start AND w.date_end)
SELECT product, contract, d AS trading_date, CAST(seg AS BIGINT) AS segment, {sql5('price * adj', 'close_adj')}, span > 1 AND d = date_start AS roll_flag FROM b""")
def bars_continuous(spark, sf_dir):
    """Daily bars of the leading contracts, adjusted, with rolls flagged."""
    d = _contract_days(spark, sf_dir).groupBy("product", "contract", "trading_date").agg(F.min("delivery_ym").alias("delivery_ym"), F.sum("volume").alias("day_volume"), F.max("position").alias("last_position"), F.max("close").alias("day_close"))
    spans = B.dominance_spans(B.dominance(d, holes=(datetime.date(1998, 6, 30),)))
    rows = d.select("product", "contract", "trading_date", F.col("trading_date").alias("bob"), F.col("day_close").alias("close"))
    out = B.continuous(rows, spans)
    return out.select("product", "contract", "trading_date", F.col("segment").cast("bigint").alias("segment"), r5(F.col("close") * F.col("adj_factor")).alias("close_adj"), "roll_flag")


# --- equity tables ----------------------------------------------------------------------------------


@query("equity_prices", f"""WITH p AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS o, max(l_extendedprice) AS h, min(l_extendedprice) AS l, median(l_extendedprice) AS c, sum(l_quantity) AS v, sum(l_extendedprice * l_quantity) AS t, avg(l_discount) AS r, avg(l_tax) AS u FROM lineitem GROUP BY ALL)
SELECT date, 'SH600000' AS symbol, {', '.join(sql5(x, n) for n, x in {'open': 'o', 'high': 'h', 'low': 'l', 'close': 'c', 'volume': 'v * 100', 'vwap': '(h + l + c) / 3', 'return_pct': 'r', 'turnover_rate': 'u'}.items())}, round(t, 2) AS turnover FROM p""")
def equity_prices(spark, sf_dir):
    """An upstream table with foreign headers as rows of the store."""
    li = table(spark, sf_dir, "lineitem")
    x = F.col("l_extendedprice")
    raw = li.groupBy(F.to_date("l_shipdate").cast("string").alias("日期")).agg(F.avg(x).alias("开盘"), F.max(x).alias("最高"), F.min(x).alias("最低"), F.median(x).alias("收盘"), F.sum("l_quantity").alias("成交量"), F.sum(x * F.col("l_quantity")).alias("成交额"), F.avg("l_discount").alias("涨跌幅"), F.avg("l_tax").alias("换手率"), F.count("*").alias("other"))
    out = equity.normalise_prices(raw, "600000.sh")
    return out.select("date", "symbol", *[r5(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume", "vwap", "return_pct", "turnover_rate")], F.round("turnover", 2).alias("turnover"))


@query("equity_members", "SELECT CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 6 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') ELSE CAST(c_custkey AS VARCHAR) END AS stock_code, CASE WHEN c_custkey % 9 > 0 THEN DATE '1995-01-01' + CAST(c_custkey % 700 AS INTEGER) END AS in_date, CAST(NULL AS DATE) AS out_date FROM customer")
def equity_members(spark, sf_dir):
    k = F.col("c_custkey")
    day = F.date_add(F.lit("1995-01-01").cast("date"), (k % 700).cast("int")).cast("string")
    raw = table(spark, sf_dir, "customer").select(k.cast("string").alias("品种代码"), F.col("c_name").alias("品种名称"), F.when(k % 9 > 0, day).otherwise("not known").alias("纳入日期"))
    return equity.normalise_events(raw)


_ADJUST_SQL = """p AS (SELECT l_suppkey % 50 AS symbol, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS close, sum(l_quantity) AS volume, sum(l_extendedprice * l_quantity) AS amount FROM lineitem GROUP BY ALL),
f AS (SELECT o_custkey % 50 AS symbol, CAST(o_orderdate AS DATE) AS date, 1 + max(o_orderkey % 7) / 10.0 AS fore FROM orders GROUP BY ALL),
m AS (SELECT p.*, coalesce(last_value(fore IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS fore FROM p LEFT JOIN f USING (symbol, date)),
b AS (SELECT symbol, arg_max(fore, date) AS base FROM m WHERE date <= DATE '1999-01-01' GROUP BY symbol), x AS (SELECT symbol, date, close / base AS close, fore / base AS fore, volume, amount FROM m LEFT JOIN b USING (symbol))"""


@query("equity_adjusted", f"WITH {_ADJUST_SQL} SELECT symbol, date, {sql5('close', 'close')}, {sql5('fore', 'fore')}, {sql5('volume / fore', 'volume')}, {sql5('amount / (volume / fore)', 'vwap')} FROM x")
def equity_adjusted(spark, sf_dir):
    """Prices rebased to the factor of a day."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    prices = li.groupBy((F.col("l_suppkey") % 50).alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(F.avg("l_extendedprice").alias("close"), F.sum("l_quantity").alias("volume"), F.sum(F.col("l_extendedprice") * F.col("l_quantity")).alias("amount"))
    factors = o.groupBy((F.col("o_custkey") % 50).alias("symbol"), F.to_date("o_orderdate").alias("date")).agg((1 + F.max(F.col("o_orderkey") % 7) / 10.0).alias("fore"))
    out = equity.adjusted(prices, factors, "fore", ["close"], datetime.date(1999, 1, 1))
    return out.select("symbol", "date", *[r5(F.col(c)).alias(c) for c in ("close", "fore", "volume", "vwap")])


@query("equity_bins", "SELECT 's' || (l_suppkey % 30) AS symbol, min(CAST(l_shipdate AS DATE)) AS first, max(CAST(l_shipdate AS DATE)) AS last, CAST(count(DISTINCT CAST(l_shipdate AS DATE)) AS BIGINT) AS days FROM lineitem GROUP BY ALL")
def equity_bins(spark, sf_dir):
    """Binary files of every symbol, and what was written."""
    li = table(spark, sf_dir, "lineitem")
    panel = li.groupBy(F.concat(F.lit("s"), F.col("l_suppkey") % 30).alias("symbol"), F.to_date("l_shipdate").alias("date")).agg(F.avg("l_extendedprice").alias("close"))
    return equity.write_bins(panel, scratch(spark, "bins"), ["close"])


# --- factors, pools, programs -----------------------------------------------------------------------


@query("f_bands_by_row", f"""WITH {MONTHS_SQL}, n AS (SELECT date, instrument, close, row_number() OVER (PARTITION BY instrument ORDER BY date) AS i, 2 + month(date) % 5 AS w FROM months)
SELECT date, instrument, {sql5('(SELECT avg(m.close) FROM n m WHERE m.instrument = n.instrument AND m.i <= n.i AND m.i > n.i - n.w)', 'mid')},
{sql5('(SELECT avg(m.close) + stddev_samp(m.close) FROM n m WHERE m.instrument = n.instrument AND m.i <= n.i AND m.i > n.i - n.w)', 'up')} FROM n""")
def f_bands_by_row(spark, sf_dir):
    """Bands over as many rows as each row asks for."""
    trees = {k: lift_parameters(parse_infix(f), K.INFIX_SERIES) for k, f in {"mid": "BB_MIDDLE($close, $w)", "up": "BB_UPPER($close, $w)"}.items()}
    m = months(spark, sf_dir).withColumn("w", (2 + F.month("date") % 5).cast("double"))
    out = compile_formulas(m, trees, K.INFIX, MONTHS)
    return out.select("date", "instrument", r5(F.col("mid")).alias("mid"), r5(F.col("up")).alias("up"))


@query("factor_distinct", f"""WITH {MONTHS_SQL}, f AS (SELECT date, close AS a, close * 2 + 1 AS same, close + 4 * volume AS other, volume AS own FROM months),
c AS (SELECT date, corr(a, same) AS same, corr(a, other) AS other, corr(a, own) AS own FROM f GROUP BY date), m AS (SELECT avg(same) AS same, avg(other) AS other, avg(own) AS own FROM c)
SELECT name, value < 0.99 AS kept FROM (UNPIVOT m ON same, other, own INTO NAME name VALUE value)""")
def factor_distinct(spark, sf_dir):
    """Which new factors aren't an old one again."""
    m = months(spark, sf_dir)
    f = m.select("date", F.col("close").alias("a"), (F.col("close") * 2 + 1).alias("same"), (F.col("close") + 4 * F.col("volume")).alias("other"), F.col("volume").alias("own"))
    kept = stats.distinct_factors(f, ["a"], ["same", "other", "own"])
    return spark.createDataFrame([(n, n in kept) for n in ("same", "other", "own")], "name string, kept boolean")


@query("pool_alpha", f"""WITH {BARS_SQL}, x AS (SELECT event_id, CASE WHEN count(close) OVER w = 3 THEN avg(close) OVER w ELSE 0 END AS a, volume AS b FROM bars WINDOW w AS (PARTITION BY product ORDER BY bob ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT event_id, {sql5('0.6 * a - 0.25 * b', 'alpha')} FROM x""")
def pool_alpha(spark, sf_dir):
    """A stored pool's weighted sum."""
    pool = search.load_pool('{"exprs": ["(ts_mean :3 close)", "volume"], "weights": [0.6, -0.25]}')
    return search.combine(bars(spark, sf_dir), pool, K.MINING, SERIES).select("event_id", r5(F.col("alpha")).alias("alpha"))


@query("panel_slice", f"WITH {MONTHS_SQL}, m AS (SELECT date, instrument, CASE WHEN instrument = 3 AND date < DATE '1998-01-01' THEN NULL ELSE close END AS close FROM months), d AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM m)), x AS (SELECT min(i) AS lo, max(i) AS hi FROM d WHERE date BETWEEN DATE '1996-03-15' AND DATE '1996-09-20'), k AS (SELECT m.* FROM m JOIN d USING (date), x WHERE i BETWEEN lo - 4 AND hi + 2) SELECT date, instrument, {sql5('close', 'close')} FROM k WHERE instrument IN (SELECT instrument FROM k WHERE close IS NOT NULL)")
def panel_slice(spark, sf_dir):
    """Half a year of months with margins, instruments without a price left out."""
    m = months(spark, sf_dir)
    price = F.when((F.col("instrument") == 3) & (F.col("date") < F.lit("1998-01-01").cast("date")), None).otherwise(F.col("close"))
    m = m.select("date", "instrument", price.alias("close"))
    out = panel.panel_slice(m, datetime.date(1996, 3, 15), datetime.date(1996, 9, 20), 4, 2)
    return out.select("date", "instrument", r5(F.col("close")).alias("close"))


@query("panel_warm_up", f"WITH {BARS_SQL}, r AS (SELECT event_id, product, day, day < DATE '2024-01-16' AS warm, dense_rank() OVER (PARTITION BY product, day < DATE '2024-01-16' ORDER BY day DESC) AS r FROM bars) SELECT event_id, product, day, warm FROM r WHERE NOT warm OR r <= 5")
def panel_warm_up(spark, sf_dir):
    """The second half of the month with the last five days of each product before it."""
    return panel.with_warm_up(bars(spark, sf_dir).select("event_id", "product", "day"), datetime.date(2024, 1, 16), ["product"], "day", 5)


@query("topk_tail", f"WITH {BARS_SQL} SELECT product, event_id, close FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY bob DESC, event_id DESC) AS r FROM bars) WHERE r <= 3")
def topk_tail(spark, sf_dir):
    return panel.tail(bars(spark, sf_dir), ["product"], [F.desc("bob"), F.desc("event_id")], 3).select("product", "event_id", "close")


@query("agg_row_pattern", f"WITH {BARS_SQL}, e AS (SELECT product, day, list_sort(list(DISTINCT event_type)) AS pattern FROM bars GROUP BY ALL), c AS (SELECT product, pattern, count(*) AS n FROM e GROUP BY ALL) SELECT product, array_to_string(pattern, '|') AS pattern, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY n DESC, pattern) AS r FROM c) WHERE r = 1")
def agg_row_pattern(spark, sf_dir):
    """The set of event types that most days of a product have."""
    p = panel.commonest_pattern(bars(spark, sf_dir), ["product"], ["day"], "event_type")
    return p.select("product", F.array_join("pattern", "|").alias("pattern"), "n")


@query("metric_portfolio", f"""WITH {BARS_SQL}, d AS (SELECT product, day, sum(close - 50) / 100 AS r FROM bars GROUP BY ALL), p AS (SELECT day, avg(r) AS r FROM d GROUP BY day), c AS (SELECT *, sum(r) OVER (ORDER BY day) AS cum FROM p), q AS (SELECT *, greatest(0, max(cum) OVER (ORDER BY day)) AS peak FROM c)
SELECT CAST(count(*) AS BIGINT) AS n, {sql5('sum(r)', 'total')}, {sql5('coalesce(avg(r) / nullif(stddev_pop(r), 0), 0) * sqrt(252)', 'sharpe')}, {sql5('max(peak - cum)', 'max_drawdown')} FROM q""")
def metric_portfolio(spark, sf_dir):
    """Measures of the evenly weighted portfolio of all products."""
    d = bars(spark, sf_dir).groupBy("product", "day").agg((F.sum(F.col("close") - 50) / 100).alias("r"))
    m = stats.daily_metrics(stats.portfolio(d, "product", "day", "r").withColumn("all", F.lit(1)), "all", "day", "r")
    return m.select("n", *[r5(F.col(c)).alias(c) for c in ("total", "sharpe", "max_drawdown")])


_PROGRAMS = {"(add x y)": "x + y", "(mul x (sub y x))": "x * (y - x)", "(sqrt (abs (sub x y)))": "sqrt(abs(abs(x - y)))", "(div x (add y 1))": "CASE WHEN abs(y + 1) > 0.001 THEN x / (y + 1) ELSE 1 END"}


@query("program_scores", "WITH t AS (SELECT l_discount AS x, l_tax AS y, l_quantity / 50 AS t FROM lineitem) " + " UNION ALL ".join(f"SELECT '{k}' AS program, CAST({k.count('(') + sum(k.count(c) for c in ' ')} AS BIGINT) AS spaces, {sql5(f'(SELECT avg(abs(t - ({v}))) FROM t)', 'mae')}, {sql5(f'(SELECT sqrt(avg(pow(t - ({v}), 2))) FROM t)', 'rmse')}" for k, v in _PROGRAMS.items()))
def program_scores(spark, sf_dir):
    """Measures of given programs, all from one plan for each measure."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), (F.col("l_quantity") / 50).alias("t"))
    library = program.Library(K.SYMBOLIC, ("x", "y"), ("add", "sub", "mul", "div", "sqrt", "abs"))
    trees = [parse_sexpr(p) for p in _PROGRAMS]
    found = [program.raw_fitness(rows, trees, library, "t", m) for m in ("mean absolute error", "rmse")]
    out = spark.createDataFrame([(p, p.count("(") + p.count(" "), a, b) for p, a, b in zip(_PROGRAMS, *found, strict=True)], "program string, spaces bigint, mae double, rmse double")
    return out.select("program", "spaces", r5(F.col("mae")).alias("mae"), r5(F.col("rmse")).alias("rmse"))


@query("mining_round", None)
def mining_round(spark, sf_dir):
    """A round over two seeds: searched, validated, gated, and run a bar late (tests compare its parts with brute force)."""
    from meridia.functions.expr import Space
    from meridia.operators import mining

    b = bars(spark, sf_dir).withColumn("seg", F.unix_date("day")).withColumn("open", F.col("close") + 1).withColumn("lock", F.lit(0))
    costs = b.select("product").distinct().withColumn("fee", F.lit(0.1)).withColumn("slippage", F.lit(0.0))
    seeds = {"cross": "(sub (ts_mean :3 close) (ts_mean :8 close))", "turn": "(neg (ts_zscore :5 close))"}
    spans = ((datetime.date(2024, 1, 1), datetime.date(2024, 1, 20)), (datetime.date(2024, 1, 21), datetime.date(2024, 1, 30)))
    out = mining.run_mining_round(b, costs, seeds, Space(("close", "volume"), windows=(3, 5, 8)), SERIES, *spans, trading=mining.Trading(20, 10, 0.2, 0.8, 30, 1.0, 0.0), generations=2, population=4)
    rows = [(c.seed_id, c.formula, c.train_fitness, c.validation_fitness, c.accepted, out.shifted_fitness) for c in out.candidates]
    return spark.createDataFrame(rows, "seed_id string, formula string, train_fitness double, validation_fitness double, accepted boolean, shifted_fitness double")
