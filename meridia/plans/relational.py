"""Queries of scans, filters, joins, aggregates, windows, orders and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridia.functions.compile import Panel
from meridia.operators import asof, bars as B, stats, vector
from meridia.plans.base import BARS_SQL, MONTHS_SQL, bars, months, query, r5, sql5, table
from meridia.sources import raw

_I = lambda x, name: f"CAST({x} AS BIGINT) AS {name}"


# --- scans and projections ----------------------------------------------------------------------

@query("scan_projection", "SELECT l_suppkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 30")
def scan_projection(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_quantity >= 30").select("l_suppkey", "l_partkey", "l_quantity")


@query("scan_normalise", "SELECT event_id, upper(event_type) AS kind, CAST(value AS BIGINT) AS whole, CAST(ts AS DATE) AS day FROM events WHERE value IS NOT NULL AND value > 0")
def scan_normalise(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null and value > 0")
    return e.select("event_id", F.upper("event_type").alias("kind"), F.rint("value").cast("bigint").alias("whole"), F.to_date("ts").alias("day"))


@query(
    "scan_contracts",
    """WITH c AS (SELECT p_partkey, chr(CAST(65 + p_partkey % 26 AS INTEGER)) || 'B' || lpad(CAST((p_partkey * 37) % 10000 AS VARCHAR), 4, '0') AS contract FROM part)
    SELECT p_partkey, contract, regexp_extract(contract, '^([A-Z]{1,2})([0-9]{4})$', 1) AS product,
    CASE WHEN CAST(substr(contract, 5, 2) AS INTEGER) BETWEEN 1 AND 12 THEN 200000 + CAST(substr(contract, 3, 4) AS INTEGER) END AS delivery_ym,
    regexp_matches(contract, '(8888|9999|9998)$') AS pseudo FROM c""",
)
def scan_contracts(spark, sf_dir):
    name = F.concat(F.char((65 + F.col("p_partkey") % 26).cast("int")), F.lit("B"), F.lpad(((F.col("p_partkey") * 37) % 10000).cast("string"), 4, "0"))
    c = table(spark, sf_dir, "part").select("p_partkey", name.alias("contract"))
    return c.select("p_partkey", "contract", raw.product_of(F.col("contract")).alias("product"), raw.delivery_of(F.col("contract")).alias("delivery_ym"), raw.is_pseudo(F.col("contract")).alias("pseudo"))


@query(
    "scan_lifetime_pruning",
    """WITH c AS (SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders)
    SELECT o_orderkey, CAST(year(m) * 100 + month(m) AS BIGINT) AS delivery FROM c WHERE m - INTERVAL 14 MONTH <= DATE '1997-06-30' AND last_day(m) >= DATE '1997-01-01'""",
)
def scan_lifetime_pruning(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("bigint").alias("delivery"))
    return o.where(raw.alive(F.col("delivery").cast("int"), F.lit("1997-01-01").cast("date"), F.lit("1997-06-30").cast("date")))


@query("scan_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def scan_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


_DEDUPE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


@query("dedupe_first", f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_DEDUPE_ORDER}) AS r FROM lineitem) WHERE r = 1")
def dedupe_first(spark, sf_dir):
    order = [F.col(c.strip()) for c in _DEDUPE_ORDER.split(",")]
    return raw.first_of(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("dedupe_distinct_pairs", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def dedupe_distinct_pairs(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag").distinct()


# --- filters and derived columns -----------------------------------------------------------------

@query("filter_dates", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')")
def filter_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate")
    return o.where((day >= F.lit("1996-01-01").cast("timestamp_ntz")) & (day < F.lit("1997-01-01").cast("timestamp_ntz")) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P")).select("o_orderkey")


@query("filter_relative_minute", "SELECT event_id, CAST((hour(ts) * 60 + minute(ts) - 1230 + 1440) % 1440 AS BIGINT) AS rel, CAST(hour(ts) * 60 + minute(ts) AS BIGINT) AS wall FROM events")
def filter_relative_minute(spark, sf_dir):
    rel = B.relative_minute(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", rel.cast("bigint").alias("rel"), B.wall_minute(rel).cast("bigint").alias("wall"))


_TRADING_SQL = f"""WITH {BARS_SQL}, days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) - DATE '1996-01-01' AS k FROM orders),
cal AS (SELECT DISTINCT DATE '2024-01-01' + CAST(k % 60 AS INTEGER) AS day FROM days WHERE (k % 60) % 7 < 5 AND k >= 0)
SELECT event_id, CASE WHEN hour(bob) >= 21 THEN (SELECT min(day) FROM cal WHERE cal.day > b.day) WHEN hour(bob) < 3 THEN (SELECT min(day) FROM cal WHERE cal.day >= b.day)
  ELSE (SELECT min(day) FROM cal WHERE cal.day = b.day) END AS trading_date FROM bars b"""


@query("filter_trading_date", f"SELECT * FROM ({_TRADING_SQL}) WHERE trading_date IS NOT NULL")
def filter_trading_date(spark, sf_dir):
    k = F.datediff(F.to_date("o_orderdate"), F.lit("1996-01-01"))
    cal = table(spark, sf_dir, "orders").select(k.alias("k")).where("k >= 0 and (k % 60) % 7 < 5").select(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("k") % 60).cast("int")).alias("day")).distinct()
    b = bars(spark, sf_dir).withColumnRenamed("day", "seg_day")
    return B.trading_dates(b, cal, "bob").select("event_id", "trading_date")


@query("filter_segment_price", f"WITH {BARS_SQL} SELECT event_id, CASE WHEN day > DATE '2024-01-15' THEN 1 ELSE 0 END AS segment, {sql5('close * 1.25', 'adj')} FROM bars")
def filter_segment_price(spark, sf_dir):
    b = bars(spark, sf_dir)
    return b.select("event_id", (F.col("day") > F.lit("2024-01-15").cast("date")).cast("int").alias("segment"), r5(F.col("close") * 1.25).alias("adj"))


@query("filter_validity_mask", f"WITH {BARS_SQL} SELECT event_id, event_type <> 'error' AND isfinite(close) AS valid, {sql5("""CASE WHEN event_type <> 'error' AND isfinite(close) THEN close ELSE 0 END""", 'x')} FROM bars")
def filter_validity_mask(spark, sf_dir):
    return _validity_mask(bars(spark, sf_dir))


def _validity_mask(b):
    ok = (F.col("event_type") != "error") & ~F.isnan("close") & (F.abs("close") < float("inf"))
    return b.select("event_id", ok.alias("valid"), r5(F.when(ok, F.col("close")).otherwise(0.0)).alias("x"))


@query(
    "filter_symbols",
    """WITH s AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN lpad(CAST(600000 + s_suppkey AS VARCHAR), 6, '0') WHEN 1 THEN 'sz' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0')
      WHEN 2 THEN CAST(300000 + s_suppkey AS VARCHAR) || '.SZ' ELSE CAST(400000 + s_suppkey AS VARCHAR) END AS raw FROM supplier), d AS (SELECT *, regexp_extract(raw, '([0-9]{6})', 1) AS n FROM s)
    SELECT s_suppkey, raw, CASE WHEN n[1] IN ('6', '9') THEN 'SH' || n WHEN n[1] IN ('0', '2', '3') THEN 'SZ' || n END AS symbol FROM d""",
)
def filter_symbols(spark, sf_dir):
    from meridia.functions.scalars import canonical_symbol

    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, F.lpad((600000 + k).cast("string"), 6, "0")).when(k % 4 == 1, F.concat(F.lit("sz"), F.lpad(k.cast("string"), 6, "0"))).when(k % 4 == 2, F.concat((300000 + k).cast("string"), F.lit(".SZ"))).otherwise((400000 + k).cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", name.alias("raw")).withColumn("symbol", canonical_symbol(F.col("raw")))


# --- joins --------------------------------------------------------------------------------------

@query("join_semi_anti", """SELECT (SELECT CAST(count(*) AS BIGINT) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)) AS semi,
  (SELECT CAST(count(*) AS BIGINT) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS anti""")
def join_semi_anti(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    semi = c.join(o, "c_custkey", "left_semi").agg(F.count("*").alias("semi"))
    return semi.crossJoin(c.join(o, "c_custkey", "left_anti").agg(F.count("*").alias("anti")))


@query("join_lookup", """SELECT n_name, r_name, CAST(count(*) AS BIGINT) AS customers, round(sum(c_acctbal), 2) + 0.0 AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def join_lookup(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    met = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return met.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), (F.round(F.sum("c_acctbal"), 2) + 0.0).alias("balance"))


@query("join_grid_exact", f"""WITH {BARS_SQL}, grid AS (SELECT day, rel FROM (SELECT DISTINCT day FROM bars), range(0, 1440, 3) t(rel)), k AS (SELECT day, (hour(bob) * 60 + minute(bob) - 1230 + 1440) % 1440 AS rel FROM bars)
SELECT k.day, CAST(count(g.rel) AS BIGINT) AS matched, CAST(count(*) - count(g.rel) AS BIGINT) AS unmatched FROM k LEFT JOIN grid g ON g.day = k.day AND g.rel = k.rel GROUP BY k.day""")
def join_grid_exact(spark, sf_dir):
    b = bars(spark, sf_dir).select("day", B.relative_minute(F.col("bob")).alias("rel"))
    grid = b.select("day").distinct().select("day", F.explode(F.sequence(F.lit(0), F.lit(1439), F.lit(3))).alias("rel"), F.lit(1).alias("hit"))
    return b.join(grid, ["day", "rel"], "left").groupBy("day").agg(F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("unmatched"))


_PRICES_SQL = "prices AS (SELECT o_custkey % 50 AS k, CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS p FROM orders GROUP BY ALL), asks AS (SELECT c_custkey, c_custkey % 50 AS k, DATE '1995-01-01' + CAST(c_custkey % 2000 AS INTEGER) AS d FROM customer)"


@query("asof_backward", f"WITH {_PRICES_SQL} SELECT a.c_custkey, {sql5('p.p', 'price')} FROM asks a ASOF LEFT JOIN prices p ON a.k = p.k AND a.d >= p.d")
def asof_backward(spark, sf_dir):
    prices = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 50).alias("k"), F.to_date("o_orderdate").alias("d")).agg(F.max("o_totalprice").alias("p"))
    asks = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 50).alias("k"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 2000).cast("int")).alias("d"))
    return asof.backward(asks, prices, ["k"], "d", "d", ["p"]).select("c_custkey", r5(F.col("p")).alias("price"))


@query("asof_next_day", """WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), q AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)
SELECT date, (SELECT min(day) FROM days WHERE day >= date) AS ge, (SELECT min(day) FROM days WHERE day > date) AS gt FROM q""")
def asof_next_day(spark, sf_dir):
    """In the calendar of every order."""
    return _next_days(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def _next_days(orders, lines):
    days = orders.select(F.to_date("o_orderdate").alias("day")).distinct()
    return asof.next_days(lines.select(F.to_date("l_shipdate").alias("date")).distinct(), days)


_SPANS_SQL = "runs AS (SELECT s_suppkey AS k, DATE '1995-01-01' + CAST(s_suppkey * 13 % 900 AS INTEGER) AS a, DATE '1995-01-01' + CAST(s_suppkey * 13 % 900 + 400 AS INTEGER) AS b, s_name AS tpl FROM supplier)"


@query("join_interval", f"WITH {_SPANS_SQL} SELECT l_suppkey, CAST(count(*) AS BIGINT) AS n, CAST(count(tpl) AS BIGINT) AS hit, max(tpl) AS tpl FROM lineitem LEFT JOIN runs ON l_suppkey = k AND CAST(l_shipdate AS DATE) BETWEEN a AND b GROUP BY l_suppkey")
def join_interval(spark, sf_dir):
    start = (F.col("s_suppkey") * 13 % 900).cast("int")
    base = F.lit("1995-01-01").cast("date")
    runs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.date_add(base, start).alias("a"), F.date_add(base, start + 400).alias("b"), F.col("s_name").alias("tpl"))
    points = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("d"))
    return asof.interval(points, runs, ["k"], "d", "a", "b", ["tpl"]).groupBy(F.col("k").alias("l_suppkey")).agg(F.count("*").alias("n"), F.count("tpl").alias("hit"), F.max("tpl").alias("tpl"))


_EDGES_SQL = """edges AS (SELECT DISTINCT ON (leader, follower, asof_date, config_hash) * FROM (SELECT 'P' || (o_custkey % 9) AS leader, 'P' || (o_custkey % 7) AS follower, CAST(o_orderdate AS DATE) AS asof_date, o_orderpriority AS config_hash,
  o_totalprice / 1000 - 150 AS a_stat, (o_orderkey % 100) / 100.0 AS q_value, (o_orderkey % 10) / 10.0 AS stability, o_orderkey FROM orders) ORDER BY leader, follower, asof_date, config_hash, o_orderkey)"""
_LATEST_SQL = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY leader, follower ORDER BY asof_date DESC, config_hash DESC) AS r FROM edges
  WHERE asof_date < DATE '1998-01-01' AND asof_date >= DATE '1998-01-01' - 45) WHERE r = 1 AND q_value <= 0.5 AND stability >= 0.2)"""


def _edges(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    e = o.select(
        F.concat(F.lit("P"), F.col("o_custkey") % 9).alias("leader"), F.concat(F.lit("P"), F.col("o_custkey") % 7).alias("follower"), F.to_date("o_orderdate").alias("asof_date"), F.col("o_orderpriority").alias("config_hash"),
        (F.col("o_totalprice") / 1000 - 150).alias("a_stat"), ((F.col("o_orderkey") % 100) / 100.0).alias("q_value"), ((F.col("o_orderkey") % 10) / 10.0).alias("stability"), "o_orderkey",
    )
    return raw.first_of(e, ["leader", "follower", "asof_date", "config_hash"], [F.col("o_orderkey")])


@query("asof_latest_edges", f"WITH {_EDGES_SQL}, {_LATEST_SQL} SELECT leader, follower, asof_date, {sql5('a_stat', 'a_stat')} FROM latest")
def asof_latest_edges(spark, sf_dir):
    e = asof.latest_edges(_edges(spark, sf_dir), F.lit("1998-01-01").cast("date"), 45, 0.5, 0.2)
    return e.select("leader", "follower", "asof_date", r5(F.col("a_stat")).alias("a_stat"))


@query("asof_top_leaders", f"WITH {_EDGES_SQL}, {_LATEST_SQL} SELECT * FROM (SELECT follower, leader, CAST(row_number() OVER (PARTITION BY follower ORDER BY abs(a_stat) DESC, leader) AS BIGINT) AS rank FROM latest) WHERE rank <= 3")
def asof_top_leaders(spark, sf_dir):
    e = asof.latest_edges(_edges(spark, sf_dir), F.lit("1998-01-01").cast("date"), 45, 0.5, 0.2)
    return asof.top_leaders(e, 3).select("follower", "leader", F.col("rank").cast("bigint").alias("rank"))


@query("join_members", "WITH log AS (SELECT c_name AS stock_code, DATE '1995-01-01' + CAST(c_custkey % 700 AS INTEGER) AS in_date, CASE WHEN c_custkey % 3 > 0 THEN DATE '1995-01-01' + CAST(c_custkey % 700 + 300 AS INTEGER) END AS out_date FROM customer) SELECT DISTINCT stock_code FROM log WHERE in_date <= DATE '1996-06-01' AND (out_date IS NULL OR out_date > DATE '1996-06-01')")
def join_members(spark, sf_dir):
    base, k = F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 700).cast("int")
    log = table(spark, sf_dir, "customer").select(F.col("c_name").alias("stock_code"), F.date_add(base, k).alias("in_date"), F.when(F.col("c_custkey") % 3 > 0, F.date_add(base, k + 300)).alias("out_date"))
    return asof.members_on(log, F.lit("1996-06-01").cast("date"))


@query("join_full_outer_fill", """WITH a AS (SELECT CAST(o_orderdate AS DATE) AS d, max(o_totalprice) AS x FROM orders GROUP BY ALL), b AS (SELECT CAST(l_shipdate AS DATE) AS d, max(l_quantity) AS y FROM lineitem GROUP BY ALL),
j AS (SELECT coalesce(a.d, b.d) AS d, x, y FROM a FULL OUTER JOIN b ON a.d = b.d)
SELECT d, coalesce(last_value(x IGNORE NULLS) OVER w, 1) AS x, coalesce(last_value(y IGNORE NULLS) OVER w, 1) AS y FROM j WINDOW w AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def join_full_outer_fill(spark, sf_dir):
    return _outer_fill(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def _outer_fill(orders, lines):
    a = orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.max("o_totalprice").alias("x"))
    b = lines.groupBy(F.to_date("l_shipdate").alias("d")).agg(F.max("l_quantity").alias("y"))
    j = asof.full_outer([a, b], ["d"]).withColumn("__k", F.lit(0))
    return asof.fill_forward(j, ["__k"], ["d"], ["x", "y"], 1.0).drop("__k")


@query("join_reindex", """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), x AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS day, sum(l_quantity) AS q FROM lineitem GROUP BY ALL),
e AS (SELECT k, min(day) AS lo, max(day) AS hi FROM x GROUP BY k) SELECT e.k, CAST(count(*) AS BIGINT) AS days, CAST(count(x.q) AS BIGINT) AS known FROM e JOIN d ON d.day BETWEEN lo AND hi LEFT JOIN x ON x.k = e.k AND x.day = d.day GROUP BY e.k""")
def join_reindex(spark, sf_dir):
    """Of every line; a supplier of its own has days without any."""
    return _reindexed(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), F.col("l_suppkey"))


def _reindexed(orders, lines, k):
    days = orders.select(F.to_date("o_orderdate").alias("day")).distinct()
    x = lines.groupBy(k.alias("k"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_quantity").alias("q"))
    return asof.reindex(x, days, "k", "day").groupBy("k").agg(F.count("*").alias("days"), F.count("q").alias("known"))


# --- aggregates ---------------------------------------------------------------------------------

@query("agg_daily_stats", f"""WITH {BARS_SQL} SELECT product, day, CAST(sum(volume) AS DOUBLE) AS volume, arg_max(close, bob) AS last_close, arg_max(CASE WHEN hour(bob) BETWEEN 9 AND 14 THEN close END, CASE WHEN hour(bob) BETWEEN 9 AND 14 THEN bob END) AS day_close FROM bars GROUP BY ALL""")
def agg_daily_stats(spark, sf_dir):
    inside = F.hour("bob").between(9, 14)
    return bars(spark, sf_dir).groupBy("product", "day").agg(F.sum("volume").alias("volume"), F.max_by("close", "bob").alias("last_close"), F.max_by(F.when(inside, F.col("close")), F.when(inside, F.col("bob"))).alias("day_close"))


@query("agg_supported_days", f"WITH {BARS_SQL} SELECT day FROM bars WHERE hour(bob) BETWEEN 9 AND 15 GROUP BY day HAVING count(DISTINCT product) >= 40")
def agg_supported_days(spark, sf_dir):
    return bars(spark, sf_dir).where(F.hour("bob").between(9, 15)).groupBy("day").agg(F.countDistinct("product").alias("n")).where("n >= 40").select("day")


@query("agg_mode", f"WITH {BARS_SQL}, c AS (SELECT product, volume, count(*) AS n FROM bars GROUP BY ALL) SELECT product, volume FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY n DESC, volume) AS r FROM c) WHERE r = 1")
def agg_mode(spark, sf_dir):
    c = bars(spark, sf_dir).groupBy("product", "volume").count()
    return c.groupBy("product").agg(F.max_by("volume", F.struct("count", -F.col("volume"))).alias("volume"))


@query("agg_multiplier", "WITH t AS (SELECT l_suppkey, l_extendedprice / (l_quantity * 100) AS ratio, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_extendedprice, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem), m AS (SELECT l_suppkey, quantile_cont(ratio, 0.5) AS med FROM t WHERE r <= 100 GROUP BY l_suppkey) SELECT l_suppkey, " + sql5("med", "med") + ", (SELECT arg_min(v, abs(med - v)) FROM (VALUES (1), (5), (10), (15), (20), (50)) t(v) WHERE abs(med - v) / v <= 0.25) AS snapped FROM m")
def agg_multiplier(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_quantity"), "l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey")
    t = table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 100")
    med = t.groupBy("l_suppkey").agg(F.percentile(F.col("l_extendedprice") / (F.col("l_quantity") * 100), 0.5).alias("m"))
    near = F.array_sort(F.filter(F.transform(F.array(*map(F.lit, (1, 5, 10, 15, 20, 50))), lambda v: F.struct(F.abs(F.col("m") - v).alias("gap"), v.alias("v"))), lambda s: s["gap"] / s["v"] <= 0.25))
    return med.select("l_suppkey", r5(F.col("m")).alias("med"), F.try_element_at(near, F.lit(1))["v"].alias("snapped"))


@query("agg_tick", f"WITH {BARS_SQL}, d AS (SELECT product, round(abs(close - lag(close) OVER (PARTITION BY product ORDER BY bob)), 0) AS t FROM bars), c AS (SELECT product, t, count(*) AS n FROM d WHERE t > 0 GROUP BY ALL) SELECT product, t AS tick FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY n DESC, t) AS r FROM c) WHERE r = 1")
def agg_tick(spark, sf_dir):
    w = Window.partitionBy("product").orderBy("bob")
    c = bars(spark, sf_dir).select("product", F.round(F.abs(F.col("close") - F.lag("close").over(w)), 0).alias("t")).where("t > 0").groupBy("product", "t").count()
    return c.groupBy("product").agg(F.max_by("t", F.struct("count", -F.col("t"))).alias("tick"))


@query("agg_liquidity", f"""WITH {BARS_SQL}, d AS (SELECT product, day, sum(volume) AS v, sum(close * volume) / sum(volume) AS vwap FROM bars GROUP BY ALL)
SELECT product, day, {sql5('CASE WHEN count(v) OVER w >= 5 THEN quantile_cont(v * vwap, 0.5) OVER w END', 'adv')} FROM d WINDOW w AS (PARTITION BY product ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def agg_liquidity(spark, sf_dir):
    d = bars(spark, sf_dir).groupBy("product", "day").agg(F.sum("volume").alias("v"), (F.sum(F.col("close") * F.col("volume")) / F.sum("volume")).alias("vwap"))
    w = Window.partitionBy("product").orderBy("day").rowsBetween(-9, 0)
    return d.select("product", "day", r5(F.when(F.count("v").over(w) >= 5, F.percentile(F.col("v") * F.col("vwap"), 0.5).over(w))).alias("adv"))


@query("agg_volume_break", f"WITH {BARS_SQL} SELECT product, {sql5('''quantile_cont(volume, 0.5) FILTER (WHERE day >= DATE '2024-01-15') / quantile_cont(volume, 0.5) FILTER (WHERE day < DATE '2024-01-15')''', 'ratio')} FROM bars GROUP BY product")
def agg_volume_break(spark, sf_dir):
    cut = F.lit("2024-01-15").cast("date")
    after, before = (F.percentile(F.when(c, F.col("volume")), 0.5) for c in (F.col("day") >= cut, F.col("day") < cut))
    return bars(spark, sf_dir).groupBy("product").agg(r5(after / before).alias("ratio"))


@query("agg_latest_rank", f"WITH {BARS_SQL}, l AS (SELECT product, arg_max(close, bob) AS last, min(bob) AS first_bar, max(bob) AS last_bar FROM bars GROUP BY product) SELECT product, last, first_bar, last_bar FROM l ORDER BY last DESC, product LIMIT 10")
def agg_latest_rank(spark, sf_dir):
    g = bars(spark, sf_dir).groupBy("product").agg(F.max_by("close", "bob").alias("last"), F.min("bob").alias("first_bar"), F.max("bob").alias("last_bar"))
    return g.orderBy(F.desc("last"), "product").limit(10)


@query("agg_pivot", "SELECT l_returnflag, " + ", ".join(f"{sql5(f'''avg(l_quantity) FILTER (WHERE l_linestatus = '{s}')''', s)}" for s in ("O", "F")) + " FROM lineitem GROUP BY l_returnflag")
def agg_pivot(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).avg("l_quantity")
    return p.select("l_returnflag", r5(F.col("O")).alias("O"), r5(F.col("F")).alias("F"))


@query("agg_unpivot", "SELECT p_partkey, field, value FROM (UNPIVOT (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) ON size, price INTO NAME field VALUE value)")
def agg_unpivot(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("p_partkey", ["size", "price"], "field", "value")


@query("agg_quality_checks", """WITH a AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 25), b AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_totalprice > 150000)
SELECT (SELECT CAST(count(*) AS DOUBLE) FROM a) / (SELECT count(*) FROM b) AS row_ratio,
round((SELECT CAST(count(*) AS DOUBLE) FROM a JOIN b ON l_orderkey = o_orderkey) / (SELECT count(*) FROM (SELECT l_orderkey FROM a UNION SELECT o_orderkey FROM b)), 9) AS jaccard,
(SELECT CAST(count(*) AS BIGINT) FROM orders WHERE isinf(o_totalprice)) AS infinite""")
def agg_quality_checks(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("k")).distinct().withColumn("a", F.lit(1))
    o = table(spark, sf_dir, "orders")
    b = o.where("o_totalprice > 150000").select(F.col("o_orderkey").alias("k")).distinct().withColumn("b", F.lit(1))
    j = a.join(b, "k", "full_outer").agg(F.count("a").alias("na"), F.count("b").alias("nb"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count("*").alias("either"))
    return j.crossJoin(o.agg(F.count_if(F.abs("o_totalprice") == float("inf")).alias("infinite"))).select((F.col("na") / F.col("nb")).alias("row_ratio"), F.round(F.col("both") / F.col("either"), 9).alias("jaccard"), "infinite")


@query("agg_entropy", "WITH c AS (SELECT count(*) * 1.0 / (SELECT count(*) FROM part) AS p FROM part GROUP BY p_brand) SELECT " + sql5("sum(-p * ln(p))", "entropy") + " FROM c")
def agg_entropy(spark, sf_dir):
    return stats.entropy(table(spark, sf_dir, "part"), "p_brand").select(r5(F.col("entropy")).alias("entropy"))


@query("agg_weighted_quantile", "WITH w AS (SELECT l_returnflag, l_extendedprice AS x, sum(l_quantity) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY x) AS up, sum(w) OVER (PARTITION BY l_returnflag) AS t FROM w) SELECT l_returnflag, min(x) AS q FROM c WHERE up >= 0.3 * t GROUP BY l_returnflag")
def agg_weighted_quantile(spark, sf_dir):
    w = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_extendedprice").alias("x")).agg(F.sum("l_quantity").alias("w"))
    p = Window.partitionBy("l_returnflag")
    c = w.withColumn("up", F.sum("w").over(p.orderBy("x"))).withColumn("t", F.sum("w").over(p))
    return c.where("up >= 0.3 * t").groupBy("l_returnflag").agg(F.min("x").alias("q"))


@query("agg_pareto", "WITH p AS (SELECT DISTINCT p_size, round(p_retailprice, 2) AS price FROM part) SELECT CAST(p_size AS BIGINT) AS p_size, price FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE (b.p_size <= a.p_size AND b.price > a.price) OR (b.p_size < a.p_size AND b.price >= a.price))")
def agg_pareto(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").cast("bigint").alias("p_size"), F.round("p_retailprice", 2).alias("price"))
    return stats.pareto_front(p, "p_size", "price")


_FIT_SQL = "f AS (SELECT o_totalprice / 1e5 AS y, (o_orderkey % 100) / 50.0 AS p, 1 + o_orderkey % 3 AS w FROM orders), s AS (SELECT sum(w) AS w, sum(w * abs(y - p)) AS ae, sum(w * pow(y - p, 2)) AS se, sum(w * y) AS y1, sum(w * y * y) AS y2, sum(w * p) AS p1, sum(w * p * p) AS p2, sum(w * y * p) AS yp FROM f), m AS (SELECT se / w AS mse, ae / w AS mae, y2 / w - pow(y1 / w, 2) AS vy, p2 / w - pow(p1 / w, 2) AS vp, yp / w - y1 * p1 / (w * w) AS c FROM s)"


@query("metric_regression", f"WITH {_FIT_SQL} SELECT {', '.join(sql5(x, n) for n, x in {'mae': 'mae', 'mse': 'mse', 'rmse': 'sqrt(mse)', 'neg_mse': '-mse', 'neg_rmse': '-sqrt(mse)', 'neg_nmse': '-mse / vy', 'neg_nrmse': '-sqrt(mse / vy)', 'neglog_mse': '-ln(1 + mse)', 'inv_mse': '1 / (1 + mse)', 'inv_nmse': '1 / (1 + mse / vy)', 'inv_nrmse': '1 / (1 + sqrt(mse / vy))', 'pearson': 'c / sqrt(vy * vp)'}.items())} FROM m")
def metric_regression(spark, sf_dir):
    f = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1e5).alias("y"), ((F.col("o_orderkey") % 100) / 50.0).alias("p"), (1 + F.col("o_orderkey") % 3).alias("w"))
    s = stats.regression_scores(f, "y", "p", "w")
    return s.select(*[r5(F.col(c)).alias(c) for c in s.columns])


@query("metric_log_loss", "WITH x AS (SELECT quality AS y, least(1 - 1e-15, greatest(1e-15, (doc_id % 97) / 97.0)) AS p FROM labels) SELECT " + sql5("avg(-(y * ln(p) + (1 - y) * ln(1 - p)))", "log_loss") + " FROM x")
def metric_log_loss(spark, sf_dir):
    x = table(spark, sf_dir, "labels").select(F.col("quality").alias("y"), ((F.col("doc_id") % 97) / 97.0).alias("p"))
    return stats.log_loss(x, "y", "p").select(r5(F.col("log_loss")).alias("log_loss"))


_IC_SQL = f"{MONTHS_SQL}, d AS (SELECT date, CAST(close AS DOUBLE) AS x, lead(close) OVER (PARTITION BY instrument ORDER BY date) / close - 1 AS y FROM months), k AS (SELECT date, x, y, rank() OVER (PARTITION BY date ORDER BY x) + (count(*) OVER (PARTITION BY date, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY date ORDER BY y) + (count(*) OVER (PARTITION BY date, y) - 1) / 2.0 AS ry FROM d WHERE y IS NOT NULL)"


def _with_target(spark, sf_dir):
    m = months(spark, sf_dir)
    return m.withColumn("target", F.lead("close").over(Window.partitionBy("instrument").orderBy("date")) / F.col("close") - 1)


@query("metric_ic", f"WITH {_IC_SQL} SELECT date, {sql5('covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)', 'ic')}, {sql5('covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0)', 'rank_ic')} FROM k GROUP BY date")
def metric_ic(spark, sf_dir):
    m = _with_target(spark, sf_dir)
    a, b = stats.daily_correlation(m, "close", "target"), stats.daily_correlation(m, "close", "target", ranked=True).withColumnRenamed("ic", "rank_ic")
    return a.join(b, "date", "full_outer").select("date", r5(F.col("ic")).alias("ic"), r5(F.col("rank_ic")).alias("rank_ic"))


@query("metric_ic_summary", f"WITH {_IC_SQL}, i AS (SELECT date, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS ic FROM k GROUP BY date) SELECT {sql5('avg(ic)', 'ic')}, {sql5('avg(ic) / stddev_samp(ic)', 'icir')}, CAST(count(ic) AS BIGINT) AS days FROM i")
def metric_ic_summary(spark, sf_dir):
    return stats.ic_summary(stats.daily_correlation(_with_target(spark, sf_dir), "close", "target")).select(r5(F.col("ic")).alias("ic"), r5(F.col("icir")).alias("icir"), "days")


@query("metric_normalise_ensemble", f"WITH {MONTHS_SQL}, n AS (SELECT date, instrument, coalesce((close - avg(close) OVER w) / nullif(stddev_pop(close) OVER w, 0), 0) AS a, coalesce((volume - avg(volume) OVER w) / nullif(stddev_pop(volume) OVER w, 0), 0) AS b FROM months WINDOW w AS (PARTITION BY date)) SELECT date, instrument, {sql5('0.7 * a - 0.3 * b', 'alpha')} FROM n")
def metric_normalise_ensemble(spark, sf_dir):
    m = months(spark, sf_dir)
    return m.select("date", "instrument", r5(0.7 * stats.normalise_by_day(m, "close") - 0.3 * stats.normalise_by_day(m, "volume")).alias("alpha"))


_RATIO = "coalesce(CASE WHEN abs({b}) > 1e-12 THEN ({a}) / ({b}) END, 0)"
_METRICS_SQL = f"""WITH {BARS_SQL}, d AS (SELECT product, day, sum(close - 50) / 100 AS r FROM bars GROUP BY ALL), p AS (SELECT *, sum(r) OVER (PARTITION BY product ORDER BY day) AS cum FROM d),
q AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY product ORDER BY day)) AS peak FROM p),
s AS (SELECT product, count(*) AS n, sum(r) AS total, avg(r) AS m, stddev_pop(r) AS sd, stddev_pop(least(r, 0)) AS down, max(peak - cum) AS mdd, count(*) FILTER (WHERE r > 0) AS up, count(*) FILTER (WHERE r <> 0) AS act,
 sum(greatest(r, 0)) AS gain, sum(least(r, 0)) AS loss, avg(r * r) AS e2 FROM q GROUP BY product)
SELECT product, CAST(n AS BIGINT) AS n, {sql5('total', 'total')}, {sql5(_RATIO.format(a='m', b='sd') + ' * sqrt(252)', 'sharpe')}, {sql5(_RATIO.format(a='m', b='down') + ' * sqrt(252)', 'sortino')}, {sql5('mdd', 'max_drawdown')},
 {sql5(_RATIO.format(a='m * 252', b='mdd'), 'calmar')}, {sql5(_RATIO.format(a='up * 1.0', b='act'), 'hit_rate')}, {sql5('CASE WHEN loss < 0 THEN -gain / loss WHEN gain > 0 THEN 999 ELSE 0 END', 'profit_factor')} FROM s"""


@query("metric_suite", _METRICS_SQL)
def metric_suite(spark, sf_dir):
    d = stats.ordered_sums(bars(spark, sf_dir).withColumn("x", F.col("close") - 50), ["product", "day"], ["bob", "event_id"], "x").select("product", "day", (F.col("x") / 100).alias("r"))
    m = stats.daily_metrics(d, "product", "day", "r")
    return m.select("product", "n", *[r5(F.col(c)).alias(c) for c in ("total", "sharpe", "sortino", "max_drawdown", "calmar", "hit_rate", "profit_factor")])


_PSR_SQL = f"""WITH {BARS_SQL}, d AS (SELECT product, day, sum(close - 50) / 100 AS r FROM bars GROUP BY ALL),
s AS (SELECT product, count(*) AS n, avg(r) AS m, stddev_pop(r) AS sd, avg(r * r) AS e2, avg(r * r * r) AS e3, avg(r * r * r * r) AS e4 FROM d GROUP BY product),
c AS (SELECT *, e2 - m * m AS m2, e3 - 3 * m * e2 + 2 * m * m * m AS m3, e4 - 4 * m * e3 + 6 * m * m * e2 - 3 * m * m * m * m AS m4 FROM s),
x AS (SELECT product, n, {_RATIO.format(a='m', b='sd')} AS sr, {_RATIO.format(a='m3', b='pow(m2, 1.5)')} AS skew, {_RATIO.format(a='m4', b='m2 * m2')} - CASE WHEN m2 > 1e-12 THEN 3 ELSE 0 END AS ex FROM c),
z AS (SELECT product, n, sr / sqrt(greatest(1 - skew * sr + (ex + 2) / 4 * sr * sr, 1e-12) / nullif(n - 1, 0)) AS z FROM x),
t AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM z),
e AS (SELECT *, 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2) AS erf FROM t)
SELECT product, {sql5('CASE WHEN z >= 0 THEN 0.5 * (1 + erf) ELSE 0.5 * (1 - erf) END', 'psr')} FROM e"""


@query("metric_psr", _PSR_SQL)
def metric_psr(spark, sf_dir):
    d = bars(spark, sf_dir).groupBy("product", "day").agg((F.sum(F.col("close") - 50) / 100).alias("r"))
    m = stats.daily_metrics(d, "product", "day", "r")
    return m.select("product", r5(stats.probabilistic_sharpe(F.col("sharpe") / (252**0.5), F.col("n"), F.col("skew"), F.col("excess_kurtosis"))).alias("psr"))


# --- windows ------------------------------------------------------------------------------------

@query("window_majority", f"WITH {BARS_SQL}, d AS (SELECT product, day, count(*) > 6 AS f FROM bars GROUP BY ALL) SELECT product, day, sum(CAST(f AS INTEGER)) OVER w * 2 > count(*) OVER w AS major FROM d WINDOW w AS (PARTITION BY product ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def window_majority(spark, sf_dir):
    d = bars(spark, sf_dir).groupBy("product", "day").agg((F.count("*") > 6).alias("f"))
    return d.select("product", "day", B.running_majority(d, ["product"], "day", "f", 7).alias("major"))


@query("window_blocks", f"WITH {BARS_SQL}, g AS (SELECT *, CASE WHEN date_diff('second', lag(bob) OVER (PARTITION BY product ORDER BY bob), bob) <= 7200 THEN 0 ELSE 1 END AS brk FROM bars), b AS (SELECT *, sum(brk) OVER (PARTITION BY product ORDER BY bob) AS blk FROM g) SELECT product, CAST(blk AS BIGINT) AS blk, CAST(count(*) AS BIGINT) AS n, min(bob) AS lo, max(bob) AS hi FROM b GROUP BY ALL")
def window_blocks(spark, sf_dir):
    w = Window.partitionBy("product").orderBy("bob")
    b = bars(spark, sf_dir)
    near = F.unix_timestamp(F.col("bob").cast("timestamp")) - F.unix_timestamp(F.lag("bob").over(w).cast("timestamp")) <= 7200
    g = b.withColumn("gap", F.coalesce(~near, F.lit(True)))
    return B.islands(g, ["product"], "bob", F.col("gap"), "blk").groupBy("product", "blk").agg(F.count("*").alias("n"), F.min("bob").alias("lo"), F.max("bob").alias("hi"))


@query("window_first_bar", f"WITH {BARS_SQL} SELECT event_id, bob = min(bob) OVER (PARTITION BY product, day) AS is_first FROM bars")
def window_first_bar(spark, sf_dir):
    return bars(spark, sf_dir).select("event_id", (F.col("bob") == F.min("bob").over(Window.partitionBy("product", "day"))).alias("is_first"))


@query("window_staleness", f"WITH {BARS_SQL}, n AS (SELECT event_id, product, bob, row_number() OVER (PARTITION BY product ORDER BY bob) AS i, event_type = 'purchase' AS t FROM bars) SELECT event_id, CAST(i - max(CASE WHEN t THEN i END) OVER (PARTITION BY product ORDER BY bob ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stale FROM n")
def window_staleness(spark, sf_dir):
    w = Window.partitionBy("product").orderBy("bob")
    n = bars(spark, sf_dir).withColumn("i", F.row_number().over(w))
    last = F.max(F.when(F.col("event_type") == "purchase", F.col("i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return n.select("event_id", (F.col("i") - last).cast("bigint").alias("stale"))


@query("window_limit_mask", f"""WITH {BARS_SQL}, b AS (SELECT event_id, product, day, bob, round(close, -2) AS c FROM bars), x AS (SELECT *, c >= max(c) OVER w OR c <= min(c) OVER w AS ext, coalesce(c <> lag(c) OVER (PARTITION BY product, day ORDER BY bob), true) AS moved FROM b WINDOW w AS (PARTITION BY product, day ORDER BY bob ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT *, sum(CASE WHEN moved OR NOT ext THEN 1 ELSE 0 END) OVER (PARTITION BY product, day ORDER BY bob) AS run FROM x) SELECT event_id, ext AND count(*) OVER (PARTITION BY product, day, run) >= 3 AS m_limit FROM r""")
def window_limit_mask(spark, sf_dir):
    b = bars(spark, sf_dir).withColumn("c", F.round("close", -2))
    return B.limit_mask(b, day="day", close="c", least=3).select("event_id", "m_limit")


@query("window_sliding_lists", f"WITH {MONTHS_SQL} SELECT date, instrument, round(list_sum(xs), 4) AS total FROM (SELECT date, instrument, list(close) OVER (PARTITION BY instrument ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS xs FROM months) WHERE len(xs) = 5")
def window_sliding_lists(spark, sf_dir):
    w = Window.partitionBy("instrument").orderBy("date").rowsBetween(-4, 0)
    x = months(spark, sf_dir).select("date", "instrument", F.collect_list("close").over(w).alias("xs")).where(F.size("xs") == 5)
    return x.select("date", "instrument", F.round(F.aggregate("xs", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("window_rolling_quantile", f"WITH {BARS_SQL} SELECT event_id, {sql5('CASE WHEN count(close) OVER w >= 10 THEN quantile_cont(close, 0.9) OVER w END', 'hi')}, {sql5('CASE WHEN count(close) OVER w >= 10 THEN quantile_cont(close, 0.1) OVER w END', 'lo')} FROM bars WINDOW w AS (PARTITION BY product ORDER BY bob ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)")
def window_rolling_quantile(spark, sf_dir):
    from meridia.operators.backtest import bands

    lo, hi = bands("close", Panel(("product",), ("bob",)), 20, 10, 0.1, 0.9)
    return bars(spark, sf_dir).select("event_id", r5(hi).alias("hi"), r5(lo).alias("lo"))


@query("window_monthly_spans", "WITH m AS (SELECT unnest(range(DATE '1996-01-01', DATE '1997-01-01', INTERVAL 1 MONTH)) AS stop) SELECT CAST(stop AS DATE) AS stop, CAST(count(*) AS BIGINT) AS n FROM m JOIN orders ON o_orderdate >= stop - INTERVAL 3 MONTH AND o_orderdate < stop GROUP BY stop")
def window_monthly_spans(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("m"))
    each = o.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.add_months("m", k))).alias("stop"))
    return each.where("stop >= date '1996-01-01' and stop < date '1997-01-01'").groupBy("stop").agg(F.count("*").alias("n"))


@query("window_pct_change", f"WITH {MONTHS_SQL} SELECT date, instrument, {sql5('coalesce(close / lag(close) OVER (PARTITION BY instrument ORDER BY date) - 1, 0)', 'ret')} FROM months")
def window_pct_change(spark, sf_dir):
    w = Window.partitionBy("instrument").orderBy("date")
    return months(spark, sf_dir).select("date", "instrument", r5(F.coalesce(F.col("close") / F.lag("close").over(w) - 1, F.lit(0.0))).alias("ret"))


# --- orders, limits, sets ---------------------------------------------------------------------------

@query("topk_per_group", "SELECT o_custkey, o_orderkey, CAST(r AS BIGINT) AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def topk_per_group(spark, sf_dir):
    t = vector.top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2)
    return t.select("o_custkey", "o_orderkey", F.col("rank").cast("bigint").alias("rank"))


@query("topk_total", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def topk_total(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "o_totalprice")


@query("topk_best_candidate", "SELECT l_suppkey, arg_max(l_partkey, (v, n, -l_partkey)) AS best FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY l_suppkey")
def topk_best_candidate(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("v"), F.count("*").alias("n"))
    return c.groupBy("l_suppkey").agg(F.max_by("l_partkey", F.struct("v", "n", -F.col("l_partkey"))).alias("best"))


@query("set_union_dedupe", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))).dropDuplicates()


_KS = "a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')"


def _urgent_and_finished(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return (o.where(c).select(F.col("o_custkey").alias("k")).distinct() for c in ("o_orderpriority = '1-URGENT'", "o_orderstatus = 'F'"))


@query("set_symmetric_difference", f"WITH {_KS} (SELECT k FROM a EXCEPT SELECT k FROM b) UNION (SELECT k FROM b EXCEPT SELECT k FROM a)")
def set_symmetric_difference(spark, sf_dir):
    a, b = _urgent_and_finished(spark, sf_dir)
    return asof.symmetric_difference(a, b)


@query("set_intersect", f"WITH {_KS} SELECT k FROM a INTERSECT SELECT k FROM b")
def set_intersect(spark, sf_dir):
    a, b = _urgent_and_finished(spark, sf_dir)
    return a.intersect(b)
