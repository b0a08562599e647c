"""Queries of the formula dialects: each compiles its formulas from text."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import kernels as K
from meridia.functions.compile import Dialect, Panel, compile_formulas
from meridia.functions.expr import Node, lift_parameters, parse_infix, parse_sexpr
from meridia.plans.base import BARS, BARS_SQL, MONTHS, MONTHS_SQL, bars, months, over_bars, over_months, query, r5, sql5


def _mining(name: str, formulas: dict[str, str], select: str, prior: str = "") -> None:
    """A query of S-expressions over bars; ``select`` are the SQL columns over bars."""

    def run(spark, sf_dir):
        out = compile_formulas(bars(spark, sf_dir), {k: parse_sexpr(v) for k, v in formulas.items()}, K.MINING, BARS)
        return out.select("event_id", *[r5(F.col(k)).alias(k) for k in formulas])

    query(name, f"WITH {BARS_SQL}{prior} SELECT event_id, {select} FROM {'staged' if prior else 'bars'}")(run)


def _c(x: str) -> str:
    return f"greatest(-1e6, least(1e6, coalesce({x}, 0)))"


def _full(f: str, x: str, n: int) -> str:
    w = over_bars(n)
    return f"CASE WHEN count({x}) {w} = {n} THEN {f} {w} END"


def _roll(op: str, n: int, x: str = "close", f: str = "") -> dict[str, str]:
    return {f"{op}_{n}": f"({op} :{n} {x})"}


_mining(
    "g_pointwise",
    {
        "v_neg": "(neg close)", "v_abs": "(abs (sub close 50))", "v_log1p": "(log1p close)", "v_sign": "(sign (sub close 50))",
        "v_add": "(add close volume)", "v_mul": "(mul close volume)", "v_div": "(div close (sub volume 5))", "v_min2": "(min2 close volume)", "v_max2": "(max2 close volume)",
        "v_gt": "(gt close volume)", "v_lt": "(lt close volume)", "v_if": "(if_then_else (gt close 50) close volume)", "v_const": "(add close (mul 2 0.5))",
    },
    ", ".join(
        sql5(_c(x), n)
        for n, x in {
            "v_neg": "-close", "v_abs": "abs(close - 50)", "v_log1p": "ln(1 + abs(close))", "v_sign": "CASE WHEN close > 50 THEN 1.0 WHEN close < 50 THEN -1.0 ELSE 0.0 END",
            "v_add": "close + volume", "v_mul": "close * volume", "v_div": "CASE WHEN abs(volume - 5) < 1e-12 THEN 0 ELSE close / (volume - 5) END", "v_min2": "least(close, volume)",
            "v_max2": "greatest(close, volume)", "v_gt": "CASE WHEN close > volume THEN 1.0 ELSE 0.0 END", "v_lt": "CASE WHEN close < volume THEN 1.0 ELSE 0.0 END",
            "v_if": "CASE WHEN close > 50 THEN close ELSE volume END", "v_const": "close + 1",
        }.items()
    ),
)

_mining(
    "g_rolling_sums",
    {"s5": "(ts_sum :5 close)", "m5": "(ts_mean :5 close)", "sd5": "(ts_std :5 close)", "lo5": "(ts_min :5 close)", "hi5": "(ts_max :5 close)"},
    ", ".join(sql5(_c(_full(f, "close", 5)), n) for n, f in {"s5": "sum(close)", "m5": "avg(close)", "sd5": "stddev_pop(close)", "lo5": "min(close)", "hi5": "max(close)"}.items()),
)
_mining(
    "g_lags",
    {"r1": "(ref :1 close)", "r5": "(ref :5 close)", "d3": "(ts_delta :3 close)"},
    ", ".join(
        [sql5(_c(f"lag(close, {k}) OVER (PARTITION BY product, day ORDER BY bob)"), f"r{k}") for k in (1, 5)] + [sql5(_c("close - lag(close, 3) OVER (PARTITION BY product, day ORDER BY bob)"), "d3")]
    ),
)
_mining(
    "g_rank_decay",
    {"k5": "(ts_rank :5 close)", "w5": "(decay_linear :5 close)", "z5": "(ts_zscore :5 close)"},
    f"""{sql5(_c(f"CASE WHEN count(close) {over_bars(5)} = 5 THEN len(list_filter(list(close) {over_bars(5)}, lambda v: v <= close)) / 5.0 END"), "k5")},
    {sql5(_c(f"CASE WHEN count(close) {over_bars(5)} = 5 THEN list_sum(list_transform(list(close) {over_bars(5)}, lambda v, i: v * i)) / 15.0 END"), "w5")},
    {sql5(_c(f"CASE WHEN count(close) {over_bars(5)} = 5 AND stddev_pop(close) {over_bars(5)} >= 1e-12 THEN (close - avg(close) {over_bars(5)}) / stddev_pop(close) {over_bars(5)} END"), "z5")}""",
)
_mining(
    "g_corr",
    {"c8": "(ts_corr :8 close volume)"},
    sql5(
        _c(
            f"""CASE WHEN count(close) {over_bars(8)} = 8 AND var_pop(close) {over_bars(8)} > 1e-12 AND var_pop(volume) {over_bars(8)} > 1e-12
            THEN covar_pop(close, volume) {over_bars(8)} / sqrt(var_pop(close) {over_bars(8)} * var_pop(volume) {over_bars(8)}) END"""
        ),
        "c8",
    ),
)
# exponential averages as a recursive query over each product and day
_EMA_SQL = f"""WITH RECURSIVE {BARS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY product, day ORDER BY bob) AS k FROM bars),
r AS (SELECT event_id, product, day, k, close AS y FROM n WHERE k = 1
  UNION ALL SELECT n.event_id, n.product, n.day, n.k, (1 - pow(0.5, 1.0 / 5)) * n.close + pow(0.5, 1.0 / 5) * r.y FROM r JOIN n ON n.product = r.product AND n.day = r.day AND n.k = r.k + 1)
SELECT event_id, {sql5("y", "e5")} FROM r"""


@query("g_ema", _EMA_SQL)
def g_ema(spark, sf_dir):
    out = compile_formulas(bars(spark, sf_dir), {"e5": parse_sexpr("(ema :5 close)")}, K.MINING, BARS)
    return out.select("event_id", r5(F.col("e5")).alias("e5"))


# the seed formulas, on windows that fit a day of these bars
SEEDS = {
    "ma_cross": "(sign (sub (ts_mean :3 close) (ts_mean :8 close)))",
    "breakout": "(sub (gt close (ts_max :5 (ref :1 close))) (lt close (ts_min :5 (ref :1 close))))",
    "rsi_style": "(sub (div (ts_mean :5 (max2 (ts_delta :1 close) 0)) (ts_mean :5 (abs (ts_delta :1 close)))) 0.5)",
    "vol_momentum": "(div (ts_delta :5 close) (mul (ts_std :5 close) 2.236068))",
}


@query(
    "g_seed_ma_cross",
    f"""WITH {BARS_SQL}, s AS (SELECT day, product, sign({_c(_full("avg(close)", "close", 3))} - {_c(_full("avg(close)", "close", 8))}) AS v FROM bars)
    SELECT day, CAST(count(*) AS BIGINT) AS n, CAST(sum(v) AS DOUBLE) AS net, CAST(count(DISTINCT product) AS BIGINT) AS products FROM s GROUP BY day""",
)
def g_seed_ma_cross(spark, sf_dir):
    out = compile_formulas(bars(spark, sf_dir), {"v": parse_sexpr(SEEDS["ma_cross"])}, K.MINING, BARS)
    return out.groupBy("day").agg(F.count("*").alias("n"), F.sum("v").alias("net"), F.countDistinct("product").alias("products"))


_D = "OVER (PARTITION BY product, day ORDER BY bob)"
_SEED_PRIOR = f""", a AS (SELECT *, {_c(f"lag(close) {_D}")} AS p1, {_c(f"close - lag(close) {_D}")} AS d1, {_c(f"close - lag(close, 5) {_D}")} AS d5 FROM bars),
staged AS (SELECT *, greatest(d1, 0) AS up, abs(d1) AS ab FROM a)"""
_mining(
    "g_seeds",
    {k: v for k, v in SEEDS.items() if k != "ma_cross"},
    ", ".join(
        [
            sql5(_c(f"(CASE WHEN close > {_c(_full('max(p1)', 'p1', 5))} THEN 1 ELSE 0 END) - (CASE WHEN close < {_c(_full('min(p1)', 'p1', 5))} THEN 1 ELSE 0 END)"), "breakout"),
            sql5(_c(f"(CASE WHEN {_c(_full('avg(ab)', 'ab', 5))} < 1e-12 THEN 0 ELSE {_c(_full('avg(up)', 'up', 5))} / {_c(_full('avg(ab)', 'ab', 5))} END) - 0.5"), "rsi_style"),
            sql5(_c(f"CASE WHEN {_c(_full('stddev_pop(close)', 'close', 5))} * 2.236068 < 1e-12 THEN 0 ELSE d5 / ({_c(_full('stddev_pop(close)', 'close', 5))} * 2.236068) END"), "vol_momentum"),
        ]
    ),
    _SEED_PRIOR,
)


def _over(name: str, formulas: dict[str, str], dialect: Dialect, series: dict[str, int], select: str, prior: str = "", panel: Panel = MONTHS) -> None:
    def run(spark, sf_dir):
        trees: dict[str, Node] = {k: lift_parameters(parse_infix(v), series) for k, v in formulas.items()}
        out = compile_formulas(months(spark, sf_dir), trees, dialect, panel)
        return out.select("date", "instrument", *[r5(F.col(k)).alias(k) for k in formulas])

    query(name, f"WITH {MONTHS_SQL}{prior} SELECT date, instrument, {select} FROM {'staged' if prior else 'months'}")(run)


def _daily(name, formulas, select, prior=""):
    _over(name, formulas, K.DAILY, K.DAILY_SERIES, select, prior)


def _infix(name, formulas, select, prior=""):
    _over(name, formulas, K.INFIX, K.INFIX_SERIES, select, prior)


def _mfull(f: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over_months(n)} = {n} THEN {f} END"


_L10 = f"list(close) {over_months(10)}"
_M10 = f"avg(close) {over_months(10)}"

_daily(
    "ag_pointwise",
    {"a": "Abs($open-$close)" .replace("$open-$close", "Sub($open,$close)"), "s": "Sign(Sub($open,$close))", "l": "Log($close)", "ad": "Add($open,$close)", "mu": "Mul($open,$close)", "di": "Div($open,$close)", "po": "Pow(Div($open,$close),2)", "g": "Greater($open,$volume)", "le": "Less($open,$volume)"},
    ", ".join(sql5(x, n) for n, x in {"a": "abs(open - close)", "s": "CAST(sign(open - close) AS DOUBLE)", "l": "CASE WHEN close > 0 THEN ln(close) END", "ad": "open + close", "mu": "open * close", "di": "open / close", "po": "pow(open / close, 2)", "g": "greatest(open, volume)", "le": "least(open, volume)"}.items()),
)
_daily(
    "ag_refs",
    {"r": "Ref($close,3d)", "fw": "Sub(Div(Ref($close,-2),$close),1)", "de": "Delta($close,4d)"},
    ", ".join([sql5("lag(close, 3) OVER (PARTITION BY instrument ORDER BY date)", "r"), sql5("lead(close, 2) OVER (PARTITION BY instrument ORDER BY date) / close - 1", "fw"), sql5("close - lag(close, 4) OVER (PARTITION BY instrument ORDER BY date)", "de")]),
)
_daily(
    "ag_rolling",
    {"m": "Mean($close,10d)", "su": "Sum($close,10)", "sd": "Std($close,10)", "va": "Var($close,10)", "mx": "Max($close,10)", "mn": "Min($close,10)"},
    ", ".join(sql5(_mfull(f"{f} {over_months(10)}", "close", 10), n) for n, f in {"m": "avg(close)", "su": "sum(close)", "sd": "stddev_samp(close)", "va": "var_samp(close)", "mx": "max(close)", "mn": "min(close)"}.items()),
)
_daily(
    "ag_moments",
    {"sk": "Skew($close,10)", "ku": "Kurt($close,10)"},
    f"""{sql5("CASE WHEN n = 10 THEN (list_sum(list_transform(xs, lambda v: pow(v - m, 3))) / 10) / pow(list_sum(list_transform(xs, lambda v: pow(v - m, 2))) / 10, 1.5) END", "sk")},
    {sql5("CASE WHEN n = 10 THEN (list_sum(list_transform(xs, lambda v: pow(v - m, 4))) / 10) / pow(var, 2) - 3 END", "ku")}""",
    f", staged AS (SELECT date, instrument, {_L10} AS xs, {_M10} AS m, count(close) {over_months(10)} AS n, var_samp(close) {over_months(10)} AS var FROM months)",
)
_daily(
    "ag_order_statistics",
    {"md": "Med($close,10)", "ma": "Mad($close,10)", "rk": "Rank($close,10)"},
    f"""{sql5("CASE WHEN n = 10 THEN list_sort(xs)[5] END", "md")}, {sql5("CASE WHEN n = 10 THEN list_sum(list_transform(xs, lambda v: abs(v - m))) / 10 END", "ma")},
    {sql5("CASE WHEN n = 10 THEN (len(list_filter(xs, lambda v: v < close)) + len(list_filter(xs, lambda v: v <= close)) + 1) / 20.0 END", "rk")}""",
    f", staged AS (SELECT date, instrument, close, {_L10} AS xs, {_M10} AS m, count(close) {over_months(10)} AS n FROM months)",
)
_daily(
    "ag_weighted",
    {"wm": "WMA($close,10)", "em": "EMA($close,10)"},
    f"""{sql5("CASE WHEN n = 10 THEN list_sum(list_transform(xs, lambda v, i: v * (i - 1))) / 45 END", "wm")},
    {sql5("CASE WHEN n = 10 THEN list_sum(list_transform(xs, lambda v, i: v * pow(9.0 / 11, 11 - i))) / list_sum(list_transform(range(1, 11), lambda i: pow(9.0 / 11, i))) END", "em")}""",
    f", staged AS (SELECT date, instrument, {_L10} AS xs, count(close) {over_months(10)} AS n FROM months)",
)
_daily(
    "ag_pairs",
    {"cv": "Cov($close,$volume,10)", "co": "Corr($close,$volume,10)"},
    f"""{sql5(_mfull(f"covar_samp(close, volume) {over_months(10)}", "close", 10), "cv")},
    {sql5(_mfull(f"covar_pop(close, volume) {over_months(10)} * 10 / (CASE WHEN var_pop(close) {over_months(10)} * 10 < 1e-6 OR var_pop(volume) {over_months(10)} * 10 < 1e-6 THEN 1 ELSE 10 * stddev_pop(close) {over_months(10)} * stddev_pop(volume) {over_months(10)} END)", "close", 10), "co")}""",
)
_daily(
    "ag_csrank",
    {"cr": "CSRank($close)"},
    sql5("(row_number() OVER (PARTITION BY date ORDER BY close, instrument) - 1) * 1.0 / count(close) OVER (PARTITION BY date)", "cr"),
)

_infix(
    "f_pointwise",
    {
        "a": "ABS($open - $close)", "e": "EXP($open / $close)", "q": "SQRT($close)", "l": "LOG($close)", "i": "INV($close)", "p": "POW($close, 2) / 100", "fl": "FLOOR($close)", "mx": "MAX($open, $volume)", "mn": "MIN($open, $volume)",
        "c": "$close > $open ? $close : -$open", "lo": "($close > 40 && $volume < 10) || $open >= 50", "f": "FILTER($close, $close > 40)", "eq": "($close == $close) + ($open != $open)", "sg": "SIGN($close - 38)",
    },
    ", ".join(
        sql5(x, n)
        for n, x in {
            "a": "abs(open - close)", "e": "exp(open / close)", "q": "sqrt(close)", "l": "ln(close + 1)", "i": "1 / close", "p": "close * close / 100", "fl": "floor(close)", "mx": "greatest(open, volume)", "mn": "least(open, volume)",
            "c": "CASE WHEN close > open THEN close ELSE -open END", "lo": "CASE WHEN (close > 40 AND volume < 10) OR open >= 50 THEN 1.0 ELSE 0.0 END", "f": "CASE WHEN close > 40 THEN close ELSE 0 END", "eq": "1.0", "sg": "CAST(sign(close - 38) AS DOUBLE)",
        }.items()
    ),
)
_DI = "OVER (PARTITION BY instrument ORDER BY date)"
_infix(
    "f_lags",
    {"d1": "DELTA($close)", "d3": "DELTA($close, 3)", "l2": "DELAY($close, 2)", "pc": "TS_PCTCHANGE($close, 2)"},
    ", ".join([sql5(f"close - lag(close) {_DI}", "d1"), sql5(f"close - lag(close, 3) {_DI}", "d3"), sql5(f"lag(close, 2) {_DI}", "l2"), sql5(f"coalesce(close / lag(close, 2) {_DI} - 1, 0)", "pc")]),
)
_infix(
    "f_rolling",
    {"mx": "TS_MAX($close, 6)", "mn": "TS_MIN($close, 6)", "me": "TS_MEAN($close, 6)", "su": "TS_SUM($close, 6)", "sc": "SUMAC($close)", "sd": "TS_STD($close, 6)", "va": "TS_VAR($close, 6)", "zs": "TS_ZSCORE($close, 6)"},
    ", ".join(
        [sql5(f"{f} {over_months(n)}", k) for k, f, n in (("mx", "max(close)", 6), ("mn", "min(close)", 6), ("me", "avg(close)", 6), ("su", "sum(close)", 6), ("sc", "sum(close)", 10), ("sd", "stddev_samp(close)", 6), ("va", "var_samp(close)", 6))]
        + [sql5(f"(close - avg(close) {over_months(6)}) / nullif(stddev_samp(close) {over_months(6)}, 0)", "zs")]
    ),
)
_infix(
    "f_quantiles",
    {"md": "TS_MEDIAN($close, 6)", "q": "TS_QUANTILE($close, 6, 0.25)", "pw": "PERCENTILE($close, 0.75, 6)", "pa": "PERCENTILE($close, 0.1)"},
    ", ".join([sql5(f"quantile_cont(close, {q}) {over_months(6)}", k) for k, q in (("md", 0.5), ("q", 0.25), ("pw", 0.75))] + [sql5("quantile_cont(close, 0.1) OVER (PARTITION BY instrument)", "pa")]),
)
_L6 = f"list(close) {over_months(6)}"
_infix(
    "f_order_statistics",
    {"rk": "TS_RANK($close, 6)", "am": "TS_ARGMAX($close, 6)", "an": "TS_ARGMIN($close, 6)", "hd": "HIGHDAY($close, 6)", "ld": "LOWDAY($close, 6)", "md": "TS_MAD($close, 6)"},
    f"""{sql5("(len(list_filter(xs, lambda v: v < close)) + (len(list_filter(xs, lambda v: v = close)) + 1) / 2.0) / len(xs)", "rk")}, {sql5("len(xs) - list_position(xs, list_max(xs))", "am")},
    {sql5("len(xs) - list_position(xs, list_min(xs))", "an")}, {sql5("len(xs) - list_position(xs, list_max(xs)) + 1", "hd")}, {sql5("len(xs) - list_position(xs, list_min(xs)) + 1", "ld")},
    {sql5("list_median(list_transform(xs, lambda v: abs(v - list_median(xs))))", "md")}""",
    f", staged AS (SELECT date, instrument, close, {_L6} AS xs FROM months)",
)
_infix(
    "f_weighted",
    {"wm": "WMA($close, 6)", "dl": "DECAYLINEAR($close, 6)", "pr": "PROD($close / 40, 4)"},
    f"""{sql5("list_sum(list_transform(xs, lambda v, i: v * pow(0.9, 6 - i))) / list_sum(list_transform(range(1, len(xs) + 1), lambda i: pow(0.9, 6 - i)))", "wm")},
    {sql5("list_sum(list_transform(xs, lambda v, i: v * i)) / 21", "dl")}, {sql5("pr", "pr")}""",
    f", staged AS (SELECT date, instrument, {_L6} AS xs, product(close / 40) {over_months(4)} AS pr FROM months)",
)
_infix(
    "f_pairs",
    {"co": "TS_CORR($close, $volume, 6)", "cv": "TS_COVARIANCE($close, $volume, 6)", "be": "REGBETA($close, $volume, 6)", "re": "REGRESI($close, $volume, 6)", "cn": "COUNT($close > $open, 6)", "si": "SUMIF($close, 6, $close > 38)" .replace("6, $close > 38", "$close > 38, 6")},
    ", ".join(
        [
            sql5(f"CASE WHEN count(close) {over_months(6)} >= 2 AND stddev_pop(close) {over_months(6)} > 1e-9 AND stddev_pop(volume) {over_months(6)} > 1e-9 THEN corr(close, volume) {over_months(6)} END", "co"),
            sql5(f"CASE WHEN count(close) {over_months(6)} >= 2 THEN covar_samp(close, volume) {over_months(6)} END", "cv"),
            sql5(_mfull(f"regr_slope(close, volume) {over_months(6)}", "close", 6), "be"),
            sql5(_mfull(f"close - (regr_intercept(close, volume) {over_months(6)} + regr_slope(close, volume) {over_months(6)} * volume)", "close", 6), "re"),
            sql5(f"sum(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) {over_months(6)}", "cn"),
            sql5(f"sum(CASE WHEN close > 38 THEN close ELSE 0.0 END) {over_months(6)}", "si"),
        ]
    ),
)
_X = "OVER (PARTITION BY date)"
_infix(
    "f_cross_section",
    {"rk": "RANK($close)", "me": "MEAN($close)", "sd": "STD($close)", "md": "MEDIAN($close)", "mx": "CS_MAX($close)", "mn": "CS_MIN($close)", "zs": "ZSCORE($close)", "sc": "SCALE($close)"},
    ", ".join(
        [sql5(f"(rank() OVER (PARTITION BY date ORDER BY close) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0) / count(close) {_X}", "rk")]
        + [sql5(f"{f} {_X}", k) for k, f in (("me", "avg(close)"), ("sd", "stddev_samp(close)"), ("md", "quantile_cont(close, 0.5)"), ("mx", "max(close)"), ("mn", "min(close)"))]
        + [sql5(f"(close - avg(close) {_X}) / nullif(stddev_samp(close) {_X}, 0)", "zs"), sql5(f"close / sum(abs(close)) {_X}", "sc")]
    ),
)
_infix("f_cross_moments", {"sk": "SKEW($close)", "ku": "KURT($close)"}, ", ".join([sql5(f"skewness(close) {_X}", "sk"), sql5(f"kurtosis(close) {_X}", "ku")]))
_infix(
    "f_bands",
    {"mid": "BB_MIDDLE($close, 6)", "up": "BB_UPPER($close, 6)", "lo": "BB_LOWER($close, 6)"},
    ", ".join([sql5(f"avg(close) {over_months(6)}", "mid"), sql5(f"avg(close) {over_months(6)} + stddev_samp(close) {over_months(6)}", "up"), sql5(f"avg(close) {over_months(6)} - stddev_samp(close) {over_months(6)}", "lo")]),
)
_EW_SQL = f""", n AS (SELECT *, row_number() {_DI} AS k FROM months),
r AS (SELECT date, instrument, k, close AS e, 1.0::DOUBLE AS eb, close AS s, 1.0::DOUBLE AS sb, close AS a, 1.0::DOUBLE AS ab FROM n WHERE k = 1
  UNION ALL SELECT n.date, n.instrument, n.k, n.close + r.e * (1 - 2.0 / 7), 1 + r.eb * (1 - 2.0 / 7), n.close + r.s * (1 - 1.0 / 5), 1 + r.sb * (1 - 1.0 / 5), n.close + r.a * (1 - 2.0 / 13), 1 + r.ab * (1 - 2.0 / 13)
  FROM r JOIN n ON n.instrument = r.instrument AND n.k = r.k + 1)"""


@query("f_exponential", f"WITH RECURSIVE {MONTHS_SQL}{_EW_SQL} SELECT date, instrument, {sql5('e / eb', 'em')}, {sql5('s / sb', 'sm')}, {sql5('e / eb - a / ab', 'macd')} FROM r")
def f_exponential(spark, sf_dir):
    formulas = {"em": "EMA($close, 6)", "sm": "SMA($close, 5, 1)", "macd": "EMA($close, 6) - EMA($close, 12)"}
    trees = {k: lift_parameters(parse_infix(v), K.INFIX_SERIES) for k, v in formulas.items()}
    out = compile_formulas(months(spark, sf_dir), trees, K.INFIX, MONTHS)
    return out.select("date", "instrument", *[r5(F.col(k)).alias(k) for k in formulas])


# rises and falls are averaged from the second row on: the first change is unknown
_RSI_SQL = f""", d AS (SELECT date, instrument, row_number() {_DI} AS k, close - lag(close) {_DI} AS c FROM months), n AS (SELECT date, instrument, k, greatest(c, 0) AS u, greatest(-c, 0) AS f FROM d WHERE k > 1),
r AS (SELECT date, instrument, k, u, f FROM n WHERE k = 2 UNION ALL SELECT n.date, n.instrument, n.k, n.u + r.u * (1 - 2.0 / 8), n.f + r.f * (1 - 2.0 / 8) FROM r JOIN n ON n.instrument = r.instrument AND n.k = r.k + 1)"""


@query("f_rsi", f"WITH RECURSIVE {MONTHS_SQL}{_RSI_SQL} SELECT date, instrument, {sql5('100 * u / nullif(u + f, 0)', 'rsi')} FROM r")
def f_rsi(spark, sf_dir):
    tree = lift_parameters(parse_infix("RSI($close, 7)"), K.INFIX_SERIES)
    out = compile_formulas(months(spark, sf_dir), {"rsi": tree}, K.INFIX, MONTHS)
    first = F.row_number().over(MONTHS.rows()) > 1
    return out.withColumn("__k", first).where("__k").select("date", "instrument", r5(F.col("rsi")).alias("rsi"))


_GUARDED = {
    "ad": ("(add close open)", "close + open"), "su": ("(sub close open)", "close - open"), "mu": ("(mul close open)", "close * open"), "di": ("(div close (sub volume volume))", "1.0"), "sq": ("(sqrt (neg close))", "sqrt(close)"),
    "lg": ("(log (neg close))", "ln(close)"), "iv": ("(inv close)", "1 / close"), "ab": ("(abs (neg close))", "close"), "mx": ("(max close open)", "greatest(close, open)"), "mn": ("(min close open)", "least(close, open)"),
    "si": ("(sin close)", "sin(close)"), "co": ("(cos close)", "cos(close)"), "ta": ("(tan (div close 100))", "tan(close / 100)"), "sg": ("(sig (div close 10))", "1 / (1 + exp(-close / 10))"),
}
_SYMBOLIC = {
    "ex": ("(exp (div close 10))", "exp(close / 10)"), "exb": ("(exp (add close 100))", "0.0"), "lg": ("(log close)", "ln(close)"), "iv": ("(inv close)", "1 / close"), "la": ("(logabs (neg close))", "ln(close)"),
    "en": ("(expneg (div close 10))", "exp(-close / 10)"), "n2": ("(n2 (div close 10))", "pow(close / 10, 2)"), "n3": ("(n3 (div close 10))", "pow(close / 10, 3)"), "n4": ("(n4 (div close 10))", "pow(close / 10, 4)"),
    "th": ("(tanh (div close 50))", "tanh(close / 50)"), "sg": ("(sigmoid (div close 10))", "1 / (1 + exp(-close / 10))"), "ha": ("(harmonic close)", "list_sum(list_transform(range(1, greatest(CAST(floor(close) AS BIGINT), 1) + 1), lambda k: 1.0 / k))"),
    "di": ("(div close open)", "close / open"), "sq": ("(sqrt close)", "sqrt(close)"),
}


def _symbolic(name: str, formulas: dict[str, tuple[str, str]], dialect: Dialect) -> None:
    def run(spark, sf_dir):
        out = compile_formulas(months(spark, sf_dir), {k: parse_sexpr(v[0]) for k, v in formulas.items()}, dialect, MONTHS)
        return out.select("date", "instrument", *[r5(F.col(k)).alias(k) for k in formulas])

    query(name, f"WITH {MONTHS_SQL} SELECT date, instrument, {', '.join(sql5(v[1], k) for k, v in formulas.items())} FROM months")(run)


_symbolic("l_guarded", _GUARDED, K.GUARDED)
_symbolic("d_symbolic", _SYMBOLIC, K.SYMBOLIC)


@query("d_polynomial", f"WITH {MONTHS_SQL} SELECT date, instrument, {sql5('2.5 * close + 0.1 * close * close * volume - 3', 'poly')}, {sql5('CASE WHEN close < 38 THEN open ELSE -open END', 'switched')} FROM months")
def d_polynomial(spark, sf_dir):
    m = months(spark, sf_dir)
    poly = K.polynomial([(2.5, {"close": 1}), (0.1, {"close": 2, "volume": 1}), (-3.0, {})])
    return m.select("date", "instrument", r5(poly).alias("poly"), r5(K.state_switch(F.col("close"), 38.0, F.col("open"), -F.col("open"))).alias("switched"))
