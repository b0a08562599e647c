"""Column kernels and the operator tables of the formula dialects.

Arrays for order statistics come from ``collect_list`` over the frame; everything else is a plain
window aggregate. Divisions and logarithms are guarded, so ANSI mode never raises.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from meridia.functions.compile import Dialect, Operator, Panel
from meridia.functions.expr import Node, call, const

LIMIT = 1e6
#: The widest window that a column may ask for.
WIDEST = 512


def d(value: float) -> Column:
    return F.lit(float(value))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def bounded(x: Column) -> Column:
    """Non-finite and null values become 0, others are cut to plus or minus a million."""
    return F.greatest(d(-LIMIT), F.least(d(LIMIT), F.coalesce(finite(x), d(0))))


def divide(a: Column, b: Column, tiny: float = 0.0, default: float | None = None) -> Column:
    small = (F.abs(b) < tiny) if tiny else (b == 0)
    return F.when(small, F.lit(default).cast("double")).otherwise(a / F.when(small, d(1)).otherwise(b))


def full(x: Column, value: Column, w, n: int) -> Column:
    """The value where the frame holds n known x."""
    return F.when(F.count(x).over(w) == n, value)


def items(x: Column, w) -> Column:
    return F.collect_list(x).over(w)


def total(xs: Column) -> Column:
    return F.aggregate(xs, d(0), lambda a, x: a + x)


def counted(xs: Column, test) -> Column:
    return F.aggregate(xs, d(0), lambda a, x: a + F.when(test(x), d(1)).otherwise(d(0)))


def dot(xs: Column, weights: Column) -> Column:
    return total(F.zip_with(xs, weights, lambda x, w: x * w))


def weights(values: list[float]) -> Column:
    return F.array(*[d(v) for v in values])


def middle(xs: Column) -> Column:
    """Median with the mean of the two middle values."""
    s, n = F.array_sort(xs), F.size(xs)
    return F.when(n > 0, (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2)


def average_rank(x: Column, over_order, over_all) -> Column:
    """Average rank of ties, from 1: rank plus half of the ties behind it."""
    return F.rank().over(over_order) + (F.count(F.lit(1)).over(over_all) - 1) / 2


def correlation(x: Column, y: Column, w=None) -> Column:
    """Correlation of the rows that have both, null where a side doesn't vary (the built-in raises there under ANSI)."""
    over = (lambda c: c.over(w)) if w is not None else (lambda c: c)
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    sx, sy = over(F.stddev_pop(x)), over(F.stddev_pop(y))
    vary = (sx > 1e-9) & (sy > 1e-9)
    return F.when(vary, over(F.covar_pop(x, y)) / F.when(vary, sx * sy))


# --- Dialect of the mining trees: every node is bounded; windows restart with the segment ----------

def _unary(f):
    return Operator(lambda p, k, a: f(k[0]), 1)


def _binary(f):
    return Operator(lambda p, k, a: f(k[0], k[1]), 2)


def _rolling(f, series: int = 1):
    return Operator(lambda p, k, a: f(p, *k, int(a[0])), series, True, 1)


def _moments_corr(p: Panel, x: Column, y: Column, n: int) -> Column:
    w = p.last(n)
    mx, my = F.avg(x).over(w), F.avg(y).over(w)
    cov = F.avg(x * y).over(w) - mx * my
    vx, vy = F.avg(x * x).over(w) - mx * mx, F.avg(y * y).over(w) - my * my
    return F.when((F.count(x).over(w) == n) & (vx > 1e-12) & (vy > 1e-12), cov / F.sqrt(F.greatest(vx, d(0)) * F.greatest(vy, d(0))))


def decay(p: Panel, x: Column, n: int) -> Column:
    xs = items(x, p.last(n))
    return F.when(F.size(xs) == n, dot(xs, weights([2.0 * (i + 1) / (n * (n + 1)) for i in range(n)])))


def _zscore(p: Panel, x: Column, n: int) -> Column:
    w = p.last(n)
    sd = F.stddev_pop(x).over(w)
    return full(x, divide(x - F.avg(x).over(w), sd, 1e-12), w, n)


MINING = Dialect(
    "mining",
    {
        "neg": _unary(lambda x: -x),
        "abs": _unary(F.abs),
        "log1p": _unary(lambda x: F.log1p(F.abs(x))),
        "sign": _unary(F.signum),
        "ref": Operator(lambda p, k, a: F.lag(k[0], int(a[0])).over(p.rows()), 1, True, 1),
        "add": _binary(lambda a, b: a + b),
        "sub": _binary(lambda a, b: a - b),
        "mul": _binary(lambda a, b: a * b),
        "div": _binary(lambda a, b: divide(a, b, 1e-12, 0.0)),
        "min2": _binary(F.least),
        "max2": _binary(F.greatest),
        "gt": _binary(lambda a, b: (a > b).cast("double")),
        "lt": _binary(lambda a, b: (a < b).cast("double")),
        "if_then_else": Operator(lambda p, k, a: F.when(k[0] != 0, k[1]).otherwise(k[2]), 3),
        "ts_sum": _rolling(lambda p, x, n: full(x, F.sum(x).over(p.last(n)), p.last(n), n)),
        "ts_mean": _rolling(lambda p, x, n: full(x, F.avg(x).over(p.last(n)), p.last(n), n)),
        "ts_std": _rolling(lambda p, x, n: full(x, F.stddev_pop(x).over(p.last(n)), p.last(n), n)),
        "ts_min": _rolling(lambda p, x, n: full(x, F.min(x).over(p.last(n)), p.last(n), n)),
        "ts_max": _rolling(lambda p, x, n: full(x, F.max(x).over(p.last(n)), p.last(n), n)),
        "ts_delta": _rolling(lambda p, x, n: x - F.lag(x, n).over(p.rows())),
        "ts_rank": _rolling(lambda p, x, n: full(x, counted(items(x, p.last(n)), lambda v: v <= x) / n, p.last(n), n)),
        "ts_zscore": _rolling(_zscore),
        "decay_linear": _rolling(decay),
        "ts_corr": _rolling(_moments_corr, 2),
        "ema": Operator(lambda p, k, a: ("halflife", int(a[0])), 1, True, 1),
    },
    bounded,
    frozenset({"ema"}),
)


# --- Daily call-style dialect: exact windows, null where history is short --------------------------

def _central(p: Panel, x: Column, n: int):
    w = p.last(n)
    m = F.avg(x).over(w)
    xs = items(x, w)
    power = lambda k: F.aggregate(xs, d(0), lambda a, v: a + F.pow(v - m, d(k))) / n
    return w, power


def _kurt(p: Panel, x: Column, n: int) -> Column:
    w, power = _central(p, x, n)
    var = F.var_samp(x).over(w)
    return full(x, divide(power(4), var * var) - 3, w, n)


def _skew(p: Panel, x: Column, n: int) -> Column:
    w, power = _central(p, x, n)
    return full(x, divide(power(3), F.pow(power(2), d(1.5))), w, n)


def _mid_rank(p: Panel, x: Column, n: int) -> Column:
    xs = items(x, p.last(n))
    below, upto = counted(xs, lambda v: v < x), counted(xs, lambda v: v <= x)
    return full(x, (below + upto + F.when(upto > below, 1.0).otherwise(0.0)) / (2 * n), p.last(n), n)


def _guarded_corr(p: Panel, x: Column, y: Column, n: int) -> Column:
    w = p.last(n)
    mx, my = F.avg(x).over(w), F.avg(y).over(w)
    xs, ys = items(x, w), items(y, w)
    sx = F.aggregate(xs, d(0), lambda a, v: a + (v - mx) * (v - mx))
    sy = F.aggregate(ys, d(0), lambda a, v: a + (v - my) * (v - my))
    sxy = total(F.zip_with(xs, ys, lambda u, v: (u - mx) * (v - my)))
    bottom = F.when((sx < 1e-6) | (sy < 1e-6), d(1)).otherwise(F.sqrt(sx * sy))
    return full(x, sxy / bottom, w, n)


def _guard_window(f):
    return _rolling(lambda p, x, n: full(x, f(x, p.last(n), n), p.last(n), n))


def cs_rank(p: Panel, x: Column) -> Column:
    """(0..n-1)/n within the section; ties in the order of the series' keys; nulls stay null."""
    order = p.cross().orderBy(F.when(x.isNull(), 1).otherwise(0), x, *p.series)
    return F.when(x.isNotNull(), (F.row_number().over(order) - 1) / F.count(x).over(p.cross()))


def _ema_window(n: int) -> list[float]:
    alpha = 1 - 2 / (1 + n)
    w = [alpha ** (n - i) for i in range(n)]
    return [v / sum(w) for v in w]


DAILY = Dialect(
    "daily",
    {
        "Abs": _unary(F.abs),
        "Sign": _unary(F.signum),
        "Log": _unary(lambda x: F.when(x > 0, F.ln(F.when(x > 0, x)))),
        "CSRank": Operator(lambda p, k, a: cs_rank(p, k[0]), 1, True),
        "Add": _binary(lambda a, b: a + b),
        "Sub": _binary(lambda a, b: a - b),
        "Mul": _binary(lambda a, b: a * b),
        "Div": _binary(divide),
        "Pow": _binary(F.pow),
        "Greater": _binary(F.greatest),
        "Less": _binary(F.least),
        "Ref": Operator(lambda p, k, a: F.lag(k[0], int(a[0])).over(p.rows()) if a[0] >= 0 else F.lead(k[0], -int(a[0])).over(p.rows()), 1, True, 1),
        "Mean": _guard_window(lambda x, w, n: F.avg(x).over(w)),
        "Sum": _guard_window(lambda x, w, n: F.sum(x).over(w)),
        "Std": _guard_window(lambda x, w, n: F.stddev_samp(x).over(w)),
        "Var": _guard_window(lambda x, w, n: F.var_samp(x).over(w)),
        "Skew": _rolling(_skew),
        "Kurt": _rolling(_kurt),
        "Max": _guard_window(lambda x, w, n: F.max(x).over(w)),
        "Min": _guard_window(lambda x, w, n: F.min(x).over(w)),
        "Med": _guard_window(lambda x, w, n: F.element_at(F.array_sort(items(x, w)), (n + 1) // 2)),
        "Mad": _rolling(lambda p, x, n: full(x, F.aggregate(items(x, p.last(n)), d(0), lambda a, v: a + F.abs(v - F.avg(x).over(p.last(n)))) / n, p.last(n), n)),
        "Rank": _rolling(_mid_rank),
        "Delta": _rolling(lambda p, x, n: x - F.lag(x, n).over(p.rows())),
        "WMA": _guard_window(lambda x, w, n: dot(items(x, w), weights([2.0 * i / (n * (n - 1)) if n > 1 else 0.0 for i in range(n)]))),
        "EMA": _guard_window(lambda x, w, n: dot(items(x, w), weights(_ema_window(n)))),
        "Cov": _rolling(lambda p, x, y, n: full(x, F.covar_samp(x, y).over(p.last(n)), p.last(n), n), 2),
        "Corr": _rolling(_guarded_corr, 2),
    },
)


def _macd(n: Node) -> Node:
    """Difference of two exponential averages."""
    short, long = n.params[:2] if len(n.params) > 1 else (12, 26)
    x = n.children[0]
    return call("SUBTRACT", call("EMA", x, params=(short,)), call("EMA", x, params=(long,)))


def _rsi(n: Node) -> Node:
    """100 - 100 / (1 + average rise / average fall); without falls, 100."""
    span = n.params[:1] or (14,)
    change = call("DELTA", n.children[0], params=(1,))
    up = call("EMA", call("MAX", change, const(0)), params=span)
    down = call("EMA", call("MAX", call("NEG", change), const(0)), params=span)
    share = call("DIVIDE", up, call("ADD", up, down))
    return call("MULTIPLY", const(100), share)


# --- Library of infix formulas: windows of what there is; cross-sections by date --------------------

def _series_all(p: Panel, x: Column, f) -> Column:
    return F.when(x.isNotNull(), f)


def _pct_rank(p: Panel, x: Column) -> Column:
    order = p.cross().orderBy(F.when(x.isNull(), 1).otherwise(0), x)
    ties = F.count(F.lit(1)).over(p.cross().partitionBy(*p.section, x))
    return F.when(x.isNotNull(), (F.rank().over(order) + (ties - 1) / 2) / F.count(x).over(p.cross()))


def _ts_pct_rank(p: Panel, x: Column, n: int) -> Column:
    xs = items(x, p.last(n))
    below, same = counted(xs, lambda v: v < x), counted(xs, lambda v: v == x)
    return F.when(x.isNotNull(), (below + (same + 1) / 2) / F.size(xs))


def _since_first(p: Panel, x: Column, n: int, pick, offset: int) -> Column:
    xs = items(x, p.last(n))
    return F.when(F.size(xs) > 0, F.size(xs) - F.array_position(xs, pick(xs)) + offset).cast("double")


def _wma(p: Panel, x: Column, n: int) -> Column:
    # a short window takes the weights of the oldest places
    w = [0.9 ** (n - 1 - i) for i in range(n)]
    xs = items(x, p.last(n))
    own = F.slice(weights(w), 1, F.size(xs))
    return F.when(F.size(xs) > 0, dot(xs, own) / total(own))


def _decay_short(p: Panel, x: Column, n: int) -> Column:
    xs = items(x, p.last(n))
    own = F.slice(weights([(i + 1) / (n * (n + 1) / 2) for i in range(n)]), 1, F.size(xs))
    return F.when(F.size(xs) > 0, dot(xs, own))


def _median_deviation(p: Panel, x: Column, n: int) -> Column:
    xs = items(x, p.last(n))
    return middle(F.transform(xs, lambda v: F.abs(v - middle(xs))))


def _bias_skew(x: Column, w) -> Column:
    n = F.count(x).over(w)
    m = F.avg(x).over(w)
    m2, m3 = F.avg(x * x).over(w) - m * m, F.avg(x * x * x).over(w) - 3 * m * F.avg(x * x).over(w) + 2 * m * m * m
    return F.when((n > 2) & (m2 > 1e-14), F.sqrt(n * (n - 1.0)) / (n - 2) * m3 / F.pow(F.when(m2 > 0, m2), d(1.5)))


def _bias_kurt(x: Column, w) -> Column:
    n = F.count(x).over(w).cast("double")
    m = F.avg(x).over(w)
    e2, e3, e4 = (F.avg(v).over(w) for v in (x * x, x * x * x, x * x * x * x))
    m2 = e2 - m * m
    m4 = e4 - 4 * m * e3 + 6 * m * m * e2 - 3 * m * m * m * m
    return F.when((n > 3) & (m2 > 1e-14), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m4 / (F.when(m2 > 0, m2) * m2) - 3 * (n - 1)))


def _regression(p: Panel, y: Column, x: Column, n: int, residual: bool) -> Column:
    w = p.last(n)
    both = F.when(x.isNotNull() & y.isNotNull(), x)
    slope = F.regr_slope(y, x).over(w)
    value = y - (F.regr_intercept(y, x).over(w) + slope * x) if residual else slope
    return F.coalesce(F.when(F.count(both).over(w) == n, value), F.when(F.row_number().over(p.rows()) >= n, d(0)))


def _at_least(n: int, x: Column, value: Column, w) -> Column:
    return F.when(F.count(x).over(w) >= n, value)


def _band(sign: int):
    def make(p: Panel, k: list[Column], a: tuple) -> Column:
        n = int(a[0])
        w = p.last(n)
        m = F.avg(k[0]).over(w)
        return m + sign * F.stddev_samp(k[0]).over(w) if sign else m

    return Operator(make, 1, True, 1)


def _band_by(sign: int):
    """Bands over the last n rows, n a column of its own on each row (cut to a whole number): the frame reaches over
    ``WIDEST`` rows, and of its known values the last that n asks for count. Null where n isn't 1 to WIDEST."""

    def make(p: Panel, k: list[Column], a: tuple) -> Column:
        rows = F.collect_list(F.struct(k[0].alias("x"))).over(p.last(WIDEST))
        n = F.when((k[1] >= 1) & (k[1] <= WIDEST), F.floor(k[1]).cast("int"))
        start = F.greatest(F.size(rows) - n, F.lit(0))
        own = F.filter(F.transform(F.slice(rows, start + 1, n), lambda r: r["x"]), lambda x: x.isNotNull())
        count = F.size(own)
        mean = total(own) / F.when(count > 0, count)
        if not sign:
            return F.when(n.isNotNull(), mean)
        spread = F.sqrt(total(F.transform(own, lambda x: (x - mean) * (x - mean))) / F.when(count > 1, count - 1))
        return F.when(n.isNotNull(), mean + sign * spread)

    return Operator(make, 2, True)


def _section(f):
    return Operator(lambda p, k, a: f(k[0], p.cross()), 1, True)


def _short(f, series: int = 1, default: int = 5):
    return Operator(lambda p, k, a: f(p, *k, int(a[0]) if a else default), series, True)


INFIX = Dialect(
    "infix",
    {
        "DELTA": _short(lambda p, x, n: x - F.lag(x, n).over(p.rows()), default=1),
        "DELAY": _short(lambda p, x, n: F.lag(x, n).over(p.rows()), default=1),
        "RANK": Operator(lambda p, k, a: _pct_rank(p, k[0]), 1, True),
        "MEAN": _section(lambda x, w: F.avg(x).over(w)),
        "STD": _section(lambda x, w: F.stddev_samp(x).over(w)),
        "SKEW": _section(_bias_skew),
        "KURT": _section(_bias_kurt),
        "MEDIAN": _section(lambda x, w: F.percentile(x, 0.5).over(w)),
        "CS_MAX": _section(lambda x, w: F.max(x).over(w)),
        "CS_MIN": _section(lambda x, w: F.min(x).over(w)),
        "ZSCORE": _section(lambda x, w: divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w))),
        "SCALE": _section(lambda x, w: divide(x, F.sum(F.abs(x)).over(w))),
        "MAX": _binary(F.greatest),
        "MIN": _binary(F.least),
        "ABS": _unary(F.abs),
        "SIGN": _unary(F.signum),
        "EXP": _unary(F.exp),
        "SQRT": _unary(lambda x: F.when(x >= 0, F.sqrt(F.when(x >= 0, x)))),
        "LOG": _unary(lambda x: F.when(x > -1, F.log1p(F.when(x > -1, x)))),
        "INV": _unary(lambda x: divide(d(1), x)),
        "FLOOR": _unary(lambda x: F.floor(x).cast("double")),
        "POW": _binary(F.pow),
        "NEG": _unary(lambda x: -x),
        "ADD": _binary(lambda a, b: a + b),
        "SUBTRACT": _binary(lambda a, b: a - b),
        "MULTIPLY": _binary(lambda a, b: a * b),
        "DIVIDE": _binary(divide),
        "AND": _binary(lambda a, b: ((a != 0) & (b != 0)).cast("double")),
        "OR": _binary(lambda a, b: ((a != 0) | (b != 0)).cast("double")),
        "EQ": _binary(lambda a, b: (a == b).cast("double")),
        "NE": _binary(lambda a, b: (a != b).cast("double")),
        "LT": _binary(lambda a, b: (a < b).cast("double")),
        "GT": _binary(lambda a, b: (a > b).cast("double")),
        "LE": _binary(lambda a, b: (a <= b).cast("double")),
        "GE": _binary(lambda a, b: (a >= b).cast("double")),
        "WHERE": Operator(lambda p, k, a: F.when(k[0] != 0, k[1]).otherwise(k[2]), 3),
        "FILTER": _binary(lambda x, c: x * (c != 0).cast("double")),
        "TS_RANK": _short(_ts_pct_rank),
        "TS_MAX": _short(lambda p, x, n: F.max(x).over(p.last(n))),
        "TS_MIN": _short(lambda p, x, n: F.min(x).over(p.last(n))),
        "TS_MEAN": _short(lambda p, x, n: F.avg(x).over(p.last(n))),
        "TS_SUM": _short(lambda p, x, n: F.sum(x).over(p.last(n))),
        "SUMAC": _short(lambda p, x, n: F.sum(x).over(p.last(n)), default=10),
        "TS_MEDIAN": _short(lambda p, x, n: F.percentile(x, 0.5).over(p.last(n))),
        "PERCENTILE": Operator(lambda p, k, a: F.percentile(k[0], float(a[0])).over(p.last(int(a[1])) if len(a) > 1 else p.rows(Window.unboundedPreceding, Window.unboundedFollowing)), 1, True, 1),
        "TS_QUANTILE": Operator(lambda p, k, a: F.percentile(k[0], float(a[1])).over(p.last(int(a[0]))), 1, True, 2),
        "TS_ARGMAX": _short(lambda p, x, n: _since_first(p, x, n, F.array_max, 0)),
        "TS_ARGMIN": _short(lambda p, x, n: _since_first(p, x, n, F.array_min, 0)),
        "HIGHDAY": _short(lambda p, x, n: _since_first(p, x, n, F.array_max, 1)),
        "LOWDAY": _short(lambda p, x, n: _since_first(p, x, n, F.array_min, 1)),
        "TS_CORR": _short(lambda p, x, y, n: _at_least(2, x, correlation(x, y, p.last(n)), p.last(n)), 2),
        "TS_COVARIANCE": _short(lambda p, x, y, n: _at_least(2, x, F.covar_samp(x, y).over(p.last(n)), p.last(n)), 2),
        "TS_STD": _short(lambda p, x, n: F.stddev_samp(x).over(p.last(n)), default=20),
        "TS_VAR": _short(lambda p, x, n: F.var_samp(x).over(p.last(n))),
        "TS_ZSCORE": _short(lambda p, x, n: divide(x - F.avg(x).over(p.last(n)), F.stddev_samp(x).over(p.last(n)))),
        "TS_MAD": _short(_median_deviation),
        "TS_PCTCHANGE": _short(lambda p, x, n: F.coalesce(divide(x, F.lag(x, n).over(p.rows())) - 1, d(0)), default=1),
        "WMA": _short(_wma, default=20),
        "DECAYLINEAR": _short(_decay_short),
        "COUNT": _short(lambda p, c, n: F.sum((c != 0).cast("double")).over(p.last(n))),
        "SUMIF": _short(lambda p, x, c, n: F.sum(x * (c != 0).cast("double")).over(p.last(n)), 2),
        "PROD": _short(lambda p, x, n: F.product(x).over(p.last(n))),
        "REGBETA": _short(lambda p, y, x, n: _regression(p, y, x, n, False), 2),
        "REGRESI": _short(lambda p, y, x, n: _regression(p, y, x, n, True), 2),
        "BB_MIDDLE": _band(0),
        "BB_UPPER": _band(1),
        "BB_LOWER": _band(-1),
        **{f"{name}_BY": _band_by(sign) for name, sign in (("BB_MIDDLE", 0), ("BB_UPPER", 1), ("BB_LOWER", -1))},
        "SMA": Operator(lambda p, k, a: ("adjusted", float(a[1]) / float(a[0])), 1, True, 2),
        "EMA": Operator(lambda p, k, a: ("adjusted", 2.0 / (int(a[0]) + 1)), 1, True, 1),
    },
    sequential=frozenset({"SMA", "EMA"}),
    macros={"MACD": _macd, "RSI": _rsi},
)
#: Series that an operator takes; what follows them in a call are numbers.
INFIX_SERIES = {name: op.series for name, op in INFIX.operators.items() if op.windowed} | {"MACD": 1, "RSI": 1}
DAILY_SERIES = {name: op.series for name, op in DAILY.operators.items() if op.windowed}


# --- Guarded point-wise operators of the two symbolic-regression dialects ----------------------------

def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(d(700), F.greatest(d(-700), x))))


GUARDED = Dialect(
    "guarded",
    {
        "add": _binary(lambda a, b: a + b),
        "sub": _binary(lambda a, b: a - b),
        "mul": _binary(lambda a, b: a * b),
        "div": _binary(lambda a, b: F.when(F.abs(b) > 0.001, a / F.when(F.abs(b) > 0.001, b)).otherwise(1.0)),
        "sqrt": _unary(lambda x: F.sqrt(F.abs(x))),
        "log": _unary(lambda x: F.when(F.abs(x) > 0.001, F.ln(F.when(F.abs(x) > 0.001, F.abs(x)))).otherwise(0.0)),
        "neg": _unary(lambda x: -x),
        "inv": _unary(lambda x: F.when(F.abs(x) > 0.001, 1 / F.when(F.abs(x) > 0.001, x)).otherwise(0.0)),
        "abs": _unary(F.abs),
        "max": _binary(F.greatest),
        "min": _binary(F.least),
        "sin": _unary(F.sin),
        "cos": _unary(F.cos),
        "tan": _unary(F.tan),
        "sig": _unary(_sigmoid),
    },
)


def _when(test: Column, x: Column, f, default: float) -> Column:
    return F.when(test, f(F.when(test, x))).otherwise(default)


def harmonic(x: Column) -> Column:
    """Sum of 1/k for k up to the whole part; 0 below 1."""
    n = F.floor(x).cast("int")
    return F.when(n >= 1, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), d(0), lambda a, k: a + d(1) / k)).otherwise(0.0)


SYMBOLIC = Dialect(
    "symbolic",
    {
        **{k: GUARDED.operators[k] for k in ("add", "sub", "mul", "neg", "abs", "max", "min", "sin", "cos", "tan")},
        "div": _binary(lambda a, b: F.when(F.abs(b) > 0.001, a / F.when(F.abs(b) > 0.001, b)).otherwise(1.0)),
        "exp": _unary(lambda x: _when(x < 100, x, F.exp, 0.0)),
        "log": _unary(lambda x: _when(F.abs(x) > 0.001, F.abs(x), F.ln, 0.0)),
        "sqrt": _unary(lambda x: F.sqrt(F.abs(x))),
        "inv": _unary(lambda x: _when(F.abs(x) > 0.001, x, lambda v: 1 / v, 0.0)),
        "logabs": _unary(lambda x: _when(x != 0, F.abs(x), F.ln, 0.0)),
        "expneg": _unary(lambda x: _when(x > -100, -x, F.exp, 0.0)),
        "n2": _unary(lambda x: _when(F.abs(x) < LIMIT, x, lambda v: F.pow(v, d(2)), 0.0)),
        "n3": _unary(lambda x: _when(F.abs(x) < LIMIT, x, lambda v: F.pow(v, d(3)), 0.0)),
        "n4": _unary(lambda x: _when(F.abs(x) < LIMIT, x, lambda v: F.pow(v, d(4)), 0.0)),
        "tanh": _unary(F.tanh),
        "sigmoid": _unary(_sigmoid),
        "harmonic": _unary(harmonic),
    },
)


def polynomial(terms: list[tuple[float, dict[str, int]]]) -> Column:
    """Sum of coefficients times powers of columns."""
    out = d(0)
    for coefficient, powers in terms:
        part = d(coefficient)
        for name, k in powers.items():
            part = part * F.pow(F.col(name), d(k))
        out = out + part
    return out


def state_switch(x: Column, threshold: float, below: Column, otherwise: Column) -> Column:
    return F.when(x < threshold, below).otherwise(otherwise)


def normal_cdf(x: Column) -> Column:
    """Normal distribution function by a rational approximation of erf (error below 1.5e-7)."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))
