"""Signals to positions to profit: quantile bands, position states, costs, scores, pool gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from meridia.functions.compile import Panel
from meridia.operators.sequential import positions, streamed

INVALID = -10.0


class UndeclaredCostsError(ValueError):
    """A product without declared costs."""


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a b + c, rounded once: the product's and the sum's own errors are added last. Very large and undefined a: as it comes."""

    def halves(x: Column) -> tuple[Column, Column]:
        wide = x * 134217729.0
        high = wide - (wide - x)
        return high, x - high

    def added(s: Column) -> Column:
        (ah, al), (bh, bl) = halves(s["a"]), halves(s["b"])
        lost = ((ah * bh - s["p"]) + ah * bl + al * bh) + al * bl
        return _let(F.struct(s["p"].alias("p"), s["c"].alias("c"), lost.alias("e"), (s["p"] + s["c"]).alias("s")), rounded)

    def rounded(s: Column) -> Column:
        back = s["s"] - s["p"]
        return s["s"] + ((s["p"] - (s["s"] - back)) + (s["c"] - back) + s["e"])

    exact = _let(F.struct(a.alias("a"), b.alias("b"), c.alias("c"), (a * b).alias("p")), added)
    return F.when((F.abs(a) < 1e290) & (F.abs(c) < 1e290), exact).otherwise(a * b + c)


def sorted_quantile(values: Column, q: float) -> Column:
    """The quantile between two neighbours of a sorted array, as quantile_cont has it to the last place: a signal that lies on
    a bound must not be told from it by a rounding."""

    def between(s: Column) -> Column:
        return F.when(s["d"] == 0, s["lo"]).otherwise(_fused(s["lo"], 1 - s["d"], s["hi"] * s["d"]))

    def met(v: Column) -> Column:
        at = (F.size(v) - 1) * F.lit(float(q))
        return _let(F.struct(F.get(v, F.floor(at).cast("int")).alias("lo"), F.get(v, F.ceil(at).cast("int")).alias("hi"), (at - F.floor(at)).alias("d")), between)

    return _let(values, met)


def bands(signal: str, panel: Panel, lookback: int, least: int, low: float, high: float) -> tuple[Column, Column]:
    """Quantiles of the ``lookback`` rows before each, null with fewer than ``least`` known."""
    w = panel.rows(-lookback, -1)
    enough = F.count(signal).over(w) >= least
    known = F.sort_array(F.collect_list(F.col(signal).cast("double")).over(w))
    return F.when(enough, sorted_quantile(known, low)), F.when(enough, sorted_quantile(known, high))


def with_positions(df: DataFrame, panel: Panel, signal: str, low: str, high: str, locked: str, segment: str, max_hold: int) -> DataFrame:
    """Adds position. One series is read in order by one task, a batch at a time."""
    staged = df.withColumn("__lock", F.col(locked).cast("double")).withColumn("__seg", F.col(segment).cast("double"))

    def run(edges, state, *columns):
        left: list = []
        return [positions(*columns, max_hold, state, edges, left)], left[0]

    return streamed(staged, panel, [signal, low, high, "__lock", "__seg"], {"position": IntegerType()}, run).drop("__lock", "__seg")


def with_costs(df: DataFrame, costs: DataFrame, product: str = "product") -> DataFrame:
    """Adds fee (in 1e-4) and slippage (in price); a product without costs raises when read. Spark broadcasts
    the costs where their size allows it."""
    met = df.join(costs, product, "left")
    return met.withColumn("fee", F.when(F.col("fee").isNotNull(), F.col("fee")).otherwise(F.raise_error(F.concat(F.lit("no costs declared for "), F.col(product).cast("string"))).cast("double")))


def profit(df: DataFrame, panel: Panel, open_: str, segment: str) -> DataFrame:
    """Adds gross, cost and net per bar: the position earns the move to the next open of its segment;
    each change of it costs the fee and the slippage over the open."""
    w = panel.rows()
    following = F.when(F.lead(segment).over(w) == F.col(segment), F.lead(open_).over(w))
    move = F.coalesce(F.when(F.col(open_) != 0, following / F.when(F.col(open_) != 0, F.col(open_)) - 1), F.lit(0.0))
    turn = F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0)))
    cost = turn * (F.col("fee") * 1e-4 + F.when(F.col(open_) != 0, F.col("slippage") / F.when(F.col(open_) != 0, F.col(open_))).otherwise(0.0))
    return df.withColumn("gross", F.col("position") * move).withColumn("turn", turn).withColumn("cost", cost).withColumn("net", F.col("gross") - F.col("cost"))


def fitness(metrics: DataFrame, per_key: DataFrame, key: str, least_trades: float = 20.0, least_time: float = 0.02, by: list[str] | None = None) -> DataFrame:
    """One row (for each value of ``by``): mean sharpe - 0.5 mean drawdown - 0.05 mean turnover, or INVALID where trades per key
    or time in the market are too few. per_key holds trades, turnover and time_in."""
    met = metrics.join(per_key, key)
    s = met.groupBy(*(by or [])).agg(F.avg("sharpe").alias("sharpe"), F.avg("max_drawdown").alias("drawdown"), F.avg("turnover").alias("turnover"), F.avg("trades").alias("trades"), F.avg("time_in").alias("time_in"))
    value = F.col("sharpe") - 0.5 * F.col("drawdown") - 0.05 * F.col("turnover")
    valid = (F.col("trades") >= least_trades) & (F.col("time_in") >= least_time)
    return s.withColumn("fitness", F.when(valid, value).otherwise(INVALID)).withColumn("valid", valid)


def correlation_gate(correlations: dict[tuple[str, str], float | None], order: list[str], constant: set[str], most: float = 0.7) -> list[str]:
    """Names kept greedily in order: no constant signal, none too close to a kept one. The table of
    pairs is as small as the pool."""
    kept: list[str] = []
    for name in order:
        near = [correlations.get((name, k), correlations.get((k, name))) for k in kept]
        if name not in constant and all(c is None or abs(c) <= most for c in near):
            kept.append(name)
    return kept


def rotate(held: set[str], ranked: list[str], keep: int, swap: int) -> tuple[list[str], list[str]]:
    """(sell, buy) of a top-``keep`` portfolio that exchanges at most ``swap`` names a day."""
    wanted = ranked[:keep]
    place = {name: i for i, name in enumerate(ranked)}
    out = sorted((n for n in held if n not in wanted), key=lambda n: -place.get(n, len(ranked)))[:swap]
    free = keep - len(held) + len(out)
    return out, [n for n in wanted if n not in held][: max(0, free)]
