"""A round of formula mining: seeds are searched on the training span, checked on the validation span, gated by
correlation, and the best one is run again a bar late to show what it owes to the present bar.

A generation is one plan: its formulas become rows (formula, series, bar), so bands, positions, profit and measures of all
of them are computed together.
"""

from __future__ import annotations

import datetime
import random
from collections import Counter
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions import kernels as K
from meridia.functions.compile import Dialect, Panel, compile_formulas
from meridia.functions.expr import Node, Space, features_of, parse_sexpr, random_tree, tree_hash
from meridia.operators import backtest, stats
from meridia.operators.search import evolve
from meridia.sources.stores import TrialLedger

Span = tuple[datetime.date, datetime.date]


@dataclass(frozen=True)
class Trading:
    """How signals are traded: quantile bands of the rows before, longest hold, and what makes a result count."""

    lookback: int = 240
    least: int = 60
    low: float = 0.1
    high: float = 0.9
    max_hold: int = 240
    least_trades: float = 20.0
    least_time: float = 0.02


def signals(bars: DataFrame, trees: list[Node], dialect: Dialect, panel: Panel) -> DataFrame:
    """Rows of bars for each formula, with ``formula`` (its number) and ``signal``."""
    staged = compile_formulas(bars, {f"__t{i}": t for i, t in enumerate(trees)}, dialect, panel)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("formula"), F.col(f"__t{i}").alias("signal")) for i in range(len(trees))]))
    return staged.select(*bars.columns, each.alias("__s")).select(*bars.columns, "__s.formula", "__s.signal")


def fitness_of(bars: DataFrame, trees: list[Node], costs: DataFrame, panel: Panel, span: Span, trading: Trading | None = None, dialect: Dialect = K.MINING, day: str = "day", segment: str = "seg", open_: str = "open", locked: str = "lock") -> list[float]:
    """Fitness of each formula on the days of a span (both ends included). Signals see the bars before the span; bands and
    positions start with it. ``bars`` holds product, day, segment and lock beside what formulas read."""
    t = trading or Trading()
    rows = signals(bars, trees, dialect, panel).where(F.col(day).between(F.lit(span[0]), F.lit(span[1])))
    p = Panel(("formula", *panel.series), panel.order, panel.section)
    low, high = backtest.bands("signal", p, t.lookback, t.least, t.low, t.high)
    held = backtest.with_positions(rows.withColumn("__lo", low).withColumn("__hi", high), p, "signal", "__lo", "__hi", locked, segment, t.max_hold)
    paid = backtest.profit(backtest.with_costs(held, costs), p, open_, segment)
    daily = paid.groupBy("formula", "product", day).agg(F.sum("net").alias("net"), F.sum("turn").alias("turn"), F.sum((F.col("position") != 0).cast("double")).alias("inside"), F.count("*").alias("n"))
    daily = daily.withColumn("__key", F.struct("formula", "product"))
    measures = stats.daily_metrics(daily, "__key", day, "net")
    use = daily.groupBy("__key").agg(F.sum("turn").alias("trades"), F.avg("turn").alias("turnover"), (F.sum("inside") / F.sum("n")).alias("time_in"))
    found = backtest.fitness(measures.withColumn("formula", F.col("__key.formula")), use, "__key", t.least_trades, t.least_time, by=["formula"])
    value = {r.formula: float(r.fitness) for r in found.select("formula", "fitness").collect()}
    return [value.get(i, backtest.INVALID) for i in range(len(trees))]


def a_bar_late(bars: DataFrame, features: list[str], panel: Panel) -> DataFrame:
    """Bars whose features are those of the bar before in the series."""
    w = Window.partitionBy(*panel.series).orderBy(*panel.order)
    return bars.select(*[F.lag(c).over(w).alias(c) if c in features else F.col(c) for c in bars.columns])


@dataclass
class Candidate:
    seed_id: str
    formula: str
    hash: str
    train_fitness: float
    validation_fitness: float
    accepted: bool = False
    reject_reason: str = ""


@dataclass
class Round:
    round_id: str
    candidates: list[Candidate] = field(default_factory=list)
    shifted_fitness: float = float("nan")

    @property
    def best_validation(self) -> float:
        return max((c.validation_fitness for c in self.candidates), default=float("nan"))


def gate(bars: DataFrame, trees: list[Node], dialect: Dialect, panel: Panel, most: float = 0.7) -> list[str]:
    """For each formula in turn "" if it joins the pool, else why not: it is constant, or too close to one that joined. Over
    all bars, in one aggregation of sums."""
    staged = compile_formulas(bars, {f"__t{i}": t for i, t in enumerate(trees)}, dialect, panel)
    pairs = [(i, j) for i in range(len(trees)) for j in range(i)]
    row = staged.agg(*[F.stddev_pop(f"__t{i}").alias(f"s{i}") for i in range(len(trees))], *[K.correlation(F.col(f"__t{i}"), F.col(f"__t{j}")).alias(f"c{i}_{j}") for i, j in pairs]).first()
    kept, why = [], []
    for i in range(len(trees)):
        near = [(abs(row[f"c{i}_{j}"]), j) for j in kept if row[f"c{i}_{j}"] is not None]
        if not row[f"s{i}"] or row[f"s{i}"] <= 1e-12:
            why.append("constant signal")
        elif near and max(near)[0] > most:
            why.append(f"|corr| {max(near)[0]:.2f} with {tree_hash(trees[max(near)[1]])[:8]}")
        else:
            kept.append(i)
            why.append("")
    return why


def run_mining_round(bars: DataFrame, costs: DataFrame, seeds: dict[str, str], space: Space, panel: Panel, train: Span, validation: Span, root: str | None = None, ledger: TrialLedger | None = None, trading: Trading | None = None, generations: int = 3, population: int = 8, most: float = 0.7, warm: bool = True, seed: int = 42, round_id: str = "round", dialect: Dialect = K.MINING) -> Round:
    """Searches from each seed formula (or, without ``warm``, from a random one), scores the best on the validation span,
    offers it to the pool in the order of the seeds, and scores the best candidate with features a bar late on the training span.
    Trials go to ``ledger`` and candidates to a table under ``root``, where these are given."""
    out, trees = Round(round_id), []
    spark = bars.sparkSession

    def scorer(seed_id: str, span: Span, split: str) -> Callable[[list[Node]], list[float]]:
        def score(generation: list[Node]) -> list[float]:
            values = fitness_of(bars, generation, costs, panel, span, trading, dialect)
            if ledger is not None:
                for t, v in zip(generation, values, strict=True):
                    ledger.log("gp_eval", str(t), round_id, seed_id=seed_id, split=split, stat=v)
            return values

        return score

    for k, (seed_id, text) in enumerate(seeds.items()):
        rng = random.Random(seed + k)
        start = parse_sexpr(text) if warm else random_tree(space, rng)
        best, value, _ = evolve(start, space, scorer(seed_id, train, "train"), generations, population, rng=rng)
        (checked,) = scorer(seed_id, validation, "validation")([best])
        trees.append(best)
        out.candidates.append(Candidate(seed_id, str(best), tree_hash(best), value, checked))
    if trees:
        for c, why in zip(out.candidates, gate(bars, trees, dialect, panel, most), strict=True):
            c.accepted, c.reject_reason = not why, why
        top = max(range(len(trees)), key=lambda i: out.candidates[i].train_fitness)
        late = a_bar_late(bars, features_of(trees[top]), panel)
        (out.shifted_fitness,) = fitness_of(late, [trees[top]], costs, panel, train, trading, dialect)
    if root is not None and out.candidates:
        rows = [{"round_id": round_id, "warm": warm, "shifted_fitness": out.shifted_fitness, **asdict(c)} for c in out.candidates]
        ddl = "round_id string, warm boolean, shifted_fitness double, seed_id string, formula string, hash string, train_fitness double, validation_fitness double, accepted boolean, reject_reason string"
        spark.createDataFrame(rows, ddl).write.mode("append").parquet(root)
    if ledger is not None:
        ledger.flush()
    return out


def most_common(counts: Counter, capacity: int, mutual: Callable[[str, str], float] | None = None, most: float = 1.0) -> list[str]:
    """The ``capacity`` formulas seen most often (ties: the first seen), each no closer than ``most`` to those kept."""
    kept: list[str] = []
    for name, _ in counts.most_common(capacity if mutual is None else None):
        if mutual is None or all(abs(mutual(k, name)) <= most for k in kept):
            kept.append(name)
            if len(kept) >= capacity:
                break
    return kept
