"""Formula search: a driver loop that scores whole generations in one Spark job each."""

from __future__ import annotations

import json
import random
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.functions.compile import Dialect, Panel, compile_formulas
from meridia.functions.expr import Node, Space, parse_sexpr, point_mutate, same_place_crossover, tree_hash


def evolve(seed: Node, space: Space, score: Callable[[list[Node]], list[float]], generations: int = 5, population: int = 16, tournament: int = 4, patience: int = 3, rng: random.Random | None = None) -> tuple[Node, float, list[float]]:
    """Frozen-structure search from one formula: point mutations first, then half same-place crossover,
    four tenths mutation and copies; the best survives, duplicates by canonical hash are drawn again.
    ``score`` gets a generation at once, so one plan evaluates it. Returns best, score, history."""
    rng = rng or random.Random(0)
    known: dict[str, float] = {}

    def scored(trees: list[Node]) -> list[float]:
        new = {tree_hash(t): t for t in trees if tree_hash(t) not in known}
        if new:
            known.update(zip(new, score(list(new.values())), strict=True))
        return [known[tree_hash(t)] for t in trees]

    def fresh(make: Callable[[], Node], taken: set[str]) -> Node:
        for _ in range(20):
            tree = make()
            if tree_hash(tree) not in taken:
                break
        taken.add(tree_hash(tree))
        return tree

    taken = {tree_hash(seed)}
    trees = [seed] + [fresh(lambda: point_mutate(seed, space, rng), taken) for _ in range(population - 1)]
    values = scored(trees)
    history = [max(values)]
    still = 0
    for _ in range(generations - 1):
        pick = lambda: trees[max(rng.sample(range(len(trees)), min(tournament, len(trees))), key=values.__getitem__)]

        def child() -> Node:
            u = rng.random()
            if u < 0.5:
                return same_place_crossover(pick(), pick(), rng)
            return point_mutate(pick(), space, rng) if u < 0.9 else pick()

        best = trees[int(np.argmax(values))]
        taken = {tree_hash(best)}
        trees = [best] + [fresh(child, taken) for _ in range(population - 1)]
        values = scored(trees)
        still = 0 if max(values) > history[-1] else still + 1
        history.append(max(values))
        if still >= patience:
            break
    k = int(np.argmax(values))
    return trees[k], values[k], history


def optimise_weights(mutual: np.ndarray, ic: np.ndarray, l1: float = 0.005, steps: int = 500, rate: float = 0.05) -> np.ndarray:
    """Weights of a linear pool that maximise the pool's correlation with the target, given each
    alpha's and all mutual correlations: proximal gradient on w'Mw - 2 w'ic + l1 |w|."""
    w = ic.copy()
    step = rate / max(np.linalg.norm(mutual, 2), 1e-9) * 10
    for _ in range(steps):
        w = w - step * (mutual @ w - ic)
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
    return w


def least_squares_weights(mutual: np.ndarray, ic: np.ndarray) -> np.ndarray:
    """Weights of least squares, of least size where several fit."""
    return np.linalg.lstsq(mutual, ic, rcond=None)[0]


def steady_weights(mutual: np.ndarray, daily: np.ndarray, objective: str = "icir", beta: float = 1.0, l1: float = 0.005, steps: int = 400, rate: float = 0.02) -> np.ndarray:
    """Weights that raise the pool's daily correlations (days, alphas) with the target together: mean over deviation ("icir"), or the
    mean less ``beta`` deviations ("lcb"), less l1 |w|; by Adam from the mean correlations. The pool is scaled by w'Mw."""
    w = daily.mean(axis=0) + 1e-6
    first, second = np.zeros_like(w), np.zeros_like(w)
    best, top = w.copy(), -np.inf

    def value(v: np.ndarray) -> float:
        pool = daily @ v / np.sqrt(max(float(v @ mutual @ v), 1e-12))
        spread = pool.std() + 1e-9
        return float(pool.mean() / spread if objective == "icir" else pool.mean() - beta * spread)

    for step in range(1, steps + 1):
        here = value(w)
        if here > top:
            best, top = w.copy(), here
        slope = np.array([(value(w + e) - value(w - e)) / 2e-5 for e in np.eye(len(w)) * 1e-5]) - l1 * np.sign(w)
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope * slope
        w = w + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return best if value(w) < top else w


class AlphaPool:
    """A bounded pool: a new alpha too close to a member is refused; beyond the capacity the one of
    least weight goes."""

    def __init__(self, capacity: int = 10, most_mutual: float = 0.99):
        self.capacity, self.most_mutual = capacity, most_mutual
        self.names: list[str] = []
        self.ic = np.empty(0)
        self.mutual = np.empty((0, 0))
        self.weights = np.empty(0)

    def add(self, name: str, ic: float, with_members: np.ndarray) -> bool:
        if len(with_members) and np.abs(with_members).max() > self.most_mutual:
            return False
        n = len(self.names)
        grown = np.eye(n + 1)
        grown[:n, :n], grown[n, :n], grown[:n, n] = self.mutual, with_members, with_members
        self.names, self.ic, self.mutual = [*self.names, name], np.append(self.ic, ic), grown
        self.weights = optimise_weights(self.mutual, self.ic)
        if len(self.names) > self.capacity:
            self.leave([i for i in range(len(self.names)) if i != int(np.argmin(np.abs(self.weights)))])
        return name in self.names

    def leave(self, kept: list[int]) -> None:
        self.names, self.ic = [self.names[i] for i in kept], self.ic[kept]
        self.mutual = self.mutual[np.ix_(kept, kept)]
        self.weights = optimise_weights(self.mutual, self.ic)

    def to_json(self) -> str:
        """Formulas and weights."""
        return json.dumps({"exprs": self.names, "weights": [float(w) for w in self.weights]})

    def value(self) -> float:
        bottom = float(self.weights @ self.mutual @ self.weights)
        return float(self.weights @ self.ic) / np.sqrt(bottom) if bottom > 0 else 0.0


def load_pool(text: str) -> list[tuple[Node, float]]:
    """Formulas, as trees, and weights of a pool's JSON."""
    state = json.loads(text)
    return [(parse_sexpr(e), float(w)) for e, w in zip(state["exprs"], state["weights"], strict=True)]


def combine(df: DataFrame, pool: list[tuple[Node, float]], dialect: Dialect, panel: Panel, name: str = "alpha") -> DataFrame:
    """df with the pool's weighted sum; a row where any member is null has none."""
    staged = compile_formulas(df, {f"__p{i}": t for i, (t, _) in enumerate(pool)}, dialect, panel)
    total = sum((F.col(f"__p{i}") * w for i, (_, w) in enumerate(pool)), F.lit(0.0))
    return staged.select(*df.columns, total.alias(name))


class BestUnique:
    """A bounded collection of distinct items with the best scores."""

    def __init__(self, capacity: int):
        self.capacity, self.items = capacity, {}

    def push(self, score: float, item: str) -> None:
        if score > self.items.get(item, float("-inf")):
            self.items[item] = score
            if len(self.items) > self.capacity:
                del self.items[min(self.items, key=lambda k: (self.items[k], k))]

    def ranked(self) -> list[tuple[str, float]]:
        return sorted(self.items.items(), key=lambda kv: (-kv[1], kv[0]))
