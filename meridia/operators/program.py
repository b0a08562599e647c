"""Symbolic regression by program search: own operators, random programs, their variation, constraints, estimators.

Programs are formula trees. A generation is compiled into one plan: its columns are staged together and one
aggregation gives every program's fitness.
"""

from __future__ import annotations

import inspect
import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace as changed

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import kernels as K
from meridia.functions.compile import Dialect, Operator, Panel, compile_formulas
from meridia.functions.expr import FormulaError, Node, const, feature, replace, size, subtree, walk

# --- operators of one's own ------------------------------------------------------------------------


def with_operator(dialect: Dialect, name: str, function: Callable[..., Column], arity: int, spark=None) -> Dialect:
    """The dialect with one more operator: a function of ``arity`` columns that returns one. With a session it is tried
    on ones, zeros and negative numbers, and must give a finite number for each."""
    if not isinstance(arity, int) or isinstance(arity, bool) or arity < 1:
        raise FormulaError(f"an arity is a whole number from 1, not {arity!r}")
    if not isinstance(name, str) or not name.isidentifier():
        raise FormulaError(f"{name!r} isn't a name")
    if len(inspect.signature(function).parameters) != arity:
        raise FormulaError(f"{name} doesn't take {arity} columns")
    if not isinstance(function(*[F.lit(1.0)] * arity), Column):
        raise FormulaError(f"{name} doesn't return a column")
    if spark is not None:
        tried = spark.createDataFrame([(1.0,), (0.0,), (-1.0,)], "x double")
        try:
            got = [r.y for r in tried.select(function(*[F.col("x")] * arity).cast("double").alias("y")).collect()]
        except Exception as e:
            raise FormulaError(f"{name} fails on ones, zeros or negative numbers: {type(e).__name__}") from e
        if len(got) != 3 or any(y is None or not math.isfinite(y) for y in got):
            raise FormulaError(f"{name} isn't closed: {got}")
    return changed(dialect, operators={**dialect.operators, name: Operator(lambda p, k, a: function(*k), arity)})


# --- programs -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Library:
    """What programs are made of: a dialect's operators without windows, features, and a range of constants."""

    dialect: Dialect
    features: tuple[str, ...]
    operators: tuple[str, ...]
    constants: tuple[float, float] | None = (-1.0, 1.0)

    def arity(self, token: str | float) -> int:
        return self.dialect.operators[token].series if isinstance(token, str) and token in self.operators else 0

    def terminal(self, rng: random.Random) -> Node:
        k = rng.randrange(len(self.features) + (self.constants is not None))
        return feature(self.features[k]) if k < len(self.features) else const(rng.uniform(*self.constants))

    def build(self, rng: random.Random, depth: tuple[int, int] = (2, 6), method: str = "half and half") -> Node:
        """A random program with an operator at its root; ``full`` has all leaves at the drawn depth, ``grow`` may end
        branches before."""
        how = rng.choice(("full", "grow")) if method == "half and half" else method
        levels = rng.randint(*depth)

        def grow(level: int) -> Node:
            choices = len(self.operators) + len(self.features)
            if level < levels and (level == 0 or how == "full" or rng.randrange(choices) < len(self.operators)):
                op = rng.choice(self.operators)
                return Node(op, tuple(grow(level + 1) for _ in range(self.arity(op))))
            return self.terminal(rng)

        return grow(0)

    def valid(self, tree: Node) -> bool:
        for _, n in walk(tree):
            if n.op == "feature":
                ok = n.params[0] in self.features
            elif n.op == "const":
                ok = not n.children
            else:
                ok = n.op in self.operators and len(n.children) == self.arity(n.op)
            if not ok:
                return False
        return True


def pick(tree: Node, rng: random.Random) -> tuple[int, ...]:
    """Path of a random subtree; operators weigh nine times as much as leaves."""
    nodes = list(walk(tree))
    return rng.choices([p for p, _ in nodes], [9 if n.children else 1 for _, n in nodes])[0]


def crossover(a: Node, b: Node, rng: random.Random) -> Node:
    """A random subtree of b in place of one of a."""
    return replace(a, pick(a, rng), subtree(b, pick(b, rng)))


def subtree_mutation(a: Node, library: Library, rng: random.Random, depth: tuple[int, int] = (2, 6)) -> Node:
    return crossover(a, library.build(rng, depth), rng)


def hoist_mutation(a: Node, rng: random.Random) -> Node:
    """A subtree gives way to a subtree of its own, so the program doesn't grow."""
    path = pick(a, rng)
    own = subtree(a, path)
    return replace(a, path, subtree(own, pick(own, rng)))


def point_mutation(a: Node, library: Library, rng: random.Random, chance: float = 0.05) -> Node:
    """Each node, by chance, exchanged for another of the same arity; a leaf for any leaf."""
    kids = tuple(point_mutation(c, library, rng, chance) for c in a.children)
    if rng.random() >= chance:
        return Node(a.op, kids, a.params)
    if not kids:
        return library.terminal(rng)
    return Node(rng.choice([op for op in library.operators if library.arity(op) == len(kids)]), kids, a.params)


def to_prefix(tree: Node) -> list[str | float]:
    """Operators, feature names and numbers in prefix order."""
    return [n.params[0] if n.op in ("feature", "const") else n.op for _, n in walk(tree)]


def from_prefix(tokens: Sequence[str | float], library: Library) -> Node:
    """The tree of a prefix traversal, read once with a stack of open operators."""
    open_: list[tuple[str, int, list[Node]]] = []
    for i, t in enumerate(tokens):
        need = library.arity(t)
        if need:
            open_.append((t, need, []))
            continue
        if isinstance(t, str) and t not in library.features:
            raise FormulaError(f"unknown token {t}")
        done = feature(t) if isinstance(t, str) else const(t)
        while open_:
            op, n, kids = open_[-1]
            kids.append(done)
            if len(kids) < n:
                break
            open_.pop()
            done = Node(op, tuple(kids))
        else:
            if i + 1 < len(tokens):
                raise FormulaError("something follows the program")
            return done
    raise FormulaError("the program ends too soon")


# --- constraints on programs in the making ----------------------------------------------------------


@dataclass
class Prefix:
    """An unfinished prefix traversal: its tokens, and of the next place the ancestors, the parent and the siblings so far."""

    library: Library
    tokens: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.open: list[tuple[str, int, list[str]]] = []
        tokens, self.tokens = self.tokens, []
        for t in tokens:
            self.add(t)

    def add(self, token: str) -> None:
        self.tokens.append(token)
        if self.open:
            self.open[-1][2].append(token)
        if self.library.arity(token):
            self.open.append((token, self.library.arity(token), []))
        else:
            # a full operator closes, and with it any that waited for it as its last
            while self.open and len(self.open[-1][2]) == self.open[-1][1]:
                self.open.pop()

    @property
    def ancestors(self) -> list[str]:
        return [o[0] for o in self.open]

    @property
    def siblings(self) -> list[str]:
        return self.open[-1][2] if self.open else []

    @property
    def dangling(self) -> int:
        """Places to fill, the next one included."""
        return sum(o[1] - len(o[2]) for o in self.open) if self.tokens else 1


Constraint = Callable[[Prefix, list[str]], set[str]]


def length_between(least: int, most: int) -> Constraint:
    def forbid(p: Prefix, tokens: list[str]) -> set[str]:
        arity = p.library.arity
        # every open place costs a token at least
        long = {t for t in tokens if len(p.tokens) + p.dangling + arity(t) > most}
        return long | ({t for t in tokens if not arity(t)} if p.dangling == 1 and len(p.tokens) + 1 < least else set())

    return forbid


def not_within(inner: set[str], outer: set[str], how: str = "descendant") -> Constraint:
    """Tokens of ``inner`` don't come as descendant, child or sibling of those of ``outer``."""

    def forbid(p: Prefix, tokens: list[str]) -> set[str]:
        near = {"descendant": p.ancestors, "child": p.ancestors[-1:], "sibling": p.siblings}[how]
        return inner & set(tokens) if outer & set(near) else set()

    return forbid


def no_nested(group: set[str]) -> Constraint:
    """For instance no trigonometric function within another."""
    return not_within(group, group)


def no_inverse(pairs: dict[str, str]) -> Constraint:
    """A unary operator isn't the child of its inverse."""

    def forbid(p: Prefix, tokens: list[str]) -> set[str]:
        parent = p.ancestors[-1] if p.ancestors else None
        return {t for t in tokens if pairs.get(t) == parent and parent is not None or pairs.get(parent) == t}

    return forbid


def some_input(inputs: set[str]) -> Constraint:
    """The last place is an input if none came before."""

    def forbid(p: Prefix, tokens: list[str]) -> set[str]:
        last = p.dangling == 1 and not inputs & set(p.tokens)
        return {t for t in tokens if not p.library.arity(t) and t not in inputs} if last else set()

    return forbid


def repeated(token: str, most: int) -> Constraint:
    return lambda p, tokens: {token} if p.tokens.count(token) >= most else set()


def exclusive(a: set[str], b: set[str]) -> Constraint:
    """Tokens of one set only."""
    return lambda p, tokens: (b if a & set(p.tokens) else set()) | (a if b & set(p.tokens) else set())


def soft_length(centre: float, spread: float) -> Callable[[Prefix, str], float]:
    """Log-weight of a token: leaves lose before the centre length, operators beyond it."""

    def weigh(p: Prefix, token: str) -> float:
        gap = centre - (len(p.tokens) + p.dangling)
        away = -gap * gap / (2 * spread * spread)
        return away if (gap > 0) == (p.library.arity(token) == 0) and gap else 0.0

    return weigh


def even_arity(library: Library, tokens: list[str]) -> Callable[[Prefix, str], float]:
    """Log-weight that gives each arity the same chance, however many tokens it has."""
    count: dict[int, int] = {}
    for t in tokens:
        count[library.arity(t)] = count.get(library.arity(t), 0) + 1
    return lambda p, token: -math.log(count[library.arity(token)])


def choices(prefix: Prefix, tokens: list[str], constraints: list[Constraint], priors: Sequence[Callable[[Prefix, str], float]] = ()) -> dict[str, float]:
    """Chance of each token that no constraint forbids; where all are forbidden, of all leaves."""
    bad: set[str] = set().union(*(c(prefix, tokens) for c in constraints)) if constraints else set()
    left = [t for t in tokens if t not in bad] or [t for t in tokens if not prefix.library.arity(t)]
    weight = {t: math.exp(sum(p(prefix, t) for p in priors)) for t in left}
    return {t: w / sum(weight.values()) for t, w in weight.items()}


def sample(library: Library, constraints: list[Constraint], rng: random.Random, priors: Sequence[Callable[[Prefix, str], float]] = ()) -> Node:
    """A program drawn token by token."""
    p = Prefix(library)
    tokens = [*library.operators, *library.features]
    while p.dangling:
        chance = choices(p, tokens, constraints, priors)
        p.add(rng.choices(list(chance), list(chance.values()))[0])
    return from_prefix(p.tokens, library)


class Builder:
    """A formula from tokens in postfix order, with what may follow at each step.

    Tokens are ("feature", name), ("const", number), ("window", rows), ("tree", node) and ("operator", name). Operators
    with a window take it last, behind one or two series that aren't constant."""

    def __init__(self, dialect: Dialect):
        self.dialect, self.stack = dialect, []

    @staticmethod
    def _series(item) -> bool:
        return isinstance(item, Node) and any(n.op == "feature" for _, n in walk(item))

    def allowed(self, token: tuple[str, object]) -> bool:
        kind, value = token
        top = self.stack[-1] if self.stack else None
        if kind in ("feature", "tree"):
            return not isinstance(top, int)
        if kind == "const":
            return top is None or self._series(top)
        if kind == "window":
            return self._series(top)
        op = self.dialect.operators.get(value)
        if op is None:
            return False
        takes_window = op.windowed or value in self.dialect.sequential
        if len(self.stack) < op.series + takes_window:
            return False
        args = self.stack[len(self.stack) - op.series - takes_window :]
        if takes_window:
            return isinstance(args[-1], int) and all(map(self._series, args[:-1]))
        return not any(isinstance(a, int) for a in args) and any(map(self._series, args))

    def mask(self) -> dict[str, bool]:
        """Which kinds of leaves, and which operators, may come next."""
        return {k: self.allowed((k, None)) for k in ("feature", "const", "window")} | {op: self.allowed(("operator", op)) for op in self.dialect.operators}

    def add(self, token: tuple[str, object]) -> None:
        if not self.allowed(token):
            raise FormulaError(f"{token} isn't allowed here")
        kind, value = token
        if kind != "operator":
            self.stack.append({"feature": feature, "const": const, "window": int, "tree": lambda n: n}[kind](value))
            return
        op = self.dialect.operators[value]
        window = (self.stack.pop(),) if op.windowed or value in self.dialect.sequential else ()
        kids = tuple(self.stack[len(self.stack) - op.series :])
        del self.stack[len(self.stack) - op.series :]
        self.stack.append(Node(value, kids, window))

    @property
    def complete(self) -> bool:
        return len(self.stack) == 1 and self._series(self.stack[0])

    def tree(self) -> Node:
        if len(self.stack) != 1 or not isinstance(self.stack[0], Node):
            raise FormulaError(f"{len(self.stack)} parts in place of one formula")
        return self.stack[0]


# --- fitness and estimators -----------------------------------------------------------------------

#: Measures by name, as columns of truth, prediction and weight, and whether more is better.
METRICS: dict[str, tuple[Callable[[Column, Column, Column], Column], bool]] = {
    "mean absolute error": (lambda y, p, w: F.sum(w * F.abs(y - p)) / F.sum(w), False),
    "mse": (lambda y, p, w: F.sum(w * (y - p) * (y - p)) / F.sum(w), False),
    "rmse": (lambda y, p, w: F.sqrt(F.sum(w * (y - p) * (y - p)) / F.sum(w)), False),
    "log loss": (lambda y, p, w: -F.sum(w * (y * F.ln(_inside(p)) + (1 - y) * F.ln(1 - _inside(p)))) / F.sum(w), False),
    "pearson": (lambda y, p, w: F.abs(_weighted_correlation(y, p, w)), True),
}


def _inside(p: Column, tiny: float = 1e-15) -> Column:
    return F.least(F.lit(1 - tiny), F.greatest(F.lit(tiny), p))


def _weighted_correlation(y: Column, p: Column, w: Column) -> Column:
    n, my, mp = F.sum(w), F.sum(w * y) / F.sum(w), F.sum(w * p) / F.sum(w)
    both = F.sqrt((F.sum(w * y * y) / n - my * my) * (F.sum(w * p * p) / n - mp * mp))
    return F.coalesce(F.when(both > 1e-12, (F.sum(w * y * p) / n - my * mp) / F.when(both > 1e-12, both)), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.lit(700.0), F.greatest(F.lit(-700.0), x))))


def raw_fitness(df: DataFrame, trees: list[Node], library: Library, target: str, metric: str = "mean absolute error", weight: str | None = None, transform: Callable[[Column], Column] | None = None) -> list[float]:
    """Each program's measure on the rows, from one plan; null and non-finite values make it NaN."""
    staged = compile_formulas(df, {f"__t{i}": t for i, t in enumerate(trees)}, library.dialect, Panel())
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    measure = METRICS[metric][0]
    shown = transform or (lambda c: c)
    row = staged.agg(*[measure(F.col(target).cast("double"), shown(F.col(f"__t{i}")), w).alias(f"m{i}") for i in range(len(trees))]).first()
    return [float("nan") if v is None else float(v) for v in row]


def parsimony(sizes: Sequence[int], fitness: Sequence[float]) -> float:
    """The coefficient at which length and fitness of a population don't go together: their covariance over the lengths' variance."""
    ok = np.isfinite(fitness)
    length, value = np.asarray(sizes, float)[ok], np.asarray(fitness, float)[ok]
    return float(np.cov(length, value, ddof=0)[0, 1] / length.var()) if len(length) > 1 and length.var() > 0 else 0.0


class SymbolicRegressor:
    """Programs bred for a measure. ``chances`` are those of crossover, subtree, hoist and point mutation; the rest is copied.
    ``penalty`` is a number per node, or "auto" (see ``parsimony``)."""

    transform: Callable[[Column], Column] | None = None

    def __init__(self, library: Library, metric: str = "mean absolute error", population: int = 32, generations: int = 5, tournament: int = 5, chances: tuple[float, float, float, float] = (0.7, 0.1, 0.1, 0.05), penalty: float | str = 0.001, depth: tuple[int, int] = (2, 4), stop_at: float | None = None, seed: int = 0):
        self.library, self.metric, self.population, self.generations, self.tournament = library, metric, population, generations, tournament
        self.chances, self.penalty, self.depth, self.stop_at, self.seed = chances, penalty, depth, stop_at, seed

    def _score(self, df: DataFrame, trees: list[Node], target: str, weight: str | None) -> list[float]:
        return raw_fitness(df, trees, self.library, target, self.metric, weight, self.transform)

    def fit(self, df: DataFrame, target: str, weight: str | None = None) -> SymbolicRegressor:
        rng, more = random.Random(self.seed), METRICS[self.metric][1]
        sign = 1 if more else -1
        worst = float("-inf")
        trees = [self.library.build(rng, self.depth) for _ in range(self.population)]
        self.history: list[float] = []
        for generation in range(self.generations):
            raw = self._score(df, trees, target, weight)
            coefficient = abs(parsimony([size(t) for t in trees], raw)) if self.penalty == "auto" else float(self.penalty)
            value = [sign * r - coefficient * size(t) if math.isfinite(r) else worst for r, t in zip(raw, trees, strict=True)]
            best = max(range(len(trees)), key=value.__getitem__)
            self.best, self.fitness, self.trees, self.values = trees[best], raw[best], trees, value
            self.history.append(raw[best])
            reached = self.stop_at is not None and math.isfinite(raw[best]) and sign * raw[best] >= sign * self.stop_at
            if reached or generation + 1 == self.generations:
                break

            def parent() -> Node:
                return trees[max(rng.sample(range(len(trees)), min(self.tournament, len(trees))), key=value.__getitem__)]

            def child() -> Node:
                u, (a, b, c, d) = rng.random(), np.cumsum(self.chances)
                if u < a:
                    return crossover(parent(), parent(), rng)
                if u < b:
                    return subtree_mutation(parent(), self.library, rng, self.depth)
                if u < c:
                    return hoist_mutation(parent(), rng)
                return point_mutation(parent(), self.library, rng) if u < d else parent()

            trees = [trees[best]] + [child() for _ in range(self.population - 1)]
        return self

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        out = compile_formulas(df, {name: self.best}, self.library.dialect, Panel())
        return out.withColumn(name, self.transform(F.col(name))) if self.transform else out


class SymbolicClassifier(SymbolicRegressor):
    """Of two classes 0 and 1: the program's sigmoid is the chance of 1."""

    transform = staticmethod(sigmoid)

    def __init__(self, library: Library, **more):
        super().__init__(library, **{"metric": "log loss"} | more)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        out = super().predict(df, f"{name}_chance")
        return out.withColumn(name, (F.col(f"{name}_chance") >= 0.5).cast("int"))


class SymbolicTransformer(SymbolicRegressor):
    """Adds columns: of the ``hall`` best programs those ``components`` that go least together."""

    def __init__(self, library: Library, components: int = 4, hall: int = 12, **more):
        super().__init__(library, **{"metric": "pearson"} | more)
        self.components, self.hall = components, hall

    def fit(self, df: DataFrame, target: str, weight: str | None = None) -> SymbolicTransformer:
        super().fit(df, target, weight)
        order = sorted(range(len(self.trees)), key=lambda i: -self.values[i])
        seen, names = set(), []
        for i in order:
            if str(self.trees[i]) not in seen:
                seen.add(str(self.trees[i]))
                names.append(self.trees[i])
        kept = names[: self.hall]
        staged = compile_formulas(df, {f"__t{i}": t for i, t in enumerate(kept)}, self.library.dialect, Panel())
        pairs = [(i, j) for i in range(len(kept)) for j in range(i)]
        if pairs:
            row = staged.agg(*[F.abs(F.coalesce(K.correlation(F.col(f"__t{i}"), F.col(f"__t{j}")), F.lit(0.0))) for i, j in pairs]).first()
            near = {p: float(v or 0.0) for p, v in zip(pairs, row, strict=True)}
        left = list(range(len(kept)))
        while len(left) > self.components:
            # of the closest pair the worse one goes
            left.remove(max(((near[i, j], i) for i, j in pairs if i in left and j in left))[1])
        self.parts = [kept[i] for i in left]
        return self

    def transform_rows(self, df: DataFrame, prefix: str = "component") -> DataFrame:
        return compile_formulas(df, {f"{prefix}_{i}": t for i, t in enumerate(self.parts)}, self.library.dialect, Panel())
