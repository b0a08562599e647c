"""Formula trees to DataFrame columns.

A tree is compiled bottom up. Operators without a window become column expressions; each distinct
windowed subtree becomes one staged column, whatever number of formulas use it, so a population of
formulas is one plan over one scan and one sort.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.expr import FormulaError, Node, canonical, expand, walk


@dataclass(frozen=True)
class Panel:
    """Which columns partition series, order them, and name the cross-section."""

    series: tuple[str, ...] = ("instrument",)
    order: tuple[str, ...] = ("date",)
    section: tuple[str, ...] = ("date",)

    def rows(self, low: int | None = None, high: int = 0):
        w = Window.partitionBy(*self.series).orderBy(*self.order)
        return w if low is None else w.rowsBetween(low, high)

    def last(self, d: int):
        return self.rows(-(d - 1), 0)

    def cross(self):
        return Window.partitionBy(*self.section)


@dataclass(frozen=True)
class Operator:
    """``make(panel, columns, params)``; windowed results are staged before use."""

    make: Callable[[Panel, list[Column], tuple], Column]
    series: int
    windowed: bool = False
    params: int = 0


@dataclass(frozen=True)
class Dialect:
    name: str
    operators: dict[str, Operator]
    finish: Callable[[Column], Column] = staticmethod(lambda c: c)
    sequential: frozenset[str] = frozenset()
    macros: dict = field(default_factory=dict)


def compile_formulas(df: DataFrame, formulas: dict[str, Node], dialect: Dialect, panel: Panel) -> DataFrame:
    """df with a column per formula. Sequential operators (exponential averages) of all formulas run in one Arrow
    pass over the series, or one for each level where they lie within each other; all else stays in the JVM."""
    staged: dict[str, Column] = {}
    state = {"df": df, "n": 0}

    def stage(column: Column) -> Column:
        name = f"__f{state['n']}"
        state["n"] += 1
        state["df"] = state["df"].withColumn(name, column)
        return F.col(name)

    def build(n: Node) -> Column:
        if n.op == "feature":
            return dialect.finish(F.col(n.params[0]).cast("double"))
        if n.op == "const":
            return F.lit(float(n.params[0]))
        key = str(canonical(n))
        if key in staged:
            return staged[key]
        op = dialect.operators.get(n.op)
        if op is None:
            raise FormulaError(f"{dialect.name} has no operator {n.op}")
        if len(n.children) != op.series or len(n.params) < op.params:
            raise FormulaError(f"{n.op} takes {op.series} series and {op.params} numbers")
        kids = [build(c) for c in n.children]
        if op.windowed:
            # window functions don't nest: arguments come first
            kids = [k if c.op in ("feature", "const") else stage(k) for k, c in zip(kids, n.children, strict=True)]
        made = op.make(panel, kids, n.params)
        # staged before the finish, which reads its argument several times
        made = dialect.finish(stage(made) if op.windowed else made)
        staged[key] = made
        return made

    def level(n: Node) -> int:
        return (n.op in dialect.sequential) + max(map(level, n.children), default=0)

    trees = {name: expand(tree, dialect.macros) for name, tree in formulas.items()}
    found = {str(canonical(n)): n for tree in trees.values() for _, n in walk(tree) if n.op in dialect.sequential}
    for depth in sorted({level(n) for n in found.values()}):
        from meridia.operators.sequential import exponentials

        wanted, sources = {}, {}
        for key, n in found.items():
            if level(n) == depth:
                op = dialect.operators[n.op]
                if len(n.children) != op.series or len(n.params) < op.params:
                    raise FormulaError(f"{n.op} takes {op.series} series and {op.params} numbers")
                child = str(canonical(n.children[0]))
                if child not in sources:
                    stage(build(n.children[0]))
                    sources[child] = f"__f{state['n'] - 1}"
                wanted[key] = (f"__e{len(wanted)}_{depth}", sources[child], *op.make(panel, [], n.params))
        state["df"] = exponentials(state["df"], panel, {name: (source, kind, number) for name, source, kind, number in wanted.values()})
        for key, (name, *_) in wanted.items():
            staged[key] = stage(dialect.finish(F.col(name)))
    built = {name: build(tree) for name, tree in trees.items()}
    out = state["df"]
    return out.select(*df.columns, *[c.alias(name) for name, c in built.items()])
