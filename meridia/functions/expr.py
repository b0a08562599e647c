"""Formula trees, their three spellings, and their normal form.

A node is an operator with child nodes and literal parameters. Trees are written as calls with
symbols (``Mean($close,20d)``), as infix formulas (``TS_MEAN($close, 5) > 1 ? $a : -$b``) or as
S-expressions (``(ts_mean :60 close)``).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass


class FormulaError(ValueError):
    """A formula that can't be read, or that holds an unknown operator or a wrong number of arguments."""


@dataclass(frozen=True)
class Node:
    """``op`` with children and literal parameters; leaves are ``feature`` (name) and ``const`` (number)."""

    op: str
    children: tuple[Node, ...] = ()
    params: tuple = ()

    def __str__(self) -> str:
        if self.op == "feature":
            return self.params[0]
        if self.op == "const":
            return f"{self.params[0]:g}"
        head = self.op + "".join(f" :{p}" for p in self.params)
        return f"({' '.join([head, *map(str, self.children)])})"


def feature(name: str) -> Node:
    return Node("feature", (), (name,))


def const(value: float) -> Node:
    return Node("const", (), (float(value),))


def call(op: str, *children: Node, params: tuple = ()) -> Node:
    return Node(op, tuple(children), tuple(params))


def size(n: Node) -> int:
    return 1 + sum(map(size, n.children))


def depth(n: Node) -> int:
    return 1 + max(map(depth, n.children), default=0)


def walk(n: Node, path: tuple[int, ...] = ()) -> Iterator[tuple[tuple[int, ...], Node]]:
    """All nodes with their paths, parents first."""
    yield path, n
    for i, c in enumerate(n.children):
        yield from walk(c, (*path, i))


def subtree(n: Node, path: tuple[int, ...]) -> Node:
    for i in path:
        n = n.children[i]
    return n


def replace(n: Node, path: tuple[int, ...], new: Node) -> Node:
    if not path:
        return new
    i = path[0]
    return Node(n.op, (*n.children[:i], replace(n.children[i], path[1:], new), *n.children[i + 1 :]), n.params)


def shape(n: Node) -> tuple:
    """The tree without contents: what frozen-structure search keeps."""
    return tuple(map(shape, n.children))


COMMUTATIVE = {"add", "mul", "min2", "max2", "ADD", "MULTIPLY", "MAX", "MIN", "Add", "Mul", "Greater", "Less"}
INVOLUTIONS = {"neg"}
IDEMPOTENT = {"abs", "sign"}
_FOLD = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b,
    "min2": min, "max2": max, "neg": lambda a: -a, "abs": abs,
}


def canonical(n: Node) -> Node:
    """Constants folded, double negation undone, abs and sign not repeated, commutative children sorted."""
    kids = tuple(map(canonical, n.children))
    if n.op in _FOLD and kids and all(k.op == "const" for k in kids):
        return const(_FOLD[n.op](*(k.params[0] for k in kids)))
    if n.op in INVOLUTIONS and kids[0].op == n.op:
        return kids[0].children[0]
    if n.op in IDEMPOTENT and kids[0].op == n.op:
        return kids[0]
    if n.op in COMMUTATIVE:
        kids = tuple(sorted(kids, key=str))
    return Node(n.op, kids, n.params)


def tree_hash(n: Node) -> str:
    """128-bit hash of the canonical spelling."""
    return hashlib.blake2b(str(canonical(n)).encode(), digest_size=16).hexdigest()


def features_of(n: Node) -> list[str]:
    return sorted({m.params[0] for _, m in walk(n) if m.op == "feature"})


def largest_common_subtree(a: Node, b: Node) -> int:
    """Nodes of the largest subtree that both hold, up to the order of commutative children."""
    mine = {str(canonical(m)): size(m) for _, m in walk(a)}
    return max((size(m) for _, m in walk(b) if str(canonical(m)) in mine), default=0)


def free_arguments(n: Node) -> int:
    """Literal numbers in a formula: constants and parameters."""
    return sum((m.op == "const") + (len(m.params) if m.op not in ("feature", "const") else 0) for _, m in walk(n))


# --- S-expressions -------------------------------------------------------------------------------

def parse_sexpr(text: str) -> Node:
    tokens = re.findall(r"[()]|[^\s()]+", text)

    def read(i: int) -> tuple[Node, int]:
        if i >= len(tokens):
            raise FormulaError("the formula ends too soon")
        t = tokens[i]
        if t == ")":
            raise FormulaError("a parenthesis closes nothing")
        if t != "(":
            try:
                return const(float(t)), i + 1
            except ValueError:
                return feature(t), i + 1
        op, i, params, kids = tokens[i + 1], i + 2, [], []
        while i < len(tokens) and tokens[i] != ")":
            if tokens[i].startswith(":"):
                params.append(int(tokens[i][1:]))
                i += 1
            else:
                kid, i = read(i)
                kids.append(kid)
        if i >= len(tokens):
            raise FormulaError("a parenthesis isn't closed")
        return Node(op, tuple(kids), tuple(params)), i + 1

    node, end = read(0)
    if end != len(tokens):
        raise FormulaError("something follows the formula")
    return node


# --- Infix formulas: precedence climbing -----------------------------------------------------------

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?d?|\.\d+)|(\$?[A-Za-z_]\w*)|(&&|\|\||[<>=!]=|[-+*/<>?:(),&|]))")
_BINARY = {
    "||": (1, "OR"), "|": (1, "OR"), "&&": (2, "AND"), "&": (2, "AND"),
    "==": (3, "EQ"), "!=": (3, "NE"), "<": (4, "LT"), ">": (4, "GT"), "<=": (4, "LE"), ">=": (4, "GE"),
    "+": (5, "ADD"), "-": (5, "SUBTRACT"), "*": (6, "MULTIPLY"), "/": (6, "DIVIDE"),
}


def tokenize(text: str) -> list[str]:
    out, i = [], 0
    text = text.rstrip()
    while i < len(text):
        m = _TOKEN.match(text, i)
        if not m:
            raise FormulaError(f"can't read {text[i : i + 10]!r}")
        out.append(m[1] or m[2] or m[3])
        i = m.end()
    return out


def parse_infix(text: str) -> Node:
    """Operators by rising strength: ``?:``, or, and, equality, order, ``+ -``, ``* /``, signs, calls.
    ``$x`` and bare names are features; TRUE, FALSE, NAN and NULL are constants; ``20d`` is 20."""
    tokens = tokenize(text)
    at = 0

    def peek() -> str | None:
        return tokens[at] if at < len(tokens) else None

    def take(want: str | None = None) -> str:
        nonlocal at
        t = peek()
        if t is None or (want and t != want):
            raise FormulaError(f"expected {want or 'more'}, found {t or 'the end'}")
        at += 1
        return t

    def ternary() -> Node:
        test = binary(1)
        if peek() != "?":
            return test
        take("?")
        yes = ternary()
        take(":")
        return Node("WHERE", (test, yes, ternary()))

    def binary(least: int) -> Node:
        left = unary()
        while (t := peek()) in _BINARY and _BINARY[t][0] >= least:
            level, op = _BINARY[take()]
            left = Node(op, (left, binary(level + 1)))
        return left

    def unary() -> Node:
        if peek() == "-":
            take()
            inner = unary()
            return const(-inner.params[0]) if inner.op == "const" else Node("NEG", (inner,))
        if peek() == "+":
            take()
            return unary()
        return primary()

    def primary() -> Node:
        t = take()
        if t == "(":
            inner = ternary()
            take(")")
            return inner
        if t[0].isdigit() or t[0] == ".":
            return const(float(t.rstrip("d")))
        if not (t[0].isalpha() or t[0] in "$_"):
            raise FormulaError(f"{t!r} is out of place")
        if peek() == "(":
            take("(")
            args = []
            while peek() != ")":
                args.append(ternary())
                if peek() != ")":
                    take(",")
            take(")")
            return Node(t, tuple(args))
        named = {"TRUE": 1.0, "FALSE": 0.0, "NAN": float("nan"), "NULL": float("nan")}
        return const(named[t]) if t in named else feature(t.lstrip("$"))

    node = ternary()
    if at != len(tokens):
        raise FormulaError(f"{tokens[at]!r} follows the formula")
    return node


def lift_parameters(n: Node, windows: dict[str, int]) -> Node:
    """Trailing constant arguments beyond an operator's number of series become parameters. A window that isn't a
    constant makes it the operator of the same name with ``_BY``, where there is one."""
    kids = tuple(lift_parameters(c, windows) for c in n.children)
    if windows.get(f"{n.op}_BY") == len(kids) and kids[-1].op != "const":
        return Node(f"{n.op}_BY", kids, n.params)
    k = windows.get(n.op)
    if k is None or len(kids) <= k:
        return Node(n.op, kids, n.params)
    rest = kids[k:]
    if any(r.op != "const" for r in rest):
        raise FormulaError(f"{n.op} takes numbers after {k} series")
    whole = tuple(int(r.params[0]) if float(r.params[0]).is_integer() else r.params[0] for r in rest)
    return Node(n.op, kids[:k], n.params + whole)


def expand(n: Node, macros: dict[str, object]) -> Node:
    """Replaces operators that are written in terms of others."""
    n = Node(n.op, tuple(expand(c, macros) for c in n.children), n.params)
    return expand(macros[n.op](n), {k: v for k, v in macros.items() if k != n.op}) if n.op in macros else n


# --- Random trees and their mutation ------------------------------------------------------------

@dataclass(frozen=True)
class Space:
    """What search may put at each place: features, constants, windows, and operators by arity and
    whether they take a window."""

    features: tuple[str, ...]
    constants: tuple[float, ...] = (-2.0, -1.0, -0.5, 0.5, 1.0, 2.0)
    windows: tuple[int, ...] = (5, 15, 30, 60, 120, 240, 480, 1200)
    plain: tuple[tuple[str, int], ...] = (("neg", 1), ("abs", 1), ("log1p", 1), ("sign", 1), ("add", 2), ("sub", 2), ("mul", 2), ("div", 2), ("min2", 2), ("max2", 2), ("gt", 2), ("lt", 2), ("if_then_else", 3))
    rolling: tuple[tuple[str, int], ...] = (("ts_sum", 1), ("ts_mean", 1), ("ts_std", 1), ("ts_min", 1), ("ts_max", 1), ("ts_delta", 1), ("ts_rank", 1), ("ts_zscore", 1), ("decay_linear", 1), ("ema", 1), ("ts_corr", 2))


def random_tree(space: Space, rng: random.Random, levels: int = 4) -> Node:
    if levels <= 1 or rng.random() < 0.2:
        return feature(rng.choice(space.features)) if rng.random() < 0.8 else const(rng.choice(space.constants))
    op, arity = rng.choice(space.plain + space.rolling)
    params = (rng.choice(space.windows),) if (op, arity) in space.rolling else ()
    return Node(op, tuple(random_tree(space, rng, levels - 1) for _ in range(arity)), params)


def point_mutate(n: Node, space: Space, rng: random.Random) -> Node:
    """One node's contents exchanged for others of its class; the shape stays."""
    other = lambda options, own: rng.choice([o for o in options if o != own] or [own])
    path, m = rng.choice(list(walk(n)))
    if m.op == "feature":
        new = feature(other(space.features, m.params[0]))
    elif m.op == "const":
        new = const(other(space.constants, m.params[0]))
    elif m.params and rng.random() < 0.5:
        new = Node(m.op, m.children, (other(space.windows, m.params[0]), *m.params[1:]))
    else:
        kind = space.rolling if m.params else space.plain
        new = Node(other([op for op, arity in kind if arity == len(m.children)], m.op), m.children, m.params)
    return replace(n, path, new)


def same_place_crossover(a: Node, b: Node, rng: random.Random) -> Node:
    """A subtree of b at the same place in a; both must have the same shape."""
    if shape(a) != shape(b):
        raise FormulaError("parents of different shapes")
    path, _ = rng.choice(list(walk(a)))
    return replace(a, path, subtree(b, path))
