import random

import pytest

from meridia.functions import kernels as K
from meridia.functions.compile import Panel, compile_formulas
from meridia.functions.expr import (
    FormulaError, Space, canonical, const, depth, feature, free_arguments, largest_common_subtree, lift_parameters, parse_infix, parse_sexpr, point_mutate, random_tree, replace, same_place_crossover, shape, size, subtree, tree_hash, walk,
)


def test_infix_precedence_and_calls():
    assert str(parse_infix("$a + $b * 2 > 1 && !$c" .replace("!", ""))) == "(AND (GT (ADD a (MULTIPLY b 2)) 1) c)"
    assert str(parse_infix("$a > 0 ? -$b : $c")) == "(WHERE (GT a 0) (NEG b) c)"
    assert str(lift_parameters(parse_infix("TS_MEAN($close, 5)"), {"TS_MEAN": 1})) == "(TS_MEAN :5 close)"
    assert str(lift_parameters(parse_infix("Ref($close,-20)/$close-1"), {"Ref": 1})) == "(SUBTRACT (DIVIDE (Ref :-20 close) close) 1)"


@pytest.mark.parametrize("bad", ["$a +", "($a", "$a)", "$a ++ * $b", "MEAN($a", "@a", "1 2"])
def test_bad_formulas(bad):
    with pytest.raises(FormulaError):
        parse_infix(bad)


def test_canonical_form():
    a, b = parse_sexpr("(add close (mul 2 0.5))"), parse_sexpr("(add 1 close)")
    assert canonical(a) == canonical(b) and tree_hash(a) == tree_hash(b)
    assert str(canonical(parse_sexpr("(neg (neg close))"))) == "close"
    assert str(canonical(parse_sexpr("(abs (abs close))"))) == "(abs close)"
    for seed in range(30):
        t = random_tree(Space(("close", "volume")), random.Random(seed), 5)
        assert canonical(canonical(t)) == canonical(t)
        assert parse_sexpr(str(t)) == t


def test_tree_tools():
    t = parse_sexpr("(sub (ts_mean :3 close) (neg volume))")
    assert (size(t), depth(t)) == (5, 3)
    assert str(subtree(t, (1, 0))) == "volume"
    assert str(replace(t, (1,), const(1))) == "(sub (ts_mean :3 close) 1)"
    assert free_arguments(t) == 1
    assert largest_common_subtree(t, parse_sexpr("(add 1 (ts_mean :3 close))")) == 2
    assert [str(n) for _, n in walk(feature("x"))] == ["x"]


def test_mutation_keeps_shape():
    rng, space = random.Random(1), Space(("close", "volume"))
    t = parse_sexpr("(sub (ts_mean :60 close) (ts_mean :480 close))")
    for _ in range(50):
        m = point_mutate(t, space, rng)
        assert shape(m) == shape(t) and m != t
        assert shape(same_place_crossover(t, m, rng)) == shape(t)
    with pytest.raises(FormulaError):
        same_place_crossover(t, feature("close"), rng)


def test_shared_subtrees_are_staged_once(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(8)], "product int, t int, close double")
    panel = Panel(("product",), ("t",), ("t",))
    trees = {"a": parse_sexpr("(neg (ts_mean :3 close))"), "b": parse_sexpr("(add 1 (ts_mean :3 close))")}
    out = compile_formulas(df, trees, K.MINING, panel)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("windowspecdefinition") == 2  # one average and the count that guards it
    assert [r.a for r in out.orderBy("t").collect()] == [0, 0, -1, -2, -3, -4, -5, -6]
    with pytest.raises(FormulaError):
        compile_formulas(df, {"x": parse_sexpr("(nothing close)")}, K.MINING, panel)


def test_division_and_bounds_never_raise(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 2, None), (1, 3, float("nan")), (1, 4, 1e300)], "product int, t int, close double")
    out = compile_formulas(df, {"d": parse_sexpr("(div 1 close)"), "m": parse_sexpr("(mul close close)")}, K.MINING, Panel(("product",), ("t",), ("t",)))
    assert [(r.d, r.m) for r in out.orderBy("t").collect()] == [(0, 0), (0, 0), (0, 0), (1e-6, 1e6)]


def test_constant_window_has_no_correlation(spark):
    df = spark.createDataFrame([(1, i, 2.0, float(i)) for i in range(6)], "instrument int, date int, close double, volume double")
    tree = lift_parameters(parse_infix("TS_CORR($close, $volume, 3)"), K.INFIX_SERIES)
    out = compile_formulas(df, {"c": tree}, K.INFIX, Panel())
    assert [r.c for r in out.collect()] == [None] * 6
