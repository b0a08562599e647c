"""Program search, constraints, builders, mining, factor gates and the command line."""

import datetime
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia import cli
from meridia.functions import kernels as K
from meridia.functions.compile import Panel, compile_formulas
from meridia.functions.expr import FormulaError, Space, feature, lift_parameters, parse_infix, parse_sexpr, size, walk
from meridia.operators import mining, program as P, search, stats

LIB = P.Library(K.SYMBOLIC, ("x", "y"), ("add", "sub", "mul", "sin", "cos", "exp", "log"))


def test_own_operators(spark):
    d = P.with_operator(K.SYMBOLIC, "twice", lambda a: a * 2, 1, spark)
    df = spark.createDataFrame([(3.0,)], "x double")
    assert compile_formulas(df, {"v": parse_sexpr("(twice x)")}, d, Panel()).first().v == 6.0
    for name, f, arity, session in (("bad", lambda a: a, 2, None), ("bad", lambda a: 1.0, 1, None), ("b d", lambda a: a, 1, None), ("bad", lambda a: a, 0, None), ("bad", lambda a: F.ln(a), 1, spark), ("bad", lambda a: 1 / a, 1, spark)):
        with pytest.raises(FormulaError):
            P.with_operator(K.SYMBOLIC, name, f, arity, session)


def test_programs_stay_valid():
    rng = random.Random(1)
    for _ in range(200):
        a, b = LIB.build(rng), LIB.build(rng)
        for t in (a, b, P.crossover(a, b, rng), P.subtree_mutation(a, LIB, rng), P.hoist_mutation(a, rng), P.point_mutation(a, LIB, rng, 0.3)):
            assert LIB.valid(t)
            back = P.from_prefix(P.to_prefix(t), LIB)
            assert str(back) == str(t)
        assert size(P.hoist_mutation(a, rng)) <= size(a)
        assert a.op in LIB.operators
    for tokens in ([], ["add", "x"], ["x", "x"], ["add", "x", "z"]):
        with pytest.raises(FormulaError):
            P.from_prefix(tokens, LIB)


def test_constraints_hold_on_samples():
    rng, trig = random.Random(3), {"sin", "cos"}
    rules = [P.length_between(4, 12), P.no_nested(trig), P.no_inverse({"exp": "log", "log": "exp"}), P.some_input({"x"}), P.repeated("exp", 1), P.not_within({"y"}, {"log"}, "child")]
    for _ in range(300):
        t = P.sample(LIB, rules, rng, [P.soft_length(7, 3), P.even_arity(LIB, [*LIB.operators, *LIB.features])])
        names = P.to_prefix(t)
        assert 4 <= len(names) <= 12 and "x" in names and names.count("exp") <= 1
        for path, n in walk(t):
            if n.op in trig:
                assert not any(m.op in trig for p, m in walk(n) if p)
            for c in n.children:
                assert {n.op, c.op} != {"exp", "log"} and not (n.op == "log" and c.op == "feature" and c.params[0] == "y")
    one = P.exclusive({"sin"}, {"cos"})
    assert one(P.Prefix(LIB, ["sin"]), list(LIB.operators)) == {"cos"}
    p = P.Prefix(LIB, ["add", "sin", "x"])
    assert p.ancestors == ["add"] and p.siblings == ["sin"] and p.dangling == 1
    p.add("y")
    assert p.dangling == 0 and p.ancestors == []


def test_regressor_finds_a_product(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), float(a * b + a)) for a, b in rng.uniform(-2, 2, (300, 2))]
    df = spark.createDataFrame(rows, "x double, y double, t double")
    library = P.Library(K.SYMBOLIC, ("x", "y"), ("add", "sub", "mul"), None)
    m = P.SymbolicRegressor(library, population=60, generations=8, seed=4, penalty=0.001, stop_at=1e-9).fit(df, "t")
    assert m.fitness < 0.35 and m.history[-1] <= m.history[0]
    out = m.predict(df).select(F.avg(F.abs(F.col("prediction") - F.col("t"))).alias("e")).first().e
    assert out == pytest.approx(m.fitness, abs=1e-9)
    c = df.withColumn("c", (F.col("t") > 0).cast("int"))
    k = P.SymbolicClassifier(library, population=24, generations=3, seed=1).fit(c, "c")
    assert k.predict(c).where("prediction = c").count() > 200
    h = P.SymbolicTransformer(library, components=2, hall=6, population=24, generations=2, seed=2, penalty="auto").fit(df, "t")
    assert [x for x in h.transform_rows(df).columns if x.startswith("component")] == ["component_0", "component_1"]
    assert P.parsimony([1, 2, 3], [2.0, 4.0, 6.0]) == pytest.approx(2.0)


def test_builder_masks():
    b = P.Builder(K.DAILY)
    rolling = next(n for n, o in K.DAILY.operators.items() if o.windowed and o.series == 1)
    two = next(n for n, o in K.DAILY.operators.items() if not o.windowed and o.series == 2)
    assert b.mask()["feature"] and b.mask()["const"] and not b.mask()["window"] and not b.mask()[rolling]
    b.add(("feature", "close"))
    assert b.complete and b.mask()["window"] and not b.mask()[two]
    b.add(("window", 5))
    assert b.mask()[rolling] and not b.mask()["feature"] and not b.mask()[two] and not b.complete
    b.add(("operator", rolling))
    b.add(("const", 2.0))
    b.add(("operator", two))
    assert str(b.tree()) == f"({two} ({rolling} :5 close) 2)" and b.complete
    with pytest.raises(FormulaError):
        b.add(("operator", two))
    c = P.Builder(K.DAILY)
    c.add(("const", 1.0))
    assert not c.allowed(("const", 2.0)) and not c.complete


def test_bands_with_a_window_of_each_row(spark):
    rng = random.Random(2)
    rows = [("a", i, None if i % 7 == 3 else rng.uniform(0, 9), float(1 + i % 5) if i % 6 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "instrument string, date int, close double, n double")
    trees = {k: lift_parameters(parse_infix(f"BB_{k}($close, $n)"), K.INFIX_SERIES) for k in ("MIDDLE", "UPPER", "LOWER")}
    got = compile_formulas(df, trees, K.INFIX, Panel()).orderBy("date").collect()
    for i, r in enumerate(got):
        n = rows[i][3]
        own = [] if n is None else [x[2] for x in rows[max(0, i + 1 - int(n)) : i + 1] if x[2] is not None]
        if not own:
            assert r.MIDDLE is None
            continue
        assert r.MIDDLE == pytest.approx(np.mean(own))
        if len(own) > 1:
            assert r.UPPER - r.LOWER == pytest.approx(2 * np.std(own, ddof=1))


def bars(spark, days=16, n=60):
    rng, rows = np.random.default_rng(5), []
    for p in range(2):
        price = 100.0
        for d in range(days):
            for t in range(n):
                step = rng.normal() * 0.2
                price += step
                at = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, minutes=t)
                rows.append((p, at, at.date(), d, float(price), float(price - step), 0, float(rng.uniform(1, 9))))
    return spark.createDataFrame(rows, "product int, bob timestamp_ntz, day date, seg int, close double, open double, lock int, volume double")


def test_mining_round(spark, tmp_path):
    from meridia.sources.stores import TrialLedger

    df = bars(spark)
    costs = spark.createDataFrame([(0, 0.1, 0.0), (1, 0.1, 0.0)], "product int, fee double, slippage double")
    panel, space = Panel(("product",), ("bob",), ("bob",)), Space(("close", "volume"), windows=(3, 5, 8))
    seeds = {"cross": "(sub (ts_mean :3 close) (ts_mean :8 close))", "same": "(sub (ts_mean :3 close) (ts_mean :8 close))", "flat": "(mul volume 0)"}
    trading = mining.Trading(40, 10, 0.2, 0.8, 30, 1.0, 0.0)
    ledger = TrialLedger(spark, str(tmp_path / "trials"))
    spans = ((datetime.date(2024, 1, 1), datetime.date(2024, 1, 10)), (datetime.date(2024, 1, 11), datetime.date(2024, 1, 16)))
    out = mining.run_mining_round(df, costs, seeds, space, panel, *spans, str(tmp_path / "pool"), ledger, trading, generations=1, population=1)
    assert [c.accepted for c in out.candidates] == [True, False, False]
    assert out.candidates[1].reject_reason.startswith("|corr| 1.00") and out.candidates[2].reject_reason == "constant signal"
    assert math.isfinite(out.shifted_fitness) and out.shifted_fitness != out.candidates[0].train_fitness
    assert ledger.count() == 6 and spark.read.parquet(str(tmp_path / "pool")).count() == 3
    assert out.best_validation == max(c.validation_fitness for c in out.candidates)
    # a generation at once gives what each formula gives alone
    trees = [parse_sexpr(s) for s in ("(ts_mean :3 close)", "(neg volume)")]
    both = mining.fitness_of(df, trees, costs, panel, spans[0], trading)
    assert both == pytest.approx([mining.fitness_of(df, [t], costs, panel, spans[0], trading)[0] for t in trees])


def test_gates_and_pools(spark):
    rng = np.random.default_rng(1)
    rows = [(d, *map(float, v)) for d in range(8) for v in rng.normal(size=(12, 2))]
    df = spark.createDataFrame(rows, "date int, a double, b double").withColumn("a2", F.col("a") * 3 + 1).withColumn("c", F.lit(1.0))
    assert stats.distinct_factors(df, ["a"], ["a2", "b", "c"]) == ["b"] and stats.distinct_factors(df, [], ["b"]) == ["b"]
    seen = Counter({"p": 5, "q": 4, "r": 3})
    assert mining.most_common(seen, 2) == ["p", "q"]
    assert mining.most_common(seen, 2, lambda x, y: 0.9 if {x, y} == {"p", "q"} else 0.1, 0.5) == ["p", "r"]
    pool = search.AlphaPool(2)
    pool.add("(ts_mean :3 close)", 0.1, np.empty(0))
    back = search.load_pool(pool.to_json())
    assert str(back[0][0]) == "(ts_mean :3 close)" and back[0][1] == pytest.approx(float(pool.weights[0]))
    got = search.combine(spark.createDataFrame([(0, 1, 4.0)], "product int, bob int, close double"), [(feature("close"), 0.5)], K.MINING, Panel(("product",), ("bob",))).first()
    assert got.alpha == 2.0


def test_command_line(spark, tmp_path, sf):
    args = lambda *a: cli.parser().parse_args([str(x) for x in a])
    assert "leadlag_gram" in cli.run(args("list"))["queries"]
    cli.run(args("query", "agg_entropy", "--data", sf, "--out", tmp_path / "q"), spark)
    assert spark.read.parquet(str(tmp_path / "q")).count() == 1
    rows = [(p, datetime.date(2024, 1, 1 + d), t, float((p * 7 + d * 3 + t * t) % 11)) for p in range(3) for d in range(12) for t in range(15)]
    spark.createDataFrame(rows, "product bigint, segment date, pos int, x double").write.parquet(str(tmp_path / "panel"))
    spark.createDataFrame([(datetime.date(2024, 1, 1), datetime.date(2024, 1, 12))], "window_start date, window_end date").write.parquet(str(tmp_path / "w"))
    spark.createDataFrame([(0, 1)], "leader bigint, follower bigint").write.parquet(str(tmp_path / "pr"))
    facts = cli.run(args("validate", "--panel", tmp_path / "panel", "--windows", tmp_path / "w", "--priors", tmp_path / "pr", "--out", tmp_path / "v", "--lags", "1,2", "--draws", 20, "--min-shift", 2, "--manifests", tmp_path / "m"), spark)
    assert facts["pairs"] == 6 and 0 <= facts["validated"] <= 6 and (tmp_path / "m" / "latest.json").exists()
    assert cli.run(args("scan", "--panel", tmp_path / "panel", "--out", tmp_path / "s", "--lags", "1"), spark)["pairs"] == 6


def test_weights_of_pools():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 3)) * [0.02, 0.02, 0.2] + [0.05, 0.03, 0.05]
    mutual = np.eye(3)
    assert np.allclose(search.least_squares_weights(mutual, np.array([0.1, 0.2, 0.0])), [0.1, 0.2, 0.0])
    flat = base.mean(axis=0)
    score = lambda w: (base @ w).mean() / (base @ w).std()
    w = search.steady_weights(mutual, base)
    assert score(w) > score(flat) and abs(w[2]) < abs(w[0])
    low = lambda w: ((p := base @ w / np.sqrt(w @ w)).mean() - p.std())
    assert low(search.steady_weights(mutual, base, "lcb")) > low(flat)
