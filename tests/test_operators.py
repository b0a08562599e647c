import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridia.functions.compile import Panel
from meridia.functions.scalars import SymbolError, canonical_symbol_of
from meridia.operators import asof, backtest, bars as B, search, stats, vector
from meridia.operators.sequential import ewm_adjusted, ewm_halflife, exponential, positions

D = lambda s: dt.date.fromisoformat(s)


def _held(signal, limit=None, seg=None, hold=100):
    n = len(signal)
    z = np.zeros(n)
    return positions(np.array(signal, float), np.full(n, -5.0), np.full(n, 5.0), z if limit is None else np.array(limit, float), z if seg is None else np.array(seg, float), hold).tolist()


def test_position_vectors():
    assert _held([0, 9, 9, -9, 0]) == [0, 0, 1, 1, -1]
    assert _held([9] * 4, limit=[0, 1, 0, 0]) == [0, 0, 1, 1]
    assert _held([9] * 6, seg=[0, 0, 0, 1, 1, 1]) == [0, 1, 1, 0, 1, 1]
    p = _held([9] + [0] * 11, hold=3)
    assert p[1] == 1 and p[4] == 1 and p[5] == 0


def test_exponential_matches_pandas(spark):
    x = np.random.default_rng(0).normal(size=200)
    assert np.allclose(ewm_halflife(x, 7), pd.Series(x).ewm(halflife=7, adjust=False).mean())
    x[[3, 50]] = np.nan
    assert np.allclose(ewm_adjusted(x, 0.2), pd.Series(x).ewm(alpha=0.2, adjust=True).mean())
    df = spark.createDataFrame([(k, i, float(i * k)) for k in (1, 2, 3) for i in range(40)], "k int, i int, x double")
    got = exponential(df, "x", "y", Panel(("k",), ("i",)), "halflife", 5).toPandas().sort_values(["k", "i"])
    want = got.groupby("k").x.transform(lambda s: s.ewm(halflife=5, adjust=False).mean())
    assert len(got) == 120 and np.allclose(got.y, want)


def test_trading_date(spark):
    days = spark.createDataFrame([(D("2020-03-05"),), (D("2020-03-06"),), (D("2020-03-09"),)], "day date")
    walls = ["2020-03-05 21:30:00", "2020-03-06 01:00:00", "2020-03-06 10:00:00", "2020-03-06 21:00:00", "2020-03-07 02:00:00", "2020-03-07 10:00:00", "2020-03-09 21:00:00"]
    bars = spark.createDataFrame([(i, w) for i, w in enumerate(walls)], "i int, w string").withColumn("wall", F.to_timestamp_ntz("w"))
    got = {r.i: r.trading_date for r in B.trading_dates(bars, days).collect()}
    assert got == {0: D("2020-03-06"), 1: D("2020-03-06"), 2: D("2020-03-06"), 3: D("2020-03-09"), 4: D("2020-03-09")}


def test_false_discovery_vector(spark):
    p = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p_value double")
    q = [r.q_value for r in stats.false_discovery(df).orderBy("i").collect()]
    assert q[0] == pytest.approx(0.008) and q[1] == pytest.approx(0.032) and q[4] == pytest.approx(0.0672)
    by = [r.q_value for r in stats.false_discovery(df, dependent=True).orderBy("i").collect()]
    assert by[0] == pytest.approx(0.008 * sum(1 / k for k in range(1, 9)))


def test_false_discovery_of_large_families(spark):
    """Families of raw rows against numpy: in seconds, with ties, nulls and values that crowd at one end."""
    rng = np.random.default_rng(5)
    n = 60000
    p = np.where(np.arange(n) % 3 == 0, np.round(rng.uniform(size=n), 2), rng.uniform(size=n) ** 8)
    gone = np.arange(n) % 1000 == 7
    family = np.where(np.arange(n) % 4 == 0, "a", "b")
    rows = [(int(i), None if gone[i] else float(p[i]), None if family[i] == "a" else "b") for i in range(n)]
    df = spark.createDataFrame(rows, "i int, p double, family string")
    want = {}
    for f in ("a", "b"):
        own = np.flatnonzero(family == f)
        own = own[np.argsort(np.where(gone[own], np.inf, p[own]), kind="stable")]
        m = len(own)
        raw = np.where(gone[own], np.inf, p[own]) * m / np.arange(1, m + 1)
        least = np.minimum.accumulate(raw[::-1])[::-1]
        total = float(np.sum(1 / np.arange(1, m + 1)))
        want |= {int(i): (min(1.0, a), min(1.0, a * total)) for i, a in zip(own, least, strict=True)}
    got = stats.false_discovery_by_parts(df, "p", ["family"], "bh", "by_q").collect()
    assert len(got) == n
    assert all(r.bh == pytest.approx(want[r.i][0]) and r.by_q == pytest.approx(want[r.i][1]) for r in got)
    began = time.time()
    by = stats.false_discovery(df, "p", ["family"], dependent=True).collect()
    assert time.time() - began < 20 and all(r.q_value == pytest.approx(want[r.i][1]) for r in by)


def test_harmonic_sum(spark):
    got = {r.m: r.h for r in spark.range(1, 200).select(F.col("id").alias("m"), stats.harmonic(F.col("id")).alias("h")).collect()}
    assert all(h == pytest.approx(sum(1 / k for k in range(1, m + 1)), rel=1e-14) for m, h in got.items())


def test_planted_lag_is_found(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=2000)
    b = 0.5 * np.concatenate([np.zeros(3), a[:-3]]) + rng.normal(size=2000)
    rows = [("a", 0, i, float(v)) for i, v in enumerate(a)] + [("b", 0, i, float(v)) for i, v in enumerate(b)]
    panel = spark.createDataFrame(rows, "product string, segment int, pos int, x double")
    s = stats.pair_statistics(stats.correlations(stats.lagged_gram(panel, [1, 2, 3, 4, 5])))
    best = s.where("leader = 'a'").first()
    assert best.lag_bars == 3 and best.strength == pytest.approx(0.5 / np.sqrt(1.25), abs=0.08) and best.a_stat > 0


def test_lagged_pairs_stay_in_segments(spark):
    rows = [("a", s, i, 1.0) for s in (0, 1) for i in range(3)]
    g = stats.lagged_gram(spark.createDataFrame(rows, "product string, segment int, pos int, x double"), [1, 2, 3])
    assert {r.lag: r.n for r in g.collect()} == {1: 4, 2: 2}


def test_dominance_rolls_forward_after_confirmation(spark):
    def day(d, va, vb):
        return [("RB", "A", D(d), 202001, va, 10.0, 100.0), ("RB", "B", D(d), 202005, vb, 10.0, 110.0)]

    rows = day("2020-01-01", 9.0, 1.0) + day("2020-01-02", 5.0, 6.0) + day("2020-01-03", 5.0, 7.0) + day("2020-01-06", 9.0, 1.0) + day("2020-01-07", 9.0, 1.0)
    stats_ = spark.createDataFrame(rows, "product string, contract string, trading_date date, delivery_ym int, day_volume double, last_position double, day_close double")
    held = B.dominance(stats_, 2).orderBy("trading_date").collect()
    assert [r.contract for r in held] == ["A", "A", "A", "B", "B"]
    assert held[3].factor == pytest.approx(1.1)
    spans = {r.contract: r.adj_factor for r in B.dominance_spans(spark.createDataFrame(held)).collect()}
    assert spans == {"A": pytest.approx(1.0), "B": pytest.approx(1 / 1.1)}


def test_latest_edges_hide_older(spark):
    rows = [("a", "b", D("2020-01-10"), "h1", 0.01, 1.0, 2.0), ("a", "b", D("2020-02-01"), "h1", 0.9, 1.0, 2.0), ("c", "b", D("2020-02-01"), "h1", 0.01, 1.0, -3.0), ("d", "b", D("2019-01-01"), "h1", 0.01, 1.0, 9.0)]
    e = spark.createDataFrame(rows, "leader string, follower string, asof_date date, config_hash string, q_value double, stability double, a_stat double")
    assert [r.leader for r in asof.latest_edges(e, F.lit("2020-02-10").cast("date")).collect()] == ["c"]
    assert [r.leader for r in asof.latest_edges(e, F.lit("2020-02-01").cast("date")).collect()] == ["a"]


def test_interval_join_open_end_and_miss(spark):
    p = spark.createDataFrame([("x", D("2020-01-05")), ("x", D("2019-01-01")), ("y", D("2020-01-05"))], "k string, d date")
    s = spark.createDataFrame([("x", D("2020-01-01"), None, "t1"), ("x", D("2020-01-03"), D("2020-01-09"), "t2")], "k string, a date, b date, tpl string")
    got = {(r.k, r.d): r.tpl for r in asof.interval(p, s, ["k"], "d", "a", "b", ["tpl"]).collect()}
    assert got == {("x", D("2020-01-05")): "t1", ("x", D("2019-01-01")): None, ("y", D("2020-01-05")): None}


def test_merge_runs():
    assert B.merge_runs(list("aaabaaccc"), 2) == [(0, 5, "a"), (6, 8, "c")]
    assert B.merge_runs([], 2) == []


def test_limit_mask_causal_variant(spark):
    rows = [(1, 0, i, 10.0) for i in range(5)]
    df = spark.createDataFrame(rows, "product int, trading_date int, bob int, close double")
    assert sum(r.m_limit for r in B.limit_mask(df, least=4).collect()) == 5
    assert sum(r.m_limit for r in B.limit_mask(df, least=4, causal=True).collect()) == 2


def test_features_do_not_look_ahead(spark):
    rng = np.random.default_rng(5)
    rows, price = [], 100.0
    for day in range(6):
        for k in range(30):
            price *= float(np.exp(rng.normal() * 0.01))
            rows.append((1, day, 0, day * 100 + k, k, 0, price, float(rng.integers(1, 9))))
    df = spark.createDataFrame(rows, "product int, day int, segment int, bob int, slot int, template int, close double, volume double")
    cut = df.where("day < 5")
    names = ["x_std", "vol_ewma", "ret_5m", "ret_1d", "z_60", "vol_ratio", "range_15"]
    a = B.features(df).where("day < 5").orderBy("bob").select(names).toPandas()
    b = B.features(cut).orderBy("bob").select(names).toPandas()
    assert len(a) == 150 and np.allclose(a.astype(float), b.astype(float), equal_nan=True)
    assert a.ret_5m.notna().sum() == 145 and a.z_60.notna().sum() == 91


def test_undeclared_costs_raise(spark):
    df = spark.createDataFrame([("A", 1), ("B", 1)], "product string, x int")
    costs = spark.createDataFrame([("A", 1.0, 0.1)], "product string, fee double, slippage double")
    assert backtest.with_costs(df.where("product = 'A'"), costs).count() == 1
    with pytest.raises(Exception, match="no costs declared for B"):
        backtest.with_costs(df, costs).collect()


def test_profit_accounting(spark):
    df = spark.createDataFrame([(1, i, 0, o, p, 1.0, 0.0) for i, (o, p) in enumerate([(100.0, 0), (101.0, 1), (103.0, 1), (102.0, 0)])], "product int, t int, seg int, open double, position int, fee double, slippage double")
    out = backtest.profit(df, Panel(("product",), ("t",)), "open", "seg").orderBy("t").collect()
    assert [r.gross for r in out] == pytest.approx([0, 103 / 101 - 1, 102 / 103 - 1, 0])
    assert [r.turn for r in out] == [0, 1, 0, 1] and sum(r.cost for r in out) == pytest.approx(2e-4)


def test_gate_pool_and_rotation():
    assert backtest.correlation_gate({("b", "a"): 0.9, ("c", "a"): 0.1}, ["a", "b", "c", "d"], {"d"}) == ["a", "c"]
    assert backtest.rotate({"a", "x"}, ["a", "b", "c", "x"], 2, 1) == (["x"], ["b"])
    pool = search.AlphaPool(2)
    assert pool.add("a", 0.1, np.array([])) and not pool.add("a2", 0.1, np.array([0.999]))
    assert pool.add("b", 0.05, np.array([0.1])) and pool.add("c", 0.2, np.array([0.0, 0.0]))
    assert set(pool.names) == {"a", "c"} and pool.value() > 0
    best = search.BestUnique(2)
    for s, k in ((1, "x"), (3, "y"), (2, "x"), (0, "z")):
        best.push(s, k)
    assert best.ranked() == [("y", 3), ("x", 2)]


def test_search_is_repeatable_and_keeps_shape():
    import random

    from meridia.functions.expr import Space, parse_sexpr, shape, size

    seed = parse_sexpr("(sub (ts_mean :60 close) (ts_mean :480 close))")
    score = lambda trees: [-abs(sum(p for _, n in __import__("meridia.functions.expr", fromlist=["walk"]).walk(t) for p in n.params if isinstance(p, int)) - 35) for t in trees]
    runs = [search.evolve(seed, Space(("close", "volume")), score, 6, 12, rng=random.Random(4)) for _ in range(2)]
    assert runs[0] == runs[1] and shape(runs[0][0]) == shape(seed) and size(runs[0][0]) == 5
    assert runs[0][2] == sorted(runs[0][2])


def test_graph_labels_block(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a")], "node int, label string")
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4)], "a int, b int")
    free = {r.node: r.distance for r in vector.neighbours_within(nodes, edges, [1], 2, "a").collect()}
    held = {r.node: r.distance for r in vector.neighbours_within(nodes, edges, [1], 2, "a", block=True).collect()}
    assert free == {1: 0, 3: 2, 4: 1} and held == {1: 0, 4: 1}


@pytest.mark.parametrize("raw,want", [("600519", "SH600519"), ("sh600519", "SH600519"), ("000001.SZ", "SZ000001"), ("300750 CH", None), ("688981.SS", "SH688981")])
def test_symbols(raw, want):
    if want is None:
        with pytest.raises(SymbolError):
            canonical_symbol_of(raw)
    else:
        assert canonical_symbol_of(raw) == want


def test_probabilistic_sharpe(spark):
    from statistics import NormalDist

    v = spark.range(1).select(stats.probabilistic_sharpe(F.lit(0.1), F.lit(250), F.lit(-0.3), F.lit(1.2)).alias("v")).first().v
    spread = (1 + 0.03 + 3.2 / 4 * 0.01) / 249
    assert v == pytest.approx(NormalDist().cdf(0.1 / spread**0.5), abs=1e-6)
