"""The permutation null and the monthly validation, on planted and independent panels."""

import datetime
import random

import numpy as np

from meridia.operators import bars as B, stats

LAGS = [1, 2, 3]


def panel(spark, seed, days=24, bars=40, products=4, planted=None, uneven=False):
    """Independent noise; with (leader, follower, lag) that follower adds its leader's values of lag bars before."""
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        n = bars + (d // 9 if uneven else 0)
        x = rng.normal(size=(n, products))
        if planted:
            lead, follow, lag = planted
            x[lag:, follow] += 0.5 * x[:-lag, lead]
        day = datetime.date(2024, 1, 1) + datetime.timedelta(days=d)
        rows += [(int(p), day, t, float(x[t, p])) for t in range(n) for p in range(products) if not (t * 7 + p) % 31 == 5]
    return spark.createDataFrame(rows, "product bigint, segment date, pos int, x double")


def brute_a(shifted, own, products):
    total = {}
    for i in range(products):
        for j in range(products):
            if i != j:
                size = 0.0
                for lag in LAGS:
                    xy = xx = yy = 0.0
                    for (p, d, t), x in shifted.items():
                        y = own.get((j, d, t + lag)) if p == i else None
                        if y is not None:
                            xy, xx, yy = xy + x * y, xx + x * x, yy + y * y
                    size += abs(xy / (xx * yy) ** 0.5) if xx * yy > 0 else 0.0
                total[i, j] = size
    return {(i, j): total[i, j] - total[j, i] for i, j in total}


def test_null_equals_brute_force(spark):
    """Every draw's statistic, from the offsets drawn, over strata of unequal days."""
    df = panel(spark, 1, days=20, bars=12, products=3, uneven=True)
    rows = {(r.product, r.segment, r.pos): r.x for r in df.collect()}
    sizes = {}
    for _, d, t in rows:
        sizes.setdefault(d, set()).add(t)
    strata, before = {}, None
    for d in sorted(sizes):
        k = 0 if before is None else strata[before][0] + (len(sizes[before]) != len(sizes[d]))
        strata[d], before = (k,), d
    members = {}
    for d, (k,) in strata.items():
        members.setdefault(k, []).append(d)
    drawn = stats.shift_draws(spark.createDataFrame([(k, len(m)) for k, m in members.items()], "stratum bigint, days bigint"), 4, 2, 42).collect()
    got = {}
    for r in stats.permutation_null(df, LAGS, 4, 2, 42).collect():
        got[r.draw, r.leader, r.follower] = r.a_stat
    for draw in range(1, 5):
        offset = {r.stratum: r.offset for r in drawn if r.draw == draw}
        to = {d: m[(i + offset[k]) % len(m)] for k, m in members.items() for i, d in enumerate(m)}
        want = brute_a({(p, to[d], t): x for (p, d, t), x in rows.items()}, rows, 3)
        for (i, j), a in want.items():
            assert abs(got[draw, i, j] - a) < 1e-9


def test_shifts_keep_their_distance(spark):
    got = stats.shift_draws(spark.createDataFrame([(0, 30), (1, 9), (2, 10)], "stratum bigint, days bigint"), 400, 5, 1).collect()
    by = {k: [r.offset for r in got if r.stratum == k] for k in range(3)}
    assert set(by[0]) == set(range(5, 26)) and set(by[1]) == {0} and set(by[2]) == {5}


def test_null_p_values_are_even_on_independent_panels(spark):
    found = []
    for seed in range(6):
        df = panel(spark, 100 + seed)
        seen = stats.pair_statistics(stats.correlations(stats.lagged_gram(df, LAGS)))
        found += [r.p_value for r in stats.permutation_p(seen, stats.permutation_null(df, LAGS, 60, 3, seed), ["leader", "follower"], drawn=60).collect()]
    assert len(found) == 72 and min(found) >= 1 / 61
    assert 0.35 < np.mean(found) < 0.65 and np.mean(np.array(found) <= 0.1) <= 0.25


def test_planted_lead_is_found_and_kept(spark):
    df = panel(spark, 7, planted=(2, 0, 2))
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=k) for k in (0, 4, 8, 23)]
    windows = spark.createDataFrame([(days[0], days[3] - datetime.timedelta(days=9)), (days[1], days[3] - datetime.timedelta(days=5)), (days[2], days[3])], "window_start date, window_end date")
    priors = spark.createDataFrame([(0, 2)], "leader bigint, follower bigint")
    edges = stats.validated_edges(df, windows, LAGS, priors, 99, 3, q_a=0.05).collect()
    lead = sorted((r for r in edges if (r.leader, r.follower) == (2, 0)), key=lambda r: r.window_end)
    assert [r.family for r in lead] == ["A"] * 3 and all(r.validated and r.lag_bars == 2 and r.sign == 1 for r in lead)
    # nothing is known before the first window; each later one sees the earlier ones alone
    assert [r.stability for r in lead] == [0.0, 1.0, 1.0]
    assert len(edges) == 3 * 12 and all(r.p_value == 0.01 for r in lead)


def contract_days(volumes, closes, start=datetime.date(2020, 3, 2)):
    """Rows of contracts A (delivery 202005) and B (202009) by day; None: not there."""
    rows = []
    for k, (v, c) in enumerate(zip(volumes, closes, strict=True)):
        for name, ym, vol, price in (("A", 202005, v[0], c[0]), ("B", 202009, v[1], c[1])):
            if vol is not None:
                rows.append(("RB", name, start + datetime.timedelta(days=k), ym, vol, 100, price))
    return rows


STATS = "product string, contract string, trading_date date, delivery_ym int, day_volume bigint, last_position bigint, day_close double"


def test_adjustment_starts_at_one_and_never_looks_ahead(spark):
    """The factor before a roll is 1, after it 1 over new by old close at confirmation; a later roll changes nothing before."""
    rows = contract_days([(10, 5), (10, 12), (10, 13), (8, 20), (8, 20)], [(100.0, 110.0)] * 3 + [(100.0, 120.0)] * 2)
    held = B.dominance(spark.createDataFrame(rows, STATS))
    assert [(r.contract, r.factor) for r in held.orderBy("trading_date").collect()] == [("A", 1.0), ("A", 1.0), ("A", 1.0), ("B", 1.1), ("B", 1.0)]
    spans = B.dominance_spans(held).orderBy("date_start").collect()
    assert [(s.contract, round(s.adj_factor, 9), s.rolled) for s in spans] == [("A", 1.0, False), ("B", round(1 / 1.1, 9), True)]
    short = B.dominance_spans(B.dominance(spark.createDataFrame(rows[:6], STATS))).collect()
    assert [(s.contract, s.adj_factor) for s in short] == [("A", 1.0)]


def test_segments_start_anew(spark):
    """After a hole the day's most traded contract leads, back to an earlier delivery too, and factors start at 1."""
    rows = contract_days([(10, 5), (10, 12), (10, 13), (8, 20), (30, 20), (30, 20)], [(100.0, 110.0)] * 6)
    hole = datetime.date(2020, 3, 5)
    spans = B.dominance_spans(B.dominance(spark.createDataFrame(rows, STATS), holes=(hole,))).orderBy("date_start").collect()
    assert [(s.segment, s.contract, round(s.adj_factor, 9), s.rolled) for s in spans] == [(0, "A", 1.0, False), (0, "B", round(1 / 1.1, 9), True), (1, "A", 1.0, False)]
    # a roll confirmed on the last day before the hole isn't carried over it
    spans = B.dominance_spans(B.dominance(spark.createDataFrame(rows, STATS), holes=(datetime.date(2020, 3, 4),))).orderBy("date_start").collect()
    assert [(s.segment, s.contract) for s in spans][:2] == [(0, "A"), (1, "B")] and spans[1].adj_factor == 1.0


def test_missing_closes_leave_the_factor_alone(spark):
    rows = contract_days([(10, 5), (10, 12), (10, 13), (8, 20)], [(100.0, None)] * 4)
    assert {r.factor for r in B.dominance(spark.createDataFrame(rows, STATS)).collect()} == {1.0}
    rng = random.Random(1)
    rows = contract_days([(rng.randrange(20), rng.randrange(20)) for _ in range(60)], [(100.0, 101.0)] * 60)
    held = [r.contract for r in B.dominance(spark.createDataFrame(rows, STATS)).orderBy("trading_date").collect()]
    assert held == sorted(held)
