"""Queries that SQL can't say, against plain Python."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridia.functions import kernels as K
from meridia.functions.compile import Panel, compile_formulas
from meridia.functions.expr import parse_sexpr
from meridia.operators import bars as B
from meridia.plans import registry
from meridia.plans.base import bars

registry.load()


def near(a, b):
    missing = lambda v: v is None or (isinstance(v, float) and math.isnan(v))
    return missing(b) if missing(a) else (not missing(b) and a == pytest.approx(b, rel=1e-7, abs=1e-7))


def brute_features(rows, broken=None):
    """rows of one product in order: (bob, day, segment, slot, close, volume)."""
    n = len(rows)
    day, seg, slot = ([r[k] for r in rows] for k in (1, 2, 3))
    close, volume = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
    r = [None] * n
    for i in range(1, n):
        if seg[i] == seg[i - 1]:
            r[i] = math.log(close[i]) - math.log(close[i - 1])
    per_day = [day.count(d) for d in day]
    days = sorted(set(day))
    out = [{} for _ in rows]
    y, short, long = None, None, None
    ewma = []
    for i in range(n):
        if r[i] is not None:
            a = 1 - 0.5 ** (1 / per_day[i])
            y = r[i] ** 2 if y is None else a * r[i] ** 2 + (1 - a) * y
        ewma.append(None if y is None else math.sqrt(y))
        for half in (60, 1200):
            a = 1 - 0.5 ** (1 / half)
            before = short if half == 60 else long
            now = volume[i] if before is None else a * volume[i] + (1 - a) * before
            short, long = (now, long) if half == 60 else (short, now)
        out[i]["vol_ewma"], out[i]["vol_ratio"] = ewma[i], short / long
    sigma, profile = {}, {}
    each = {}
    for i in range(n):
        if r[i] is not None:
            each.setdefault((day[i], slot[i]), []).append(abs(r[i]))
        else:
            each.setdefault((day[i], slot[i]), [])
    mean_of = {k: float(np.mean(v)) if v else None for k, v in each.items()}
    for k, d in enumerate(days):
        past = [r[i] for i in range(n) if r[i] is not None and day[i] in days[max(0, k - 60) : k]]
        sigma[d] = float(np.std(past)) if len(past) >= 100 else None
        med = {}
        for s in {s for dd, s in each if dd == d}:
            known = [mean_of[dd, s] for dd in days[max(0, k - 60) : k] if mean_of.get((dd, s)) is not None]
            med[s] = float(np.median(known)) if len(known) >= 5 else None
        whole = [v for v in med.values() if v is not None]
        for s, v in med.items():
            profile[d, s] = max(0.25, v / np.mean(whole)) if v is not None and np.mean(whole) > 0 else None
    flagged = [broken is not None and abs((d - broken).days) <= 3 for d in day]
    for i in range(n):
        f, b = out[i], per_day[i]
        for w in (5, 15, 60):
            own = r[max(0, i + 1 - w) : i + 1]
            f[f"ret_{w}m"] = sum(own) if len(own) == w and None not in own else None
        own = r[max(0, i + 1 - b) : i + 1]
        f["ret_1d"] = sum(own) if len(own) == b and None not in own else None
        f["oi_chg_1d"] = volume[i] / volume[i - b] - 1 if i >= b and seg[i] == seg[i - b] and not (flagged[i] or (i and flagged[i - 1])) else None
        for w in (60, 240, 1200):
            own = close[max(0, i + 1 - w) : i + 1]
            f[f"z_{w}"] = (close[i] - own.mean()) / own.std() if len(own) == w and own.std() > 0 else None
        for w in (1, 15, 60):
            own = close[max(0, i + 1 - w) : i + 1]
            f[f"range_{w}"] = (own.max() - own.min()) / close[i] if len(own) == w else None
        f["x_std"] = None
        if r[i] is not None and ewma[i - 1] is not None:
            cut = r[i] if sigma[day[i]] is None else max(-5 * sigma[day[i]], min(5 * sigma[day[i]], r[i]))
            p = profile.get((day[i], slot[i]))
            scale = ewma[i - 1] * (1.0 if p is None else p)
            f["x_std"] = cut / scale if scale > 0 else None
    return out


@pytest.mark.parametrize("broken", [None, datetime.date(2024, 1, 8)])
def test_features(spark, broken):
    rng, rows = np.random.default_rng(4), []
    for product in ("a", "b"):
        price = 100.0
        for d in range(14):
            for t in range(20 + 3 * (d % 3)):
                price *= math.exp(rng.normal() * 0.01)
                at = datetime.datetime(2024, 1, 1, 9) + datetime.timedelta(days=d, minutes=t)
                rows.append((product, at, at.date(), int(d >= 9), t // 6, price, float(rng.uniform(1, 9))))
    df = spark.createDataFrame(rows, "product string, bob timestamp_ntz, day date, segment int, slot int, close double, volume double").withColumn("template", F.lit(0))
    got = {(r.product, r.bob): r for r in B.features(df, breaks={"a": broken, "b": broken} if broken else None).collect()}
    assert len(got) == len(rows)
    for product in ("a", "b"):
        own = [r[1:] for r in rows if r[0] == product]
        for row, want in zip(own, brute_features(own, broken), strict=True):
            for name, value in want.items():
                assert near(got[product, row[0]][name], value), (product, row[0], name, got[product, row[0]][name], value)


def test_backtest(spark, sf):
    """Bands, positions, costs and profit of state_backtest, bar by bar."""
    rows = bars(spark, sf).select("product", "bob", "day", "close").orderBy("product", "bob").collect()
    want = {}
    for product in sorted({r.product for r in rows}):
        own = [r for r in rows if r.product == product]
        signal = [-r.close for r in own]
        now = kept = following = 0
        held, fresh = [], []
        for i, r in enumerate(own):
            past = signal[max(0, i - 20) : i]
            lo, hi = (float(np.quantile(past, q)) for q in (0.1, 0.9)) if len(past) >= 10 else (None, None)
            before = now
            new = i == 0 or own[i - 1].day != r.day
            now = 0 if new else following
            kept = kept + 1 if now and now == before else 0
            held.append(now)
            fresh.append(new)
            following = now if lo is None or lo <= signal[i] <= hi else (1 if signal[i] > hi else -1)
            if following == now and kept >= 100:
                following = 0
        for i, r in enumerate(own):
            price = r.close + 1
            there = i + 1 < len(own) and own[i + 1].day == r.day
            move = (own[i + 1].close + 1) / price - 1 if there else 0.0
            turn = abs(held[i] - (held[i - 1] if i else 0))
            net = held[i] * move - turn * (1e-4 + 0.01 / price)
            a = want.setdefault((product, r.day), [0.0, 0, 0, 0])
            a[0], a[1], a[2], a[3] = a[0] + net, a[1] + turn, a[2] + (held[i] != 0), a[3] + 1
    got = registry.QUERIES["state_backtest"](spark, sf).collect()
    assert {(r.product, r.day) for r in got} == set(want)
    for r in got:
        net, turn, inside, n = want[r.product, r.day]
        assert abs(r.net - net) < 2e-5 and r.turnover == turn and abs(r.time_in - inside / n) < 2e-5


def test_backtest_of_signals_on_a_bound(spark, tmp_path):
    """Signals that lie on their bound or a last place beside it: positions are those of the SQL."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq
    from oracle import same

    past = [
        [112.85, 62.46, 49.96, 41.04, 34.97, 23.1, 18.82, 17.75, 16.83, 13.81, 10.43, 9.99, 9.1, 7.45, 7.41, 6.64, 5.03, 3.16, 2.36, 1.01],
        [116.81, 92.16, 89.36, 74.4, 72.49, 68.08, 55.81, 44.05, 40.57, 40.1, 29.65, 24.48, 23.43, 19.87, 19.59, 17.63, 10.41, 5.69, 3.77, 2.61],
        [186.85, 148.34, 97.04, 71.09, 68.3, 53.12, 50.66, 49.98, 48.54, 48.05, 47.96, 47.75, 47.22, 45.58, 36.94, 30.66, 16.87, 16.41, 14.22, 1.6],
    ]
    series = [[*rows, last, 10.0, 20.0] for rows, last in zip(past, [51.21, 89.64, 102.17], strict=True)] + [[7.3] * 24, [0.1] * 12 + [0.7] * 9]
    rows = [(k, v) for k, values in enumerate(series) for v in values]
    at = [datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i) for i in range(len(rows))]
    pq.write_table(pa.table({"event_id": range(len(rows)), "ts": pa.array(at, pa.timestamp("us")), "user_id": [k for k, _ in rows], "event_type": ["view"] * len(rows), "value": [v for _, v in rows], "props": ['{"k": 1}'] * len(rows)}), f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    same(registry.QUERIES["state_backtest"](spark, str(tmp_path)).toPandas(), con.execute(registry.ORACLES["state_backtest"]).fetchdf())


def test_day_sums_that_cancel(spark, tmp_path):
    """A day whose moves cancel counts as the SQL counts it, in whatever files its rows lie."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq
    from oracle import same

    days = [[1.2, 24.43, 27.32, 10.42, 186.63], [19.04, 93.91, 111.98, 18.03, 7.04]]
    rows = [(i, p, v) for i, values in enumerate(zip(*days, strict=True)) for p, v in enumerate(values)]
    at = [datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i) for i, _, _ in rows]
    table = pa.table({"event_id": range(len(rows)), "ts": pa.array(at, pa.timestamp("us")), "user_id": [p for _, p, _ in rows], "event_type": ["view"] * len(rows), "value": [v for _, _, v in rows], "props": ['{"k": 1}'] * len(rows)})
    (tmp_path / "events.parquet").mkdir()
    pq.write_table(table.slice(0, 6), f"{tmp_path}/events.parquet/a.parquet")
    pq.write_table(table.slice(6), f"{tmp_path}/events.parquet/b.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = registry.QUERIES["metric_suite"](spark, str(tmp_path)).toPandas()
    same(got, con.execute(registry.ORACLES["metric_suite"]).fetchdf())
    assert got.set_index("product").hit_rate.to_dict() == {0: 0.0, 1: 1.0}


def test_generation_gives_what_each_formula_gives(spark, sf):
    """One formula by pandas, and every formula by itself."""
    got = {r.formula: (r.ic, r.n) for r in registry.QUERIES["search_generation"](spark, sf).collect()}
    pdf = bars(spark, sf).select("product", "bob", "close", "volume").toPandas().sort_values(["product", "bob"])
    by = pdf.groupby("product").close
    seed = "(sub (ts_mean :3 close) (ts_mean :8 close))"
    x = (by.transform(lambda s: s.rolling(3).mean()).fillna(0) - by.transform(lambda s: s.rolling(8).mean()).fillna(0)).clip(-1e6, 1e6)
    y = by.shift(-1) - pdf.close
    known = y.notna()
    assert seed in got and got[seed][1] == int(known.sum())
    assert got[seed][0] == pytest.approx(float(np.corrcoef(x[known], y[known])[0, 1]), abs=2e-5)
    for formula, (ic, _) in got.items():
        df = compile_formulas(bars(spark, sf), {"x": parse_sexpr(formula)}, K.MINING, Panel(("product",), ("bob",))).select("product", "bob", "close", "x").toPandas().sort_values(["product", "bob"])
        y = df.groupby("product").close.shift(-1) - df.close
        ok = y.notna() & df.x.notna()
        alone = np.corrcoef(df.x[ok].astype(float), y[ok])[0, 1] if df.x[ok].std() > 0 else None
        assert near(ic, alone) or abs(ic - alone) < 2e-5


def test_clusters_are_a_fixed_point(spark, sf):
    """Every vector lies with the centre it is most similar to; centres are means of their unit vectors."""
    from meridia.operators import vector
    from meridia.plans.base import table

    rows = vector.cosine_kmeans(table(spark, sf, "embeddings"), 8, 200).select("vec_id", "embedding", "cluster").toPandas()
    x = np.array(rows.embedding.tolist(), dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = np.stack([x[rows.cluster == k].mean(axis=0) for k in range(8)])
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    best = (x @ centres.T).max(axis=1)
    own = (x * centres[rows.cluster]).sum(axis=1)
    assert np.mean(own < best - 1e-3) < 0.02
    counts = registry.QUERIES["vec_kmeans"](spark, sf).toPandas()
    assert counts.n.sum() == len(rows) and isinstance(counts, pd.DataFrame)
