"""Calendars, overrides, lookups, splits."""

import datetime

import pytest
from pyspark.sql import functions as F

from meridia.operators import calendar as C


def D(text):
    return datetime.date.fromisoformat(text)


def T(text):
    return datetime.datetime.fromisoformat(text)


def test_dates_of_sessions(spark):
    rows = [(D("2024-01-08"), D("2024-01-05"), rel) for rel in (0, 209, 210, 389, 390, 1100)]
    got = spark.createDataFrame(rows, "t date, p date, rel int").select(C.calendar_date(F.col("t"), F.col("p"), F.col("rel")).alias("d")).collect()
    assert [str(r.d) for r in got] == ["2024-01-05", "2024-01-05", "2024-01-06", "2024-01-06", "2024-01-08", "2024-01-08"]


def test_lookups_and_cache(spark, tmp_path):
    days = spark.createDataFrame([(D(f"2024-01-0{k}"),) for k in (2, 3, 4, 8)] + [(None,)], "trade_date date")
    cal = C.TradeCalendar(days)
    assert cal.is_trading_day(D("2024-01-03")) and not cal.is_trading_day(D("2024-01-05"))
    assert cal.following(D("2024-01-04")) == D("2024-01-08") == cal.following(D("2024-01-05"))
    assert cal.previous(D("2024-01-08")) == D("2024-01-04") == cal.previous(D("2024-01-05"))
    with pytest.raises(IndexError):
        cal.following(D("2024-01-08"))
    with pytest.raises(IndexError):
        cal.previous(D("2024-01-02"))
    assert cal.between(D("2024-01-03"), D("2024-01-07")).count() == 2 and cal.between(D("2024-01-07"), D("2024-01-03")).count() == 0
    path = str(tmp_path / "cal")
    assert C.TradeCalendar.load(spark, path) is None
    cal.save(path)
    assert C.TradeCalendar.load(spark, path).days.count() == 4 and C.TradeCalendar.load(spark, path, -1) is None
    near = {r.day: (r.previous, r.following, r.place) for r in C.neighbours(days.where("trade_date is not null").withColumnRenamed("trade_date", "day")).collect()}
    assert near[D("2024-01-04")] == (D("2024-01-03"), D("2024-01-08"), 2)


def test_override_trims_runs(spark):
    runs = spark.createDataFrame([("A", D("2024-01-01"), D("2024-01-10"), "x"), ("A", D("2024-01-11"), D("2024-01-20"), "y"), ("B", D("2024-01-01"), D("2024-01-20"), "x")], "product string, date_start date, date_end date, template string")
    template = C.template_of([("09:00", "10:15"), ("21:00", "01:00")])
    assert template == "30-270,750-825"
    got = sorted((r.product, str(r.date_start), str(r.date_end), r.template) for r in C.override(runs, "A", D("2024-01-05"), D("2024-01-12"), template).collect())
    assert got == [("A", "2024-01-01", "2024-01-04", "x"), ("A", "2024-01-05", "2024-01-12", template), ("A", "2024-01-13", "2024-01-20", "y"), ("B", "2024-01-01", "2024-01-20", "x")]
    inside = C.override(runs, "B", D("2024-01-03"), D("2024-01-03"), "z").where("product = 'B'").orderBy("date_start").collect()
    assert [r.template for r in inside] == ["x", "z", "x"]


def test_build_calendar(spark):
    rows = []
    for k in range(2, 12):
        day = D("2024-01-01") + datetime.timedelta(days=k)
        for product in ("RB", "AG"):
            # AG has no night session on one day
            if product == "RB" or k != 6:
                rows += [(product, day, T(f"{day - datetime.timedelta(days=1)}T21:0{m}:00")) for m in range(3)]
            rows += [(product, day, T(f"{day}T09:0{m}:00")) for m in range(4)]
    bars = spark.createDataFrame(rows, "product string, trading_date date, wall timestamp_ntz")
    out = C.build_calendar(bars, ["RB", "AG"], 2, shortest=2, overrides=[("RB", D("2024-01-05"), D("2024-01-05"), "750-752")])
    assert out["days"].count() == 10
    assert [(r.product, str(r.trading_date)) for r in out["exceptions"].collect()] == [("AG", "2024-01-07")]
    templates = {(r.template_id, r.seq): (r.start, r.end, r.bars) for r in out["templates"].collect()}
    assert templates == {(0, 0): (30, 33, 3), (0, 1): (750, 754, 4), (1, 0): (750, 752, 2)}
    sessions = sorted((r.product, str(r.date_start), str(r.date_end), r.template_id) for r in out["sessions"].collect())
    assert sessions == [("AG", "2024-01-03", "2024-01-12", 0), ("RB", "2024-01-03", "2024-01-04", 0), ("RB", "2024-01-05", "2024-01-05", 1), ("RB", "2024-01-06", "2024-01-12", 0)]
    known = out["days"].where("day <> date'2024-01-06'")
    with pytest.raises(C.CalendarError):
        C.build_calendar(bars, ["RB", "AG"], 2, known_days=known)


def test_universe_and_splits(spark):
    liquidity = spark.createDataFrame([("A", D("2024-01-01"), 9.0), ("A", D("2024-01-02"), 1.0), ("B", D("2024-01-01"), 5.0), ("C", D("2024-01-01"), None), ("D", D("2024-01-01"), 99.0)], "product string, day date, adv double")
    assert C.developer_universe(liquidity, ["A", "B", "C"], 2) == ["B", "A"]
    assert C.developer_universe(liquidity.limit(0), ["A", "B", "C"], 2) == ["A", "B"]
    train, validation = (D("2019-01-01"), D("2020-01-01")), (D("2020-01-02"), D("2021-01-01"))
    assert C.resolve_splits(D("2019-06-01"), D("2020-06-01"), train, validation) == ((D("2019-06-01"), D("2020-01-01")), (D("2020-01-02"), D("2020-06-01")))
    (a, b), (c, d) = C.resolve_splits(D("2024-01-01"), D("2024-01-11"), train, validation)
    assert (a, b, c, d) == (D("2024-01-01"), D("2024-01-08"), D("2024-01-09"), D("2024-01-11"))
