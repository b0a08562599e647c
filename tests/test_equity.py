"""Equity sources: normalisation, retries, backfill, adjustment, binary files, orders."""

import datetime
import math

import pytest

from meridia.sources import equity as E

D = datetime.date.fromisoformat
RAW = "`日期` string, `股票代码` string, `开盘` double, `收盘` double, `最高` double, `最低` double, `成交量` double, `成交额` double, `振幅` double, `涨跌幅` double, `涨跌额` double, `换手率` double, `新列` string"


def raw(spark, days):
    return spark.createDataFrame([(d, "600000", 10.0, 11.0, 12.0, 9.0, 5.0, 5500.0, 1.0, 0.1, 1.0, 0.5, "x") for d in days], RAW)


class Source:
    name = "fake"

    def __init__(self, spark):
        self.spark, self.asked = spark, 0

    def prices(self, symbol, start, end, adjust):
        if symbol == "SZ000002":
            raise E.EmptyResponse(symbol)
        return E.normalise_prices(raw(self.spark, [str(start), str(end)]), symbol)

    def members(self, universe):
        if universe != "csi300":
            raise E.UniverseUnavailable(universe)
        return E.normalise_events(self.spark.createDataFrame([("600000", "a", "2020-01-01"), ("2", "b", "no date"), ("000001", "c", "2023-01-01")], "`品种代码` string, `品种名称` string, `纳入日期` string"))

    def trading_days(self):
        self.asked += 1
        return self.spark.createDataFrame([(D("2024-01-02"),), (D("2024-01-03"),)], "trade_date date")


def test_normalised_rows(spark):
    (r,) = E.normalise_prices(raw(spark, ["2024-01-02"]), "600000").collect()
    assert (r.date, r.symbol, r.volume, r.turnover) == (D("2024-01-02"), "SH600000", 500.0, 5500.0) and r.vwap == pytest.approx(32 / 3)
    rows = {r.stock_code: (r.in_date, r.out_date) for r in Source(spark).members("csi300").collect()}
    assert rows == {"600000": (D("2020-01-01"), None), "000002": (None, None), "000001": (D("2023-01-01"), None)}
    with pytest.raises(E.UniverseUnavailable):
        E.normalise_events(spark.createDataFrame([("1",)], "`品种代码` string"))


def test_retries():
    asked = []

    def call():
        asked.append(1)
        if len(asked) < 3:
            raise OSError("later")
        return "here"

    assert E.retrying(call, 3, 0) == "here" and len(asked) == 3
    with pytest.raises(OSError):
        E.retrying(lambda: (_ for _ in ()).throw(OSError("never")), 2, 0)


def test_fetcher(spark, tmp_path):
    source = Source(spark)
    f = E.Fetcher(spark, str(tmp_path / "root"), source)
    span = (D("2024-01-02"), D("2024-01-03"))
    assert f.pull(*span, universe="csi300") == {"pulled": 4, "skipped": 0, "failed": 1}
    assert f.pull(*span, symbols=["600000"]) == {"pulled": 0, "skipped": 2, "failed": 0}
    with pytest.raises(ValueError):
        f.pull(*span)
    with pytest.raises(E.UniverseUnavailable):
        f.pull(*span, universe="other")
    assert f.universe("csi300", D("2021-01-01")) == ["SH600000"]
    assert f.panel("csi300", ["close"], *span).count() == 4 and f.panel(["sh600000"], ["close", "vwap"], *span).columns == ["date", "symbol", "close", "vwap"]
    assert f.calendar().following(D("2024-01-02")) == D("2024-01-03") and f.calendar().days.count() == 2 and source.asked == 1
    f.calendar(refresh=True)
    assert source.asked == 2 and f.context(D("2024-01-02")) == {"as_of": D("2024-01-02")}


def test_url_source(spark, tmp_path):
    for s in ("a", "b"):
        (tmp_path / f"{s}.csv").write_text("日期,开盘,收盘,最高,最低,成交量,成交额,涨跌幅,换手率\n2024-01-02,1,2,3,0.5,10,20,0.1,0.2\n", encoding="utf-8")
    spark.dataSource.register(E.UrlPrices)
    df = spark.read.format("url_prices").option("url", f"file://{tmp_path}/{{symbol}}.csv").option("symbols", "a,b").option("wait", "0").load()
    assert df.count() == 2 and {r.symbol for r in df.collect()} == {"a", "b"}
    (row,) = E.normalise_prices(df.where("symbol = 'a'").drop("symbol"), "600000").collect()
    assert (row.symbol, row.volume, row.close) == ("SH600000", 1000.0, 2.0)


def test_adjustment(spark):
    prices = spark.createDataFrame([("s", D(f"2024-01-0{k}"), 10.0 * k, 100.0, 5000.0) for k in range(1, 5)], "symbol string, date date, close double, volume double, amount double")
    factors = spark.createDataFrame([("s", D("2024-01-02"), 2.0), ("s", D("2024-01-04"), 4.0)], "symbol string, date date, fore double")
    got = {str(r.date): r for r in E.adjusted(prices, factors, "fore", ["close"]).collect()}
    assert [got[f"2024-01-0{k}"].fore for k in range(1, 5)] == [1.0, 2.0, 2.0, 4.0]
    assert got["2024-01-03"].volume == 50.0 and got["2024-01-03"].vwap == 100.0
    based = {str(r.date): r for r in E.adjusted(prices, factors, "fore", ["close"], D("2024-01-03")).collect()}
    assert based["2024-01-03"].fore == 1.0 and based["2024-01-04"].close == 20.0 and based["2024-01-01"].fore == 0.5


def test_binary_export(spark, tmp_path):
    rows = [("SH1", D("2024-01-02"), 1.0), ("SH1", D("2024-01-04"), 3.0), ("SZ2", D("2024-01-03"), 7.0)]
    out = E.write_bins(spark.createDataFrame(rows, "symbol string, date date, close double"), str(tmp_path), ["close"])
    assert {(r.symbol, r.days) for r in out.collect()} == {("SH1", 2), ("SZ2", 1)}
    first, values = E.read_bin(str(tmp_path / "features/sh1/close.day.bin"))
    assert first == 0 and values[0] == 1.0 and math.isnan(values[1]) and values[2] == 3.0
    assert E.read_bin(str(tmp_path / "features/sz2/close.day.bin")) == (1, [7.0])
    assert (tmp_path / "calendars/day.txt").read_text().split() == ["2024-01-02", "2024-01-03", "2024-01-04"]
    assert (tmp_path / "instruments/all.txt").read_text().splitlines()[1] == "SZ2\t2024-01-03\t2024-01-03"


def test_orders():
    sell, buy = E.orders_of({"a": 1.0, "b": 2.0, "x": 3.0}, {"a": 10.0, "b": 3.0, "c": 5.0}, {"c": 200.0, "a": 100.0}, 50.0)
    assert sell == {"c": 200.0} and buy == {"b": 300.0}
