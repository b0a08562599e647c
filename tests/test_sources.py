import datetime as dt

import pytest
from pyspark.sql import functions as F

from meridia.sources import raw, stores

LINE = "{ex},{sym},{o},{c},{h},{l},{amt},{v},{pos},{bob},{bob},14"


def _file(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(",".join(raw.HISTORICAL) + "\n" + "\n".join(rows) + "\n")


def _bar(sym, bob, close="100.0", volume="10.0"):
    return LINE.format(ex="SHFE", sym=sym, o=100.0, c=close, h=101.0, l=99.0, amt=1000.0, v=volume, pos=1000.0, bob=bob)


def test_tree_to_bars(spark, tmp_path):
    _file(tmp_path / "SHFE/RB/RB2001.csv", [_bar("rb2001", "2019-12-02 21:30:00+08:00"), _bar("rb2001", "2019-12-02 21:31:00+08:00", close="nan"), _bar("rb2001", "2019-12-02 21:32:00+08:00", volume="0.0"), _bar("rb8888", "2019-12-02 21:30:00+08:00")])
    tree = raw.historical_tree(str(tmp_path))
    assert len(tree.discover()) == 1
    bars = raw.normalise(tree.read(spark)).collect()
    assert [(b.contract, b.product, b.delivery_ym, b.wall.hour, b.volume) for b in bars] == [("RB2001", "RB", 202001, 21, 10)]
    assert raw.merge_trees([raw.normalise(tree.read(spark)), raw.normalise(tree.read(spark)).withColumn("tree_priority", F.lit(1))]).collect()[0].tree_priority == 0


def test_header_and_contract_errors():
    raw.check_header(",".join(raw.HISTORICAL), raw.HISTORICAL)
    with pytest.raises(raw.SchemaDriftError):
        raw.check_header("a,b", raw.HISTORICAL)
    assert raw.split_contract("RB2001") == ("RB", 202001)
    for bad in ("RB2013", "rb2001", "ABC2001", "R1"):
        with pytest.raises(raw.ContractError):
            raw.split_contract(bad)
    with pytest.raises(ValueError):
        raw.readers("other", "a", "b")


def test_fingerprint_follows_files(tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("1")
    one = raw.fingerprint([str(f)])
    f.write_text("22")
    assert raw.fingerprint([str(f)]) != one


def _prices(spark, days):
    rows = [(dt.date(2020, 1, d), "SH600519", *[1.0] * 9) for d in days]
    return spark.createDataFrame(rows, stores.PRICES)


def test_price_store_is_idempotent(spark, tmp_path):
    s = stores.PriceStore(spark, str(tmp_path / "p"))
    assert s.read().count() == 0
    assert s.write(_prices(spark, [1, 2])) == (2, 0)
    assert s.write(_prices(spark, [2, 3])) == (1, 1)
    assert s.read(["SH600519"], "2020-01-02", "2020-01-02").count() == 1 and s.symbols() == ["SH600519"]
    assert s.panel(["close"]).columns == ["date", "symbol", "close"]
    with pytest.raises(ValueError):
        s.panel(["nothing"])
    with pytest.raises(stores.SchemaError):
        s.write(spark.range(1))


def test_edges_append_only_and_ledger(spark, tmp_path):
    e = stores.EdgeStore(spark, str(tmp_path / "e"))
    assert e.scan().count() == 0
    one = spark.createDataFrame([(dt.date(2020, 1, 1), "a", "b", 1)], "asof_date date, leader string, follower string, lag_bars int")
    full = one.select("*", *[F.lit(None).cast("string").alias(c.split()[0]) for c in stores.EDGES.split(", ") if c.split()[0] not in one.columns])
    e.append(full, "2020-01-01")
    assert e.scan().count() == 1
    with pytest.raises(Exception):
        e.append(full, "2020-01-01")
    ledger = stores.TrialLedger(spark, str(tmp_path / "t"), batch=2)
    ids = [ledger.log("seed", str(i), "c") for i in range(3)]
    assert len(set(ids)) == 3 and ledger.count() == 3


def test_manifest_cache_and_upsert(spark, tmp_path):
    stores.write_manifest(str(tmp_path), "scan", {"wall_s": 1.5})
    assert stores.read_latest(str(tmp_path)) == {"wall_s": 1.5}
    assert stores.config_hash({"b": 1, "a": 2}) == stores.config_hash({"a": 2, "b": 1})
    c = stores.KeyValueCache(spark, str(tmp_path / "kv"))
    assert c.get("x") is None
    c.put({"x": "1"})
    c.put({"x": "2"})
    assert c.get("x") == "2"
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert sorted(map(tuple, stores.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c")]
