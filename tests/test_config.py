import pytest

from meridia.operators import stats
from meridia.sources import config


def test_toml_refuses_unknown_keys(tmp_path):
    f = tmp_path / "a.toml"
    f.write_text("[slice]\nstart = '2019-01-01'\n")
    assert config.load_toml(str(f), {"slice": {"start"}})["slice"]["start"] == "2019-01-01"
    for known in ({"slice": set()}, {"other": {"start"}}):
        with pytest.raises(config.ConfigError):
            config.load_toml(str(f), known)


def test_costs_and_constituents(spark, tmp_path):
    assert config.costs_table(spark, {"RB": {"fee": 1, "slippage": 0.5}}).collect()[0].fee == 1.0
    with pytest.raises(config.ConfigError):
        config.costs_table(spark, {"RB": {"fee": 1}})
    f = tmp_path / "c.tsv"
    f.write_text("SZ000001\t2010-01-01\t2020-01-31\nSH600000\t2010-01-01\t2015-01-01\n")
    got = config.constituents(spark, str(f), "2030-01-01").collect()
    assert [(r.stock_code, str(r.out_date)) for r in got] == [("SH600000", "2015-01-01"), ("SZ000001", "2030-01-01")]


def test_formula_zoo(tmp_path):
    zoo = config.FormulaZoo(str(tmp_path / "zoo.csv"), most_shared=3)
    assert zoo.add("a", "TS_MEAN($close, 5) - $open") and not zoo.add("b", "TS_MEAN($close, 5) - $open + $low")
    assert config.FormulaZoo(str(tmp_path / "zoo.csv")).formulas == {"a": "TS_MEAN($close, 5) - $open"}


def test_day_strata(spark):
    rows = [(d,) for d, n in enumerate((2, 2, 3, 3, 2)) for _ in range(n)]
    got = stats.day_strata(spark.createDataFrame(rows, "segment int")).orderBy("segment").collect()
    assert [r.stratum for r in got] == [0, 0, 1, 1, 2]
