"""Scratch folders: named by the cluster, temporary in local mode, an error elsewhere."""

from types import SimpleNamespace

import pytest

from meridia.session import scratch_root, written


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(master=master))


def test_roots():
    assert scratch_root(session("spark://host:7077", "hdfs://x/shared/")) == "hdfs://x/shared"
    assert scratch_root(session("local[4]")) and scratch_root(session("local"))
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        with pytest.raises(ValueError):
            scratch_root(session(master))


def test_written_rows_come_back(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    back = written(df, "test")
    assert back.schema == df.schema and sorted(back.collect()) == sorted(df.collect())
