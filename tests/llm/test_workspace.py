"""The shared folder, and tables by part."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from meridia.llm.workspace import Workspace, shared_root, side_rows


def test_shared_root_needs_a_shared_folder():
    session = lambda master, folder=None: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default), sparkContext=SimpleNamespace(master=master))
    assert shared_root(session("yarn", "file:///mnt/shared/")) == "file:///mnt/shared" and shared_root(session("local[2]"))
    for master in ("yarn", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError):
            shared_root(session(master))


def test_rows_by_part(spark):
    space = Workspace(spark, "test")
    df = spark.range(1000).select((F.col("id") % 7).cast("int").alias("part"), F.col("id").alias("row"), (F.col("id") % 2 == 0).alias("hot"))
    folder = space.write_parts(df, "rows", "part")
    for k in range(7):
        got = side_rows(folder, k, ["row", "hot"])
        assert sorted(got["row"].to_pylist()) == list(range(k, 1000, 7)) and got["hot"].to_pylist() == [r % 2 == 0 for r in got["row"].to_pylist()]
    assert side_rows(folder, 99, ["row", "hot"]).num_rows == 0
    empty = space.write_parts(df.limit(0), "none", "part")
    assert side_rows(empty, 0, ["row"]).num_rows == 0
