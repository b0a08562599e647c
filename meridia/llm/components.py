"""Connected components of an edge table by repeated contraction; nothing of it reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.workspace import Workspace


def components(edges: DataFrame, space: Workspace, step: str) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node that links reach.

    ``edges`` holds columns u and v; loops and repeated edges do no harm, rows with a null end are
    left out, and an empty table gives an empty result. Each round hangs every node under its
    smallest neighbour, shortens the paths and joins the trees' edges; the number of trees at
    least halves, so rounds grow with the logarithm of the longest path.
    """
    k = 0
    e = space.write(edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{step}-e0")
    whole = None
    while not e.isEmpty():
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = space.write(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("p")), f"{step}-p{k}")
        for hop in range(2):
            up = parents.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            parents = parents.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
            parents = space.write(parents, f"{step}-p{k}h{hop}")
        a = parents.select(F.col("u").alias("u"), F.col("p").alias("pu"))
        b = parents.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        following = e.join(a, "u").join(b, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        following = space.write(following, f"{step}-e{k + 1}")
        if whole is None:
            whole = parents.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            whole = whole.join(a.select(F.col("u").alias("root"), "pu"), "root", "left").select("node", F.coalesce("pu", "root").alias("root"))
        whole = space.write(whole, f"{step}-w{k}")
        space.drop(f"{step}-e{k}", f"{step}-p{k}", f"{step}-p{k}h0", f"{step}-w{k - 1}")
        e, k = following, k + 1
    if whole is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return whole
