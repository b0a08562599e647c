"""Vector search over stored chunks, graph neighbourhoods and clustering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.session import written


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    bottom = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(bottom > 0, dot(a, b) / F.when(bottom > 0, bottom))


def search(store: DataFrame, query: list[float], k: int, least: float = -1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, score): the k most similar of the store to one query vector; ties go to the smaller id."""
    q = F.array(*[F.lit(float(v)) for v in query])
    scored = store.select(id_col, cosine(F.col(vector_col), q).alias("score")).where(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def neighbours_within(nodes: DataFrame, edges: DataFrame, start: list, steps: int, label: str | None = None, block: bool = False) -> DataFrame:
    """(node, distance) of nodes that undirected edges (a, b) reach in at most ``steps`` steps. With a
    label, only nodes of it are returned, and with ``block`` other nodes aren't passed through. Edges and each
    step's new nodes are written, so a step reads tables and the plan doesn't grow."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    kinds = nodes.select(F.col("node"), F.col("label"))
    front = written(nodes.where(F.col("node").isin(start)).select("node", F.lit(0).alias("distance")), "front")
    seen = front
    for step in range(1, steps + 1):
        if block and label is not None and step > 1:
            front = front.join(kinds.where(F.col("label") == label), "node", "left_semi")
        new = front.join(both, front["node"] == both["a"]).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        front = written(new.withColumn("distance", F.lit(step)), "front")
        seen = seen.union(front)
    return seen.join(kinds.where(F.col("label") == label), "node", "left_semi") if label is not None else seen


def chunks(df: DataFrame, text: str, size: int) -> DataFrame:
    """A row per stretch of ``size`` characters of the text, numbered from 0; an empty text has none."""
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(1), F.length(text), F.lit(size)))
    return df.select("*", F.posexplode(starts).alias("chunk_no", "__at")).withColumn("chunk", F.substring(F.col(text), F.col("__at"), F.lit(size))).drop("__at")


def cosine_kmeans(store: DataFrame, k: int = 20, iterations: int = 100, vector_col: str = "embedding", seed: int = 1) -> DataFrame:
    """Adds cluster: k-means under cosine distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = store.withColumn("__v", array_to_vector(F.col(vector_col).cast("array<double>")))
    model = KMeans(k=k, maxIter=iterations, distanceMeasure="cosine", seed=seed, featuresCol="__v", predictionCol="cluster").fit(rows)
    return model.transform(rows).drop("__v")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
