import numpy as np
import pytest

from meridia.llm import hilbert


def recall(spark, x, every=50):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = hilbert.nearest(spark, df, every).toPandas()
    hits = total = 0
    for q in range(0, len(x), every):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(len(x)), d))[:10]
        hits += len(set(got[got.query_id == q].vec_id) & set(want.tolist()))
        total += 10
    return hits / total


@pytest.mark.parametrize("kind", ["far", "cluster"])
def test_recall_with_far_vectors_and_a_tight_cluster(spark, kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    if kind == "far":
        x[[7, 1207, 2911]] *= 5000
    else:
        x[::2] = 3 + 1e-4 * rng.normal(size=(1500, 16))
    found = recall(spark, x)
    print("RECALL", kind, found)
    assert found >= 0.97
