import datetime as dt
import zlib

import numpy as np
import pytest
from oracle import expected, same

from meridia.llm import bigru, hilbert, quality, queries, urllists


def test_op3_against_sql(spark, sf):
    same(queries.op3_temporal_list_join(spark, sf).toPandas(), expected(queries.OP3_SQL, sf))


def test_list_intervals_and_odd_captures(spark):
    D = dt.date
    entries = spark.createDataFrame(
        [("host", "a.com", D(2024, 1, 1), "add"), ("host", "a.com", D(2024, 3, 1), "remove"), ("host", "a.com", D(2024, 3, 1), "add"), ("domain", "b.org", D(2024, 2, 1), "add"), ("folder", "x.b.org/z", D(2024, 2, 2), "add"), ("host", None, D(2024, 1, 1), "add"), ("host", "c.com", None, "add"), ("host", "d.com", D(2024, 1, 1), "remove")],
        urllists.ENTRY,
    )
    captures = spark.createDataFrame(
        [(1, "https://A.com/q", D(2024, 2, 29)), (2, "http://a.com", D(2024, 3, 1)), (3, "http://u@x.b.org:80/z/y?k", D(2024, 2, 2)), (4, "http://x.b.org/z/", D(2024, 2, 1)), (5, None, D(2024, 1, 1)), (6, "no url", D(2024, 1, 1)), (7, "http://a.com/", None), (1, "https://A.com/q", D(2024, 2, 29)), (8, "http://d.com", D(2025, 1, 1))],
        "page_id int, url string, fetched_on date",
    ).selectExpr("*", "'clash' as kind", "1 as value", "2 as host")
    got = {r.page_id: (r.n_active, r.blocked, r.reason) for r in urllists.evaluate(captures, entries).collect()}
    assert got == {1: (1, True, "host:a.com"), 2: (0, False, None), 3: (2, True, "folder:x.b.org/z"), 4: (1, True, "domain:b.org"), 5: (0, False, None), 6: (0, False, None), 7: (0, False, None), 8: (0, False, None)}
    assert urllists.evaluate(captures.limit(0), entries).count() == 0
    assert all(not r.blocked for r in urllists.evaluate(captures, entries.limit(0)).collect())


def test_pairwise_weights_rank():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 600)
    x = rng.normal(size=(600, 5)) + y[:, None] * np.array([2, -2, 0, 0, 0])
    model = quality.fit_pairs(x, y)
    s = model.score(x)
    assert ((s >= quality.CUT) == y).mean() > 0.9 and ((s > 0) & (s < 1)).all()
    alone = quality.fit_pairs(x, np.ones(600))
    assert np.allclose(alone.score(x), quality.CUT)
    assert np.allclose(quality.fit_pairs(np.zeros((0, 5)), np.zeros(0)).score(x), quality.CUT)


def test_quality_held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality_scores(spark, docs, labels).toPandas().set_index("doc_id")
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    assert all(bool(got.held_out[i]) == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got.index)
    known = labels.toPandas().set_index("doc_id").quality
    assert (got.predicted[known.index] == known).mean() > 0.95


def test_quality_of_odd_rows(spark, table, odd_rows):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, None, 0), (None, 1, 0), (5, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(spark, table(odd_rows), labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert quality.good_documents(spark, table(odd_rows), labels).columns == table(odd_rows).columns
    assert quality.quality_scores(spark, table([]), labels.limit(0)).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = bigru.new_network(["a", "b", "c"], hidden=5)
    x = rng.integers(97, 110, (7, 4))
    x[5:, 0] = bigru.PAD
    y = np.array([0, 1, 2, 1])
    _, grads = bigru.gradients(net, x, y)
    for p, g in zip([*net.tables, *net.recurrences, net.read, net.bias], grads, strict=True):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        was = p[at]
        p[at] = was + 1e-2
        up = bigru.gradients(net, x, y)[0]
        p[at] = was - 1e-2
        down = bigru.gradients(net, x, y)[0]
        p[at] = was
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.02, abs=1e-4)


def test_network_learns_and_pools():
    texts = [b"the thing and this there " * 8, "über schön größe weiß ".encode() * 8]
    net = bigru.train(texts * 20, ["en", "de"] * 20, steps=200, batch=32)
    p = bigru.document_probabilities(net, [b"this thing", "größe schön".encode(), b"", b"the " * 3000])
    assert [net.languages[k] for k in p[[0, 1, 3]].argmax(axis=1)] == ["en", "de", "en"]
    assert p[2].tolist() == [0.5, 0.5] and np.allclose(p.sum(axis=1), 1)
    assert bigru.train([], []).languages == ["und"] and bigru.train([b"x"], ["en"]).languages == ["en"]


def test_language_of_odd_rows(spark, table, odd_rows):
    got = bigru.language_of(spark, table(odd_rows)).collect()
    texts = dict(odd_rows)
    assert len(got) == len(odd_rows)
    for r in got:
        has_letter = any(c.isalpha() for c in texts[r.doc_id] or "")
        assert (r.lang_pred == "und" and r.score == 0) if not has_letter else (r.lang_pred in ("en", "de") and 0 < r.score <= 1)
    assert bigru.known_language(spark, table(odd_rows)).columns == table(odd_rows).columns
    assert bigru.language_of(spark, table([])).count() == 0


def test_hilbert_keys_are_a_walk():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16))
    x[700:760] = x[100]
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)]
    rows += [(5000, None), (5100, [0.0] * 16), (5200, [float("nan")] * 16), (5300, [1.0]), (None, [1.0] * 16), (5400, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as label", "2 as cell")
    got = hilbert.nearest(spark, df).toPandas()
    hits = total = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(1500), d))[:10]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and np.allclose(own.score, d[own.vec_id])
        hits += len(set(own.vec_id) & set(want))
        total += 10
        if q in (100, 700):
            assert own.vec_id.tolist() == want.tolist()
    assert set(got.query_id) == set(range(0, 1500, 100)) and hits / total >= 0.9
    few = hilbert.nearest(spark, df.where("vec_id in (0, 3, 9)")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, 1), (0, 2)]
    assert hilbert.nearest(spark, df.limit(0)).count() == 0


def test_pipeline_stages(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    before = docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0.5 * before < docs.count() <= before
    assert "sequence_id" in docs.columns
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
