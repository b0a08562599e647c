import numpy as np
import pytest
from test_duplicates import LOWER, WORD, near_copies

from meridia.llm import jaccard, queries


def brute_links(rows, num, den, words):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    kinds = {s for s in sets.values() if s}
    near = {a: sum(a != b and den * len(a & b) >= num * len(a | b) for b in kinds) for a in kinds}
    return {i: near.get(s, 0) for i, s in sets.items()}


@pytest.mark.parametrize("side", [256, 7])
def test_links_equal_brute_force(spark, table, odd_rows, monkeypatch, side):
    """With one hub for forty texts that all link, in one block and in many."""
    monkeypatch.setattr(jaccard, "SIDE", side)
    base = [f"b{i}" for i in range(200)]
    group = [(2000 + i, " ".join(base[:40 + 4 * i] + [f"x{i}"] + base[41 + 4 * i:])) for i in range(40)]
    rows = near_copies(5) + [(1000 + i, t) for i, t in odd_rows if i is not None] + group
    want = brute_links(list(dict(rows).items()), 85, 100, 4)
    got = jaccard.jaccard_components(spark, table(rows), jaccard.Threshold(85, 100, 4)).collect()
    assert {r.doc_id: r.n_links for r in got} == want and want[2003] == 39


def test_overlaps():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, 4000)).astype(np.uint64) for _ in range(9)] + [np.array([9500], np.uint64)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    own = jaccard.overlaps(sets)
    assert all(own[i, j] == want[i][j] for i in range(10) for j in range(10) if i != j)
    assert np.array_equal(jaccard.overlaps(sets[:4], sets[4:]), np.array(want)[:4, 4:])


def test_op4_gives_its_links(spark, sf):
    assert "n_links" in queries.op4_ngram_jaccard(spark, sf).columns
