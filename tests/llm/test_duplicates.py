import collections
import hashlib
import random
import re

import numpy as np
import pytest

from meridia.llm import jaccard, substrings
from meridia.llm.components import components
from meridia.llm.textscan import ngrams
from meridia.llm.workspace import Workspace

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute_components(rows, num, den, words):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").encode().translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(seed, n=160):
    rng = random.Random(seed)
    rows, word = [], lambda: f"w{rng.randrange(4000)}"
    bases = [[word() for _ in range(rng.choice((3, 8, 40, 120)))] for _ in range(12)]
    common = [word() for _ in range(25)]
    for i in range(n):
        base = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 2, 6))):
            base[rng.randrange(len(base))] = word()
        if rng.random() < 0.3:
            base += common
        rows.append((i, " ".join(base).upper() if rng.random() < 0.1 else " ".join(base)))
    return rows


@pytest.mark.parametrize("num,words", [(85, 4), (80, 5)])
def test_components_equal_brute_force(spark, table, odd_rows, num, words):
    extra = [(1000 + i, t) for i, t in odd_rows if i is not None]
    rows = near_copies(num) + extra
    want = brute_components(list(dict(rows).items()), num, 100, words)
    got = jaccard.jaccard_components(spark, table(rows), jaccard.Threshold(num, 100, words)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(want)


def test_near_copies_that_the_hub_does_not_link(spark, table):
    """A chain: each text links with the next, but not with the first."""
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 100])) for i in range(12)]
    got = jaccard.jaccard_components(spark, table(rows), jaccard.Threshold(80, 100, 5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 80, 100, 5)


def test_one_document_of_each_group_stays(spark, table, odd_rows):
    out = jaccard.one_per_group(spark, table(odd_rows))
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    assert (False, 1) not in kept and (False, 0) in kept and (True, 0) in kept
    assert jaccard.jaccard_components(spark, table([])).count() == 0


def test_suffix_filter_is_an_upper_bound():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 200, rng.integers(0, 80))).astype(np.uint64) for _ in range(2))
        assert jaccard.overlap_bound(a, b) >= len(np.intersect1d(a, b))


def test_components_of_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 150)]
    got = components(spark.createDataFrame(edges, "u long, v long"), Workspace(spark, "test"), "t").collect()
    assert {r.node: r.root for r in got} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 150, 200: 150}


def brute_removal(rows, width):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone[k : k + width] = [True] * width
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("group", [3, 100_000])
def test_removal_equals_brute_force(spark, table, odd_rows, group):
    rng = random.Random(5)
    passages = [[f"p{k}x{i}" for i in range(rng.choice((19, 20, 21, 45)))] for k in range(6)]
    rows = []
    for i in range(120):
        words = [f"u{i}y{k}" for k in range(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            words += rng.choice(passages) + [f"z{i}"] * rng.randrange(3)
        if rng.random() < 0.2:
            words += ["Und"] * rng.randrange(60)
        rows.append((i, " ".join(words)))
    rows += [(500 + i, t) for i, t in rows[:10]] + [(1000 + i, t) for i, t in odd_rows if i is not None]
    want = brute_removal(list(dict(rows).items()), 20)
    got = substrings.without_repeats(spark, table(rows), 20, group).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want
    digest = hashlib.sha256(want[500][2].encode()).hexdigest()
    assert digest == hashlib.sha256(next(r.kept for r in got if r.doc_id == 500).encode()).hexdigest()


def test_cut_texts_keeps_the_rest(spark, table):
    passage = " ".join(f"w{i}" for i in range(30))
    rows = [(1, passage), (2, "a\n b  c"), (3, "head " + passage), (4, passage), (None, passage)]
    out = {r.doc_id: r for r in substrings.cut_texts(spark, table(rows)).collect()}
    assert out[2].text == "a\n b  c" and out[3].text == "head" and out[3].n_chars == 4 and 4 not in out
    assert out[None].text == passage and substrings.cut_texts(spark, table([])).count() == 0


def test_ngrams_tell_order_and_content():
    h = np.arange(1, 50, dtype=np.uint64)
    for n in (1, 2, 5, 20):
        g = ngrams(h, n)
        assert len(g) == 50 - n and len(set(g.tolist())) == len(g)
    again = np.concatenate([h, h])
    counts = collections.Counter(ngrams(again, 20).tolist())
    assert sorted(counts.values(), reverse=True)[:30] == [2] * 30
