import random

import numpy as np
import pyarrow as pa
from test_duplicates import brute_removal

from meridia.llm import substrings
from meridia.llm.textscan import Lane, slices


def brute_tree(rows, width, gram):
    """(leaf, offset) of windows that an earlier leaf of the same prefix has at the same offset."""
    seen, out = set(), set()
    for i, (prefix, far, near, words) in enumerate(rows):
        for o in range(near, far + 1):
            key = (prefix, o, tuple(words[far - o : far - o + width]))
            if key in seen:
                out.add((i, o))
            seen.add(key)
    return out


def test_tree_tells_words_apart_whatever_the_prefix():
    """All suffixes share two prefixes, as colliding hashes would have it: the words decide."""
    rng, width, gram = random.Random(2), 12, 8
    rows = []
    for k in range(400):
        far = rng.randrange(0, width - gram + 1)
        near = rng.randrange(0, far + 1)
        words = [f"w{rng.choice((1, 1, 1, 1, 1, 2)) if rng.random() < 0.1 else 0}" for _ in range(far + width - near)]
        rows.append((k % 2, far, near, words))
    contexts = pa.array([" ".join(r[3]).encode() for r in rows], pa.binary())
    again, leads = substrings.tree_repeats(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), contexts, width)
    want = brute_tree(rows, width, gram)
    assert set(zip(*map(np.ndarray.tolist, np.nonzero(again)), strict=True)) == want and len(want) > 100
    firsts = {i for i, r in enumerate(rows) if any((i, o) not in want for o in range(r[2], r[1] + 1))}
    assert set(np.flatnonzero(leads).tolist()) == firsts


def test_anchors_cover_each_window_once():
    texts = pa.array(["", "a b c", " ".join(f"x{i % 37}" for i in range(300)), None, " ".join("same" for _ in range(50))])
    (w,) = slices(texts)
    a = substrings.Anchors(w, Lane(23).words(w.data, w.starts, w.ends), 20)
    windows = [s for lo, hi in zip(a.low.tolist(), a.high.tolist(), strict=True) for s in range(lo, hi + 1)]
    first = w.first.tolist()
    assert windows == [s for lo, hi in zip(first[:-1], first[1:], strict=True) for s in range(lo, hi - 19)]
    assert ((a.at >= a.high) & (a.at + 8 <= a.low + 20)).all()


def test_repeated_ids_and_clashing_columns(spark):
    """Rows that share an id and differ, and columns named as the operator's own."""
    p = [" ".join(f"p{k}w{i}" for i in range(30)) for k in range(3)]
    rows = [(1, p[0] + " end"), (2, "short"), (2, "x " + p[0] + " y"), (2, p[1]), (3, p[1] + " tail"), (None, p[0]), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as id", "7 as part", "'r' as row", "1 as n", "2 as f1", "'s' as rest", "array(1) as __spans", "'k' as kept")
    out = substrings.cut_texts(spark, docs.coalesce(1))
    assert out.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
    assert got == sorted([(1, p[0] + " end"), (2, "short"), (2, "x y"), (2, p[1]), (3, "tail"), (0, p[0]), (4, ""), (4, "")])
    assert out.where("part <> 7 or row <> 'r' or kept <> 'k' or not id <=> doc_id").count() == 0


def test_hot_passage_over_many_parts(spark, table):
    """A passage that most documents share, in many parts, read with room for five suffixes."""
    passage = " ".join(f"p{i}" for i in range(33))
    rng = random.Random(9)
    rows = [(i, " ".join([f"a{i}"] * rng.randrange(3) + [passage] + [f"b{rng.randrange(4)}"] * rng.randrange(30))) for i in range(90)]
    want = brute_removal(rows, 20)
    got = substrings.without_repeats(spark, table(rows).repartition(7), 20, 5).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == want
    spans = {r.doc_id: r.spans for r in got}
    assert all(sum(b - a for a, b in zip(s[0::2], s[1::2], strict=True)) == want[i][1] for i, s in spans.items())


def test_texts_of_twenty_thousand_words(spark, table):
    words = [f"w{i % 6007}" for i in range(20_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[500:900]))]
    got = substrings.without_repeats(spark, table(rows)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in got} == brute_removal(rows, 20)
