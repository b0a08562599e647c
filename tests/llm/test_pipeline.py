"""The pipeline against brute force behind its two models, and each stage on odd rows."""

import zlib

import corpus_pipeline as C
import numpy as np
import pytest
from test_duplicates import WORD, brute_components
from tokenizers import Tokenizer

HF = Tokenizer.from_file(C.WORD_BPE)


def brute_cut(rows, width):
    """Texts without the windows that start earlier; those without any stay as they are, empty ones go."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = [x.decode() for x in WORD.findall((t or "").encode())]
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone[k : k + width] = [True] * width
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        if not any(gone):
            out[i] = t
        elif kept:
            out[i] = kept
    return out


def brute_pieces(texts, capacity=2048):
    out = {}
    for i, t in texts.items():
        ids = np.array([*HF.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            out[i, k] = (a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes()))
    return out


def test_run_equals_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k in range(2):
        C.STAGES[k][1](spark, docs, sf).write.parquet(str(tmp_path / f"s{k}"))
        docs = spark.read.parquet(str(tmp_path / f"s{k}"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = brute_components(rows, 80, 100, 5)
    texts = brute_cut([(i, t) for i, t in rows if groups[i][1] == i], 20)
    want = brute_pieces(texts)
    got = C.run(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1


CLASH = "*, 1 as n, 'x' as score, 2 as part, 3 as row, 'k' as kept, 4 as id, 5 as rest, 6 as lang_pred, 7 as __spans, 8 as __gone, 9 as piece, 10 as f1, 11 as root, 12 as class_id"
LONG = " ".join(f"word{i % 900}" for i in range(20_000))
ODD = [(1, "The quick brown fox jumps over the lazy dog near the river bank. " * 6), (1, "The quick brown fox jumps over the lazy dog near the river bank. " * 6), (2, None), (3, ""), (4, " \n\t "), (5, LONG), (6, LONG + " end"), (7, "7"), (None, "no id here, but words"), (None, None), (8, "ein kurzer Satz mit Wörtern und Ünïcödé 🎉"), (8, "another text under the same id")]


@pytest.mark.parametrize("stage", [name for name, _ in C.STAGES])
@pytest.mark.parametrize("rows", [ODD, [], [(None, None)], [(2, None), (2, None)]], ids=["odd", "empty", "null", "twice"])
def test_stages_take_odd_rows(spark, sf, stage, rows):
    docs = spark.createDataFrame([(i, t, "en" if k % 2 else None, None, None if t is None else len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").selectExpr(*CLASH.split(", "))
    out = dict(C.STAGES)[stage](spark, docs, sf)
    got = out.collect()
    if stage == "packing":
        assert {r.doc_id for r in got} == {i for i, _ in rows}
        assert sum(r.length for r in got) == sum(len(HF.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
        return
    assert out.columns == docs.columns and len(got) <= len(rows)
    assert all(r["__spans"] == 7 and r.kept == "k" and r.part == 2 for r in got)
    if stage == "near duplicates" and len(rows) > 3:
        ids = [r.doc_id for r in got]
        # 6 holds 5 and a word more; rows without an id and texts without words stay
        assert 6 not in ids and 5 in ids and ids.count(None) == 2 and {2, 3, 4, 7} <= set(ids)
    if stage == "substrings" and len(rows) > 3:
        texts = sorted((r.doc_id or 0, r.text or "") for r in got)
        assert (8, "another text under the same id") in texts and (0, "no id here, but words") in texts and sum(i == 1 for i, _ in texts) == 1
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
