"""Layouts of stored texts, damaged sizes, emission after bounded lookahead, token decoding, token files, hosts."""

import io
import random
import struct

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meridia.llm import arrowseq, bpefst, hilbert, queries, tiff, urllists
from meridia.llm.tokens import WordEncoder


def texts(n=120):
    rng = random.Random(4)
    return [" ".join(rng.choice(("aa", "b", "längere", "x" * 9)) for _ in range(rng.choice((0, 3, 200, 9000)))) for _ in range(n)]


def test_texts_take_every_layout():
    seen, counts = set(), set()
    for t in texts():
        file = tiff.text_to_tiff(t.encode())
        assert file == tiff.text_to_tiff(t.encode())
        found = list(tiff.pages(file))
        assert all(p["error"] is None for p in found)
        assert b"".join(p["pixels"] for p in found) == tiff.text_payload(t.encode())
        seen |= {(p["compression"], p["predictor"], p["tiled"]) for p in found}
        counts.add(len(found))
    assert {c for c, _, _ in seen} == set(tiff.SCHEMES.values()) and {p for _, p, _ in seen} == {1, 2} and {t for _, _, t in seen} == {False, True}
    assert 1 in counts and max(counts) > 3


def test_pages_join_in_order_and_keep_errors(spark):
    good = [tiff.text_to_tiff(t.encode()) for t in texts(40)]
    rows = [(i, bytearray(m)) for i, m in enumerate(good)] + [(100, bytearray(b"junk")), (101, None)]
    df = spark.createDataFrame(rows, "k int, media binary").repartition(3)
    got = {r.k: r for r in tiff.join_pages(tiff.tiff_pages(df)).collect()}
    assert set(got) == {*range(40), 100}
    for i, t in enumerate(texts(40)):
        payload = tiff.text_payload(t.encode())
        assert bytes(got[i].pixels) == payload and got[i].height == len(payload) // 64 and got[i].page >= 1
    assert got[100].pixels is None and got[100].error


def test_sizes_that_the_file_can_not_hold():
    file = bytearray(tiff.write_tiff([tiff.write_page(np.zeros((3, 64), np.uint8))]))
    (at,) = struct.unpack_from("<I", file, 4)
    (n,) = struct.unpack_from("<H", file, at)
    for k in range(n):
        (tag,) = struct.unpack_from("<H", file, at + 2 + 12 * k)
        if tag in (tiff.WIDTH, tiff.HEIGHT, tiff.ROWS_PER_STRIP):
            struct.pack_into("<I", file, at + 2 + 12 * k + 8, 1 << 20)
    (page,) = tiff.pages(bytes(file))
    assert "more samples" in page["error"] and page["pixels"] is None
    for k in range(8, len(file)):
        bad = bytes(file[:k]) + bytes([file[k] ^ 0x5A]) + bytes(file[k + 1 :])
        assert list(tiff.pages(bad))


def test_tokens_come_before_the_end():
    """Lookahead stays below the longest token whatever the length, and ids are those of merging."""
    machine = bpefst.BpeTransducer.of(queries.BYTE_BPE, P.PATTERN)
    longest = max(map(len, machine.ranks))
    rng = random.Random(2)
    for _ in range(20):
        piece = "".join(rng.choice("abcdefghilmnoprstuv") for _ in range(400)).encode()
        taken, given, most = 0, 0, 0

        def fed():
            nonlocal taken
            for b in piece:
                taken += 1
                yield b

        ids = []
        for i in machine.stream(fed()):
            given += len(machine.bytes_of[i])
            ids.append(i)
            most = max(most, taken - given)
        assert ids == [machine.ranks[t] for t in machine._merge(piece)] and most < 2 * longest and given == len(piece)


def test_decoder_over_split_characters():
    machine = bpefst.BpeTransducer.of(queries.BYTE_BPE, P.PATTERN)
    decoder = bpefst.TokenDecoder(machine.bytes_of)
    single = {v[0]: k for k, v in machine.bytes_of.items() if len(v) == 1}
    for text in ("aé日🎉 z", "", "�", "日本語"):
        assert decoder.decode([single[b] for b in text.encode()]) == (text, True)
        assert decoder.decode(machine.encode(text)) == (text, True)
    for bad in (b"\xff a", b"a\xc3", b"\xe2\x28\xa1"):
        text, whole = decoder.decode([single[b] for b in bad])
        assert text == bad.decode(errors="replace") and not whole
    assert len(decoder.states) < 2000


def test_special_tokens_and_odd_letters_as_the_library_has_them():
    plain = Tokenizer.from_file(queries.WORD_BPE)
    rng = random.Random(6)
    marks = ["<|endoftext|>", "a<|startoftext|>b", "İstanbul", "ǅungla", "ﬁn", "ÀÉÎÕÜ", "ÿ.", "µm", "ª", "Straße,", "x!", "Hello.,", "don't", "１２", "é", "​", "ÆØÅ;:", "a\tb", "a b"]
    lines = marks + [" ".join(rng.choice(marks) for _ in range(12)) for _ in range(150)]
    ids, at = WordEncoder.of(queries.WORD_BPE).encode(pa.array(lines, pa.string()))
    for i, want in enumerate(plain.encode_batch(lines, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == want.ids, lines[i]


def test_wide_ids_and_streamed_files():
    sink = io.BytesIO()
    out = arrowseq.SequenceWriter(sink, 8, True)
    ids = np.arange(70_000, 70_000 + 9000, dtype=np.uint32)
    for at in range(0, len(ids), 700):
        out.append(ids[at : at + 700])
    out.close()
    reader = arrowseq.SequenceReader(pa.BufferReader(sink.getvalue()))
    at = 0
    for n in (0, 1, 4095, 4097, 0, 807):
        assert np.array_equal(reader.ids(at, n), ids[at : at + n])
        at += n
    assert at == len(ids) and arrowseq.sequence_schema(8, False).field(0).type.value_type == pa.uint16()


def test_hosts(spark):
    rows = [("http://[2001:db8::1]:80/x/", "[2001:db8::1]"), ("http://" + "." * 8000 + "/", None), ("http://" + "a." * 300 + "com/", None), ("https://User@Example.COM./a/b", "example.com"), ("no url", None), (None, None), ("http://a.b.c/d/e", "a.b.c")]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id int, url string")
    got = {r.page_id: r.h for r in df.select("page_id", urllists.host_of(F.col("url")).alias("h")).collect()}
    assert [got[i] for i in range(len(rows))] == [h for _, h in rows]
    keys = urllists.capture_keys(df)
    assert keys.groupBy("page_id").count().agg(F.max("count")).first()[0] <= 128
    assert {(r.kind, r.value) for r in keys.where("page_id = 0").collect()} == {("host", "[2001:db8::1]"), ("domain", "[2001:db8::1]"), ("folder", "[2001:db8::1]/x")}


@pytest.mark.parametrize("kind", ["onehot", "binary"])
def test_ties_at_the_last_place_go_to_smaller_ids(spark, kind):
    """Thousands of distinct vectors at one distance, all in the window of a small table."""
    n = 300
    x = np.eye(n) if kind == "onehot" else np.array([[(i >> b) & 1 for b in range(9)] for i in range(1, n + 1)], dtype=float)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = hilbert.nearest(spark, df).toPandas()
    for q in range(0, n, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == np.lexsort((np.arange(n), d))[:10].tolist()
