"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text is read as UTF-8 bytes in segments of ``SEGMENT``. Two gated recurrent layers, one from the
left and one from the right, label every byte with class probabilities; a document's probabilities
are the means over all its bytes. Training is backpropagation through time on windows of labelled
texts with Adam, from a fixed seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from meridia.llm.quality import held_out
from meridia.llm.tokens import pieces_of_batch
from meridia.llm.workspace import ship, tidy

SEGMENT = 128
HIDDEN = 12
#: Documents of each language that the network is trained on, and training windows of each of them.
PER_LANGUAGE = 400
WINDOWS = 4
PAD = 256
UNKNOWN = "und"


@dataclass
class Network:
    """Weights of both directions: byte tables (257, 3H), recurrences (H, 3H), and the read-out."""

    languages: list[str]
    tables: list[np.ndarray]
    recurrences: list[np.ndarray]
    read: np.ndarray
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def new_network(languages: list[str], hidden: int = HIDDEN, seed: int = 1) -> Network:
    rng = np.random.default_rng(seed)
    f = np.float32
    return Network(
        languages,
        [(rng.normal(size=(257, 3 * hidden)) * 0.3).astype(f) for _ in range(2)],
        [(rng.normal(size=(hidden, 3 * hidden)) / np.sqrt(hidden)).astype(f) for _ in range(2)],
        (rng.normal(size=(2 * hidden, len(languages))) * 0.1).astype(f),
        np.zeros(len(languages), f),
    )


def _layer(x: np.ndarray, table: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (T, B, H) of bytes x (T, B) read in order; a pad leaves the state empty. Gates: z
    updates, r resets."""
    steps, batch = x.shape
    pads = x == PAD
    padded = pads.any(axis=1)
    n = u.shape[0]
    states = np.empty((steps, batch, n), np.float32)
    h = np.zeros((batch, n), np.float32)
    u_gates, u_new = np.ascontiguousarray(u[:, : 2 * n]), np.ascontiguousarray(u[:, 2 * n :])
    for t in range(steps):
        a = table[x[t]]
        gates = h @ u_gates
        gates += a[:, : 2 * n]
        gates = _sigmoid(gates)
        z, r = gates[:, :n], gates[:, n:]
        reset = r * h
        new = reset @ u_new
        new += a[:, 2 * n :]
        np.tanh(new, out=new)
        if keep is not None:
            keep.append((z.copy(), r.copy(), new.copy(), h.copy()))
        # h + z (new - h)
        new -= h
        new *= z
        h = h + new
        if padded[t]:
            h[pads[t]] = 0
        states[t] = h
    return states


def label_positions(net: Network, x: np.ndarray) -> np.ndarray:
    """Class probabilities (T, B, K) of every byte of x (T, B); pad is 256."""
    left = _layer(x, net.tables[0], net.recurrences[0])
    right = _layer(x[::-1], net.tables[1], net.recurrences[1])[::-1]
    n = left.shape[2]
    logits = left.reshape(-1, n) @ net.read[:n] + np.ascontiguousarray(right).reshape(-1, n) @ net.read[n:] + net.bias
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits.reshape(*x.shape, -1)


def _back(x: np.ndarray, u: np.ndarray, kept: list, d_states: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of table and recurrence, through time."""
    n = u.shape[0]
    d_table, d_u = np.zeros_like(table), np.zeros_like(u)
    d_h = np.zeros_like(d_states[0])
    for t in range(len(kept) - 1, -1, -1):
        z, r, new, h = kept[t]
        d_h = d_h + d_states[t]
        d_h[x[t] == PAD] = 0
        d_new = d_h * z * (1 - new * new)
        d_z = d_h * (new - h) * z * (1 - z)
        d_reset = d_new @ u[:, 2 * n :].T
        d_r = d_reset * h * r * (1 - r)
        d_u[:, 2 * n :] += (r * h).T @ d_new
        d_gates = np.concatenate([d_z, d_r], axis=1)
        d_u[:, : 2 * n] += h.T @ d_gates
        d_h = d_h * (1 - z) + d_reset * r + d_gates @ u[:, : 2 * n].T
        d_a = np.concatenate([d_gates, d_new], axis=1)
        order = np.argsort(x[t], kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(x[t][order]) != 0]))
        d_table[x[t][order][first]] += np.add.reduceat(d_a[order], first, axis=0)
    return d_table, d_u


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all bytes other than pads, and its gradients: tables, recurrences, read, bias."""
    kept: list[list] = [[], []]
    left = _layer(x, net.tables[0], net.recurrences[0], kept[0])
    right = _layer(x[::-1], net.tables[1], net.recurrences[1], kept[1])[::-1]
    both = np.concatenate([left, right], axis=2)
    n = left.shape[2]
    logits = both @ net.read + net.bias
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    real = (x != PAD).astype(np.float32)
    total = max(real.sum(), 1)
    at = (np.arange(x.shape[0])[:, None], np.arange(x.shape[1])[None], y[None])
    loss = float(-(np.log(np.maximum(p[at], 1e-12)) * real).sum() / total)
    p[at] -= 1
    p *= (real / total)[:, :, None]
    flat = p.reshape(-1, p.shape[2])
    d_read, d_bias = both.reshape(-1, 2 * n).T @ flat, flat.sum(axis=0)
    d_both = p @ net.read.T
    lt, lu = _back(x, net.recurrences[0], kept[0], d_both[:, :, :n], net.tables[0])
    rt, ru = _back(x[::-1], net.recurrences[1], kept[1], d_both[::-1, :, n:], net.tables[1])
    return loss, [lt, rt, lu, ru, d_read, d_bias]


def train(texts: list[bytes], labels: list[str], steps: int = 480, batch: int = 128, seed: int = 1) -> Network:
    """A network for the distinct labels. Windows are drawn with equal chance of each language."""
    languages = sorted(set(labels))
    net = new_network(languages or [UNKNOWN], seed=seed)
    if len(languages) < 2:
        return net
    rng = np.random.default_rng(seed)
    by = [[t for t, g in zip(texts, labels, strict=True) if g == lang and t] for lang in languages]
    usable = [k for k, own in enumerate(by) if own]
    parts = [*net.tables, *net.recurrences, net.read, net.bias]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        x, y = np.full((SEGMENT // 2, batch), PAD, dtype=np.int64), np.empty(batch, dtype=np.int64)
        for b in range(batch):
            y[b] = usable[b % len(usable)]
            own = by[y[b]]
            text = own[rng.integers(len(own))]
            at = rng.integers(max(1, len(text) - len(x) + 1))
            piece = np.frombuffer(text[at : at + len(x)], dtype=np.uint8)
            x[: len(piece), b] = piece
        _, grads = gradients(net, x, y)
        rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for p, g, m, v in zip(parts, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def document_probabilities(net: Network, texts: list[bytes], batch: int = 1024) -> np.ndarray:
    """(documents, languages): class probabilities pooled over every byte; 1/K each for an empty text."""
    k = len(net.languages)
    sums, counts = np.zeros((len(texts), k)), np.zeros(len(texts))
    pieces, owners, sizes = [], [], []

    def flush() -> None:
        x = np.full((len(pieces), SEGMENT), PAD, dtype=np.int64)
        for i, p in enumerate(pieces):
            x[i, : len(p)] = np.frombuffer(p, dtype=np.uint8)
        p = label_positions(net, np.ascontiguousarray(x.T))
        p *= (x.T != PAD)[:, :, None]
        np.add.at(sums, owners, p.sum(axis=0))
        np.add.at(counts, owners, sizes)
        pieces.clear()
        owners.clear()
        sizes.clear()

    for i, text in enumerate(texts):
        for at in range(0, len(text), SEGMENT):
            pieces.append(text[at : at + SEGMENT])
            owners.append(i)
            sizes.append(len(pieces[-1]))
            if len(pieces) == batch:
                flush()
    if pieces:
        flush()
    return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], 1 / k)


def learn(spark: SparkSession, documents: DataFrame, per_language: int = PER_LANGUAGE) -> Network:
    """Trains on at most about ``per_language`` documents of each language, chosen by a hash of the id,
    held-out documents left out. Of each text, ``WINDOWS`` stretches go to the driver, evenly spread,
    so a long text costs no more than a short one. Null languages, ids and texts don't count."""
    known = documents.where("doc_id is not null and lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").where(~held_out())
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return new_network([UNKNOWN])
    chance = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, per_language / n))])
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) < chance[F.col("lang")] * (1 << 20))
    n = F.length("text")
    size = SEGMENT * 2
    stretches = F.concat(*[F.substring("text", (n * i / WINDOWS).cast("int") + 1, F.lit(size)) for i in range(WINDOWS)])
    rows = chosen.select("doc_id", "lang", F.when(n <= WINDOWS * size, F.col("text")).otherwise(stretches).alias("text")).orderBy("doc_id", "text").toArrow()
    return train([t.encode() for t in rows["text"].to_pylist()], rows["lang"].to_pylist())


def _probable(batch: pa.RecordBatch, net: Network, column: str) -> tuple[list[str], np.ndarray]:
    p = document_probabilities(net, [t or b"" for t in pc.cast(batch.column(column), pa.binary()).to_pylist()])
    best = p.argmax(axis=1)
    return [net.languages[k] for k in best], p[np.arange(len(p)), best]


def has_letter(text):
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(spark: SparkSession, documents: DataFrame, net: Network) -> DataFrame:
    """Adds lang_pred and score to the rows: `und` and 0 where the text is null or has no letter.
    Columns of the input with these names are replaced."""
    ship(spark)
    held = spark.sparkContext.broadcast(net)
    kept = documents.drop("lang_pred", "score")
    schema = StructType([*kept.schema.fields]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces_of_batch(whole, "text", 4 << 20):
                lang, score = _probable(batch, held.value, "text")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    found = kept.mapInArrow(tidy(run), schema)
    sure = has_letter(F.col("text"))
    return found.withColumn("lang_pred", F.when(sure, F.col("lang_pred")).otherwise(UNKNOWN)).withColumn("score", F.when(sure, F.col("score")).otherwise(0.0))


def language_of(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per input row, learned from its own documents."""
    net = learn(spark, documents)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return predict(spark, rows, net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known_language(spark: SparkSession, documents: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows whose language is recognised: not `und`, with a probability of ``least`` or more."""
    found = predict(spark, documents.withColumn("text", F.col("text").cast("string")), learn(spark, documents))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(documents.columns)
