"""Document quality by Bradley-Terry pairwise ranking.

Features are shares of byte kinds and of repeated words of the whole text. From labelled
documents, pairs of a preferred and a rejected one are drawn; weights minimise the logistic loss
of the features' differences, so that the preferred document scores higher. The decision is at a
quantile of the training scores: the one that leaves the fewest wrong decisions. Scores are mapped
to 0..1 with that quantile at ``CUT``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.textscan import Lane, Words, slices
from meridia.llm.workspace import ship, tidy

#: Labelled documents of each label that the weights are learned from, and pairs drawn from them.
PER_LABEL = 4000
PAIRS = 30_000
CUT = 0.7
_LANE = Lane(31)

# Byte kinds: each byte of the text counts as one of these.
KINDS = ["space", "newline", "lower", "upper", "digit", "beyond ascii", ".,;:'\"?()-", "!", "|", "*", "#", "%", "$", "&", "other", "control"]
KIND_OF = np.full(256, 14, dtype=np.int64)
KIND_OF[:32] = KIND_OF[127] = 15
KIND_OF[[32, 9]] = 0
KIND_OF[[10, 11, 12, 13]] = 1
KIND_OF[97:123] = 2
KIND_OF[65:91] = 3
KIND_OF[48:58] = 4
KIND_OF[128:] = 5
KIND_OF[[ord(c) for c in KINDS[6]]] = 6
for _k in range(7, 14):
    KIND_OF[ord(KINDS[_k])] = _k
N_FEATURES = len(KINDS) + 5


def held_out(id_col: str = "doc_id"):
    """Documents that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(w: Words) -> np.ndarray:
    """(documents, N_FEATURES); all zero for an empty text."""
    m, counts = len(w.rows), w.counts()
    doc_of = np.repeat(np.arange(m), np.diff(w.edges))
    kinds = np.bincount(doc_of * len(KINDS) + KIND_OF[w.data], minlength=m * len(KINDS)).reshape(m, -1).astype(float)
    kinds[:, 0] -= 1  # the separating space
    h = _LANE.words(w.data, w.starts, w.ends)
    same = np.zeros(m)
    distinct = np.zeros(m)
    most = np.zeros(m)
    for i, (lo, n) in enumerate(zip(w.first.tolist(), counts.tolist(), strict=False)):
        if n:
            own = h[lo : lo + n]
            same[i] = np.count_nonzero(own[1:] == own[:-1]) / n
            ranked = np.sort(own)
            turn = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]]))
            distinct[i] = (len(turn) - 1) / n
            most[i] = np.diff(turn).max() / n
    total = kinds.sum(axis=1)
    share = kinds / np.maximum(total, 1)[:, None]
    letters = np.maximum(kinds[:, 2] + kinds[:, 3] + kinds[:, 5], 1)
    length = (total - kinds[:, 0] - kinds[:, 1]) / np.maximum(counts, 1)
    rest = np.stack([kinds[:, 3] / letters, same, distinct * (counts > 0), most, np.log1p(length)], axis=1)
    return np.concatenate([np.sqrt(np.maximum(share, 0)), rest], axis=1)


@dataclass(frozen=True)
class Ranking:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        s = ((x - self.centre) / self.spread) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (s - self.cut) + np.log(CUT / (1 - CUT)), -30, 30)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, steps: int = 400, seed: int = 3) -> Ranking:
    """Bradley-Terry weights from rows x with labels y in {0, 1}. With one label only no pair can be
    formed: the weights are 0 and every score is ``CUT``."""
    width = x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 1.0)
    centre, spread = x.mean(axis=0), x.std(axis=0)
    spread = np.where(spread > 1e-9, spread, 1.0)
    z = (x - centre) / spread
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    weights, speed = np.zeros(width), np.zeros(width)
    rate = 4.0 / max(1.0, (d * d).sum(axis=1).mean())
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ weights, -30, 30)))
        speed = 0.9 * speed + (d * p[:, None]).mean(axis=0) - 1e-3 * weights
        weights = weights + rate * speed
    s = z @ weights
    # each quantile of the scores as the cut: errors are good ones below it and bad ones at or above it
    order = np.argsort(s, kind="stable")
    weigh = np.where(y[order] == 1, 1 / len(good), 1 / len(bad))
    signed = np.where(y[order] == 1, weigh, -weigh)
    wrong = np.concatenate([[1.0], 1.0 + np.cumsum(signed)])
    at = int(np.argmin(wrong))
    low = s[order[at - 1]] if at else s[order[0]] - 1.0
    high = s[order[at]] if at < len(s) else s[order[-1]] + 1.0
    return Ranking(centre, spread, weights, float((low + high) / 2), float(4 / max(s.std(), 1e-6)))


def _feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of (doc_id, text), as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column("text")):
                x = features(w)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(w.rows[0], len(x)), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.mapInArrow(tidy(run), "doc_id long, x array<double>")


def learn(spark: SparkSession, documents: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Ranking:
    """Weights from a sample of at most about ``per_label`` labelled documents of each label, chosen
    by a hash of the id, held-out documents left out. Null labels and ids don't count; an id with
    several labels counts by their mean, and not at all at a half."""
    mean = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("m"))
    known = mean.where(F.col("m") != 0.5).select("doc_id", (F.col("m") > 0.5).cast("int").alias("y")).where(~held_out())
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chance = F.when(F.col("y") == 1, F.lit(per_label / max(counts.get(1, 0), per_label))).otherwise(F.lit(per_label / max(counts.get(0, 0), per_label)))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) < chance * (1 << 20))
    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = _feature_rows(text.select("doc_id", "text")).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "x").toArrow()
    x = np.array(rows["x"].to_pylist(), dtype=float).reshape(-1, N_FEATURES)
    return fit_pairs(x, rows["y"].to_numpy())


def quality_scores(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per input row. Null and empty texts have all
    features 0 and the score that follows; a null id is scored and not held out."""
    ship(spark)
    model = spark.sparkContext.broadcast(learn(spark, documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column("text")):
                score = model.value.score(features(w))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(w.rows[0], len(score)), pa.array(score)], names=["doc_id", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(tidy(run), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def good_documents(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that the ranking accepts, unchanged and in one scan."""
    ship(spark)
    model = spark.sparkContext.broadcast(learn(spark, documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for w in slices(batch.column("text")):
                keep[w.rows] = model.value.score(features(w)) >= CUT
            yield batch.filter(pa.array(keep))

    return documents.mapInArrow(tidy(run), documents.schema)
