"""Nearest neighbours by shifted space-filling curves.

Each of ``curves`` orderings projects the vectors onto ``dims`` random orthonormal directions,
quantises their ranks in a sample, shifted, and takes the Hilbert key. The keys are range-partitioned into cells of
a bounded size; a query looks through its own cell and the neighbouring ones on either side, in all a
share of ``window`` of the rows, whatever the size of the table (and ``LEAST_ROWS`` a cell at least). What the windows of all
curves find is merged and ranked again by the exact distance of the original vectors.

Equal vectors are searched once and stand for their smallest ids. Equal keys are told apart by a
hash of the id that differs from curve to curve, so a key that many rows have fills many cells.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridia.llm.workspace import Workspace, tidy

#: Vectors from which the scale of the projections and the cells' bounds are taken.
SAMPLE = 20_000
CELL_ROWS = 100_000
LEAST_ROWS = 64
TIE_BITS = 15
#: Quantiles of the sample that place a projection.
KNOTS = 257


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n, m) of ``bits`` bits each; m * bits <= 63.
    Gray-code form: rotations are undone from the highest bit down, then bits are interleaved."""
    x = cells.T.astype(np.int64)
    m = len(x)
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(m):
            high = (x[i] >> bit) & 1 == 1
            swap = np.where(high, low, (x[0] ^ x[i]) & low)
            x[0] ^= swap
            if i:
                x[i] ^= np.where(high, 0, swap)
    for i in range(1, m):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[m - 1] >> bit) & 1 == 1, (1 << bit) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(m):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


class Curves:
    """The orderings, fitted on a sample."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, curves: int, dims: int, bits: int, cells: int, seed: int):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        self.bits, self.dims, self.cells = bits, min(dims, width), cells
        self.directions = np.stack([np.linalg.qr(rng.normal(size=(width, width)))[0][:, : self.dims] for _ in range(curves)])
        flat = [sample @ d for d in self.directions]
        # places are ranks in the sample, so that a few far vectors or a tight cluster don't squeeze the rest
        self.share = np.linspace(0, 1, KNOTS)
        self.knots = np.stack([np.quantile(f, self.share, axis=0).T for f in flat])
        self.shift = rng.uniform(0, 0.3, (curves, self.dims))
        keys = [np.sort(self.keys(c, sample, ids)) for c in range(curves)]
        at = (np.arange(1, cells) * len(sample)) // cells
        self.bounds = np.stack([k[at] for k in keys]) if cells > 1 else np.empty((curves, 0), dtype=np.int64)

    def keys(self, curve: int, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        flat = x @ self.directions[curve]
        place = np.stack([np.interp(flat[:, i], knots, self.share) for i, knots in enumerate(self.knots[curve])], axis=1)
        place = (place + self.shift[curve]) / 1.3 * (1 << self.bits)
        key = hilbert_keys(np.clip(place, 0, (1 << self.bits) - 1).astype(np.int64), self.bits)
        with np.errstate(over="ignore"):
            tie = (ids.astype(np.uint64) * np.uint64(2 * curve + 1) + np.uint64(curve)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TIE_BITS)
        return (key << TIE_BITS) | tie.astype(np.int64)

    def cell(self, curve: int, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds[curve], self.keys(curve, x, ids), "right")


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of the commonest length (the longer, on a tie) without null or non-finite
    components and not all zero. Rows with a null id are left out; of rows that share an id the
    least vector stays."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    rows = rows.where(F.size("v") == (length[0].n if length else 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(spark: SparkSession, vectors: DataFrame, every: int = 100, k: int = 10, curves: int = 20, dims: int = 8, bits: int = 6, window: float = 0.0625, seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its k nearest
    found by Euclidean distance, itself left out; ties go to the smaller id. Fewer rows than k give
    what there is; see ``usable_vectors`` for what takes part."""
    space = Workspace(spark, "hilbert")
    rows = space.write(usable_vectors(vectors), "vectors")
    n = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    # equal vectors: the first k + 1 ids are all that can be among k nearest
    order = Window.partitionBy("v").orderBy("vec_id")
    firsts = rows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    classes = firsts.groupBy("v").agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = space.write(classes, "classes")
    step = max(1, n // SAMPLE)
    sampled = classes.where(F.pmod(F.xxhash64("rep"), F.lit(step)) == 0).orderBy("rep").limit(2 * SAMPLE).toArrow()
    if not len(sampled):
        sampled = classes.orderBy("rep").limit(1).toArrow()
    cells = max(1, min(n // LEAST_ROWS, max(math.ceil(5 / window), math.ceil(n / CELL_ROWS))))
    reach = max(1, math.ceil((window * cells - 1) / 2))
    index = Curves(_matrix(sampled["v"]), sampled["rep"].to_numpy(), curves, dims, bits, cells, seed)
    held = spark.sparkContext.broadcast(index)

    def place(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column("v")), batch.column("rep").to_numpy()
            for c in range(curves):
                cell = held.value.cell(c, x, ids)
                yield pa.RecordBatch.from_arrays([pa.array(cell + c * cells, pa.int64()), batch.column("rep"), batch.column("v"), batch.column("ids"), pa.nulls(len(ids), pa.int64())], names=["cell", "rep", "v", "ids", "query_id"])

    def ask(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _matrix(batch.column("v")), batch.column("vec_id").to_numpy()
            for c in range(curves):
                own = held.value.cell(c, x, ids)
                # at either end the window keeps its width
                low = np.clip(own - reach, 0, max(0, cells - 2 * reach - 1))
                width = min(2 * reach + 1, cells)
                at = (low[:, None] + np.arange(width)[None]).ravel()
                who = pa.array(np.repeat(np.arange(len(ids)), width))
                yield pa.RecordBatch.from_arrays([pa.array(at + c * cells, pa.int64()), pa.nulls(len(at), pa.int64()), batch.column("v").take(who), pa.nulls(len(at), pa.list_(pa.int64())), batch.column("vec_id").take(who)], names=["cell", "rep", "v", "ids", "query_id"])

    def search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names = ["query_id", "score", "rep", "ids"]
        asked, there = table.filter(pa.compute.is_valid(table["query_id"])), table.filter(pa.compute.is_valid(table["rep"]))
        if not len(asked) or not len(there):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64()))], names=names)
        there = there.sort_by("rep")
        q, x = _matrix(asked["v"]), _matrix(there["v"])
        squares = (x * x).sum(axis=1)
        most, step = min(len(x), k + 1), max(1, min(256, (1 << 22) // len(x)))
        who, found, score = [], [], []
        for at in range(0, len(q), step):
            part = q[at : at + step]
            near = squares[None] - 2 * part @ x.T
            # whatever may tie with the last place, for rounding's sake a little beyond
            last = np.partition(near, most - 1, axis=1)[:, most - 1]
            asks, place = np.nonzero(near <= (last + 1e-9 * (squares.max() + (part * part).sum(axis=1)))[:, None])
            exact = np.concatenate([np.sqrt(((x[place[i : i + 65536]] - part[asks[i : i + 65536]]) ** 2).sum(axis=1)) for i in range(0, len(asks), 65536)])
            order = np.lexsort((place, exact, asks))
            rank = np.arange(len(order)) - np.searchsorted(asks[order], asks[order])
            order = order[rank <= k]
            who.append(asks[order] + at)
            found.append(place[order])
            score.append(exact[order])
        found, who = pa.array(np.concatenate(found)), pa.array(np.concatenate(who))
        return pa.table([asked["query_id"].take(who), pa.array(np.concatenate(score)), there["rep"].take(found), there["ids"].take(found)], names=names)

    columns = "cell long, rep long, v array<double>, ids array<long>, query_id long"
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    both = classes.select("rep", "v", "ids").mapInArrow(tidy(place), columns).union(queries.mapInArrow(tidy(ask), columns))
    met = both.groupBy("cell").applyInArrow(search, "query_id long, score double, rep long, ids array<long>")
    merged = met.groupBy("query_id", "rep").agg(F.first("score").alias("score"), F.first("ids").alias("ids"))
    each = merged.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
