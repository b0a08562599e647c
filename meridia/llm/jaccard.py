"""Exact set-similarity join of documents on word n-grams, and its connected components.

A document's set holds the 64-bit hashes of its distinct n-word shingles of A-Z-folded words.
Documents with equal sets form a class; the smallest id stands for it. Tokens are ordered rare
first, by a count over all documents with a fixed number of hash cells (the order affects cost,
never results). Each representative sends its prefix of n - ceil(t n) + 1 tokens; two sets with
similarity t or more share one of them. Candidates pass the length and positional filters and
a suffix filter on counts of each set's tokens in ``BINS`` parts of the hash range; then each pair
is verified once, with the suffix filter by halves before the full intersection.

A group of near copies shares its prefix tokens, so all its pairs would be candidates. The join
therefore goes in two rounds. First each token's documents are compared with the smallest of
them only, and the links found make components. Then every token whose documents still lie in
more than one component compares the documents of the smaller components with all documents of
other components. A pair is left out only if links already join its ends, so the components are
exact, and work grows with a group's size rather than its square.

All links of a document lie in its component, so a last step counts them there: every two
classes of a component are compared by their whole sets. A component's classes are dealt to blocks of
about ``SIDE`` and each two blocks meet in one task, whose sets are multiplied as 0-1 matrices. This
step alone grows with the square of a component, as the number of links does.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.components import components
from meridia.llm.textscan import Lane, U, Words, mix, ngrams, slices
from meridia.llm.workspace import Workspace, texts_by_id, tidy

#: Hash cells of the document-frequency count, as a power of two: 8 MB whatever the input.
CELL_BITS = 20
BLOCK = 1 << 14
#: Parts of the hash range whose token counts bound an intersection.
BINS = 128
#: Classes of a component in one block of the link count.
SIDE = 256
_LANE = Lane(11, fold=True)


@dataclass(frozen=True)
class Threshold:
    """Links when den * |A and B| >= num * |A or B|; shingles of ``words`` words."""

    num: int = 80
    den: int = 100
    words: int = 5

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - -(-self.num * n // self.den) + 1

    def overlap(self, a, b):
        """Least intersection of sets of a and b elements that link."""
        return -(-self.num * (a + b) // (self.num + self.den))


def shingle_sets(w: Words, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, flat, and their bounds."""
    h = _LANE.words(w.data, w.starts, w.ends)
    counts = w.counts()
    grams = ngrams(h, words)
    found, bounds = [], np.zeros(len(counts) + 1, dtype=np.int64)
    for i, (lo, n) in enumerate(zip(w.first.tolist(), counts.tolist(), strict=False)):
        if n >= words:
            own = np.sort(grams[lo : lo + n - words + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            # fewer words: the whole sequence is the one shingle
            own = ngrams(h[lo : lo + n], n, 0x9FB21C651E98DF25 + 2 * n)
        else:
            own = grams[:0]
        found.append(own)
        bounds[i + 1] = bounds[i] + len(own)
    return (np.concatenate(found) if found else grams[:0]), bounds


def _prints(flat: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set; 0 for an empty one."""
    with np.errstate(over="ignore"):
        out = []
        for salt in (U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)):
            sums = np.concatenate([[U(0)], np.cumsum(mix(flat ^ salt), dtype=np.uint64)])
            out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def _bins(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tokens of each set by their low bits, (sets, BINS); counts beyond uint16 stop there, which
    only the filter's caller must know (see ``_bounded``)."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    counts = np.bincount(owner * BINS + (flat & U(BINS - 1)).astype(np.int64), minlength=(len(bounds) - 1) * BINS)
    return np.minimum(counts, 65535).astype(np.uint16).reshape(-1, BINS)


def _scan(docs: DataFrame, t: Threshold) -> DataFrame:
    """A row (doc_id, n, f1, f2, bins) per document and, of each task, its cell counts in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, dtype=np.int32)
        held: list[np.ndarray] = []
        size = 0
        names = ["doc_id", "n", "f1", "f2", "bins", "block", "counts"]
        for batch in batches:
            for w in slices(batch.column("text")):
                flat, bounds = shingle_sets(w, t.words)
                held.append((flat >> U(64 - CELL_BITS)).astype(np.int32))
                size += len(flat)
                if size > 1 << CELL_BITS:
                    cells += np.bincount(np.concatenate(held), minlength=len(cells)).astype(np.int32)
                    held, size = [], 0
                f1, f2 = _prints(flat, bounds)
                m = len(w.rows)
                bins = _bins(flat, bounds)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(w.rows[0], m), pa.array(np.diff(bounds)), pa.array(f1), pa.array(f2), pa.array([b.tobytes() for b in bins], pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names
                )
        if held:
            cells += np.bincount(np.concatenate(held), minlength=len(cells)).astype(np.int32)
        if cells.any():
            blocks = cells.reshape(-1, BLOCK)
            m = len(blocks)
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(m, pa.binary()), pa.array(np.arange(m), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())], names=names)

    return docs.mapInArrow(tidy(run), "doc_id long, n long, f1 long, f2 long, bins binary, block int, counts binary")


def _cells(scanned: DataFrame) -> np.ndarray:
    """Document frequency by hash cell, summed over all tasks: a fixed 64 rows of 64 KB reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(c, dtype=np.int32).astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(v, 2**31 - 1).astype(np.int32).tobytes() for v in sums.values()], pa.binary())], names=["block", "counts"])

    parts = scanned.where("block is not null").select("block", "counts")
    summed = parts.mapInArrow(tidy(add), "block int, counts binary").repartition("block").mapInArrow(tidy(add), "block int, counts binary")
    cells = np.zeros((1 << CELL_BITS) // BLOCK * BLOCK, dtype=np.int64).reshape(-1, BLOCK)
    for row in summed.collect():
        cells[row.block] += np.frombuffer(row.counts, dtype=np.int32)
    return cells.reshape(-1)


def _prefixes(docs: DataFrame, t: Threshold, cells) -> DataFrame:
    """(token, print, doc_id, n, pos): the prefix tokens of one document of each set in a task, with half
    the set's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = cells.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for w in slices(batch.column("text")):
                flat, bounds = shingle_sets(w, t.words)
                f1, f2 = _prints(flat, bounds)
                if len(seen) > 500_000:
                    seen.clear()
                df = frequency[(flat >> U(64 - CELL_BITS)).astype(np.int64)]
                tokens, prints, docs_, sizes, places = [], [], [], [], []
                order = np.argsort(ids[w.rows], kind="stable")
                for i in order.tolist():
                    lo, hi = bounds[i], bounds[i + 1]
                    key = (int(f1[i]), int(f2[i]))
                    if lo == hi or key in seen:
                        continue
                    seen.add(key)
                    n = int(hi - lo)
                    p = int(t.prefix(n))
                    own = flat[lo:hi]
                    rare = np.lexsort((own, df[lo:hi]))[:p]
                    tokens.append(own[rare])
                    prints.append(np.full(p, f1[i]))
                    docs_.append(np.full(p, ids[w.rows[i]]))
                    sizes.append(np.full(p, n, dtype=np.int32))
                    places.append(np.arange(p, dtype=np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(prints)), pa.array(np.concatenate(docs_)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], names=["token", "print", "doc_id", "n", "pos"])

    return docs.mapInArrow(tidy(run), "token long, print long, doc_id long, n int, pos int")


def _shared(prefixes: DataFrame) -> DataFrame:
    """Rows of tokens that two or more rows have, each with its token's first row as the hub. A run of
    equal tokens streams through with its first row alone in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first row of the last run, and whether it was given out
        for batch in batches:
            token, doc, n, pos = (batch.column(c).to_numpy() for c in range(4))
            if not len(token):
                continue
            given = False
            if held is not None and held[0] == token[0]:
                token, doc, n, pos = (np.concatenate([[v], a]) for v, a in zip(held[:4], (token, doc, n, pos), strict=True))
                given = held[4]
            first = np.concatenate([[True], token[1:] != token[:-1]])
            starts = np.flatnonzero(first)
            size = np.diff(np.concatenate([starts, [len(token)]]))
            run_of = np.cumsum(first) - 1
            hub = starts[run_of]
            keep = size[run_of] > 1
            if given:
                keep[0] = False
            at = np.flatnonzero(keep)
            last = starts[-1]
            held = (token[last], doc[last], n[last], pos[last], bool(size[-1] > 1) or (given and last == 0))
            if len(at):
                h = hub[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.astype(k)) for x, k in ((token[at], np.int64), (doc[at], np.int64), (n[at], np.int32), (pos[at], np.int32), (doc[h], np.int64), (n[h], np.int32), (pos[h], np.int32))],
                    names=["token", "doc_id", "n", "pos", "hub", "hub_n", "hub_pos"],
                )

    # copies that different tasks sent become one row where they meet, without a further shuffle
    once = prefixes.repartition("token").groupBy("token", "print").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("pos").alias("pos"))
    grouped = once.select("token", "doc_id", "n", "pos").sortWithinPartitions("token", "doc_id")
    return grouped.mapInArrow(tidy(run), "token long, doc_id long, n int, pos int, hub long, hub_n int, hub_pos int")


def _may_link(t: Threshold, n1, p1, n2, p2):
    """Length and positional filters on two sets that share a token at places p1 and p2. The
    positional bound holds at the first token two sets share, so a linking pair passes there."""
    least = F.ceil((F.lit(t.num) * (n1 + n2)) / F.lit(t.num + t.den) - F.lit(1e-9))
    rest = F.lit(1) + F.least(n1 - p1 - 1, n2 - p2 - 1)
    return (F.least(n1, n2) * t.den >= F.greatest(n1, n2) * t.num) & (rest >= least)


def overlap_bound(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """Suffix filter: an upper bound of the intersection of two sorted sets, by halving the
    value range of the larger and bounding each part by the smaller share."""
    if not len(a) or not len(b) or depth == 0:
        return min(len(a), len(b))
    middle = a[len(a) // 2] if len(a) >= len(b) else b[len(b) // 2]
    i, j = int(np.searchsorted(a, middle)), int(np.searchsorted(b, middle))
    return overlap_bound(a[:i], b[:j], depth - 1) + overlap_bound(a[i:], b[j:], depth - 1)


def _bounded(pairs: DataFrame, bins: DataFrame, t: Threshold) -> DataFrame:
    """Pairs (u, v) that the suffix filter on counts lets through. A full count bounds nothing, so it
    counts as the smaller whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, BINS).astype(np.int64) for c in ("a", "b"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            least = np.where((a == 65535) & (b == 65535), np.minimum(na, nb)[:, None], np.minimum(a, b)).sum(axis=1)
            keep = least >= t.overlap(na, nb)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(keep)), batch.column("v").filter(pa.array(keep))], names=["u", "v"])

    a = bins.select(F.col("doc_id").alias("u"), F.col("n").alias("na"), F.col("bins").alias("a"))
    b = bins.select(F.col("doc_id").alias("v"), F.col("n").alias("nb"), F.col("bins").alias("b"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "na", "nb", "a", "b").mapInArrow(tidy(run), "u long, v long")


def _verified(docs: DataFrame, bins: DataFrame, pairs: DataFrame, t: Threshold, space: Workspace, step: str) -> DataFrame:
    """The pairs (u, v) whose sets link. Only documents of some pair are scanned again."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column("text")):
                flat, bounds = shingle_sets(w, t.words)
                own = [flat[lo:hi].tobytes() for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(w.rows[0], len(own)), pa.array(own, pa.binary())], names=["doc_id", "own"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.empty(0, dtype=np.uint64)
        for batch in batches:
            us, vs = batch.column("u").to_pylist(), batch.column("v").to_pylist()
            keep = []
            for i, own in enumerate(batch.column("own")):
                b = np.frombuffer(own.as_buffer(), dtype=np.uint64)
                if vs[i] is None:
                    a = b.copy()
                    continue
                least = int(t.overlap(len(a), len(b)))
                if overlap_bound(a, b) >= least and len(np.intersect1d(a, b, assume_unique=True)) >= least:
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([us[i] for i in keep], pa.int64()), pa.array([vs[i] for i in keep], pa.int64())], names=["u", "v"])

    pairs = space.write(_bounded(pairs, bins, t), f"{step}-bounded")
    ends = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    wanted = space.write(docs.join(ends, "doc_id", "left_semi").mapInArrow(tidy(sets), "doc_id long, own binary"), f"{step}-sets")
    # a hub's partners are dealt to parts of about SIDE; its set goes once to each part, ahead of theirs
    parts = space.write(pairs.groupBy("u").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("parts")), f"{step}-parts")
    hubs = wanted.join(parts, F.col("doc_id") == F.col("u")).select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("v"), "own")
    others = pairs.join(parts, "u").select("u", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), "v")
    others = others.join(wanted.select(F.col("doc_id").alias("v"), "own"), "v").select("u", "part", "v", "own")
    met = hubs.union(others).repartition("u", "part").sortWithinPartitions("u", "part", F.col("v").asc_nulls_first())
    links = space.write(met.select("u", "v", "own").mapInArrow(tidy(verify), "u long, v long"), f"{step}-links")
    space.drop(f"{step}-sets", f"{step}-bounded", f"{step}-parts")
    return links


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of each set on the left with each on the right, or with each other,
    then without what a set shares with itself alone.
    Sets multiply as 0-1 matrices over the tokens that can meet, a few megabytes at a time."""
    if right is None:
        values, times = np.unique(np.concatenate(left), return_counts=True)
        common = values[times > 1]
    else:
        common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    found = np.zeros((len(left), len(left if right is None else right)), dtype=np.int64)
    if not len(common):
        return found

    def placed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        hit = common[at] == flat
        at, owner = at[hit], owner[hit]
        order = np.argsort(at, kind="stable")
        return at[order], owner[order]

    a, b = placed(left), None if right is None else placed(right)
    width = max(256, (1 << 21) // max(found.shape))

    def dense(side: tuple[np.ndarray, np.ndarray], rows: int, at: int) -> np.ndarray:
        lo, hi = np.searchsorted(side[0], (at, at + width))
        out = np.zeros((rows, width), dtype=np.float32)
        out[side[1][lo:hi], side[0][lo:hi] - at] = 1
        return out

    for at in range(0, len(common), width):
        x = dense(a, found.shape[0], at)
        y = x if b is None else dense(b, found.shape[1], at)
        found += np.rint(x @ y.T).astype(np.int64)
    return found


def link_counts(docs: DataFrame, roots: DataFrame, t: Threshold) -> DataFrame:
    """(class_id, n_links) of the classes in ``roots``: with how many others of its component each links."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column("text")):
                flat, bounds = shingle_sets(w, t.words)
                own = [flat[lo:hi].tobytes() for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                rest = [batch.column(c).slice(w.rows[0], len(own)) for c in ("doc_id", "root", "parts")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(own, pa.binary())], names=["doc_id", "root", "parts", "own"])

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = [np.frombuffer(s, dtype=np.uint64) for s in table["own"].to_pylist()]
        ids, block = table["doc_id"].to_numpy(), table["block"].to_numpy()
        n = np.array([len(s) for s in own])
        if key[1].as_py() == key[2].as_py():
            links = overlaps(own) >= t.overlap(n[:, None], n[None])
            np.fill_diagonal(links, False)
            degree = links.sum(axis=1)
        else:
            degree = np.zeros(len(own), dtype=np.int64)
            a, b = np.flatnonzero(block == key[1].as_py()), np.flatnonzero(block == key[2].as_py())
            if len(a) and len(b):
                links = overlaps([own[i] for i in a], [own[i] for i in b]) >= t.overlap(n[a][:, None], n[b][None])
                degree[a], degree[b] = links.sum(axis=1), links.sum(axis=0)
        return pa.table({"class_id": ids, "part": pa.array(degree, pa.int64())})

    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    placed = roots.join(sizes, "root")
    # two classes that make a component link with each other
    two = placed.where("size = 2").select(F.col("node").alias("class_id"), F.lit(1).cast("long").alias("part"))
    many = placed.where("size > 2").select(F.col("node").alias("doc_id"), "root", F.ceil(F.col("size") / SIDE).cast("int").alias("parts"))
    held = docs.select("doc_id", "text").join(many, "doc_id").select("doc_id", "text", "root", "parts").mapInArrow(tidy(sets), "doc_id long, root long, parts int, own binary")
    held = held.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = held.select("doc_id", "root", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "own")
    counted = met.groupBy("root", "lo", "hi").applyInArrow(count, "class_id long, part long")
    return two.union(counted).groupBy("class_id").agg(F.sum("part").alias("n_links"))


def jaccard_components(spark: SparkSession, documents: DataFrame, t: Threshold | None = None, counted: bool = True) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, n_links): the set's size, the smallest id with the
    same set, the smallest id that links reach, and the number of other classes that its class links with.

    A null or empty text, or one without words, has no shingles and links with nothing. Rows with a
    null id are left out; of rows that share an id one stays (see ``texts_by_id``). Other columns are
    not read. An empty table gives an empty result. Without ``counted`` there is no ``n_links``.
    """
    t = t or Threshold()
    space = Workspace(spark, "jaccard")
    docs = texts_by_id(documents)
    scanned = space.write(_scan(docs, t), "scan")
    own = scanned.where("block is null").select("doc_id", "n", "f1", "f2")
    # a table of its own, so that the join can split a class however large
    first = own.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("k")).where("k > 1").drop("k")
    first = space.write(first, "firsts")
    classes = own.join(first, ["f1", "f2", "n"], "left").select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id"))
    classes = space.write(classes, "classes")

    cells = spark.sparkContext.broadcast(_cells(scanned))
    shared = space.write(_shared(_prefixes(docs, t, cells)), "shared")
    as_class = classes.select("doc_id", "class_id")
    tokens = shared.join(as_class, "doc_id").select("token", F.col("class_id").alias("u"), "n", "pos", "hub", "hub_n", "hub_pos")
    tokens = tokens.join(as_class.select(F.col("doc_id").alias("hub"), F.col("class_id").alias("hub_class")), "hub")
    tokens = space.write(tokens.select("token", "u", "n", "pos", F.col("hub_class").alias("v"), F.col("hub_n").alias("vn"), F.col("hub_pos").alias("vpos")).distinct(), "tokens")
    space.drop("shared")
    bins = scanned.where("block is null").select("doc_id", "n", "bins")

    near = tokens.where((F.col("u") != F.col("v")) & _may_link(t, F.col("n"), F.col("pos"), F.col("vn"), F.col("vpos")))
    pairs = space.write(near.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs1")
    links1 = _verified(docs, bins, pairs, t, space, "first")
    roots = components(links1, space, "c1")

    # tokens whose documents lie in more than one component
    placed = tokens.select("token", "u", "n", "pos").distinct().join(roots.select(F.col("node").alias("u"), "root"), "u", "left")
    placed = space.write(placed.select("token", "u", "n", "pos", F.coalesce("root", "u").alias("root")), "placed")
    main = placed.groupBy("token", "root").count().groupBy("token").agg(F.max(F.struct("count", "root")).alias("m"), F.count("*").alias("k"))
    main = space.write(main.where("k > 1").select("token", F.col("m.root").alias("main")), "main")
    split = space.write(placed.join(main, "token"), "split")
    left = split.where("root <> main").select("token", "u", "n", "pos", "root")
    right = split.select("token", F.col("u").alias("v"), F.col("n").alias("vn"), F.col("pos").alias("vpos"), F.col("root").alias("vroot"))
    met = left.join(right, (left["token"] == right["token"]) & (F.col("root") != F.col("vroot")) & _may_link(t, F.col("n"), F.col("pos"), F.col("vn"), F.col("vpos")))
    again = met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().join(pairs, ["u", "v"], "left_anti")
    again = space.write(again, "pairs2")
    if not again.isEmpty():
        links = space.write(links1.union(_verified(docs, bins, again, t, space, "second")), "links")
        roots = components(links, space, "c2")
    out = classes.join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
    columns = ["doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("root", "class_id").alias("component_id")]
    if not counted:
        return out.select(*columns)
    degree = space.write(link_counts(docs, roots, t), "degrees")
    return out.join(degree, "class_id", "left").select(*columns, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_per_group(spark: SparkSession, documents: DataFrame, t: Threshold | None = None) -> DataFrame:
    """The rows of documents whose id is the smallest of its component. Rows with a null id stay."""
    found = jaccard_components(spark, documents, t, counted=False)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone"))
    return documents.join(gone, documents["doc_id"] == gone["__gone"], "left_anti")
