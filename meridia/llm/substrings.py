"""Exact substring deduplication on words with prefix-partitioned suffix trees.

A window is ``width`` consecutive words of one document. Every word covered by a window whose word
sequence also starts earlier (smaller id, or the same document and an earlier word) goes.

Of the ``GRAM``-word grams inside a window the leftmost one with the smallest hash is its anchor. Equal
windows have their anchors at the same offset, so the suffixes that start at anchors are all the tree needs: two
windows are equal exactly if their anchors' suffixes share the words from the anchor on and the words before it.
An anchor that occurs once in the whole table repeats in nothing, and its suffix isn't sent.

The suffixes are dealt to groups by variable-length prefixes: by the anchor's ``GRAM`` words, and where more than
``group`` suffixes share these, each of its windows by all ``width`` words. A task reads group after group
and builds their trees from the root down, on the words themselves: the leaves of a node are split by
their next word, and a node with a single leaf isn't followed. A second tree over the words before the
anchors, read backwards, hangs under the nodes of depth ``GRAM``. A node of the first tree and one of the second whose
depths come to ``width`` words or more hold a repeat; extended to both sides it is maximal. Its first leaf, in
document order, stays. Equal contexts within a task are settled where they are read, so of a passage however
common each task sends one suffix.

Documents whose whole word sequence (128 bits) an earlier one has lose every word and take no further part.

The texts are written once, each file a part with a number; what later steps find (anchors that repeat, spans to cut)
is written in a folder for each part and read beside it, so texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from meridia.llm.textscan import Lane, U, Words, mix, ngrams, slices
from meridia.llm.workspace import Workspace, side_rows, tidy

GRAM = 8
#: Suffixes that share a prefix beyond which they are dealt by longer ones; also what a task holds at a time.
GROUP = 50_000
#: Anchors, and contexts, that a task gathers before it sends them or starts afresh.
GATHER = 1 << 19
SEEN = 60_000
_LANES = (Lane(23), Lane(29))


class SequencePrints:
    """Order-sensitive 64-bit fingerprints of each document's word sequence, by prefix sums."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.salt = U(int(rng.integers(1, 1 << 62)))
        self.base = U((int(rng.integers(1, 1 << 61)) << 3) | 5)
        self.inverse = U(pow(int(self.base), -1, 1 << 64))

    def of(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate([[U(1)], np.full(len(h), self.base)]), dtype=np.uint64)
            back = np.cumprod(np.concatenate([[U(1)], np.full(len(h), self.inverse)]), dtype=np.uint64)
            sums = np.concatenate([[U(0)], np.cumsum(mix(h ^ self.salt) * power[:-1], dtype=np.uint64)])
            return (mix((sums[first[1:]] - sums[first[:-1]]) * back[first[:-1]])).view(np.int64)


_PRINTS = (SequencePrints(41), SequencePrints(43))


def leftmost_least(x: np.ndarray, n: int) -> np.ndarray:
    """Place of the leftmost minimum of each run of n values, by doubling."""
    at, size = np.arange(len(x)), 1

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(x[a] <= x[b], a, b)

    while size * 2 <= n:
        at = better(at[: len(at) - size], at[size:])
        size *= 2
    rest = n - size
    return better(at[: len(at) - rest], at[rest:]) if rest else at


class Anchors:
    """The anchors of a slice, ascending: place and hash of each, the windows [low, high] that have it, and its
    document's number in the slice. Places count words of the slice."""

    def __init__(self, w: Words, h: np.ndarray, width: int):
        gram = min(GRAM, width)
        grams = ngrams(h, gram)
        n = width - gram + 1
        place = leftmost_least(grams, n) if len(grams) >= n else np.empty(0, dtype=np.int64)
        counts = w.counts()
        starts = np.flatnonzero(np.arange(len(h)) + width <= np.repeat(w.first[1:], counts))
        place = place[starts]
        new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.empty(0, dtype=np.int64)
        self.at, self.low = place[new], starts[new]
        self.high = starts[np.concatenate([new[1:], [len(starts)]]) - 1] if len(new) else starts
        self.hash = grams[self.at].view(np.int64)
        self.doc = np.searchsorted(w.first, self.at, "right") - 1


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches cut where the part changes; a task may read several parts one after the other."""
    for batch in batches:
        parts = batch.column("part").to_numpy()
        cuts = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi > lo:
                yield int(parts[lo]), batch.slice(lo, hi - lo)


def _texts(documents: DataFrame, width: int, rest: list[str]) -> DataFrame:
    """(id, text, part, row, n, f1, f2[, rest]): each text with its part, a number of its own, its words if it
    holds a window (else 0) and its sequence's fingerprints."""
    columns = [F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")]
    if rest:
        columns.append(F.struct(*[documents[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(rest)]).alias("rest"))
    source = documents.select(*columns)
    schema = StructType([f for f in source.schema.fields if f.name != "rest"]).add("n", "long").add("f1", "long").add("f2", "long")
    if rest:
        schema = schema.add(source.schema["rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in slices(batch.column("text")):
                m = len(w.rows)
                own = batch.slice(w.rows[0], m)
                prints = [p.of(lane.words(w.data, w.starts, w.ends), w.first) for p, lane in zip(_PRINTS, _LANES, strict=True)]
                counts = np.where(w.counts() >= width, w.counts(), 0)
                yield pa.RecordBatch.from_arrays([*own.columns[:4], pa.array(counts, pa.int64()), *map(pa.array, prints), *own.columns[4:]], names=schema.names)

    return source.mapInArrow(tidy(run), schema)


def _copies(texts: DataFrame, space: Workspace) -> DataFrame:
    """(part, row) of documents whose word sequence an earlier one has. The groups' first rows are a table of
    their own, so that the join can split a group however large."""
    own = texts.where("n > 0 and id is not null").select("part", F.struct("id", "row").alias("key"), "n", "f1", "f2")
    first = own.groupBy("n", "f1", "f2").agg(F.min("key").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    first = space.write(first, "firsts")
    return own.join(first, ["n", "f1", "f2"]).where(F.col("key") > F.col("first")).select("part", F.col("key.row").alias("row"))


def _repeated(texts: DataFrame, gone: str, width: int, group: int) -> DataFrame:
    """(part, anchor, hot): anchors of each part that occur more than once in all, and whether more than
    ``group`` times. Of an anchor each task sends a few rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, part_of, left_out = 0, None, None

        def given() -> pa.RecordBatch:
            anchors, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(np.full(len(n), part_of, dtype=np.int32)), pa.array(n)], names=["anchor", "part", "n"])

        for part, batch in _by_part(batches):
            if part != part_of:
                if held:
                    yield given()
                held, size, part_of, left_out = [], 0, part, _rows_of(gone, part)
            rows = batch.column("row").to_numpy()
            for w in slices(batch.column("text")):
                a = Anchors(w, _LANES[0].words(w.data, w.starts, w.ends), width)
                held.append(a.hash[~np.isin(rows[w.rows], left_out)[a.doc]])
                size += len(held[-1])
                if size > GATHER:
                    yield given()
                    held, size = [], 0
        if held:
            yield given()

    found = texts.where("n > 0 and id is not null").select("text", "part", "row").mapInArrow(tidy(run), "anchor long, part int, n long")
    found = found.withColumn("total", F.sum("n").over(Window.partitionBy("anchor"))).where("total > 1")
    return found.select("part", "anchor", (F.col("total") > group).alias("hot"))


def _rows_of(folder: str, part: int) -> np.ndarray:
    return np.sort(side_rows(folder, part, ["row"])["row"].to_numpy())


SUFFIX = "prefix long, id long, row long, part int, at int, far int, near int, context binary"


def _suffixes(texts: DataFrame, gone: str, sets: str, width: int) -> DataFrame:
    """Suffixes at repeated anchors: the anchor's place in its document, the windows' offsets before it (far to near),
    and the words of all these windows. Without a context, windows that are settled: an equal
    context of this task starts earlier."""
    names = [c.split()[0] for c in SUFFIX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_of, left_out, known, hot = None, None, None, None
        seen: dict[bytes, tuple[int, int, int]] = {}
        for part, batch in _by_part(batches):
            if part != part_of:
                part_of, left_out = part, _rows_of(gone, part)
                table = side_rows(sets, part, ["anchor", "hot"])
                known, hot = table["anchor"].to_numpy(), table["hot"].to_numpy(zero_copy_only=False)
                known, place = np.unique(known, return_index=True)
                hot = hot[place]
            ids, rows = batch.column("id").to_numpy(), batch.column("row").to_numpy()
            for w in slices(batch.column("text")):
                if len(seen) > SEEN:
                    seen.clear()
                found = of_slice(w, ids[w.rows], rows[w.rows], left_out, known, hot, seen)
                if found is not None:
                    columns, contexts = found
                    kinds = [np.int64, np.int64, np.int64, np.int32, np.int32, np.int32]
                    prefix, doc, row, at, far, near = (c.astype(k) for c, k in zip(columns, kinds, strict=True))
                    parts = np.full(len(at), part, dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, (prefix, doc, row, parts, at, far, near)), pa.array(contexts, pa.binary())], names=names)

    def of_slice(w, ids, rows, left_out, known, hot, seen):
        if not len(known):
            return None
        h = _LANES[0].words(w.data, w.starts, w.ends)
        a = Anchors(w, h, width)
        k = np.minimum(np.searchsorted(known, a.hash), len(known) - 1)
        chosen = (known[k] == a.hash) & ~np.isin(rows, left_out)[a.doc]
        warm = chosen & hot[k]
        cold = np.flatnonzero(chosen & ~warm)
        prefix, at, low, high, doc = a.hash[cold], a.at[cold], a.low[cold], a.high[cold], a.doc[cold]
        if warm.any():
            # each window by itself, by all its words
            each = np.flatnonzero(warm)
            times = a.high[each] - a.low[each] + 1
            which = np.repeat(each, times)
            start = a.low[which] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            full = ngrams(h, width).view(np.int64)
            prefix, at, low, high, doc = (np.concatenate(x) for x in ((prefix, full[start]), (at, a.at[which]), (low, start), (high, start), (doc, a.doc[which])))
        if not len(at):
            return None
        order = np.lexsort((at, rows[doc], ids[doc]))
        prefix, at, low, high, doc = (x[order] for x in (prefix, at, low, high, doc))
        body, place = spaced(w)
        mine, row = ids[doc], rows[doc]
        begin, end = place[low].tolist(), (place[high + width] - 1).tolist()
        contexts: list[bytes | None] = []
        for lo, hi, *key in zip(begin, end, mine.tolist(), row.tolist(), at.tolist(), strict=True):
            context, key = body[lo:hi], tuple(key)
            before = seen.get(context)
            if before is not None and before < key:
                contexts.append(None)
            else:
                seen[context] = key
                contexts.append(context)
        settled = np.fromiter((c is None for c in contexts), dtype=bool, count=len(contexts))
        with np.errstate(over="ignore"):
            prefix = np.where(settled, mix(row.view(np.uint64) + U(1)).view(np.int64), prefix)
        return (prefix, mine, row, at - w.first[doc], at - low, at - high), contexts

    source = texts.where("n > 0 and id is not null").select("id", "text", "part", "row")
    return source.mapInArrow(tidy(run), SUFFIX)


def spaced(w: Words, stay: np.ndarray | None = None) -> tuple[bytes, np.ndarray]:
    """The words (or those that stay) with one space behind each, and where each begins; one more
    place for the end."""
    starts, ends = (w.starts, w.ends) if stay is None else (w.starts[stay], w.ends[stay])
    place = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    flat = np.full(int(place[-1]), 0x20, dtype=np.uint8)
    room = np.ones(len(flat), dtype=bool)
    room[place[1:] - 1] = False
    mark = np.zeros(len(w.data) + 1, dtype=np.int8)
    mark[starts] += 1
    mark[ends] -= 1
    flat[room] = w.data[np.cumsum(mark[:-1], dtype=np.int8).astype(bool)]
    return flat.tobytes(), place


def descend(root: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """The node above each leaf at every depth, from the root down: leaves of a node go on together while their
    next words agree. -1 where a leaf has no further word, or is alone under its node."""
    nodes = [root]
    step = int(words.max(initial=0)) + 1
    for column in words.T:
        node = np.full(len(root), -1, dtype=np.int64)
        live = np.flatnonzero((nodes[-1] >= 0) & (column >= 0))
        if len(live):
            _, which, count = np.unique(nodes[-1][live] * step + column[live], return_inverse=True, return_counts=True)
            inner = count[which] > 1
            node[live[inner]] = which[inner]
        nodes.append(node)
    return nodes


def tree_repeats(prefix: np.ndarray, far: np.ndarray, near: np.ndarray, contexts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes in document order: (leaves, offsets) whether the window at each offset before its anchor
    is a leaf of a repeat but not its first, and whether a leaf is the first of any of its windows."""
    gram, m = min(GRAM, width), len(prefix)
    split = pc.split_pattern(contexts.cast(pa.string()), " ")
    flat = split.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = split.offsets.to_numpy().astype(np.int64)
    first = first - first[0]
    anchor, end = (first[:-1] + far)[:, None], first[1:][:, None]

    def words(at: np.ndarray, there: np.ndarray) -> np.ndarray:
        return np.where(there, flat[np.where(there, at, 0)], -1)

    ahead = anchor + np.arange(width)
    behind = anchor - 1 - np.arange(width - gram)
    after = descend(np.unique(prefix, return_inverse=True)[1].astype(np.int64), words(ahead, ahead < end))
    before = descend(after[gram], words(behind, behind >= first[:-1][:, None]))
    again, leads = np.zeros((m, width - gram + 1), dtype=bool), np.zeros(m, dtype=bool)
    for offset in range(width - gram + 1):
        own = (near <= offset) & (offset <= far)
        right, left = after[width - offset], before[offset]
        live = np.flatnonzero(own & (right >= 0) & (left >= 0))
        leads |= own
        if len(live):
            _, at, which = np.unique(right[live] * (int(left.max()) + 1) + left[live], return_index=True, return_inverse=True)
            late = np.ones(len(live), dtype=bool)
            late[at] = False
            again[live[late], offset] = True
    # a leaf all of whose windows come earlier leads none of them
    leads &= again.sum(axis=1) < far - near + 1
    return again, leads


REMOVED = "part int, row long, low int, high int"


def _removed(suffixes: DataFrame, width: int, group: int) -> DataFrame:
    """Runs of window starts [low, high] whose windows start earlier as well."""
    names = [c.split()[0] for c in REMOVED.split(", ")]
    hold = max(group, 1)

    def runs(part, row, low, high) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in ((part, np.int32), (row, np.int64), (low, np.int32), (high, np.int32))], names=names)

    def of_groups(table: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
        part, row, at, far, near, prefix = (table[c].to_numpy() for c in ("part", "row", "at", "far", "near", "prefix"))
        again, leads = tree_repeats(prefix, far, near, table["context"].combine_chunks(), width)
        edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        leaf, nearest = np.nonzero(edge == 1)
        _, beyond = np.nonzero(edge == -1)
        return runs(part[leaf], row[leaf], at[leaf] - beyond + 1, at[leaf] - nearest), leads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            settled = pc.is_null(batch.column("context"))
            if batch.num_rows and pc.any(settled).as_py():
                part, row, at, far, near = (batch.column(c).filter(settled).to_numpy() for c in ("part", "row", "at", "far", "near"))
                yield runs(part, row, at - far, at - near)
                batch = batch.filter(pc.invert(settled))
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < hold:
                continue
            table = pa.Table.from_batches(held)
            prefix = table["prefix"].to_numpy()
            # the last group may go on; where it is all there is, only leaves that lead a repeat need to wait
            cut = int(np.searchsorted(prefix, prefix[-1]))
            found, leads = of_groups(table.slice(0, cut) if cut else table)
            yield found
            rest = table.slice(cut) if cut else table.filter(pa.array(leads))
            held, size = rest.combine_chunks().to_batches(), len(rest)
        if held:
            yield of_groups(pa.Table.from_batches(held))[0]

    dealt = suffixes.repartition("prefix").sortWithinPartitions("prefix", "id", "row", "at")
    return dealt.mapInArrow(tidy(run), REMOVED)


def _cut(w: Words, rows: np.ndarray, removed: tuple[np.ndarray, np.ndarray, np.ndarray], gone: np.ndarray, width: int) -> tuple[np.ndarray, list[list[int]], list[str]]:
    """Of each document of a slice: words removed, the maximal runs [from, to) of them, and the words kept."""
    row, low, high = removed
    counts, own = w.counts(), rows[w.rows]
    lo, hi = np.searchsorted(row, own, "left"), np.searchsorted(row, own, "right")
    times = hi - lo
    at = np.repeat(lo, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    base = np.repeat(w.first[:-1], times)
    depth = np.zeros(len(w.starts) + 1, dtype=np.int64)
    np.add.at(depth, base + low[at], 1)
    np.add.at(depth, base + high[at] + width, -1)
    whole = np.isin(own, gone)
    np.add.at(depth, w.first[:-1][whole], 1)
    np.add.at(depth, w.first[1:][whole], -1)
    away = np.cumsum(depth)[:-1] > 0
    body, place = spaced(w, ~away)
    upto = np.concatenate([[0], np.cumsum(~away)])[w.first]
    kept = [body[place[a] : place[b] - 1].decode() if b > a else "" for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]
    lost = counts - np.diff(upto)
    spans: list[list[int]] = [[] for _ in range(len(own))]
    for i in np.flatnonzero(lost).tolist():
        mine = np.concatenate([[False], away[w.first[i] : w.first[i + 1]], [False]])
        spans[i] = np.flatnonzero(mine[1:] != mine[:-1]).tolist()
    return lost, spans, kept


class Repeats:
    """Where the repeats of a table lie: its texts by part, and beside them the rows that go whole and
    the runs of windows that go."""

    def __init__(self, spark: SparkSession, documents: DataFrame, width: int, group: int, rest: list[str]):
        if width < 2:
            raise ValueError("a window has two words at least")
        space = Workspace(spark, "substrings")
        self.width = width
        self.texts = space.write(_texts(documents, width, rest), "texts")
        self.gone = space.write_parts(_copies(self.texts, space), "gone", "part")
        sets = space.write_parts(_repeated(self.texts, self.gone, width, group), "sets", "part")
        self.removed = space.write_parts(_removed(_suffixes(self.texts, self.gone, sets, width), width, group), "removed", "part")
        space.drop("sets", "firsts")

    def cut(self, columns: list[str], out: StructType, give) -> DataFrame:
        """``give(batch, words, counts, lost, spans, kept)`` of every slice of the texts, as batches of ``out``."""
        width, gone, removed = self.width, self.gone, self.removed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part_of, left_out, runs = None, None, None
            for part, batch in _by_part(batches):
                if part != part_of:
                    part_of, left_out = part, _rows_of(gone, part)
                    table = side_rows(removed, part, ["row", "low", "high"]).sort_by("row")
                    runs = tuple(table[c].to_numpy() for c in ("row", "low", "high"))
                rows = batch.column("row").to_numpy()
                for w in slices(batch.column("text")):
                    lost, spans, kept = _cut(w, rows, runs, left_out, width)
                    yield give(batch.slice(w.rows[0], len(w.rows)), w.counts(), lost, spans, kept)
    
        return self.texts.select("part", "row", "text", *columns).mapInArrow(tidy(run), out)


def without_repeats(spark: SparkSession, documents: DataFrame, width: int = 20, group: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of each row with an id: the number of words, of words removed, the
    maximal runs [from, to) of these, flat, and the words that stay, joined by one space.

    A null text has no words. Rows that share an id come in the order in which they are stored. Rows with a
    null id are left out. Texts of fewer than ``width`` words lose nothing. Other columns aren't read, and an empty
    table gives an empty result.
    """
    out = StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("spans", ArrayType(IntegerType())).add("kept", "string")

    def give(batch, counts, lost, spans, kept):
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(kept, pa.string())], names=out.names)

    return Repeats(spark, documents.where("doc_id is not null"), width, group, []).cut(["id"], out, give)


def cut_texts(spark: SparkSession, documents: DataFrame, width: int = 20, group: int = GROUP) -> DataFrame:
    """The rows of documents with their repeats cut out of ``text``, and ``n_chars`` to match where
    there is such a column. Texts without repeats stay byte for byte; rows that lose every word
    go; rows with a null id stay as they are, and rows that share an id each lose their own repeats."""
    rest = [c for c in documents.columns if c != "text"]
    found = Repeats(spark, documents, width, group, rest)
    kind = found.texts.schema["rest"]
    out = StructType().add("text", "string").add(kind)

    def give(batch, counts, lost, spans, kept):
        text = batch.column("text")
        if lost.any():
            text = pc.if_else(pa.array(lost > 0), pa.array(kept, text.type), text)
        stays = pa.array((lost == 0) | (lost < counts))
        return pa.RecordBatch.from_arrays([text, batch.column("rest")], names=out.names).filter(stays)

    cut = found.cut(["rest"], out, give)
    columns = []
    for c in documents.columns:
        if c == "text":
            columns.append(F.col("text"))
        elif c == "n_chars":
            columns.append(F.length("text").cast(documents.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"rest.c{rest.index(c)}").alias(c))
    return cut.select(*columns)
