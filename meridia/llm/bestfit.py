"""Best-fit packing of token sequences with swap-based local search.

``pack`` places lengths into bins of a fixed capacity: best fit of the longer half first and then the shorter, as they come,
and a local search over the underfull bins. The search moves one item, or exchanges one for one,
two for one or one for two, whenever a fuller bin gains and a less full one loses tokens; each
such step raises the sum of squared fills, so it ends, and bins that lose everything go. It
stops early once the number of bins equals the lower bound, ceil(sum / capacity). Where it ends above
the bound, it starts again from best fit in decreasing order, and the fewer bins count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.tokens import WordEncoder, pieces_of_batch
from meridia.llm.workspace import Workspace, tidy

#: Pieces that are packed together in one task. Groups waste less than a bin each beyond the search's own loss.
GROUP = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: list[int], capacity: int, step: int = 1) -> list[list[int]]:
    """Bins of item numbers; the longest first (those of one length in units of ``step`` as they come), each into the
    fullest bin that holds it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set where a bin has r tokens of room
    for i in sorted(range(len(lengths)), key=lambda i: (-(lengths[i] // step), i)):
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - n
        by_room[left].append(b)
        rooms |= 1 << left
    return bins


def improve(lengths: list[int], bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Local search that empties the least full bins, the least full first, until no exchange improves or
    the bins are as few as the bound."""
    bins = [list(b) for b in bins if b]
    fill = [sum(lengths[i] for i in b) for b in bins]
    bound = -(-sum(fill) // capacity)
    count = len(bins)
    if count <= bound:
        return bins
    index, moved = _Exchanges(lengths, bins, fill, capacity), True
    while moved and count > bound:
        moved = False
        for donor in sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=fill.__getitem__):
            while bins[donor] and fill[donor] < capacity and index.step(donor):
                moved = True
            count -= not bins[donor]
            if count <= bound:
                break
    return [b for b in bins if b]


class _Exchanges:
    """What each underfull bin can give back, as flat arrays: nothing, one item or two, so that one
    pass over the arrays finds an exchange or shows that there is none."""

    def __init__(self, lengths: list[int], bins: list[list[int]], fill: list[int], capacity: int):
        self.lengths, self.bins, self.fill, self.capacity = lengths, bins, fill, capacity
        self._fill_in()

    def _fill_in(self) -> None:
        self.backs: list[list[int]] = []
        self.at: dict[int, tuple[int, int]] = {}
        rows = [self._rows(b) for b in range(len(self.bins))]
        self.n = sum(map(len, rows))
        room = 2 * self.n + 1024
        self.low, self.top, self.two, self.owner = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.zeros(room, bool), np.zeros(room, np.int32)
        self.n = 0
        for b, r in enumerate(rows):
            self._append(b, r)

    def _rows(self, b: int) -> list[tuple[int, list[int]]]:
        """(tokens given back, the items): one way for each sum, of the fewest items."""
        if not self.bins[b] or self.fill[b] >= self.capacity:
            return []
        one = {self.lengths[i]: [i] for i in self.bins[b]}
        pairs: dict[int, list[int]] = {}
        kinds: dict[int, list[int]] = {}
        for i in self.bins[b]:
            kinds.setdefault(self.lengths[i], []).append(i)
        values = sorted(kinds)
        for k, x in enumerate(values):
            if len(kinds[x]) > 1:
                pairs.setdefault(2 * x, kinds[x][:2])
            for y in values[k + 1 :]:
                pairs.setdefault(x + y, [kinds[x][0], kinds[y][0]])
        return [(0, [])] + list(one.items()) + [(v, p) for v, p in pairs.items() if v not in one]

    def _append(self, b: int, rows: list[tuple[int, list[int]]]) -> None:
        lo, hi = self.n, self.n + len(rows)
        self.low[lo:hi] = [v for v, _ in rows]
        self.top[lo:hi] = self.low[lo:hi] + (self.capacity - self.fill[b])
        self.two[lo:hi] = [len(p) == 2 for _, p in rows]
        self.owner[lo:hi] = b
        self.backs += [p for _, p in rows]
        self.at[b], self.n = (lo, hi), hi

    def _renew(self, b: int) -> None:
        lo, hi = self.at[b]
        self.top[lo:hi] = -1
        rows = self._rows(b)
        if self.n + len(rows) > len(self.low):
            self._fill_in()
        else:
            self._append(b, rows)

    def step(self, donor: int) -> bool:
        """One improving exchange out of ``donor``, longest items first; False if there is none."""
        mine = sorted(self._rows(donor)[1:], key=lambda r: (len(r[1]), -r[0]))
        room = self.capacity - self.fill[donor]
        low, top = self.low[: self.n], self.top[: self.n]
        least = np.maximum(low, top - room)
        lo, hi = self.at[donor]
        least[lo:hi] = np.iinfo(np.int32).max
        for out, items in mine:
            ok = (least < out) & (out <= top)
            if len(items) == 2:
                ok &= ~self.two[: self.n]
            found = np.flatnonzero(ok)
            if not len(found):
                continue
            # into the fullest bin, and there the most
            k = int(found[np.lexsort((low[found], top[found] - low[found]))[0]])
            b, d = int(self.owner[k]), out - int(low[k])
            back = self.backs[k]
            self.bins[donor][:] = [i for i in self.bins[donor] if i not in items] + back
            self.bins[b][:] = [i for i in self.bins[b] if i not in back] + items
            self.fill[donor] -= d
            self.fill[b] += d
            self._renew(donor)
            self._renew(b)
            return True
        return False


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Item numbers of each bin. Every length lies in 1..capacity."""
    bound, found = -(-sum(lengths) // capacity), None
    for step in (capacity // 2 + 1, 1):
        bins = improve(lengths, best_fit(lengths, capacity, step), capacity)
        if found is None or len(bins) < len(found):
            found = bins
        if len(found) <= bound:
            break
    return found


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut only where
    longer than the capacity. Null texts are empty; rows that share an id each give their pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(tokenizer)
        for whole in batches:
            for batch in pieces_of_batch(whole, "text"):
                ids, bounds = encoder.encode(batch.column("text"), end_id)
                raw = ids.astype("<u4").tobytes()
                n = np.diff(bounds)
                count = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, n[doc] - start)
                at = bounds[:-1][doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(tidy(run), PIECES)


def pack_pieces(pieces: DataFrame, capacity: int = 2048, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset. Pieces are dealt evenly to groups of about ``group`` by a hash of
    all their columns and place, whatever their documents; each group is packed in one task. Full
    pieces need no partner. An empty table stays empty."""
    n = pieces.count()
    groups = max(1, -(-n // group))
    names = [c.split()[0] for c in PIECES.split(", ")]
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(*[pieces[c] for c in names]), F.lit(groups)))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.drop_columns(["__group"]).sort_by([(c, "ascending") for c in names])
        lengths = table.column("length").to_pylist()
        full = [[i] for i, m in enumerate(lengths) if m == capacity]
        rest = [i for i, m in enumerate(lengths) if m < capacity]
        bins = full + [[rest[i] for i in b] for b in pack([lengths[i] for i in rest], capacity)]
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for k, b in enumerate(bins):
            at = 0
            for i in sorted(b):
                sequence[i], offset[i] = k, at
                at += lengths[i]
        return table.append_column("sequence_id", pa.array(sequence * groups + key[0].as_py())).append_column("offset", pa.array(offset))

    return dealt.groupBy("__group").applyInArrow(run, f"{PIECES}, sequence_id long, offset long")


def packed(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their sequences; ids are encoded once and only the pieces' sizes,
    places and checksums are kept."""
    space = Workspace(spark, "packing")
    pieces = space.write(token_pieces(docs, tokenizer, capacity, end_id), "pieces")
    return pack_pieces(pieces, capacity)
