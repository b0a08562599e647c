"""Token ids in Arrow stream files of fixed-size-list batches.

``write_sequences`` cuts the ids of all documents, in ascending id order, into rows of
``length`` ids with a mask of the valid ones (only a file's last row is padded), one Arrow
stream file a partition, and beside each a small stream with each document's place. Ids are
stored as uint16 where the vocabulary fits, else as uint32. Every row has the same width, so
row r of a batch lies at a fixed byte offset of a memory map: random access copies nothing.
Files are written under a name of their own and then renamed, so a task that runs twice or
dies leaves no half file under a final name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.llm.tokens import WordEncoder, pieces_of_batch
from meridia.llm.workspace import Workspace, file_system, tidy

ROWS_PER_BATCH = 512
PLACE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def sequence_schema(length: int, wide: bool) -> pa.Schema:
    kind = pa.uint32() if wide else pa.uint16()
    return pa.schema([("ids", pa.list_(pa.field("item", kind, nullable=False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length))])


class SequenceWriter:
    """Appends ids to one file; rows leave as soon as a batch of them is full."""

    def __init__(self, sink, length: int, wide: bool):
        self.length, self.kind = length, np.uint32 if wide else np.uint16
        self.schema = sequence_schema(length, wide)
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        step = self.length * ROWS_PER_BATCH
        if self.n_held >= step:
            flat = np.concatenate(self.held)
            whole = len(flat) // step * step
            for at in range(0, whole, step):
                self._batch(flat[at : at + step], step)
            self.held, self.n_held = [flat[whole:]], len(flat) - whole

    def _batch(self, flat: np.ndarray, valid: int) -> None:
        ids = pa.FixedSizeListArray.from_arrays(pa.array(flat), type=self.schema.field(0).type)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(flat)) < valid), type=self.schema.field(1).type)
        self.out.write_batch(pa.RecordBatch.from_arrays([ids, mask], schema=self.schema))

    def close(self) -> None:
        flat = np.concatenate([*self.held, np.empty(0, dtype=self.kind)])
        if len(flat):
            self._batch(np.concatenate([flat, np.zeros(-len(flat) % self.length, dtype=self.kind)]), len(flat))
        self.out.close()


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, length: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, int, int]]:
    """Writes the files; returns (file, documents, ids) in order, one row a file.

    A null text is empty, so its document holds the end id alone. Rows with a null id are left
    out; rows that share an id all stay, in the order of their texts. An empty table gives
    empty files. Ids take 16 bits where the vocabulary and ``end_id`` fit, else 32.
    """
    wide = max(end_id, WordEncoder.of(tokenizer).largest_id) >= 1 << 16
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    sorted_rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.coalesce("text", F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k = TaskContext.get().partitionId()
        encoder = WordEncoder.of(tokenizer)
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        mine = f"{root}/.{k:06d}-{uuid.uuid4().hex}"
        n_docs = n_ids = 0
        with fs.open_output_stream(f"{mine}.ids") as ids_sink, fs.open_output_stream(f"{mine}.docs") as docs_sink:
            out, places = SequenceWriter(ids_sink, length, wide), pa.ipc.new_stream(docs_sink, PLACE)
            for whole in batches:
                for batch in pieces_of_batch(whole, "text"):
                    ids, bounds = encoder.encode(batch.column("text"), end_id)
                    out.append(ids)
                    places.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bounds[:-1] + n_ids), pa.array(np.diff(bounds))], schema=PLACE))
                    n_docs, n_ids = n_docs + batch.num_rows, n_ids + len(ids)
            out.close()
            places.close()
        for kind in ("ids", "docs"):
            fs.move(f"{mine}.{kind}", f"{root}/{k:06d}.{kind}")
        yield pa.RecordBatch.from_pydict({"file": pa.array([k], pa.int64()), "docs": pa.array([n_docs], pa.int64()), "ids": pa.array([n_ids], pa.int64())})

    return sorted((r.file, r.docs, r.ids) for r in sorted_rows.mapInArrow(tidy(run), "file long, docs long, ids long").collect())


class SequenceFile:
    """Random access to the rows and ids of one file on a local or mounted path. The file is mapped, so its
    batches are addresses and only what is asked for is read."""

    def __init__(self, path: str):
        self.source = pa.memory_map(path)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.length = self.batches[0].schema.field(0).type.list_size if self.batches else 0

    def row(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        batch, r = self.batches[r // ROWS_PER_BATCH], r % ROWS_PER_BATCH
        ids, mask = batch.column(0)[r].values, batch.column(1)[r].values
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from ``start`` of the file."""
        step, found = self.length * ROWS_PER_BATCH, []
        while n > 0:
            flat = self.batches[start // step].column(0).flatten().to_numpy()
            part = flat[start % step : start % step + n]
            found.append(part)
            start, n = start + len(part), n - len(part)
        return found[0] if len(found) == 1 else np.concatenate([*found, np.empty(0, dtype=np.uint16)])


class SequenceReader:
    """One file's ids in ascending order of places, a batch in memory at a time: for stores that can't be mapped."""

    def __init__(self, source):
        self.stream = pa.ipc.open_stream(source)
        self.flat, self.at = np.empty(0, dtype=np.uint16), 0

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from ``start``, which isn't before the last start."""
        found = []
        while True:
            part = self.flat[max(0, start - self.at) :][:n]
            if len(part):
                found.append(part)
                start, n = start + len(part), n - len(part)
            if not n:
                return found[0] if len(found) == 1 else np.concatenate([*found, np.empty(0, dtype=self.flat.dtype)])
            self.at += len(self.flat)
            self.flat = self.stream.read_next_batch().column(0).flatten().to_numpy()


def read_documents(spark: SparkSession, folder: str, files: list[tuple[int, int, int]]) -> DataFrame:
    """(doc_id, file, place, start, n_tokens, ids) read back from the files: start counts the ids of
    all documents before, place those before in the same file; ids are little-endian uint32."""
    base, total = {}, 0
    for k, _, n in files:
        base[k] = total
        total += n
    count = 1 + max([k for k, _, _ in files], default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, root = file_system(folder)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                if k not in base:
                    continue
                path = f"{root}/{k:06d}.ids"
                file = SequenceFile(path) if isinstance(fs, pafs.LocalFileSystem) else SequenceReader(fs.open_input_stream(path))
                with fs.open_input_file(f"{root}/{k:06d}.docs") as source:
                    for places in pa.ipc.open_stream(source):
                        starts, sizes = places.column(1).to_pylist(), places.column(2).to_pylist()
                        ids = [file.ids(s, n).astype("<u4").tobytes() for s, n in zip(starts, sizes, strict=True)]
                        yield pa.RecordBatch.from_arrays(
                            [places.column(0), pa.array([k] * len(ids), pa.int64()), places.column(1), pa.array([s + base[k] for s in starts], pa.int64()), places.column(2), pa.array(ids, pa.binary())],
                            names=["doc_id", "file", "place", "start", "n_tokens", "ids"],
                        )

    return spark.range(0, count, 1, count).mapInArrow(tidy(run), "doc_id long, file long, place long, start long, n_tokens long, ids binary")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2) -> DataFrame:
    """Writes all documents' ids to files in the shared folder and reads them back by document."""
    space = Workspace(spark, "tokens")
    folder = space.path("sequences")
    return read_documents(spark, folder, write_sequences(docs, folder, tokenizer, length, end_id))


