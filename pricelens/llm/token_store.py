"""Operator 8: token ids as Arrow files of fixed-size-list batches.

Documents are ordered by doc_id over range partitions; each partition writes its token stream, an end id
after every document, as one Arrow file. A row is a sequence of ``length`` ids with a mask of the same
length; only the last row of a file is padded, under mask 0. So token t of a file is element t of its
flattened list values, and any sequence is a slice of the mapped file without a copy. Beside it lies a small
Arrow file with each document's place.

Files go to the shared folder under a name of their own for each attempt; the manifest holds the names of
successful tasks only, so lost executors and repeated tasks leave nothing but unused files.
Null and empty texts are one end id. Rows with a null doc_id come first; rows with the same doc_id follow
each other, ordered by text.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from pricelens.llm.common import map_batches, materialize, partitions, text_list, work_dir
from pricelens.llm.hf_ids import tokenizer_of

#: Sequences in one record batch.
BATCH_SEQUENCES = 64


def _schema(dtype: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(dtype, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Appends ids to an Arrow file of equal-length sequences."""

    def __init__(self, sink, dtype: pa.DataType, length: int):
        self.schema, self.length, self.tokens = _schema(dtype, length), length, 0
        self.dtype, self.parts, self.held = dtype.to_pandas_dtype(), [], 0
        self.file = pa.ipc.new_file(sink, self.schema)

    def append(self, ids: np.ndarray) -> None:
        self.parts.append(ids.astype(self.dtype))
        self.held += len(ids)
        self.tokens += len(ids)
        if self.held >= self.length * BATCH_SEQUENCES:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)
        size = self.length * BATCH_SEQUENCES
        while len(flat) >= size or last and len(flat):
            real, flat = flat[:size], flat[size:]
            rows = -(-len(real) // self.length)
            ids, mask = np.zeros(rows * self.length, self.dtype), np.zeros(rows * self.length, bool)
            ids[: len(real)], mask[: len(real)] = real, True
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(v), self.length) for v in (ids, mask)]
            self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.parts, self.held = [flat], len(flat)

    def close(self) -> None:
        self._flush(True)
        self.file.close()


class SequenceFile:
    """Random access to the sequences of one file; arrays are views of the mapped memory."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size

    def sequence(self, row: int) -> tuple[pa.Array, pa.Array]:
        """Ids and mask of one sequence, without a copy; the mask is a bitmap."""
        batch = self.file.get_batch(row // BATCH_SEQUENCES)
        return tuple(batch.column(k).slice(row % BATCH_SEQUENCES, 1).flatten() for k in (0, 1))

    def slices(self, offsets: np.ndarray, counts: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of consecutive token ranges."""
        size, at, ids, real = self.length * BATCH_SEQUENCES, -1, None, 0
        for first, n in zip(offsets.tolist(), counts.tolist(), strict=True):
            parts = []
            while n:
                if first // size != at:
                    at = first // size
                    batch = self.file.get_batch(at)
                    ids, mask = (batch.column(k).flatten() for k in (0, 1))
                    ids, real = ids.to_numpy(zero_copy_only=True), mask.true_count
                low = first % size
                take = min(n, size - low)
                if low + take > real:
                    raise ValueError("a document reaches into padding")
                parts.append(ids[low : low + take])
                first, n = first + take, n - take
            yield parts[0] if len(parts) == 1 else np.concatenate(parts)


def _open(root: str, name: str):
    """A file of the store for reading; mapped into memory where the store is a local path."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(f"{root}/{name}")
    return pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)


def write_store(docs: DataFrame, path: str, *, end_id: int = 0, length: int = 2048) -> tuple[str, DataFrame]:
    """Write every document; the folder and its manifest (part, stem, n_docs, n_tokens, first: tokens before the file)."""
    spark = docs.sparkSession
    root = f"{work_dir(spark)}/tokens-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        tokenizer = tokenizer_of(path)
        dtype = pa.uint16() if max(tokenizer.vocab_size, end_id + 1) <= 1 << 16 else pa.uint32()
        end = np.array([end_id], "<u4")
        part = TaskContext.get().partitionId()
        stem = f"part-{part:06d}-{uuid.uuid4().hex}"
        system, folder = fs.FileSystem.from_uri(root)
        system.create_dir(folder)
        docs_, counts = [], []
        with system.open_output_stream(f"{folder}/{stem}.arrow") as sink:
            writer = SequenceWriter(sink, dtype, length)
            for batch in batches:
                for ids in tokenizer.encode(text_list(batch)):
                    writer.append(ids)
                    writer.append(end)
                    counts.append(len(ids) + 1)
                docs_ += batch.column("doc_id").to_pylist()
            writer.close()
        if docs_:
            index = pa.table({"doc_id": pa.array(docs_, pa.int64()), "n_tokens": pa.array(counts, pa.int64())})
            with system.open_output_stream(f"{folder}/{stem}.docs.arrow") as sink, pa.ipc.new_file(sink, index.schema) as file:
                file.write_table(index, max_chunksize=1 << 16)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "stem": [stem], "n_docs": pa.array([len(docs_)], pa.int64()), "n_tokens": pa.array([writer.tokens], pa.int64())})

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialize(map_batches(ordered, run, "part int, stem string, n_docs long, n_tokens long"), "token-manifest")
    # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return root, manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_store(root: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = SequenceFile(_open(root, row["stem"] + ".arrow"))
                index = pa.ipc.open_file(_open(root, row["stem"] + ".docs.arrow"))
                first = 0
                for k in range(index.num_record_batches):
                    docs = index.get_batch(k)
                    counts = docs.column("n_tokens").to_numpy()
                    offsets = first + np.cumsum(counts) - counts
                    crc = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in tokens.slices(offsets, counts)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": docs.column("doc_id"), "start": pa.array(offsets + row["first"], pa.int64()),
                        "n_tokens": docs.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64()),
                    })
                    first += int(counts.sum())

    return map_batches(manifest.repartition(partitions(manifest.sparkSession)), run, "doc_id long, start long, n_tokens long, ids_crc32 long")
