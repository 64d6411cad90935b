"""Token ids in Arrow files of equal-length sequences, with masks.

The documents, in ascending ``doc_id`` order, are dealt by range over tasks;
each task writes one Arrow IPC file. A record batch holds up to ``BATCH``
sequences as two fixed-size lists: ``ids`` (the token stream, cut every
``length`` ids) and ``mask`` (true: a token, false: padding of the file's last
sequence). Equal lists need no offsets, so a reader maps the file and takes any
sequence or mask without copying. Ids are 16 bits wide where the vocabulary
allows it.

File names carry the task attempt; only files named in the written manifest
count, so a lost executor or a second attempt leaves no wrong rows, at most a
file that nobody names.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import new_folder, write_shared
from .tokens import encode_in_slices, slices

#: Sequences of a record batch.
BATCH = 256


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The store and path of a Hadoop-style address (``file:/x``, ``file:///x``, ``hdfs://...``, ``/x``)."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pa.fs.FileSystem.from_uri(uri)


def file_schema(length: int, wide: bool) -> pa.Schema:
    kind = pa.uint32() if wide else pa.uint16()
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceWriter:
    """Cuts a stream of ids into equal sequences and writes them as record batches."""

    def __init__(self, sink, length: int, wide: bool):
        self.length, self.kind = length, np.uint32 if wide else np.uint16
        self.schema = file_schema(length, wide)
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n += len(ids)
        if self.n >= BATCH * self.length:
            flat = np.concatenate(self.held)
            whole = len(flat) // (BATCH * self.length) * BATCH * self.length
            for at in range(0, whole, BATCH * self.length):
                part = flat[at:at + BATCH * self.length]
                self._write(part, len(part))
            self.held, self.n = [flat[whole:]], len(flat) - whole

    def _write(self, flat: np.ndarray, tokens: int) -> None:
        mask = np.arange(len(flat)) < tokens
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.held)
            self._write(np.concatenate([flat, np.zeros(-len(flat) % self.length, self.kind)]), len(flat))
        self.out.close()


class SequenceReader:
    """A written file, mapped into memory where the store is a local one."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(source)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file, no copy) and mask of the file's sequence ``k``."""
        batch = self.file.get_batch(k // BATCH)
        ids, mask = batch.column(0)[k % BATCH].values, batch.column(1)[k % BATCH].values
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the file's stream on."""
        length = self.file.schema.field("ids").type.list_size
        parts, size = [], BATCH * length
        for b in range(start // size, -(-(start + n) // size)):
            flat = self.file.get_batch(b).column(0).flatten()
            at = max(0, start - b * size)
            parts.append(flat.slice(at, min(size, start + n - b * size) - at).to_numpy(zero_copy_only=True))
        return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint32), *parts])


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 2048, wide: bool = False) -> DataFrame:
    """Write every document's ids and ``end_id``; return the manifest.

    Manifest: ``file, part, doc_id, at, n_tokens`` (``at``: place in the file's
    stream). Null ids come first; rows that share a ``doc_id`` stand next to
    each other, by text. A null text is empty. An empty table writes no file.
    ``wide``: 32-bit ids, for vocabularies over 65,536. Only ``doc_id`` and
    ``text`` are read.
    """
    spark = docs.sparkSession
    folder, end = new_folder(spark, "tokens"), int(end_id).to_bytes(4, "little")

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        uri = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.arrow"
        fs, path = filesystem(uri)
        writer = sink = None
        at = 0
        for batch in batches:
            if writer is None:
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                sink = fs.open_output_stream(path)
                writer = SequenceWriter(sink, length, wide)
            starts, sizes = [], []
            for _, ids in encode_in_slices(tokenizer, batch.column(1)):
                ids = np.frombuffer(ids + end, "<u4")
                writer.add(ids)
                starts.append(at)
                sizes.append(len(ids))
                at += len(ids)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array([uri] * n, pa.string()), pa.array([task.partitionId()] * n, pa.int64()), batch.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                ["file", "part", "doc_id", "at", "n_tokens"])
        if writer is not None:
            writer.close()
            sink.close()

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = source.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    with slices(spark):
        return write_shared(dealt.mapInArrow(write, "file string, part long, doc_id long, at long, n_tokens long"), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all documents before it, over all files.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = (manifest.groupBy("part", "file").agg(F.sum("n_tokens").alias("__size"))  # one row per file
             .withColumn("__base", F.coalesce(F.sum("__size").over(before), F.lit(0))))

    def read(batches):
        reader, of = None, None
        for batch in batches:
            sums = []
            for uri, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n_tokens"))):
                if uri != of:
                    reader, of = SequenceReader(uri), uri
                sums.append(zlib.crc32(reader.ids(at, n).astype("<u4")))
            starts = pa.array(batch.column("__base").to_numpy() + batch.column("at").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), starts, batch.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = manifest.join(files.select("file", "__base"), "file")
    return rows.select("file", "doc_id", "at", "n_tokens", "__base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
