"""Best-fit packing of documents into sequences of a fixed number of tokens.

Best-fit decreasing puts the pieces, longest first, each into the open sequence
with the least room that still takes it. Which sequence gets a piece depends on
its length alone, so the packing is planned on the counts by length (at most
``capacity`` rows, whatever the corpus): a segment tree over the remaining
capacities finds the tightest open sequences in logarithmic time, and equal
pieces are placed as runs. Every piece then finds its place from its length and
its rank among the pieces of that length; ranks are counted by (length, bucket),
so no length, however frequent, meets in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_shared
from .tokens import WIDE, Room, encode_in_slices, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Rows of one (length, bucket) group, about.
BUCKET_ROWS = 20_000


class Capacities:
    """Segment tree over remaining capacities: which of them have an open sequence."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.leaves)

    def mark(self, room: int, there: bool) -> None:
        at = self.leaves + room
        self.any[at] = there
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity >= ``length`` that has an open sequence."""
        at = self.leaves + length
        if not self.any[at]:
            while at > 1 and (at % 2 or not self.any[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Best-fit decreasing over counts by length, as runs of equal pieces.

    A run places the pieces of ``length`` ranked from ``rank`` on: ``each`` to a
    sequence, from sequence ``first`` on, at place ``offset`` within it. There
    are less than 252 * capacity runs for any corpus: an open interval of equal
    sequences is cut at most twice for a length, and one sequence holds pieces
    of at most sqrt(2 * capacity) different lengths.
    """
    tree, open_ = Capacities(capacity), defaultdict(deque)
    runs, sequences = [], 0

    def add(room: int, first: int, n: int) -> None:
        if n and room:
            open_[room].append((first, n))
            tree.mark(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            else:
                first, n = open_[room].popleft()
                if not open_[room]:
                    tree.mark(room, False)
            each = room // length
            full = min(n, left // each)
            part = left - full * each if full < n else 0
            placed = full * each + part
            runs.append((length, rank, first, each, capacity - room))
            add(room - each * length, first, full)
            if part:
                add(room - part * length, first + full, 1)
            add(room, first + full + bool(part), n - full - bool(part))
            rank, left = rank + placed, left - placed
    cols = np.array(runs, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "first", "each", "offset"), cols))


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, room: Room = WIDE) -> DataFrame:
    """Tokens of each document and ``end_id``, cut where longer than ``capacity``.

    The first piece of a cut document may be the shorter one. ``keep_ids`` adds
    the piece's ids as little-endian unsigned 32-bit integers. A null text is
    empty: one piece that is the end id. A special token's string becomes that
    token. ``room`` bounds what a worker holds. Other columns of ``docs`` are not read.
    """
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        for batch in batches:
            names, rows = batch.column(0), [[] for _ in range(5 + keep_ids)]
            for k, ids in encode_in_slices(tokenizer, batch.column(1), room):
                ids += end
                n, start = len(ids) // 4, 0
                size = n % capacity or capacity
                for piece in range(-(-n // capacity)):
                    part = ids[4 * start:4 * (start + size)]
                    for col, value in zip(rows, (k, piece, start, size, zlib.crc32(part), part)):
                        col.append(value)
                    start, size = start + size, capacity
            cols = [names.take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:5])]
            if keep_ids:
                cols.append(pa.array(rows[5], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(cols)])

    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(cut, PIECES + ", ids binary" * keep_ids)


def assign(rows: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows that have ``doc_id, piece, start, length, ids_crc32``.

    Lengths are 1 to ``capacity``. Wholly equal rows take each other's places at
    will; an empty table gives an empty result. ``rows`` is read three times, so
    hand in a written table.
    """
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = plan(counts, capacity)
    top = int(max(counts.values(), default=0)) + 1
    key = runs["length"] * top + runs["rank"]
    order = np.argsort(key)
    key, first, each, offset, rank0 = (a[order] for a in (key, runs["first"], runs["each"], runs["offset"], runs["rank"]))

    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (rows.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
              .withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    within = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (rows.join(starts, ["length", "__bucket"])
              .withColumn("__rank", F.col("__from") + F.row_number().over(within) - 1))
    kept = [c for c in rows.columns if c != "__bucket"]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            run = np.searchsorted(key, length * top + rank, side="right") - 1
            nth = rank - rank0[run]
            cols = [batch.column(c) for c in kept]
            cols += [pa.array(first[run] + nth // each[run]), pa.array(offset[run] + nth % each[run] * length)]
            yield pa.RecordBatch.from_arrays(cols, [*kept, "sequence_id", "offset"])

    schema = rows.select(*kept).schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*kept, "__rank").mapInArrow(place, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False, room: Room = WIDE) -> DataFrame:
    """Pack all documents: one row per piece with its sequence and its place there."""
    with slices(docs.sparkSession, room):
        written = write_shared(pieces(docs, tokenizer, capacity, end_id, keep_ids, room), "pieces")
    return assign(written, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token ids: ``sequence_id, ids`` (little-endian unsigned 32-bit), from ``pack(..., keep_ids=True)``.

    A group holds at most ``capacity`` tokens.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("__parts")).select(
        "sequence_id", F.aggregate("__parts", F.lit(b"").cast("binary"), lambda got, x: F.concat(got, x["ids"])).alias("ids"))
