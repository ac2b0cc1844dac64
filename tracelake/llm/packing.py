"""Best-fit packing of token sequences, planned on the histogram of lengths.

1. Each document is encoded, ended with an id, and cut where it is longer than the capacity: the first piece takes what is
   left over, all others are full. Pieces are written to the shared folder; each carries its rank among the pieces of its
   length that the same task wrote.
2. The histogram of lengths (at most `capacity` rows) goes to the driver. Best-fit decreasing runs over counts: bins of the
   same filling are one group, so the work and the plan depend on the number of distinct lengths and not on documents.
3. A piece's rank within its length is its rank within the task plus the pieces of that length of earlier tasks, and the plan
   gives the rank its sequence and place. No length, however common, meets in one task.

Defined cases: a null text is an empty one, which is one piece that holds the end id; without an end id it has no piece.
A long text is cut into pieces, all but the first full. Repeated rows are packed each. Rows without doc_id are packed, their doc_id stays null. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracelake.llm.bpe import Vocabulary, encoder
from tracelake.llm.common import binary, documents, map_arrow, stored

CAPACITY = 1024
#: Rows of the table of (task, length) up to which it is broadcast; a shuffle join takes more.
BROADCAST_ROWS = 100_000

PIECES = "task int, doc_id long, piece int, start long, length int, local long, ids binary"


@dataclass
class Slots:
    """A run of ranks of one length: `bins` sequences from `sequence` on take `each` pieces from `offset` on."""

    length: int
    rank: int
    bins: int
    each: int
    sequence: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Slots], int]:
    """Best-fit decreasing over counts: the runs of slots and the number of sequences.

    A group is a run of sequences with the same room left. Giving a length to the tightest groups splits at most one group,
    and opens at most two, so there are at most 3 groups for each distinct length, whatever the counts.
    """
    slots: list[Slots] = []
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    made = 0

    def put(room: int, first: int, bins: int) -> None:
        if room and bins:
            if room not in groups:
                insort(rooms, room)
            groups.setdefault(room, []).append((first, bins))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0

        def give(room: int, first: int, bins: int, each: int, length: int = length) -> int:
            slots.append(Slots(length, rank, bins, each, first, capacity - room))
            put(room - each * length, first, bins)
            return bins * each

        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                for bins, n in ((left // each, each), (int(left % each > 0), left % each)):
                    if bins:
                        rank += give(capacity, made, bins, n)
                        made += bins
                break
            room = rooms[at]
            first, bins = groups[room].pop()
            if not groups[room]:
                del groups[room], rooms[at]
            each = room // length
            use = min(bins, left // each)
            if not use:
                use, each = 1, left
            put(room, first + use, bins - use)
            got = give(room, first, use, each)
            rank += got
            left -= got
    return slots, made


def piece_table(docs: DataFrame, vocabulary: str, end_id: int | None = 2, capacity: int = CAPACITY, memo: int | None = None) -> DataFrame:
    """The pieces with their ids (little-endian unsigned 32-bit), written to the shared folder. memo: pre-tokens that a worker remembers; it changes speed and memory only."""
    voc = Vocabulary(vocabulary)
    text, key = voc.broadcast(docs.sparkSession), voc.key

    def make():
        encode = encoder(key, text, memo)
        end = b"" if end_id is None else struct.pack("<I", end_id)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for doc_id, got in zip(b.column(0).to_pylist(), encode.many(b.column(1).to_pylist()), strict=True):
                ids = np.frombuffer(got, dtype=encode.dtype).astype("<u4").tobytes() + end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    size = (n - at) % capacity or capacity
                    rows.append((doc_id, piece, at, size, int(seen[size]), ids[4 * at : 4 * (at + size)]))
                    seen[size] += 1
                    at, piece = at + size, piece + 1
            c = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([task] * len(rows), type=pa.int32()), *(pa.array(v, type=k) for v, k in zip(c, kinds, strict=False)), binary(c[5])], ["task", "doc_id", "piece", "start", "length", "local", "ids"])

        return batch

    return stored(map_arrow(documents(docs), PIECES, make), "pieces")


def assign(pieces: DataFrame, rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (any columns of pieces, among them task, length and local) with sequence_id and offset.

    The table of (task, length) is broadcast only where counting shows it small; it is joined by a shuffle otherwise.
    """
    counts = stored(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(histogram, capacity)
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("_before"))
    if counts.count() <= BROADCAST_ROWS:
        before = F.broadcast(before)
    ranked = rows.join(before, ["task", "length"]).withColumn("_rank", F.col("_before") + F.col("local")).drop("_before")
    slots.sort(key=lambda s: (s.length, s.rank))
    # Sorted by length and rank; its size depends on the distinct lengths only.
    held = rows.sparkSession.sparkContext.broadcast(np.array([(s.length, s.rank, s.each, s.sequence, s.offset) for s in slots], dtype=np.int64).reshape(-1, 5))
    schema = T.StructType([*ranked.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def make():
        runs = held.value
        first = {int(n): (int(lo), int(hi)) for n, lo, hi in zip(*_bounds(runs[:, 0]), strict=True)}

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column(b.schema.get_field_index("_rank")).to_numpy(zero_copy_only=False)
            at = np.empty(len(rank), dtype=np.int64)
            for n in np.unique(length):
                lo, hi = first[int(n)]
                mine = length == n
                at[mine] = lo + np.searchsorted(runs[lo:hi, 1], rank[mine], side="right") - 1
            _, began, each, sequence, offset = runs[at].T
            nth = rank - began
            return pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence + nth // each), pa.array(offset + nth % each * length)], [*b.schema.names, "sequence_id", "offset"])

        return batch

    return map_arrow(ranked, schema, make, rows=100_000).drop("_rank")


def _bounds(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, begin, n = np.unique(values, return_index=True, return_counts=True)
    return keys, begin, begin + n


def pack(docs: DataFrame, vocabulary: str, end_id: int | None = 2, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids, sequence_id and offset."""
    pieces = piece_table(docs, vocabulary, end_id, capacity)
    return assign(pieces, pieces, capacity).drop("task", "local")


def pack_digests(docs: DataFrame, vocabulary: str, end_id: int | None = 2, capacity: int = CAPACITY, memo: int | None = None) -> DataFrame:
    """pack() with the ids' CRC-32 for the ids, taken before anything is shuffled."""
    pieces = piece_table(docs, vocabulary, end_id, capacity, memo)
    rows = pieces.select("task", "doc_id", "piece", "start", "length", "local", F.crc32("ids").alias("ids_crc32"))
    placed = assign(pieces, rows, capacity)
    return placed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): pack()'s sequences in full, by one shuffle on sequence_id; a sequence is at most the capacity long."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
