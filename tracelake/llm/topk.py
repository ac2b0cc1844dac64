"""Exact top-k search by inner product: tiled matrix products, partial selection per tile, and tree merging of top lists.

Vectors become whole numbers floor(scale * x). Candidates are packed into shards and queries into blocks, both bounded in rows;
every block meets every shard by an equi-join on the shard's number. For each such tile one matrix product gives all scores and
a partial selection leaves each query's k best; top lists of a block are then merged, FAN shards at a time, until one is left.
Scores are sums of products of whole numbers and are computed exactly (in float64 where every sum is proven below 2 ** 53, in
Python's whole numbers otherwise); ties go to the smaller vec_id, then to the earlier row of a repeated one.

Defined cases: vectors that are null, or hold nulls, NaN or infinities, take no part, nor do rows without vec_id; a query is
never its own candidate (rows of its vec_id are left out); with fewer than k candidates all are returned; vectors meet those of
their own length only; an empty vector scores zero with other empty ones; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_arrow, stored

K = 20
SCALE = 64
SHARD_ROWS = 8192
BLOCK_ROWS = 1024
#: Top lists that a merge takes at a time.
FAN = 16

PACKED = "dim int, part int, ids binary, data binary"
LISTS = "dim int, block int, shard int, n int, query_ids binary, ids binary, scores binary"


def whole_vectors(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, x): the vectors that take part, x an array of doubles that are whole numbers."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & fine)
    return rows.select("vec_id", F.size("embedding").alias("dim"), F.transform("embedding", lambda v: F.floor(v * F.lit(float(scale))).cast("double")).alias("x"))


def packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows in parts of about `size`, each one row of ids and a matrix. Parts are dealt by a hash, so none is hot."""
    sizes = rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(sizes), "dim") if sizes.count() <= 1000 else rows.join(sizes, "dim")
    dealt = dealt.select("dim", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "x")
    grouped = dealt.groupBy("dim", "part").agg(F.collect_list(F.struct("vec_id", "x")).alias("rows"))

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            ids, data = [], []
            for dim, rows in zip(b.column(0).to_pylist(), b.column(2), strict=True):
                own = rows.values.field("vec_id").to_numpy()
                matrix = rows.values.field("x").flatten().to_numpy().reshape(len(own), dim)
                order = np.argsort(own, kind="stable")
                ids.append(own[order].astype("<i8").tobytes())
                data.append(matrix[order].astype("<f8").tobytes())
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, type=pa.binary()), pa.array(data, type=pa.binary())], ["dim", "part", "ids", "data"])

        return batch

    return map_arrow(grouped, PACKED, make, rows=4)


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """All inner products as signed 64-bit numbers."""
    dim = queries.shape[1]
    if not dim or not len(candidates):
        return np.zeros((len(queries), len(candidates)), dtype=np.int64)
    if float(np.abs(queries).max()) * float(np.abs(candidates).max()) * dim < 2.0**53:
        return (queries @ candidates.T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(q, c, strict=True)) for c in candidates.tolist()] for q in queries.tolist()]
    return np.array(exact, dtype=np.int64)  # OverflowError if a score is no long


def best(got: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a query's scores and the ids beside them, the k best: highest score, then smallest id."""
    if len(got) > k:
        least = np.partition(got, len(got) - k)[len(got) - k]
        above = np.flatnonzero(got > least)
        level = np.flatnonzero(got == least)
        if len(level) > k - len(above):
            level = level[np.argsort(ids[level], kind="stable")[: k - len(above)]]
        keep = np.concatenate([above, level])
        got, ids = got[keep], ids[keep]
    order = np.lexsort((ids, -got))
    return got[order], ids[order]


def _lists(dim: int, block: int, shard: int, query_ids: np.ndarray, found: list, k: int) -> tuple:
    n = np.array([len(s) for s, _ in found], dtype="<i4")
    return (dim, block, shard, k, np.asarray(query_ids, dtype="<i8").tobytes() + n.tobytes(), b"".join(i.astype("<i8").tobytes() for _, i in found), b"".join(s.astype("<i8").tobytes() for s, _ in found))


def _unpack(row: dict):
    raw = row["query_ids"]
    m = len(raw) // 12
    query_ids, n = np.frombuffer(raw[: 8 * m], dtype="<i8"), np.frombuffer(raw[8 * m :], dtype="<i4")
    ids, found = np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["scores"], dtype="<i8")
    ends = np.cumsum(n)
    return query_ids, [(found[e - c : e], ids[e - c : e]) for c, e in zip(n.tolist(), ends.tolist(), strict=True)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True)) or [()] * 7
    kinds = [pa.int32()] * 4 + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(c, kinds, strict=True)], [x.split()[0] for x in LISTS.split(", ")])


def tile_lists(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Each tile's top lists."""
    shards = candidates.groupBy("dim").agg(F.max("part").alias("last"))
    sent = queries.join(shards, "dim").select("dim", F.col("part").alias("block"), F.col("ids").alias("query_ids"), F.col("data").alias("query"), F.explode(F.sequence(F.lit(0), F.col("last"))).alias("part"))
    tiles = candidates.join(sent, ["dim", "part"]).select("dim", "block", "part", "query_ids", "query", "ids", "data")

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for r in b.to_pylist():
                qi, ci = np.frombuffer(r["query_ids"], dtype="<i8"), np.frombuffer(r["ids"], dtype="<i8")
                q, c = (np.frombuffer(r[n], dtype="<f8").reshape(len(i), r["dim"]) for n, i in (("query", qi), ("data", ci)))
                found = []
                for at in range(0, len(qi), 256):
                    got = scores(q[at : at + 256], c)
                    for one, own in zip(got, qi[at : at + 256], strict=True):
                        lo, hi = np.searchsorted(ci, [own, own + 1])
                        found.append(best(np.delete(one, np.s_[lo:hi]), np.delete(ci, np.s_[lo:hi]), k) if hi > lo else best(one, ci, k))
                out.append(_lists(r["dim"], r["block"], r["part"], qi, found, k))
            return _batch(out)

        return batch

    return map_arrow(tiles, LISTS, make, rows=1)


def merge(lists: DataFrame, shards: int, k: int) -> DataFrame:
    """One top list a query: lists of FAN neighbouring shards become one, level by level. A merge holds at most FAN lists a query."""
    while shards > 1:

        def join(key: tuple, rows: pa.Table) -> pa.Table:
            parts = [_unpack(r) for r in rows.to_pylist()]
            query_ids = parts[0][0]
            found = [best(np.concatenate([p[1][j][0] for p in parts]), np.concatenate([p[1][j][1] for p in parts]), k) for j in range(len(query_ids))]
            return pa.Table.from_batches([_batch([_lists(key[0].as_py(), key[1].as_py(), key[2].as_py(), query_ids, found, k)])])

        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int")).groupBy("dim", "block", "shard").applyInArrow(join, LISTS)
        shards = -(-shards // FAN)
    return lists


def top_k(table: DataFrame, queries: F.Column | None = None, k: int = K, scale: int = SCALE, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. table: vec_id, embedding; queries: a condition on vec_id, every 20th by default."""
    rows = whole_vectors(table, scale)
    candidates = stored(packed(rows, shard_rows), "shards")
    asked = packed(rows.where(F.col("vec_id") % 20 == 0 if queries is None else queries), block_rows)
    shards = (candidates.agg(F.max("part")).first()[0] or 0) + 1
    lists = merge(tile_lists(asked, candidates, k), shards, k)

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            out: list[np.ndarray] = []
            for r in b.to_pylist():
                for q, (s, i) in zip(*_unpack(r), strict=True):
                    out.append(np.stack([np.full(len(s), q), np.arange(1, len(s) + 1), i, s]))
            query_id, rank, vec_id, score = np.concatenate(out, axis=1) if out else np.zeros((4, 0), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(query_id), pa.array(rank.astype(np.int32)), pa.array(vec_id), pa.array(score)], ["query_id", "rank", "vec_id", "score"])

        return batch

    return map_arrow(lists, "query_id long, rank int, vec_id long, score long", make, rows=4)
