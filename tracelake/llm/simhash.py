"""SimHash near-duplicates: 64-bit fingerprints of word shingles, and all links within a radius by tiled exact comparison.

1. A text's words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) give shingles of three words, repeats included; a text of fewer words
   is one shingle, one without words has fingerprint zero. A bit is set if over half the shingles' XXH64 (seed 42) have it.
2. Equal fingerprints are one from here on, however many documents share them.
3. Fingerprints whose four 16-bit quarters have the same population counts form a cell; a cell is cut into tiles of at most
   TILE fingerprints. Two fingerprints within the radius have population counts within the radius, quarter by quarter in sum,
   so tile pairs beyond it are skipped and every other pair is compared in full with numpy's exclusive-or and bit counts.
   Only packed tiles are shuffled; no fingerprint pairs are made. A tile pair gives the links of a spanning forest of its
   matches, at most one a fingerprint, so a group of thousands of near copies makes no square of links.
4. Components of those links name groups by their smallest doc_id.

Defined cases: a null text is an empty one; all texts without words share fingerprint zero and are linked; texts are read whole,
their shingles' bits in blocks; repeated rows and rows of one doc_id are rows of their own; a row without doc_id keeps its group,
which is null if no row of it has one; an empty table gives no rows; other columns are ignored. A fingerprint that many rows
share is one row wherever links are made; the last join gives it back to its rows, whose side adaptive execution can split.
"""

from __future__ import annotations

from itertools import product, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import documents, map_arrow, stored
from tracelake.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Most fingerprints in a tile.
TILE = 4096
#: Shingles whose bits are unpacked at a time.
BLOCK = 1 << 16

QUARTERS = [0xFFFF << (16 * k) for k in range(4)]


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The text's fingerprint as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False)))
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(seed)), dtype="<u8", count=len(shingles))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], dtype=np.uint64)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

        return batch

    return map_arrow(documents(docs), "doc_id long, fp long", make)


def _cell(counts: list) -> F.Column:
    """A number for four population counts of 0 to 16, with room for a neighbour's -RADIUS to 16 + RADIUS."""
    n = F.lit(0)
    for c in counts:
        n = n * 64 + c + 16
    return n.cast("int")


def tiles(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """(cell, tile, fps): the distinct fingerprints, packed. A cell's fingerprints are dealt to as many tiles as its size needs."""
    counts = [F.bit_count(F.col("fp").bitwiseAND(F.lit(q - (1 << 64) if q >> 63 else q))) for q in QUARTERS]
    in_cells = distinct.select("fp", _cell(counts).alias("cell"))
    # At most 17 ** 4 cells, whatever the data.
    sizes = F.broadcast(in_cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    dealt = in_cells.join(sizes, "cell").select("cell", F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / (tile * 3 // 4))).cast("int").alias("tile"), "fp")
    return dealt.groupBy("cell", "tile").agg(F.sort_array(F.collect_list("fp")).alias("fps"))


def _steps(radius: int) -> list[int]:
    """Steps from a cell to itself and to each later cell within the radius."""
    out = []
    for d in product(range(-radius, radius + 1), repeat=4):
        if sum(map(abs, d)) <= radius and d >= (0, 0, 0, 0):
            out.append(((d[0] * 64 + d[1]) * 64 + d[2]) * 64 + d[3])
    return out


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all pairs of a and b (of a with itself if b is None) within the radius."""
    other = a if b is None else b
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[up]
        return x

    links = []
    rows = max(1, (1 << 18) // max(1, len(other)))
    for at in range(0, len(a), rows):
        near = np.bitwise_count(a[at : at + rows, None] ^ other[None, :]) <= radius
        i, j = np.nonzero(near)
        i += at
        if b is None:
            i, j = i[i < j], j[i < j]
        for x, y in zip(a[i].tolist(), other[j].tolist(), strict=True):
            p, q = root(x), root(y)
            if p != q:
                parent[max(p, q)] = min(p, q)
                links.append((x, y))
    return links


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(x, y): fingerprints (as signed longs) linked within the radius, enough of them to join all that are."""
    packed = stored(tiles(distinct, tile), "tiles")
    here = packed.select("cell", "tile", "fps")
    steps = F.array(*[F.lit(s) for s in _steps(radius)])
    # Cells that a tile is compared with: those within the radius, of which only existing ones are kept (at most 17 ** 4 of them).
    cells = F.broadcast(packed.groupBy(F.col("cell").alias("to")).agg(F.max("tile").alias("last")))
    sent = packed.select(F.col("cell").alias("from"), F.col("tile").alias("from_tile"), F.col("fps").alias("other"), F.explode(F.transform(steps, lambda s: F.col("cell") + s)).alias("to")).join(cells, "to")
    # Each of a cell's tiles is a key of its own, so the tiles of a full cell are compared in as many tasks.
    sent = sent.withColumn("to_tile", F.explode(F.sequence(F.lit(0), "last"))).where("from != to or from_tile <= to_tile").drop("last")
    pairs = here.join(sent, (here["cell"] == sent["to"]) & (here["tile"] == sent["to_tile"])).select(F.col("fps").alias("a"), "other", (F.col("from").eqNullSafe(F.col("cell")) & F.col("from_tile").eqNullSafe(F.col("tile"))).alias("same"))

    def make():
        def array(column: pa.Array, k: int) -> np.ndarray:
            return column[k].values.to_numpy().view(np.uint64)

        def batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
            found: list[tuple[int, int]] = []
            for k, same in enumerate(b.column(2).to_pylist()):
                found += forest(array(b.column(0), k), None if same else array(b.column(1), k), radius)
            if not found:
                return None
            out = np.array(found, dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["x", "y"])

        return batch

    return map_arrow(pairs, T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())]), make, rows=64)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id, the smallest doc_id that links reach."""
    fps = stored(fingerprints(docs, shingle, seed), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    joined = links(classes.select("fp"), radius, tile)
    groups = stored(components(joined.select(F.col("x").alias("a"), F.col("y").alias("b"))), "groups")
    # A class's name: the smallest doc_id of all classes of its component.
    linked = groups.join(classes, groups["node"] == classes["fp"]).groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = groups.join(linked, "component").select(F.col("node").alias("fp"), "component_id")
    names = classes.join(by_fp, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    named = stored(names, "names")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
