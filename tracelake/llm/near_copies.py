"""Near copies: all pairs of texts whose five-word shingles have a Jaccard similarity of LEAST or more, as groups of rows.

1. Words are those of simhash ([^\\x20\\x09-\\x0D]+, A-Z lower-cased). Rows of the same words are one class, whose smallest row
   stands for it. A text's set is that of its shingles' 64-bit hashes; a text of fewer words is one shingle, one without has none.
2. SimHash first: fingerprints of the sets are linked within RADIUS bits by simhash.links(), and each link is checked exactly.
   That joins most of a large group of copies by a few links. It finds only what hardly differs, so it is not the whole job.
3. The rest is an exact join by prefixes: of a set of n hashes in one total order, the first n - ceil(LEAST * n) + 1 hold at
   least one hash of every set that is similar enough. The order is by hash, but hashes that stand in more than HOT prefixes are
   put last, the most frequent MOST_HOT of them; which these are decides only how many pairs are looked at, not which links are found.
4. Rows that share a prefix hash meet. A meeting's rows are compared with one pivot of it in each of STARS rounds, leaving out
   rows that links already join. What still meets then is dealt to tiles of about TILE rows, and tiles are compared in full.
   Only rows that are in a pair which passes a bound leave a tile. They meet once more in tiles that carry their sets, where each
   such pair is compared exactly, and links leave that join groups: fewer than a tile has rows, not one for each similar pair.
   No pair is made of rows that links join; no link between groups is missed.
5. The bound: sketches count a set's hashes in cells, and the smaller counts summed over cells are no less than what two sets
   share. Sets in full are made only of the texts of pairs that the bound lets through. A pair that meets often is looked at in
   its first meeting only, by what each row knows of its meetings.
6. Groups are the components of links, named by their smallest row.

Between these steps the executors' JVMs give back the heap that the one before left behind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import simhash
from tracelake.llm.common import binary, collect_garbage, map_arrow, stored, worker_value
from tracelake.llm.components import components

SHINGLE = 5
RADIUS = simhash.RADIUS
SEED = 42
#: LEAST as a fraction, 4 / 5.
OVER, UNDER = 4, 5
#: Prefixes that a hash stands in at most before it is put last, and how many hashes are at most (8 bytes each on the driver).
HOT, MOST_HOT = 1, 500_000
#: Shared hashes that are broadcast at most (8 bytes each); a shuffle join takes more.
MOST_SHARED = 4_000_000
STARS = 2
#: Rows of a tile, and cells of the sketches that it carries at most.
TILE, COARSE = 256, 512
#: Rows of a tile of sets, and hashes that it carries at most (but for those of one row, and as rows are dealt by their hashes).
SET_TILE, SET_HASHES = 1024, 1 << 19
#: Earlier meetings of a row that a tile knows of at most; with fewer, pairs are looked at more often than once.
EARLIER = 64
#: Rows to look up that are broadcast at most (8 bytes each).
FEW = 300_000
#: Words that a worker remembers.
MEMO_ENTRIES = 200_000


class Words(dict):
    """Words' hashes."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > MEMO_ENTRIES:
            self.clear()
        h = self[word] = xxh64_intdigest(word, SEED)
        return h


def cut(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], memo: Words | None = None) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    own = np.fromiter(map((Words() if memo is None else memo).__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(SHINGLE, len(words))
    h = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        h = (h ^ own[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set: bits that over half its hashes have, as a signed number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), simhash.BLOCK):
        ones += np.unpackbits(hashes[at : at + simhash.BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def prefix_length(n: int) -> int:
    return n - -(-OVER * n // UNDER) + 1 if n else 0


def prefix(hashes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first of a set (in order) once the hot ones are put last."""
    n = prefix_length(len(hashes))
    if not len(hot) or not n:
        return hashes[:n]
    last = hot[np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)] == hashes
    return np.concatenate([hashes[~last], hashes[last]])[:n]


def sketch(hashes: np.ndarray) -> bytes:
    """Counts of a set's hashes in a power of two of cells, about two a cell; empty where a cell has too many to count."""
    cells = 1 << max(3, int(len(hashes) // 2).bit_length())
    counts = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def most_shared(a: bytes, b: bytes) -> int:
    """No less than what the sets of two sketches share."""
    if not a or not b:
        return 1 << 62
    x, y = (np.frombuffer(s, dtype=np.uint8).astype(np.int64) for s in ((a, b) if len(a) <= len(b) else (b, a)))
    return int(np.minimum(x, y.reshape(-1, len(x)).sum(axis=0)).sum())


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.empty(0, dtype=np.uint64)]).view(np.int64)))


def _memo() -> Words:
    return worker_value(("words",), Words)


READ = "row long, key binary, n int, fp long, prefix array<long>, sketch binary"


def read(rows: DataFrame, hot=None) -> DataFrame:
    """Of each text its key (16 bytes of its words), the size of its set, fingerprint, prefix and sketch. hot: hashes put last, as a broadcast value."""

    def make():
        memo = _memo()
        last = np.empty(0, dtype=np.uint64) if hot is None else hot.value

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            made, sets = [], []
            for t in b.column(1):
                words = cut(t.as_py() or "")
                made.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                sets.append(shingles(words, memo))
            columns = [b.column(0), binary(made), pa.array([len(s) for s in sets], type=pa.int32()), pa.array([fingerprint(s) for s in sets], type=pa.int64()), _lists([prefix(s, last) for s in sets]), binary([sketch(s) for s in sets])]
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in READ.split(", ")])

        return batch

    return map_arrow(rows, READ, make)


def sets(rows: DataFrame) -> DataFrame:
    """(row, hashes)."""

    def make():
        memo = _memo()

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0), _lists([shingles(cut(t or ""), memo) for t in b.column(1).to_pylist()])], ["row", "hashes"])

        return batch

    return map_arrow(rows, "row long, hashes array<long>", make)


def few(df: DataFrame) -> DataFrame:
    """df (one column of numbers), marked for broadcast if it is counted small."""
    return F.broadcast(df) if df.count() <= FEW else df


def shared_hashes(own: DataFrame) -> DataFrame:
    """(hash, n): hashes of two prefixes or more."""
    return stored(own.select(F.explode("prefix").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values stand in a table in order."""
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values if len(table) else np.zeros(len(values), dtype=bool)


def holding(own: DataFrame, hashes) -> DataFrame:
    """own (row, n, prefix) with those hashes of the prefixes that stand in a broadcast table; rows without any go."""

    def make():
        wanted = hashes.value

        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            lists = b.column(2)
            values = lists.flatten().to_numpy().view(np.uint64)
            found = _among(values, wanted)
            before = np.concatenate([[0], np.cumsum(found)]).astype(np.int32)
            ends = before[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
            kept = pa.ListArray.from_arrays(pa.array(ends), pa.array(values[found].view(np.int64)))
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), kept], ["row", "n", "prefix"]).filter(pa.array(np.diff(ends) > 0))

        return batch

    return map_arrow(own.select("row", "n", "prefix"), "row long, n int, prefix array<long>", make, rows=100_000)


def numbers(df: DataFrame) -> np.ndarray:
    """A column of hashes, in order, on the driver: for tables of a checked size."""
    return np.sort(df.toArrow().column(0).to_numpy().view(np.uint64))


def ordered_prefixes(rows: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """own (row, n, prefix) with prefixes that leave out hot hashes where a text has enough others, and the hashes that are shared then."""
    shared = shared_hashes(own)
    hot = numbers(shared.where(F.col("n") > HOT).orderBy(F.desc("n"), "hash").limit(MOST_HOT).select("hash"))
    if not len(hot):
        return own, shared
    held = rows.sparkSession.sparkContext.broadcast(hot)
    touched = few(stored(holding(own, held).select("row"), "touched"))
    anew = read(rows.join(touched, "row", "left_semi"), held).select("row", "n", "prefix")
    own = stored(own.join(touched, "row", "left_anti").unionByName(anew), "prefixes")
    held.unpersist()
    return own, shared_hashes(own)


def meetings(own: DataFrame, shared: DataFrame) -> DataFrame:
    """(meeting, row, n): rows that share a prefix hash; of meetings of the same rows one stays."""
    if shared.count() <= MOST_SHARED:
        held = own.sparkSession.sparkContext.broadcast(numbers(shared.select("hash")))
        each = stored(holding(own, held).select("row", "n", F.explode("prefix").alias("hash")), "shared_prefixes")
        held.unpersist()
    else:
        each = stored(own.select("row", "n", F.explode("prefix").alias("hash")).join(shared.select("hash"), "hash", "left_semi"), "shared_prefixes")
    same = [F.count(F.lit(1)).alias("rows"), F.min("row").alias("least"), F.max("row").alias("most"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("sum")]
    kinds = each.groupBy("hash").agg(*same).groupBy("rows", "least", "most", "sum").agg(F.min("hash").alias("hash")).select("hash")
    return stored(each.join(kinds, "hash", "left_semi").select(F.col("hash").alias("meeting"), "row", "n"), "meetings")


def _similar(shared, a, b):
    return (OVER + UNDER) * shared >= OVER * (a + b)


def bounded(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """pairs (a, b) that their sketches do not rule out, with the sizes of their sets."""

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch:
            na, nb = b.column(2).to_pylist(), b.column(3).to_pylist()
            keep = [_similar(most_shared(x, y), i, j) for i, j, x, y in zip(na, nb, b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3)], ["a", "b", "na", "nb"]).filter(pa.array(keep, type=pa.bool_()))

        return batch

    left = sketches.select(F.col("row").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    right = sketches.select(F.col("row").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    both = pairs.join(left, "a").join(right, "b").where(UNDER * F.least("na", "nb") >= OVER * F.greatest("na", "nb"))
    return map_arrow(both.select("a", "b", "na", "nb", "x", "y"), "a long, b long, na int, nb int", make)


def coarse(sketch: bytes) -> bytes:
    """A sketch of at most COARSE cells; empty where a cell has too many to count."""
    if len(sketch) <= COARSE:
        return sketch
    counts = np.frombuffer(sketch, dtype=np.uint8).reshape(-1, COARSE).sum(axis=0, dtype=np.int64)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


class Tile:
    """Rows (n, row, group, earlier meetings) in the order of their sizes, with their coarse sketches as matrices by width."""

    def __init__(self, rows: list[dict], sketches: list[bytes]):
        self.n, self.row, self.group = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("n", "row", "group"))
        self.earlier = [frozenset(r["earlier"]) for r in rows]
        self.sketches = sketches
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def cells(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(counts in so many cells, whether a row has them)."""
        if width not in self.folded:
            fits = np.array([len(s) >= width for s in self.sketches], dtype=bool)
            counts = np.zeros((len(fits), width), dtype=np.int32)
            for k in np.flatnonzero(fits).tolist():
                counts[k] = np.frombuffer(self.sketches[k], dtype=np.uint8).reshape(-1, width).sum(axis=0)
            self.folded[width] = counts, fits
        return self.folded[width]

    def near(self, other: Tile, same: bool) -> Iterator[tuple[int, int]]:
        """Places of pairs of different groups that did not meet earlier and that coarse sketches do not rule out. Groups may be joined meanwhile."""
        low = np.searchsorted(other.n, -(-OVER * self.n // UNDER))
        high = np.searchsorted(other.n, UNDER * self.n // OVER, side="right")
        for k, (lo, hi) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
            at = np.arange(max(lo, k + 1) if same else lo, hi)
            at = at[other.group[at] != self.group[k]]
            # Sizes so near each other have sketches of the same length, or of twice or half of it.
            own = len(self.sketches[k])
            for width in (max(8, own // 2), own):
                if len(at) and own:
                    counts, fits = other.cells(width)
                    bound = np.minimum(counts[at], self.cells(width)[0][k]).sum(axis=1)
                    at = at[~fits[at] | _similar(bound, other.n[at], self.n[k])]
            for j in at.tolist():
                if other.group[j] != self.group[k] and self.earlier[k].isdisjoint(other.earlier[j]):
                    yield k, j

    def rename(self, group: int, name: int) -> None:
        self.group[self.group == group] = name


def touched(rows: list[dict], others: list[dict] | None) -> set[int]:
    """Of the rows of two tiles (of one, if others is None), whose values are coarse sketches, those in a pair to be compared."""
    tile = Tile(rows, [r["value"] for r in rows])
    other = tile if others is None else Tile(others, [r["value"] for r in others])
    return {int(x) for k, j in tile.near(other, others is None) for x in (tile.row[k], other.row[j])}


def forest(rows: list[dict], others: list[dict] | None) -> list[tuple[int, int]]:
    """Links between rows of two tiles (of one, if others is None), whose values are their sets: they join the groups that all similar pairs would, each link two of them."""

    def read_tile(rows: list[dict]) -> tuple[Tile, list[np.ndarray]]:
        held = [np.frombuffer(r["value"], dtype="<u8") for r in rows]
        return Tile(rows, [coarse(sketch(x)) for x in held]), held

    tile, x = read_tile(rows)
    other, y = (tile, x) if others is None else read_tile(others)
    links = []
    for k, j in tile.near(other, others is None):
        less, more = sorted((x[k], y[j]), key=len)
        if _similar(int(np.count_nonzero(_among(less, more))), len(less), len(more)):
            links.append((int(min(tile.row[k], other.row[j])), int(max(tile.row[k], other.row[j]))))
            gone, name = int(other.group[j]), int(tile.group[k])
            tile.rename(gone, name)
            other.rename(gone, name)
    return links


def tile_pairs(here: DataFrame, values: DataFrame, tiles: F.Column, tag: str) -> DataFrame:
    """(meeting, rows, others): tiles of here (meeting, row, n, group, earlier) with their values (row, value), each by itself (others is null) and
    with every other of its meeting. tiles: how many a meeting has, as an aggregate."""
    sized = here.groupBy("meeting").agg(tiles.cast("int").alias("tiles"))
    dealt = here.join(sized, "meeting").withColumn("tile", F.pmod(F.xxhash64("row"), F.col("tiles")).cast("int"))
    dealt = dealt.join(values, "row").groupBy("meeting", "tile").agg(F.first("tiles").alias("tiles"), F.array_sort(F.collect_list(F.struct("n", "row", "group", "earlier", "value"))).alias("rows"))
    packed = stored(dealt, tag)
    alone = packed.where("tiles = 1").select("meeting", "rows", F.lit(None).cast(packed.schema["rows"].dataType).alias("others"))
    several = packed.where("tiles > 1")
    sent = several.select("meeting", F.col("tile").alias("from"), F.col("rows").alias("others"), F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)).alias("tile"))
    pairs = several.select("meeting", "tile", "rows").join(sent, ["meeting", "tile"]).select("meeting", "rows", F.when(F.col("from") != F.col("tile"), F.col("others")).alias("others"))
    return alone.unionByName(pairs)


def met_rows(here: DataFrame, sketches: DataFrame) -> DataFrame:
    """Rows of here (meeting, row, n, group) that are in a pair of different groups which coarse sketches do not rule out, with earlier: smaller
    meetings of the row, EARLIER at most. A pair counts at its first meeting only, and rows are given, not pairs."""

    def fold():
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), binary([coarse(x) for x in b.column(1).to_pylist()])], ["row", "value"])

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
            found = {(m, x) for m, rows, others in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in touched(rows, others)}
            if not found:
                return None
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*found, strict=True)], ["meeting", "row"])

        return batch

    first = here.groupBy("row").agg(F.slice(F.array_sort(F.collect_list("meeting")), 1, EARLIER).alias("first"))
    here = stored(here.join(first, "row").select("meeting", "row", "n", "group", F.filter("first", lambda m: m < F.col("meeting")).alias("earlier")), "met")
    values = map_arrow(sketches.select("row", "sketch").join(few(here.select("row").distinct()), "row", "left_semi"), "row long, value binary", fold)
    pairs = tile_pairs(here, values, F.ceil(F.count(F.lit(1)) / TILE), "sketch_tiles")
    found = stored(map_arrow(pairs, "meeting long, row long", make), "near_rows")
    return stored(here.join(found.distinct(), ["meeting", "row"], "left_semi"), "met_rows")


def tile_links(here: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b): links of here (meeting, row, n, group, earlier) that join the same groups as all similar pairs that meet. Sets are compared in the tiles, so
    no pairs are made; a pair of tiles gives fewer links than it has rows, so a group of thousands of near copies makes no square of them."""

    def read_sets():
        memo = _memo()
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), binary([shingles(cut(t.as_py() or ""), memo).astype("<u8").tobytes() for t in b.column(1)])], ["row", "value"])

    def make():
        def batch(b: pa.RecordBatch) -> pa.RecordBatch | None:
            links = {x for here, others in zip(*(c.to_pylist() for c in b.columns), strict=True) for x in forest(here, others)}
            if not links:
                return None
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

        return batch

    values = map_arrow(rows.join(few(here.select("row").distinct()), "row", "left_semi"), "row long, value binary", read_sets)
    tiles = F.greatest(F.ceil(F.count(F.lit(1)) / SET_TILE), F.ceil(F.sum("n") / SET_HASHES))
    return map_arrow(tile_pairs(here, values, tiles, "set_tiles").select("rows", "others"), "a long, b long", make)


def near_copies(rows: DataFrame) -> DataFrame:
    """rows (row, text), where row is unique: (row, group), the smallest row of the group."""
    rows = rows.select("row", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    every = stored(read(rows), "read")
    classes = stored(every.groupBy("key").agg(F.min("row").alias("row")), "classes")
    copies = few(stored(every.select("row", "key").join(classes.withColumnRenamed("row", "least"), "key").where("row != least").select("row"), "copies"))
    own = every.join(copies, "row", "left_anti")
    sketches = own.select("row", "n", "sketch")

    def compared(pairs: DataFrame, tag: str) -> DataFrame:
        """pairs (a, b), a < b, that the sketches do not rule out, with near: whether they are similar."""
        left = stored(bounded(pairs, sketches), f"{tag}_bounded")
        wanted = few(left.select(F.explode(F.array("a", "b")).alias("row")).distinct())
        held = sets(rows.join(wanted, "row", "left_semi"))
        both = left.join(held.select(F.col("row").alias("a"), F.col("hashes").alias("x")), "a").join(held.select(F.col("row").alias("b"), F.col("hashes").alias("y")), "b")
        return stored(both.select("a", "b", _similar(F.size(F.array_intersect("x", "y")), F.col("na"), F.col("nb")).alias("near")), tag)

    spark = rows.sparkSession
    collect_garbage(spark)
    # SimHash: each fingerprint's rows with the first of them, and those of the links.
    prints = stored(own.where("n > 0").groupBy("fp").agg(F.min("row").alias("first")), "prints")
    linked = stored(simhash.links(prints.select("fp"), RADIUS), "linked_prints")
    of_links = linked.join(prints.select(F.col("fp").alias("x"), F.col("first").alias("p")), "x").join(prints.select(F.col("fp").alias("y"), F.col("first").alias("q")), "y").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    of_prints = own.where("n > 0").select("row", "fp").join(prints, "fp").where("row != first").select(F.col("first").alias("a"), F.col("row").alias("b"))
    tested = compared(of_links.unionByName(of_prints), "linked")
    collect_garbage(spark)
    met = meetings(*ordered_prefixes(rows, own.select("row", "n", "prefix")))

    for turn in range(STARS + 1):
        collect_garbage(spark)
        found = stored(components(tested.where("near").select("a", "b")), "groups")
        grouped = met.join(found.select(F.col("node").alias("row"), "component"), "row", "left").select("meeting", "row", "n", F.coalesce("component", "row").alias("group"))
        apart = grouped.groupBy("meeting").agg(F.min("group").alias("g"), F.max("group").alias("h")).where("g != h").select("meeting")
        here = stored(grouped.join(apart, "meeting", "left_semi"), "apart")
        if here.isEmpty():
            break
        if turn < STARS:
            pick = F.min(F.struct(F.xxhash64("row", F.lit(turn)).alias("k"), F.col("row").alias("p"), F.col("n").alias("pn"), F.col("group").alias("pg"))).alias("s")
            one = here.groupBy("meeting").agg(pick).select("meeting", "s.p", "s.pn", "s.pg")
            pairs = here.join(one, "meeting").where((F.col("group") != F.col("pg")) & (UNDER * F.least("n", "pn") >= OVER * F.greatest("n", "pn")))
            pairs = pairs.select(F.least("row", "p").alias("a"), F.greatest("row", "p").alias("b")).distinct()
            tested = tested.unionByName(compared(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "compared"))
        else:
            links = stored(tile_links(met_rows(here, sketches), rows), "tile_links")
            tested = tested.unionByName(links.select("a", "b", F.lit(True).alias("near")))
    else:
        found = stored(components(tested.where("near").select("a", "b")), "groups")
    named = classes.join(found.select(F.col("node").alias("row"), "component"), "row", "left").select("key", F.coalesce("component", "row").alias("group"))
    return every.select("row", "key").join(named, "key").select("row", "group")
