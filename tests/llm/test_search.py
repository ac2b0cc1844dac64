import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tracelake.llm import components, simhash, topk

from .conftest import MESSY


def plain_fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[k : k + 3]) for k in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    group = list(range(len(fps)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 3:
                group[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(fps):
        least[root(k)].append(i)
    name = {k: min((i for i in ids if i is not None), default=None) for k, ids in least.items()}
    return Counter((i, f"{fp:016x}", name[root(k)]) for k, (i, fp) in enumerate(fps))


def corpus():
    rng = random.Random(11)
    vocabulary = [f"v{k}" for k in range(400)]
    rows = list(MESSY)
    for k in range(60):
        words = rng.choices(vocabulary, k=rng.randint(20, 300))
        rows.append((100 + 10 * k, " ".join(words)))
        for j in range(rng.randint(0, 4)):  # near copies
            changed = list(words)
            for _ in range(rng.randint(0, 2)):
                changed[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((101 + 10 * k + j, " ".join(changed)))
    return rows


def test_simhash_equals_brute_force(docs, none):
    rows = corpus()
    got = simhash.near_duplicates(docs(rows), tile=8).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == plain_groups(rows)
    assert any(n > 1 for n in Counter(r["component_id"] for r in got if r["doc_id"] and r["doc_id"] >= 100).values())
    assert simhash.near_duplicates(none).collect() == []


@pytest.mark.parametrize("tile", [16, 4096])
def test_links_join_all_within_the_radius(spark, tile):
    rng = random.Random(tile)
    fps = set()
    for _ in range(150):
        fp = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            fps.add(fp)
            for _ in range(rng.randint(0, 4)):
                fp ^= 1 << rng.randrange(64)
    fps |= {0, (1 << 64) - 1, 7, (1 << 64) - 8, 1 << 63}
    fps = sorted(fps)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.links(df, tile=tile).collect()
    near = {(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3}
    place = {s: k for k, s in enumerate(signed)}
    got = {(max(p), min(p)) for r in links for p in [(place[r["x"]], place[r["y"]])]}
    assert got <= near

    def groups(pairs):
        g = list(range(len(fps)))
        for _ in range(len(fps)):
            before = list(g)
            for a, b in pairs:
                g[a] = g[b] = min(g[a], g[b])
            if g == before:
                return g

    assert groups(got) == groups(near)


def test_a_large_group_makes_few_links(spark):
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)})
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    assert simhash.links(df).count() < 70 * len(fps)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5200)] + [(7, 7), (None, 3), (3, None)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    g = {}
    for a, b in pairs:
        if a is not None and b is not None and a != b:
            g.setdefault(a, a)
            g.setdefault(b, b)
    for _ in range(len(g)):
        before = dict(g)
        for a, b in pairs:
            if a in g and b in g and a != b:
                g[a] = g[b] = min(g[a], g[b])
        if g == before:
            break
    assert got == g
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_top(rows, k=20):
    whole = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for q, x in whole:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in whole if i != q and len(x) == len(y))
            out.update((q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1))
    return out


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    return [(k, [float(x) for x in np.round(rng.normal(size=dim), 1)]) for k in range(n)]


@pytest.mark.parametrize("shard", [7, 8192])
def test_top_k_equals_brute_force(spark, shard):
    rows = vectors(130, 4, shard)
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (40, [2.0] * 4), (3, [0.5] * 4), (300, [1.0, 2.0]), (301, [1.0, 1.0]), (320, [])]
    df = spark.createDataFrame([(i, v, 1, "x", 2.0) for i, v in rows], "vec_id long, embedding array<float>, label int, part string, score double")
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = topk.top_k(df, shard_rows=shard, block_rows=3).collect()
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == plain_top(single)


def test_top_k_of_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).collect() == []
    assert topk.top_k(spark.createDataFrame([(20, [1.0])], schema)).collect() == []
    two = topk.top_k(spark.createDataFrame([(20, [1.0]), (21, [1.0])], schema)).collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in two] == [(20, 21, 4096)]


def test_large_numbers_stay_exact():
    q, c = np.array([[2.0**31 - 1, 1.0]]), np.array([[2.0**31 - 1, 1.0], [2.0**31 - 2, 3.0]])
    assert topk.scores(q, c).tolist() == [[(2**31 - 1) ** 2 + 1, (2**31 - 1) * (2**31 - 2) + 3]]


def test_queries_are_registered():
    names = entry.queries()
    assert [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")][9].startswith("op10_") and "pipeline" in names
    assert {"op6_url_filter", "op7_exact_topk", "op10_license_scan"} <= set(entry.oracle_sql())


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = docs.limit(20).withColumn("doc_id", F.col("doc_id") + 1_000_000).union(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    now = docs.union(extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, now = now, stage(spark, now, sf)
        assert now.columns == docs.columns
        path = str(tmp_path / name)
        now.write.parquet(path)
        now = spark.read.parquet(path)
        assert now.count() < before.count() or name == "language_id"
    packed = corpus_pipeline.STAGES[-1][1](spark, now, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in now.collect()}
    assert not any(r["doc_id"] >= 1_000_000 for r in packed)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = corpus_pipeline.quality(spark, docs, sf).select("doc_id").collect()
    assert sum(labels.get(r["doc_id"]) == 0 for r in kept) <= 0.1 * sum(q == 0 for q in labels.values())


def test_pipeline_of_nothing(spark, none):
    now = none
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "/root/testdata/sf0.001")
        assert now.collect() == []
    assert corpus_pipeline.pack(spark, now, "").collect() == []
