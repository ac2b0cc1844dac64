import random

import corpus_pipeline
from tracelake.llm import near_copies


def sentence(seed, n=60):
    return " ".join(f"w{x}" for x in random.Random(seed).choices(range(5000), k=n))


def test_the_stage_keeps_one_row_of_each_group_by_row(spark, docs):
    rows = [(None, sentence(1)), (None, sentence(2)), (None, sentence(2)), (3, sentence(3)), (5, "zzz " + sentence(4)), (5, sentence(3)), (5, sentence(5)), (None, sentence(3))]
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs(rows), "").collect())
    assert kept == sorted([(0, sentence(1)), (0, sentence(2)), (3, sentence(3)), (5, "zzz " + sentence(4)), (5, sentence(5))])


def plain_groups(rows):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets = [shingles(t or "") for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        before = list(group)
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    return {rows[k][0]: rows[g][0] for k, g in enumerate(group)}


def corpus():
    rng = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(30))
    texts = [None, "", " ", "x", "X", "a b", "a b c d", "a b c d e", "a b c d e f"]
    for k in range(25):
        words = sentence(100 + k, rng.randint(20, 250)).split()
        for _ in range(rng.randint(1, 5)):  # copies of copies, by which chains arise
            words = list(words)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = f"c{rng.random()}"
            texts.append(" ".join(words) + (f" {passage}" if rng.random() < 0.4 else ""))
    words = sentence(7, 150).split()
    texts += [" ".join([*words[:k], "new", str(k), *words[k:]]) for k in range(0, 150, 3)]
    return list(enumerate(texts))


def test_near_copies_equal_brute_force(spark):
    rows = corpus()
    got = near_copies.near_copies(spark.createDataFrame(rows, "row long, text string")).collect()
    assert {r["row"]: r["group"] for r in got} == plain_groups(rows)


def test_pairs_that_stars_leave_are_compared(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "STARS", 0)
    test_near_copies_equal_brute_force(spark)


def test_small_tiles_and_few_known_meetings_lose_nothing(spark, monkeypatch):
    for name, value in (("STARS", 0), ("RADIUS", 0), ("TILE", 8), ("SET_TILE", 4), ("EARLIER", 2)):
        monkeypatch.setattr(near_copies, name, value)
    test_near_copies_equal_brute_force(spark)


def test_a_group_of_near_copies_makes_no_square_of_rows(spark, monkeypatch):
    made = {}
    write = near_copies.stored

    def counted(df, tag):
        out = write(df, tag)
        made[tag] = max(made.get(tag, 0), out.count())
        return out

    for name, value in (("STARS", 0), ("RADIUS", 0), ("stored", counted)):
        monkeypatch.setattr(near_copies, name, value)
    words = sentence(21, 150).split()
    rows = [(k, " ".join([*words[:k], f"new{k}", *words[k + 1 :]])) for k in range(5, 145)]
    got = near_copies.near_copies(spark.createDataFrame(rows, "row long, text string")).collect()
    assert {r["group"] for r in got} == {5}
    # Prefixes have at most 31 hashes; all pairs would be 9,730.
    assert max(made.values()) <= 31 * len(rows)


def test_the_stage_finds_copies_beyond_the_radius_of_simhash(spark, docs):
    from tracelake.llm import simhash

    words = sentence(12, 100).split()
    far = [w if k not in (20, 70) else "other" for k, w in enumerate(words)]
    one, two = " ".join(words), " ".join(far)
    assert (simhash.fingerprint(one) ^ simhash.fingerprint(two)).bit_count() > simhash.RADIUS
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs([(1, one), (2, two)]), "").collect()] == [1]


def test_stages_carry_columns_of_any_name(spark):
    rows = [(k, sentence(k) if k else sentence(1), 1, f"x{k}", k) for k in range(3)]
    named = spark.createDataFrame(rows, "doc_id long, text string, _first int, `a.b` string, row long")
    got = corpus_pipeline.near_duplicates(spark, named, "")
    assert got.columns == named.columns
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], rows[2]]
    assert corpus_pipeline.quality(spark, named, "/root/testdata/sf0.001").columns == named.columns


def test_records_of_one_id_are_cut_into_shards(spark, docs, vocab):
    from tracelake.llm import record_files
    from tracelake.llm.common import scratch

    path = scratch(spark, "records")
    record_files.write_records(docs([(7, "the same text")] * 600), vocab, path, rows_per_shard=100)
    sizes = [r["n"] for r in record_files.build_index(spark, path, f"{path}-index").groupBy("shard").count().withColumnRenamed("count", "n").collect()]
    assert sum(sizes) == 600 and max(sizes) < 300
