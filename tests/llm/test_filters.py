import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import language_crf, license_scan, quality_rules, url_filter

from .conftest import LONG, MESSY

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\x0b\x0c\r\x1c\x85é#|<漢", max_size=80))
def test_base_counts(text):
    assert quality_rules.base_counts(text) == plain_counts(text)


def test_base_counts_of_long_texts():
    assert quality_rules.base_counts(LONG) == plain_counts(LONG)


@pytest.fixture(scope="module")
def labelled(spark, docs):
    rng = random.Random(3)
    good, bad = ("alpha beta gamma delta house tree water light".split(), "%%% $$$ win!! cash### free** now&& click|| buy<<".split())
    rows, marks = [], []
    for k in range(240):
        rows.append((k, " ".join(rng.choices(good if k % 2 else bad, k=rng.randint(12, 60)))))
        marks.append((k, k % 2, 0, "clash"))
    marks += [(1, 0, 0, "x"), (None, 1, 0, "x"), (3, None, 1, "x"), (4, 7, 0, "x")]
    return docs(rows + MESSY[:4]), spark.createDataFrame(marks, "doc_id long, quality int, toxic int, text string"), rows


def test_quality_rules(labelled, spark):
    docs, labels, rows = labelled
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, labels, limit=100).where("doc_id >= 4").collect()}
    fresh = [r for r in got.values() if r["doc_id"] < 240]
    assert sum((r["p_good"] >= 0.5) == bool(r["doc_id"] % 2) for r in fresh) > 0.97 * len(fresh)
    for r in fresh:
        counts = plain_counts(dict(rows)[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
        assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert r["kept"] == (not r["base_failed"] and r["p_good"] >= 0.5)
    low = np.mean([r["p_good"] for r in fresh if not r["doc_id"] % 2])
    assert low < 0.2


def test_quality_without_labels(messy, none, labelled):
    _, labels, _ = labelled
    rows = quality_rules.quality_rules(messy, labels.limit(0)).collect()
    assert len(rows) == len(MESSY) and all(r["p_good"] > 0.99 for r in rows)
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 9))
    assert quality_rules.quality_rules(none, labels).collect() == []


def test_spans_hash_alike_wherever_they_stand():
    from tracelake.llm.hashing import spans

    data = np.frombuffer(b"word other word  x word", dtype=np.uint8)
    h = spans(data, np.array([0, 5, 11, 19]), np.array([4, 10, 15, 23]))
    assert h[0] == h[2] == h[3] != h[1]


VOICES = {"en": "the house and their water think throughout nothing".split(), "de": "das schöne haus und zwischen nichts geschichte straße".split(), "fr": "la maison et leur après déjà toujours lumière".split()}


def voice(rng, lang, n):
    return " ".join(rng.choices(VOICES[lang], k=n))


@pytest.fixture(scope="module")
def tongues(docs):
    rng = random.Random(5)
    return docs([(k, voice(rng, lang, rng.randint(5, 80)), lang) for k in range(240) for lang in [rng.choice(list(VOICES))]] + [(500, "plenty of text", None)])


def test_language_on_held_out(tongues):
    rows = language_crf.identify(tongues).join(tongues.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert len(held) > 30 and sum(r["lang_pred"] == r["lang"] for r in held) > 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in VOICES for r in rows)


def brute_marginals(e, a):
    """By summing over all paths."""
    from itertools import product

    n, k = e.shape
    out = np.zeros((n, k))
    for path in product(range(k), repeat=n):
        w = e[0, path[0]] * a[:, path[0]].mean()
        for t in range(1, n):
            w *= a[path[t - 1], path[t]] * e[t, path[t]]
        for t in range(n):
            out[t, path[t]] += w
    return out / out.sum(1, keepdims=True)


def recursive_marginals(e, a):
    n, k = e.shape
    left, now = np.zeros((n, k)), np.full(k, 1 / k)
    for t in range(n):
        now = (now @ a) * e[t]
        now /= now.sum()
        left[t] = now
    out, now = np.zeros((n, k)), np.ones(k)
    for t in range(n - 1, -1, -1):
        out[t] = left[t] * now / (left[t] * now).sum()
        now = a @ (e[t] * now)
        now /= now.sum()
    return out


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    model = language_crf.Crf(["x", "y", "z"], np.zeros((1 << language_crf.BITS, 3), dtype=np.float32), rng.normal(size=(3, 3)))
    label = language_crf.Labeller(model)
    label.e = rng.uniform(0.05, 1, size=(400, 3)).astype(np.float32)
    texts = [np.arange(n, dtype=np.int32) for n in (0, 1, 6, 63, 64, 65, 128, 397)]
    got = label.marginals(texts)
    for ids, g in zip(texts, got, strict=True):
        assert g.shape == (len(ids), 3)
        if len(ids):
            assert np.abs(recursive_marginals(label.e[ids].astype(float), label.a.astype(float)) - g).max() < 1e-4
    assert np.abs(brute_marginals(label.e[:6].astype(float), label.a.astype(float)) - got[2]).max() < 1e-4


def test_code_switching():
    rng = random.Random(9)
    model = language_crf.fit([(lang, voice(rng, lang, 20).encode().split()) for _ in range(60) for lang in VOICES])
    assert all(model.transitions[k, k] > model.transitions[k].sum() - model.transitions[k, k] for k in range(3))
    words = f"{voice(rng, 'de', 15)} {voice(rng, 'fr', 15)}"
    label = language_crf.Labeller(model)
    g = label.marginals(label._look_up([words]))[0]
    named = [model.languages[k] for k in g.argmax(1)]
    assert named == ["de"] * 15 + ["fr"] * 15


def test_numerals_are_no_letters(docs):
    model = language_crf.fit([("de", [b"der", b"und"]), ("en", [b"the", b"and"])])
    got = {r["doc_id"]: r["lang_pred"] for r in language_crf.identify(docs([(1, "½ ²"), (2, "Ⅷ ①"), (3, "12"), (4, "漢")]), model).collect()}
    assert [got[k] for k in (1, 2, 3)] == ["und"] * 3 and got[4] != "und"


def test_language_of_messy_tables(messy, none, docs):
    rows = language_crf.identify(messy).collect()
    by = Counter(r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3))
    assert by == Counter({"und": 3}) and len(rows) == len(MESSY)
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    assert language_crf.identify(none).collect() == []
    digits = docs([(1, "12 345 --- ...", "en"), (3, "words here", "en")])
    assert {r["doc_id"]: r["lang_pred"] for r in language_crf.identify(digits).collect()}[1] == "und"


URLS = [
    (0, None), (1, ""), (2, "no scheme/x"), (3, "http://A.Example.ORG/es/12"), (4, "https://example.org/en/1x"), (5, "http://sub.org"), (6, "http://sub.org/"),
    (7, "http://x.com/fr/1?u=://y"), (8, "http://com/de/2#f"), (9, "http://notcom/de/2"), (10, "http://x.net/a/b/c/d/e/7.html"), (10, "http://x.net/a/b/c/d/e/7.html"),
    (None, "http://x.net/q"), (11, "http://example.org?/es/"), (12, "ftp://user@h:80/p;x"), (13, "://"), (14, "http:///de/1"), (15, "http://x.com/de"), (16, "http://x.net/" + "s" * 5000),
]


def pages_table(spark, rows):
    return spark.createDataFrame([(i, u, "h", "clash", True) for i, u in rows], "page_id long, url string, html string, host string, rejected boolean")


def labels_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split(r"[?#]", rest[len(host) :])[0]


def test_rules(spark):
    got = url_filter.judge(pages_table(spark, URLS), labels_table(spark, [])).collect()
    assert Counter((r["page_id"], r["host"], r["path"]) for r in got) == Counter((i, *plain_url(u)) for i, u in URLS)
    rules = {r["page_id"]: (r["rule"], r["verdict"]) for r in got}
    assert rules[3] == ("example.org/es/", "block") and rules[4] == ("example.org/en/1", "block") and rules[5] == (None, "allow") and rules[6] == ("org/", "allow")
    assert rules[7] == ("com/fr/", "allow") and rules[8] == ("com/de/", "block") and rules[9] == (None, "allow") and rules[15] == (None, "allow")
    assert url_filter.judge(pages_table(spark, []), labels_table(spark, [])).collect() == []


def test_templates_are_rejected_by_purity(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(600):
        kind = ("spam", "news", "blog")[k % 3]
        rows.append((k, f"http://h.net/{kind}/{'tag' + rng.choice('abcdefghijklmnopqrstuvwxyz') * 2 if kind == 'blog' else 'x'}/{k}.html"))
        labels.append((k, int(kind != "spam"), 0))
    rows += [(k, f"http://h.net/blog/tag{chr(97 + k % 26) * 2}/{k}") for k in range(600, 700)]
    pages, marks = pages_table(spark, rows), labels_table(spark, labels[:300] + [(None, 0, 0), (5, None, None), (7, None, 1)])
    got = url_filter.judge(pages, marks).collect()
    assert {r["verdict"] for r in got if "/spam/" in r["path"]} == {"block"}
    assert {r["verdict"] for r in got if "/spam/" not in r["path"]} == {"allow"}
    assert {r["template"].split("/")[1] for r in got if "/blog/" in r["path"]} <= {"*", "~"}
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    con.register("labels", marks.toPandas().astype({"doc_id": "Int64", "quality": "Int32", "toxic": "Int32"}))
    want = con.sql(url_filter.sql()).fetchall()
    assert Counter(want) == Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["template"]) for r in got)


def plain_license(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        own = phrase.split()
        at = [k for k in range(len(words)) if words[k : k + len(own)] == own]
        places += at
        labels |= {label} if at else set()
    score, more = 0.0, set()
    for line in low.split("\n"):
        own = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
        for label, t in license_scan.TEMPLATES:
            want = license_scan.template_words(t)
            shared = len(own & set(want))
            if shared >= license_scan.needed(len(want)):
                more.add(label)
                score = max(score, shared / len(want))
    for paragraph in re.split(r"\n[ \t\x0b\x0c\r]*\n", low):
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", paragraph)
        own = set(zip(own, own[1:]))
        for label, t in license_scan.TEMPLATES:
            w = re.findall(r"[a-z0-9]+", t.lower())
            want = set(zip(w, w[1:]))
            shared = len(own & want)
            if shared >= license_scan.needed(len(want)):
                more.add(label)
                score = max(score, shared / len(want))
    first = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), *first, ",".join(sorted(labels)), ",".join(sorted(labels | more)), round(score, 9)


NOTICES = [
    (20, "x\nLicensed under the Apache License, Version 2.0.\ny"), (21, "released UNDER the mit-license"), (22, "CC BY CC-by cc  by"), (23, "all rights reserved. All Rights   Reserved"),
    (24, "General Public License General public, license"), (25, "worK is licensed under the GNU General Public License, version 3"), (26, " cc by"), (27, "ccby cc byx"),
    (28, "under the version\nlicensed apache license 2"), (29, LONG + "\nReleased under the MIT License. " * 50), (30, "élicense under mit the released"), (31, "version 3 license public general gnu the under licensed is work this"),
]


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
WRAPPED = [
    (40, f"Copyright (c) 2001 A. Person\n\n{MIT}\n"), (41, "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n */"),
    (42, "# Licensed under the Apache\n# License, Version\n# 2.0"), (43, "Permission is hereby granted, free of charge, to any\n\nperson obtaining a copy of this software and associated documentation files"),
]


def test_notices_wrapped_over_lines(docs):
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in license_scan.scan(docs(WRAPPED)).collect()}
    assert [got[k][0] for k in (40, 41, 42)] == ["mit-grant", "bsd", "apache-2.0"]
    assert got == {i: plain_license(t)[-2:] for i, t in WRAPPED}


def test_licenses(docs, none):
    rows = MESSY + NOTICES
    got = license_scan.scan(docs(rows)).collect()
    found = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], round(r["score"], 9)) for r in got)
    assert found == Counter((i, *plain_license(t)) for i, t in rows)
    assert license_scan.scan(none).collect() == []


def test_license_plan_is_native(spark, docs):
    plan = license_scan.scan(docs(NOTICES))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_similarity_join_with_other_thresholds(spark, docs):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(12)]
    templates = [(f"t{k}", " ".join(rng.sample(vocabulary, rng.randint(1, 8)))) for k in range(6)]
    blocks = [(k, 0, sorted(rng.sample(vocabulary, rng.randint(1, 12)))) for k in range(150)]
    df = spark.createDataFrame(blocks, "row long, block int, tokens array<string>")
    for threshold in (0.3, 0.5, 0.8, 1.0):
        order = rng.sample(vocabulary, len(vocabulary))
        got = {(r["row"], r["label"]) for r in license_scan.similar_blocks(df, templates, order, threshold).collect()}
        want = {(i, label) for i, _, t in blocks for label, text in templates for own in [license_scan.template_words(text)] if len(set(own) & set(t)) >= license_scan.needed(len(own), threshold)}
        assert got == want
