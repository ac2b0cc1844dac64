"""License scans: phrases, and text blocks that hold license templates, by an exact set-similarity join. DataFrame functions only.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased. Base labels come from phrases whose words stand
one behind the other. The method adds labels of templates. A block has a template's label if it holds at least the share
THRESHOLD of the template's tokens. Blocks are of two kinds: a line, whose tokens are its words; and a paragraph (what stands
between blank lines), whose tokens are pairs of words that stand side by side, over the ends of lines too, so that a notice
wrapped over lines is found wherever it is broken, and words that only happen to stand in neighbouring lines are none.

The join is exact and never compares all blocks with all templates. Template tokens are ordered by how often they stand in all
documents, rarest first. A block that holds c of a template's m tokens holds one of its m - c + 1 rarest (its prefix), and has c
template tokens at least (length filter); where the first shared one stands at place i of the template and j of the block's own
in that order, 1 + min(m - i - 1, n - j - 1) must reach c (positional filter). Pairs that pass are counted in full.
Templates are a parameter of fixed size: their words and prefixes go with the plan. No block is dropped for its frequency.

Defined cases: a null text is an empty one: no words, no places, no labels, score 0; phrases overlap freely; texts are scanned
whole, however long; equally frequent tokens are ordered by name; each row gives a
row, repeated or without doc_id or not; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import documents, stored

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that public licenses are given by, and their labels.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-international", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.8

#: What stands between words, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between paragraphs: a blank line.
PARAGRAPHS = r"\n[ \t\x0B\f\r]*\n"
#: The one character beyond ASCII that lower() would turn into an ASCII letter; any other that is none keeps words the same.
KELVIN = "K"


def _words(text: str) -> list[str]:
    """A template's words, in order."""
    out, word = [], ""
    for c in text + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or c > "\x7f":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def template_words(text: str) -> list[str]:
    """A template's distinct words, in order."""
    return list(dict.fromkeys(_words(text)))


def template_pairs(text: str) -> list[str]:
    """A template's distinct pairs of words side by side, in order."""
    own = _words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(own, own[1:], strict=False)))


def token_sets(templates: list[tuple[str, str]]) -> list[tuple[str, list[str]]]:
    """(label, tokens): the words of each template, and its pairs."""
    return [(label, own) for make in (template_words, template_pairs) for label, t in templates if (own := make(t))]


def words(text: F.Column) -> F.Column:
    """All words; the array may begin and end with an empty one."""
    return F.split(F.lower(F.replace(text, F.lit(KELVIN), F.lit("�"))), SEPARATORS, -1)


def pairs(w: F.Column) -> F.Column:
    """Words side by side; a pair with an empty word at either end of the array is no template's."""
    return F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))


def _literal(values: list[str]) -> F.Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _rows(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A table of literals."""
    cell = lambda x: _literal(x) if isinstance(x, list) else F.lit(x)
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[cell(x).alias(n) for n, x in zip(names, r, strict=True)]) for r in rows])))


def token_frequencies(rows: DataFrame, tokens: list[str]) -> dict[str, int]:
    """How often each token stands in all texts; one row a token goes to the driver."""
    single, double = [t for t in tokens if " " not in t], [t for t in tokens if " " in t]
    w = words(F.col("text"))
    held = rows.select(F.filter(w, lambda x: x.isin(single)).alias("one"), F.when(F.arrays_overlap(w, _literal(single)), F.filter(pairs(w), lambda x: x.isin(double))).alias("two"))
    found = held.select(F.explode(F.concat("one", F.coalesce("two", F.array().cast("array<string>")))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    return dict.fromkeys(tokens, 0) | {r["w"]: r["n"] for r in found}


def needed(m: int, threshold: float = THRESHOLD) -> int:
    """The words that a block must share with a template of m words."""
    return max(1, ceil(round(threshold * m, 9)))


def similar_blocks(blocks: DataFrame, templates: list[tuple[str, str]], order: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """blocks (row, block, tokens: the block's distinct template words) joined with templates: row, block, label, containment; a pair may stand more than once."""
    return similar_sets(blocks, [(label, template_words(t)) for label, t in templates], order, threshold)


def similar_sets(blocks: DataFrame, sets: list[tuple[str, list[str]]], order: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The same for (label, tokens)."""
    spark = blocks.sparkSession
    rank = {w: k for k, w in enumerate(order)}
    prefixes, whole = [], []
    for k, (label, tokens) in enumerate(sets):
        own = sorted(tokens, key=rank.__getitem__)
        c = needed(len(own), threshold)
        prefixes += [(w, k, i, len(own), c) for i, w in enumerate(own[: len(own) - c + 1])]
        whole.append((k, label, own, c))
    index = F.broadcast(_rows(spark, ["w", "k", "i", "m", "c"], prefixes))
    table = F.broadcast(_rows(spark, ["k", "label", "own", "c"], whole))
    position = F.create_map(*[x for w, k in rank.items() for x in (F.lit(w), F.lit(k))])
    ranked = blocks.withColumn("sorted", F.array_sort(F.transform("tokens", lambda w: F.struct(position[w].alias("r"), w.alias("w")))))
    probes = ranked.select("row", "block", "sorted", F.size("sorted").alias("n"), F.posexplode("sorted").alias("j", "s")).withColumn("w", F.col("s.w"))
    met = probes.join(index, "w").where((F.col("n") >= F.col("c")) & (1 + F.least(F.col("m") - F.col("i") - 1, F.col("n") - F.col("j") - 1) >= F.col("c")))
    # A block may meet a template at several of its prefix words; it is then counted as often, and stands as often in the result.
    met_pairs = met.select("row", "block", "k", F.transform("sorted", lambda s: s["w"]).alias("tokens"))
    shared = F.size(F.array_intersect("tokens", "own"))
    return met_pairs.join(table, "k").where(shared >= F.col("c")).select("row", "block", "label", (shared / F.size("own")).alias("containment"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every document."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    rows = documents(docs)
    sets = token_sets(templates)
    tokens = sorted({w for _, own in sets for w in own})
    often = token_frequencies(rows, tokens)
    order = sorted(tokens, key=lambda w: (often[w], w))
    rank = {w: k for k, w in enumerate(order)}
    prefix = sorted({w for _, unordered in sets for own in [sorted(unordered, key=rank.__getitem__)] for w in own[: len(own) - needed(len(own), threshold) + 1]})
    single, double = ([t for t in tokens if (" " in t) == two] for two in (False, True))

    split = rows.withColumn("w", words(F.col("text")))
    size = F.size("w") - (F.element_at("w", 1) == "").cast("int") - ((F.size("w") > 1) & (F.element_at("w", -1) == "")).cast("int")
    # Where the array begins with an empty word, places move by one.
    shift = (F.element_at("w", 1) == "").cast("int")

    def places(phrase: str) -> F.Column:
        own = phrase.split()
        here = lambda i: F.get("w", i) == own[0]
        every = F.sequence(F.lit(0), F.size("w") - 1)

        def starts(i):
            fits = here(i)
            for k, x in enumerate(own[1:], 1):
                fits = fits & (F.get("w", i + k) == x)
            return F.coalesce(fits, F.lit(False))

        return F.when(F.array_contains("w", own[-1]) & F.array_contains("w", own[0]), F.transform(F.filter(every, starts), lambda i: i - shift)).otherwise(F.array().cast("array<int>"))

    lines = F.transform(F.split("text", "\n", -1), lambda x: F.array_intersect(words(x), _literal(single)))
    paragraphs = F.transform(F.split("text", PARAGRAPHS, -1), lambda x: F.array_intersect(pairs(words(x)), _literal(double)))
    blocks = F.filter(F.concat(lines, paragraphs), lambda t: F.arrays_overlap(t, _literal(prefix)))
    kept = split.select(
        "doc_id",
        size.cast("long").alias("n_words"),
        F.array(*[places(p) for p in phrases]).alias("places"),
        # A pair of a template is there only where its first word is.
        F.when(F.arrays_overlap("w", _literal(sorted({t.split()[0] for t in prefix}))), blocks).alias("blocks"),
    )
    table = stored(kept.withColumn("row", F.monotonically_increasing_id()), "scanned")
    blocks = table.where("blocks is not null").select("row", F.posexplode("blocks").alias("block", "tokens"))
    found = similar_sets(blocks, sets, order, threshold).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    base = F.filter(F.array(*[F.when(F.size(F.col("places")[k]) > 0, label) for k, label in enumerate(phrases.values())]), lambda x: x.isNotNull())
    every = F.flatten("places")
    return (
        table.join(found, "row", "left")
        .select("doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(base)).alias("b"), "more", "containment")
        .select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("b", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("b", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"), F.coalesce("containment", F.lit(0.0)).alias("score"))
    )


def sql() -> str:
    """The same over the table documents in ANSI SQL, comparing every line and paragraph with every template."""
    sep = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    cut = lambda x: f"list_filter(string_split_regex({x}, '{sep}'), lambda s: s <> '')"
    place = []
    for p in PHRASES:
        own = p.split()
        fits = " and ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(own))
        place.append(f"list_filter(range(1, len(w) + 1), lambda i: coalesce({fits}, false))")
    values = ", ".join(f"('{label}', {own!r}, {needed(len(own))})" for label, own in token_sets(TEMPLATES))
    base = "list_filter([" + ", ".join(f"case when len(p{k}) > 0 then '{label}' end" for k, label in enumerate(PHRASES.values())) + "], lambda x: x is not null)"
    every = "list_concat(" + ", ".join(f"p{k}" for k in range(len(PHRASES))) + ")"
    return f"""with texts as (select row_number() over () as r, doc_id, {lower("coalesce(text, '')")} as t from documents),
words as (select r, doc_id, t, {cut("t")} as w from texts),
placed as (select r, doc_id, len(w) as n_words, {", ".join(f"{x} as p{k}" for k, x in enumerate(place))} from words),
based as (select r, doc_id, n_words, {every} as every, list_sort(list_distinct({base})) as b from placed),
templates(label, own, c) as (values {values}),
lines as (select r, {cut("line")} as w from (select r, unnest(string_split(t, chr(10))) as line from texts) where line <> ''),
paragraphs as (select r, {cut("paragraph")} as p from (select r, unnest(string_split_regex(t, '{PARAGRAPHS}')) as paragraph from texts) where paragraph <> ''),
blocks as (select r, w from lines union all select r, list_transform(range(1, len(p)), lambda i: concat(p[i], ' ', p[i + 1])) from paragraphs),
held as (select r, label, len(list_intersect(list_distinct(w), own)) as shared, len(own) as m, c from blocks, templates where list_has_any(w, own)),
found as (select r, list(distinct label) as more, max(shared / m) as containment from held where shared >= c group by r)
select doc_id, n_words, len(every) as n_base, list_min(every) - 1 as first_word, list_max(every) - 1 as last_word, array_to_string(b, ',') as base_labels,
array_to_string(list_sort(list_distinct(list_concat(b, coalesce(more, [])))), ',') as labels, cast(coalesce(containment, 0.0) as double) as score
from based left join found using (r)"""
