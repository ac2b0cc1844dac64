"""URL filters: fixed rules first, then a tree of path templates per host, rejected by smoothed labelled purity.

1. A url's host and path are cut out; a rule (host, path prefix) fits its host and all subdomains of it if the path starts with
   its prefix; the longest rule wins.
2. The tree: a path's segments that hold a digit, or are longer than LONG, become `*`. Urls are then summed by host and
   template, which is all that the tree is built from. Level by level, down to the longest path's last, a segment becomes `*`
   where more than VARIETY different ones stand under one parent.
3. Merging: level by level again, branches that differ in one segment are pooled; a branch whose share of bad labels does not differ
   from its pool's by more than Z standard errors joins the pool (`~`).
4. A template's purity is its labelled pages' share of bad ones, drawn towards the share of all labelled pages with the weight
   of PRIOR pages. A template is rejected if that reaches REJECT. Other pages are allowed.

A page's label is that of the document whose id is the last all-digit segment (or file name) of its path; a document is bad if a
label says quality 0 or toxic 1.

All of it is joins and aggregations. A hot host's pages are pre-summed by template in the map tasks; the joins back to pages
are by (host, template) and can be split by Spark where a template is hot. Two rows go to the driver: the number of levels and the
overall share. A level works on the templates that reach it only, and its result is stored every few levels.

sql() is the same for paths of up to DEPTH segments; deeper ones it cuts at DEPTH, which judge() does not.

Defined cases: a null url, or one without ://, has empty host and path, no rule and verdict allow; null labels are no labels;
pages are counted and judged each, urls of any length whole; of equally long rules the one with the longer host wins; a null page_id stays null; empty tables give no rows or no rejections; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import stored

#: (host, path prefix, verdict)
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Segments that sql() tells apart.
DEPTH = 6
#: Levels after which lineage is cut.
LEVELS = 3
LONG = 24
VARIETY = 20
Z = 1.96
PRIOR = 8.0
REJECT = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def located(pages: DataFrame) -> DataFrame:
    """(page_id, host, path)."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, PARTS, 2).alias("path"))


def with_rule(rows: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rows with rule and ruled, the verdict of the longest rule that fits; null where none does."""
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, prefix, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(prefix)
        rule, ruled = F.when(fits, host + prefix).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return rows.withColumns({"rule": rule, "ruled": ruled})


def template() -> F.Column:
    """The path's first template: an array of segments."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike("[0-9]") | (F.length(s) > LONG), "*").otherwise(s))


def _masked(level: int) -> F.Column:
    """The template with a level's segment left out."""
    return F.transform("t", lambda s, i: F.when(i == level, F.lit("")).otherwise(s))


def _replaced(level: int, by: str, condition: F.Column) -> F.Column:
    return F.when(condition, F.transform("t", lambda s, i: F.when(i == level, F.lit(by)).otherwise(s))).otherwise(F.col("t"))


def _summed(tree: DataFrame) -> DataFrame:
    return tree.groupBy("host", "t").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))


def _each_level(shapes: DataFrame, depth: int, step) -> DataFrame:
    """step(rows, level) for each level, over the shapes that have it; the others stay."""
    for level in range(depth):
        if level and level % LEVELS == 0:
            shapes = stored(shapes, "levels")
        shapes = shapes.where(F.size("t") <= level).select("host", "first", "t", "labelled", "bad").unionByName(step(shapes.where(F.size("t") > level), level).select("host", "first", "t", "labelled", "bad"))
    return shapes


def generalised(shapes: DataFrame, depth: int, variety: int = VARIETY) -> DataFrame:
    """shapes (host, first, t, labelled, bad): t with segments of great variety as `*`."""

    def step(shapes: DataFrame, level: int) -> DataFrame:
        literal = (F.size("t") > level) & (F.get("t", F.lit(level)) != "*")
        keyed = shapes.withColumn("_parent", F.slice("t", 1, level)).withColumn("_own", F.when(literal, F.get("t", F.lit(level))))
        kinds = keyed.where("_own is not null").select("host", "_parent", "_own").distinct().groupBy("host", "_parent").agg(F.count(F.lit(1)).alias("_kinds"))
        return keyed.join(kinds, ["host", "_parent"], "left").withColumn("t", _replaced(level, "*", F.col("_own").isNotNull() & (F.col("_kinds") > variety))).drop("_parent", "_own", "_kinds")

    return _each_level(shapes, depth, step)


def merged(shapes: DataFrame, depth: int, z: float = Z) -> DataFrame:
    """shapes: t with statistically similar branches pooled as `~`."""

    def step(shapes: DataFrame, level: int) -> DataFrame:
        branches = _summed(shapes).where(F.size("t") > level).withColumn("_pool", _masked(level))
        pools = branches.groupBy("host", "_pool").agg(F.sum("labelled").alias("_n"), F.sum("bad").alias("_b"), F.count(F.lit(1)).alias("_branches"))
        share = (F.col("_b") + 1) / (F.col("_n") + 2)
        near = F.abs(F.col("bad") - F.col("labelled") * share) <= z * F.sqrt(F.col("labelled") * share * (1 - share))
        similar = branches.join(pools, ["host", "_pool"]).where((F.col("_branches") > 1) & near).select("host", "t", F.lit(True).alias("_similar"))
        return shapes.join(similar, ["host", "t"], "left").withColumn("t", _replaced(level, "~", F.col("_similar").isNotNull())).drop("_similar")

    return _each_level(shapes, depth, step)


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] | None = None, prior: float = PRIOR, reject: float = REJECT) -> DataFrame:
    """page_id, host, path, rule, verdict and template for every page."""
    rows = with_rule(located(pages), RULES if rules is None else rules).withColumn("first", F.array_join(template(), "/"))
    number = F.regexp_extract("path", r"/([0-9]{1,18})(?:\.[A-Za-z]+)?/?$", 1)
    documents = labels.select(F.col("doc_id").cast("long").alias("doc_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")).where("doc_id is not null and bad is not null").groupBy("doc_id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
    counted = rows.where("host != ''").select("host", "first", F.when(number != "", number.cast("long")).alias("doc_id"))
    # Pages are summed by document first, so a document of many pages is one row of the join with labels.
    by_document = counted.groupBy("host", "first", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    known = by_document.where("doc_id is not null").join(documents, "doc_id").select("host", "first", F.col("n").alias("labelled"), (F.col("n") * F.col("bad")).alias("bad"))
    plain = by_document.select("host", "first", F.lit(0).cast("long").alias("labelled"), F.lit(0).cast("long").alias("bad"))
    shapes = known.unionAll(plain).groupBy("host", "first").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    shapes = stored(shapes.withColumn("t", F.when(F.col("first") == "", F.array().cast("array<string>")).otherwise(F.split("first", "/"))), "shapes")
    depth = shapes.agg(F.max(F.size("t"))).first()[0] or 0
    tree = stored(merged(stored(generalised(shapes, depth), "templates"), depth), "merged")
    total = tree.agg(F.sum("bad"), F.sum("labelled")).first()
    overall = float(total[0] or 0) / float(total[1]) if total[1] else 0.0
    purity = (F.col("bad") + F.lit(prior * overall)) / (F.col("labelled") + F.lit(prior))
    verdicts = _summed(tree).select("host", "t", (purity >= reject).alias("rejected"))
    decisions = tree.join(verdicts, ["host", "t"]).select("host", "first", F.array_join("t", "/").alias("template"), "rejected")
    method = F.when(F.coalesce(F.col("rejected"), F.lit(False)), "block").otherwise("allow")
    return rows.join(decisions, ["host", "first"], "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.coalesce("template", F.lit("")).alias("template"))


def sql(rules: list[tuple[str, str, str]] | None = None) -> str:
    """The same over tables pages and labels in ANSI SQL."""
    ordered = sorted(RULES if rules is None else rules, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0]), r))
    fits = [f"when (host = '{h}' or host like '%.{h}') and starts_with(path, '{p}')" for h, p, _ in ordered]
    rule = "case " + " ".join(f"{f} then '{h}{p}'" for f, (h, p, _) in zip(fits, ordered, strict=True)) + " end"
    ruled = "case " + " ".join(f"{f} then '{v}'" for f, (_, _, v) in zip(fits, ordered, strict=True)) + " end"
    lower = f"translate(regexp_extract(u, '{PARTS}', 1), '{UPPER}', '{LOWER}')"
    cte = [
        f"located as (select page_id, {lower} as host, regexp_extract(u, '{PARTS}', 2) as path from (select page_id, coalesce(url, '') as u from pages))",
        f"parts as (select *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: case when regexp_matches(s, '[0-9]') or length(s) > {LONG} then '*' else s end) as g from located)",
        f"paged as (select *, {rule} as rule, {ruled} as ruled, array_to_string(case when len(g) > {DEPTH} then list_concat(g[1:{DEPTH}], ['**']) else g end, '/') as f from parts)",
        "bads as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) as bad from labels where doc_id is not null and (quality = 0 or toxic = 1) is not null group by doc_id)",
        r"numbered as (select host, f, try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})(?:\.[A-Za-z]+)?/?$', 1), '') as bigint) as n from paged where host <> '')",
        "shapes0 as (select host, f, case when f = '' then [] else string_split(f, '/') end as t, count(bad) as labelled, coalesce(sum(bad), 0) as bad from numbered left join bads on n = doc_id group by host, f)",
    ]
    last = "shapes0"
    for k in range(1, DEPTH + 1):
        cte.append(f"kinds{k} as (select host, t[1:{k - 1}] as parent, count(distinct t[{k}]) as kinds from {last} where len(t) >= {k} and t[{k}] <> '*' group by 1, 2)")
        cte.append(f"general{k} as (select s.host, s.f, s.labelled, s.bad, case when len(s.t) >= {k} and s.t[{k}] <> '*' and c.kinds > {VARIETY} then list_concat(s.t[1:{k - 1}], ['*'], s.t[{k + 1}:]) else s.t end as t from {last} s left join kinds{k} c on s.host = c.host and s.t[1:{k - 1}] = c.parent)")
        last = f"general{k}"
    for k in range(1, DEPTH + 1):
        pool = f"list_concat(t[1:{k - 1}], [''], t[{k + 1}:])"
        cte.append(f"branches{k} as (select host, t, {pool} as pool, sum(labelled) as labelled, sum(bad) as bad from {last} where len(t) >= {k} group by host, t)")
        cte.append(f"pools{k} as (select host, pool, (sum(bad) + 1) / (sum(labelled) + 2) as share, count(*) as branches from branches{k} group by host, pool)")
        cte.append(f"similar{k} as (select b.host, b.t from branches{k} b join pools{k} p on b.host = p.host and b.pool = p.pool where branches > 1 and abs(bad - labelled * share) <= {Z} * sqrt(labelled * share * (1 - share)))")
        cte.append(f"merged{k} as (select s.host, s.f, s.labelled, s.bad, case when m.host is not null then list_concat(s.t[1:{k - 1}], ['~'], s.t[{k + 1}:]) else s.t end as t from {last} s left join similar{k} m on s.host = m.host and s.t = m.t)")
        last = f"merged{k}"
    cte.append(f"overall as (select coalesce(sum(bad) / nullif(sum(labelled), 0), 0.0) as share from {last})")
    cte.append(f"verdicts as (select host, t, (sum(bad) + {PRIOR} * (select share from overall)) / (sum(labelled) + {PRIOR}) >= {REJECT} as rejected from {last} group by host, t)")
    cte.append(f"decisions as (select s.host, s.f, array_to_string(s.t, '/') as template, v.rejected from {last} s join verdicts v on s.host = v.host and s.t = v.t)")
    return "with " + ",\n".join(cte) + "\nselect p.page_id, p.host, p.path, p.rule, coalesce(p.ruled, case when coalesce(d.rejected, false) then 'block' else 'allow' end) as verdict, coalesce(d.template, '') as template from paged p left join decisions d on p.host = d.host and p.f = d.f"
