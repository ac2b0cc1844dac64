"""Reports of single targets and libraries: bounded Markdown, rendered on the driver."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.sinks.catalogs import markdown_table, merged_with_manual, page, redacted

HEADER = "<!-- trace target={target} path={path} upstream={upstream} -->"
TBD = "| _TBD_ |"


def trace_page(target: str, path: str | None, facts: DataFrame, upstream: DataFrame, most: int = 200) -> str:
    """A target's facts and callers; callers in the order of confidence (as text), then name."""
    own = facts.where(F.col("repo") == target)
    callers = upstream.where(F.col("target_repo") == target).drop("target_repo")
    n = callers.select("source_repo").distinct().count()
    head = HEADER.format(target=target, path=path or "", upstream=n)
    return page(f"Trace of {target}", head, "## Facts\n", markdown_table(own, ["repo"], 1), "## Upstream\n", markdown_table(callers, ["confidence", "source_repo", "kind"], most))


def repo_page(repo: str, nodes: DataFrame, old: str | None = None, most: int = 500) -> str:
    """A repository's page: counts by family and its first findings in a generated block; text around the block stays."""
    own = nodes.where(F.col("repo") == repo)
    counts = own.groupBy("family", "kind").agg(F.count(F.lit(1)).alias("n"))
    shown = [c for c in ("family", "kind", "file", "line", "confidence", "raw") if c in own.columns]
    body = page(repo, "## Counts\n", markdown_table(counts, ["family", "kind"], most), "## Nodes\n", markdown_table(redacted(own.select(*shown)), ["family", "file", "line"], most))
    return merged_with_manual(old, body)


def trace_headers(spark, path: str) -> DataFrame:
    """(target, path, upstream) of the trace pages below a path."""
    rows = spark.read.text(path, wholetext=True).select(F.substring("value", 1, 500).alias("t"))
    rx = r"<!-- trace target=(\S+) path=(\S*) upstream=(\d+) -->"
    return rows.where(F.col("t").rlike(rx)).select(F.regexp_extract("t", rx, 1).alias("repo"), F.regexp_extract("t", rx, 2).alias("path"), F.regexp_extract("t", rx, 3).cast("long").alias("upstream"))


def catalogue_targets(spark, path: str) -> DataFrame:
    """Distinct (repo, endpoint_path) of raw-code-payload catalogues."""
    return spark.read.schema("repo string, endpoint_path string").json(path).where("repo is not null").distinct().orderBy("repo", "endpoint_path")


def curated_library(old: str, api: DataFrame, repo: str, most: int = 40) -> str:
    """A library's page whose placeholder table is replaced by its public methods; a page without one stays as it is."""
    if TBD not in old:
        return old
    table = markdown_table(api.where(F.col("repo") == repo).select("signature", "role", "sink_type", "notes"), ["signature"], most)
    return re.sub(r"(?:^\|[^\n]*\n)*^\| _TBD_ \|[^\n]*\n?", lambda _: table, old, count=1, flags=re.MULTILINE)
