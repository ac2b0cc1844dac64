"""Findings derived from observations: SQL sinks, raw-code payloads, entry points, carriers, enclosing methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.fields import is_database_receiver, sql_execution

#: Families and kinds that are findings and not observations.
DERIVED = (("sql", "sink"), ("raw-code-payload", "source"), ("entry-point", "source"), ("tainted-path", "finding"))


def observations(nodes: DataFrame) -> DataFrame:
    """nodes without findings: what a scan saw, from which findings can be derived anew."""
    out = F.lit(False)
    for family, kind in DERIVED:
        out = out | ((F.col("family") == family) & (F.col("kind") == kind))
    return nodes.where(~out)


def sql_sinks(nodes: DataFrame) -> DataFrame:
    """Call sites that are SQL, and whether they execute it."""
    verdict = sql_execution(F.col("symbol"), F.col("library_hint"), F.col("receiver"), is_database_receiver(F.col("receiver")), F.col("file_sql_evidence"))
    rows = nodes.where("family = 'call-site'").withColumn("execution", verdict).where("execution is not null")
    return rows.withColumns({"family": F.lit("sql"), "kind": F.lit("sink"), "confidence": F.when(F.col("execution"), "high").otherwise("medium")})


def raw_code_payloads(nodes: DataFrame, sinks: DataFrame) -> DataFrame:
    """Endpoints in files that hold a statement field and an execution sink: one for each (path, field's line, sink's name) of a file.

    The three sides are reduced to what a finding says before they meet, so a file of many nodes gives its distinct findings only.
    """
    key = ["repo", "file"]
    first = lambda *by: F.min(F.struct(*by))
    endpoints = nodes.where("family = 'http-in'").groupBy(*key, F.coalesce("path", F.lit("?")).alias("endpoint_path")).agg(F.min("line").alias("endpoint_line"))
    markers = nodes.where("family = 'sql-field-marker'").select(*key, F.col("line").alias("field_line")).distinct()
    executed = sinks.where("execution").groupBy(*key, F.col("symbol").alias("sink_symbol")).agg(first("ord", "line").getField("line").alias("sink_line"))
    return endpoints.join(markers, key).join(executed, key)


def entry_points(nodes: DataFrame) -> DataFrame:
    """Ways into a service: endpoints, consumed topics, and one for each mechanism that markers of a file name."""
    f = F.col("family")
    rows = nodes.where(f.isin("http-in", "queue-sub", "entry-marker")).select(
        "repo", "file", "line", "ord", "confidence", "family", "enclosing_class", "enclosing_method",
        F.when(f == "http-in", "http").when(f == "queue-sub", "queue").otherwise(F.col("mechanism")).alias("mechanism"),
        F.coalesce(F.when(f == "http-in", F.col("path")).when(f == "queue-sub", F.col("topic")).otherwise(F.col("raw")), F.lit("?")).alias("channel"),
    )
    rows = rows.withColumn("externally_triggered", F.col("mechanism") != "schedule")
    one = Window.partitionBy("repo", "file", "mechanism").orderBy("ord")
    markers = rows.where("family = 'entry-marker'").withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    return rows.where("family != 'entry-marker'").unionByName(markers)


def payload_carriers(fields: DataFrame, calls: DataFrame) -> DataFrame:
    """As-of join: for each field of a file the nearest outbound call at or after its line, else the nearest before.

    One window over fields and calls of a file together: the next and the last call's line, without comparing pairs.
    """
    both = fields.select("repo", "file", "line", F.lit(None).cast("int").alias("call"), "ord").unionByName(calls.select("repo", "file", "line", F.col("line").alias("call"), "ord"))
    # At one line a field stands before a call, so the call counts as at or after it.
    after = Window.partitionBy("repo", "file").orderBy("line", F.col("call").isNotNull())
    seen = both.withColumns({"next": F.first("call", ignorenulls=True).over(after.rowsBetween(0, Window.unboundedFollowing)), "last": F.last("call", ignorenulls=True).over(after.rowsBetween(Window.unboundedPreceding, 0))})
    return seen.where("call is null").select("repo", "file", "line", "ord", F.coalesce("next", "last").alias("call_line")).where("call_line is not null")


def enclosing(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """rows (repo, file, line, ord) with the innermost span (start_line, end_line, owner) around each; null without one."""
    size = 64
    s = spans.select("repo", "file", "start_line", "end_line", "owner")
    wide = s.withColumn("block", F.explode(F.sequence(F.floor(F.col("start_line") / size), F.floor(F.col("end_line") / size))))
    places = rows.select("repo", "file", "line").distinct().withColumn("block", F.floor(F.col("line") / size))
    met = places.join(wide, ["repo", "file", "block"]).where("line between start_line and end_line")
    inner = met.groupBy("repo", "file", "line").agg(F.min_by("owner", F.struct(F.col("end_line") - F.col("start_line"), F.col("start_line"), F.col("owner"))).alias("owner"))
    return rows.join(inner, ["repo", "file", "line"], "left")


def prune_calls(nodes: DataFrame, declared: DataFrame) -> DataFrame:
    """nodes without calls that nothing can resolve: a call stays if it is sink-shaped (has a library hint, true or false) or its repository declares its symbol."""
    kept = nodes.where("family != 'call-site' or library_hint is not null")
    calls = nodes.where("family = 'call-site' and library_hint is null")
    return kept.unionByName(calls.join(declared.select("repo", "symbol").distinct(), ["repo", "symbol"], "left_semi").select(*nodes.columns))
