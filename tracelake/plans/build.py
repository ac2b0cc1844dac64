"""A fleet from end to end: a checkout is scanned, findings are derived, tables are aggregated, and catalogues and reports are written.

    build(spark, root, out, bindings)   everything below out: the node and edge tables, catalogues, reports and the run's manifest
    rederive(spark, out)                findings and reports anew from the stored observations, without the checkout
    trace(spark, out, target)           one target's facts and callers from all sources, and its page

Each step's result is a table that the next one reads. Reports hold the first rows of an order, as many as sinks.catalogs.ROWS says;
the tables beside them hold all.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tracelake.extractors.scan import Binding, extract
from tracelake.functions.text import trace_slug
from tracelake.operators import calls, derive, fleet, inventory, privacy, resolve
from tracelake.schema import DETAIL
from tracelake.sinks import catalogs, reports
from tracelake.sinks.catalogs import ROWS, markdown_table, page
from tracelake.sources import files as source
from tracelake.sources import manifests, scans
from tracelake.storage import stored

PLACE = ("repo", "file", "line", "language", "framework", "kind", "family", "symbol", "pii_classification", "data_class", "confidence", "id")
BINDING = "target_repo string, maven_artifact string, import_prefix string, paths array<string>, payload_fields array<string>, service_aliases array<string>, class_patterns array<string>"
#: Nodes of a file, and files of a repository, that a row's place in its repository leaves room for.
IN_FILE, IN_REPO = 1 << 20, 1 << 22


@dataclass
class Scan:
    """What a checkout holds. nodes are flat: a column for each detail."""

    nodes: DataFrame
    repos: DataFrame
    dependencies: DataFrame
    identities: DataFrame
    specs: DataFrame
    producers: DataFrame
    notes: DataFrame


def flat(nodes: DataFrame) -> DataFrame:
    """Nodes with their details (JSON) as columns, and ord: an order over the fleet by repository, file and line.

    Places are numbered within files and files within repositories; only repositories are numbered together, one row each.
    """
    names = [f for f in DETAIL.fieldNames() if f not in PLACE]
    rows = nodes.withColumn("_d", F.from_json("detail", DETAIL)).select(*PLACE, *[F.col("_d").getField(n).alias(n) for n in names])
    numbered = lambda n, *by: F.row_number().over(Window.partitionBy(*by).orderBy(n) if by else Window.orderBy(n)).cast("long")
    repos = rows.select("repo").distinct().withColumn("_r", numbered("repo"))
    places = rows.select("repo", "file").distinct().withColumn("_f", numbered("file", "repo")).join(repos, "repo")
    at = F.row_number().over(Window.partitionBy("repo", "file").orderBy("line", "id", "raw")).cast("long")
    return rows.withColumn("_n", at).join(places, ["repo", "file"]).withColumn("ord", (F.col("_r") * IN_REPO + F.col("_f")) * IN_FILE + F.col("_n")).drop("_n", "_f", "_r")


def binding_table(spark: SparkSession, bindings: list[Binding]) -> DataFrame:
    return spark.createDataFrame([tuple(list(v) if isinstance(v, tuple) else v for v in asdict(b).values()) for b in bindings], BINDING)


def flat_bindings(bindings: DataFrame) -> DataFrame:
    """target_repo, maven_artifact, path, alias: a row for each path and alias of a binding, null where it has none."""
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit(None).cast("string")))
    return bindings.select("target_repo", "maven_artifact", F.explode(some("paths")).alias("path"), "service_aliases").select("target_repo", "maven_artifact", "path", F.explode(some("service_aliases")).alias("alias"))


def scan(spark: SparkSession, root: str, bindings: list[Binding] | None = None, indicators: list[str] | None = None, limit: int | None = None) -> Scan:
    """Reads a checkout once and gives its tables. limit: the first so many repositories by name, for a trial run."""
    files = source.checkout(spark, root)
    if limit is not None:
        files = files.join(files.select("repo").distinct().orderBy("repo").limit(limit), "repo", "left_semi")
    files = stored(files, "checkout")
    wanted, skipped = source.screened(source.scannable(files), indicators)
    observed = stored(extract(wanted, bindings), "observed")
    hit, missed = manifests.gradle_catalog(files)
    read = [manifests.maven(files), manifests.gradle(files), hit, manifests.go(files), manifests.python(files), manifests.npm(files)]
    columns = ["repo", "file", "group_id", "artifact_id", "version", "version_kind"]
    declared = read[0].select(*columns)
    for more in read[1:]:
        declared = declared.unionByName(more.select(*columns))
    declared = fleet.dedupe_dependencies(declared.withColumn("ord", F.xxhash64(*columns)))
    counted = wanted.where("language != 'config'").select("repo", "language", F.xxhash64("file").alias("ord"))
    known = files.select("repo").distinct().join(inventory.language_breakdown(counted), "repo", "left")
    parts = F.split("repo", "/")
    repos = known.select("repo", parts[0].alias("grp"), parts[1].alias("name"), F.xxhash64("repo").alias("ord"), "primary_language").join(source.build_systems(files), "repo", "left")
    failed = observed.where("family = 'scan-error'").select("repo", F.concat("file", F.lit(": "), F.get_json_object("detail", "$.raw")).alias("note"))
    notes = skipped.select("repo", F.concat("file", F.lit(": "), "reason").alias("note")).unionByName(failed).unionByName(source.unparsed_manifests(files).select("repo", "note"))
    specs = source.openapi_specs(files).select("target_repo", "spec_path", F.explode("paths").alias("path"))
    found = scans.producer_imports(files, binding_table(spark, bindings or []))
    return Scan(stored(flat(observed.where("family != 'scan-error'")), "nodes"), stored(repos, "repos"), stored(declared, "dependencies"), stored(scans.identities(files), "identities"), stored(specs, "specs"), stored(found, "producers"), stored(notes, "notes"))


def findings(nodes: DataFrame) -> DataFrame:
    """Observations with what is derived from them: SQL sinks, payload endpoints, entry points and tainted paths. Findings that nodes hold already are derived anew."""
    seen = derive.observations(nodes)
    declared = seen.where("family = 'method-decl'")
    seen = derive.prune_calls(seen.withColumn("library_hint", F.when(F.col("raw").isNotNull(), F.col("library_hint").cast("boolean"))), declared)
    sinks = stored(derive.sql_sinks(seen), "sinks")
    node = {f.name: F.lit(None).cast(f.dataType) for f in seen.schema.fields}

    def made(rows: DataFrame, family: str, kind: str, **columns: Column) -> DataFrame:
        """rows (repo, file, line, ord and more) as nodes of a family."""
        given = {"repo": F.col("repo"), "file": F.col("file"), "line": F.col("line").cast("int"), "ord": F.col("ord"), "family": F.lit(family), "kind": F.lit(kind), "confidence": F.lit("high")} | columns
        cells = [given.get(n, c).cast(seen.schema[n].dataType).alias(n) for n, c in node.items() if n != "id"]
        key = F.substring(F.sha2(F.concat_ws("|", "family", "kind", F.col("line").cast("string"), "symbol", "endpoint_path", "sink_symbol", "channel", "path_hops"), 256), 1, 12)
        return rows.select(*cells).withColumn("id", F.concat_ws(":", "repo", "file", F.col("line").cast("string"), "family", "kind", key)).select(*seen.columns)

    payloads = derive.raw_code_payloads(seen, sinks).withColumn("line", F.col("endpoint_line")).withColumn("ord", F.xxhash64("repo", "file", "endpoint_path", "field_line", "sink_symbol"))
    payloads = made(payloads, "raw-code-payload", "source", path=F.col("endpoint_path"), endpoint_path=F.col("endpoint_path"), field_line=F.col("field_line"), sink_symbol=F.col("sink_symbol"), sink_line=F.col("sink_line"), data_class=F.lit("raw-sql-payload"))
    entries = stored(derive.entry_points(seen), "entries")
    ways = made(entries, "entry-point", "source", mechanism=F.col("mechanism"), channel=F.col("channel"), externally_triggered=F.col("externally_triggered"), enclosing_class=F.col("enclosing_class"), enclosing_method=F.col("enclosing_method"), confidence=F.col("confidence"))
    every = seen.unionByName(sinks.select(*seen.columns)).unionByName(payloads).unionByName(ways)
    paths = taint(seen, sinks, entries)
    tainted = made(paths, "tainted-path", "finding", path_hops=F.split("path", ">"), hops=F.col("n_hops"), tainted_at_sink=F.array("tainted_at_sink"), search_truncated=F.col("search_truncated"), weakest_link=F.col("weakest_link"), confidence=F.col("confidence"))
    return every.unionByName(tainted)


def scope() -> Column:
    return F.concat_ws(".", F.coalesce("enclosing_class", F.lit("")), "enclosing_method")


def taint(seen: DataFrame, sinks: DataFrame, entries: DataFrame) -> DataFrame:
    """The shortest tainted path for each entry point and sink, with the entry's place."""
    declared = stored(seen.where("family = 'method-decl'").select("repo", F.coalesce("class", F.lit("")).alias("class"), "method", "params", "self_name"), "methods")
    types = seen.where("family = 'type-decl'")
    kinds = types.groupBy("repo", "class").agg(F.bool_or("is_interface").alias("is_interface"))
    members = types.where("fields is not null").select("repo", "class", F.explode("fields").alias("field", "type")).distinct()
    supers = types.select("repo", "class", F.explode("supertypes").alias("supertype")).distinct()
    owns = declared.where("self_name is not null").select("repo", F.col("class").alias("owner"), F.col("method").alias("enclosing_method"), F.col("self_name").alias("_own")).distinct()
    made = seen.where("family = 'call-site' and enclosing_method is not null").select("repo", F.col("ord").alias("call_id"), "ord", F.coalesce("enclosing_class", F.lit("")).alias("owner"), "enclosing_method", "symbol", "receiver", "arguments", scope().alias("scope"))
    made = made.join(owns, ["repo", "owner", "enclosing_method"], "left").withColumnRenamed("_own", "self_name")
    resolved = resolve.resolve_calls(made, declared, kinds, members, supers)
    named = declared.select("repo", F.concat_ws(".", "class", "method").alias("scope"), "params")
    targets = named.groupBy("repo", F.col("scope").alias("to_scope")).agg(F.min("params").alias("to_params"))
    resolved = stored(resolved.withColumn("to_scope", F.concat_ws(".", "to_class", "symbol")).join(targets, ["repo", "to_scope"]), "resolved")
    reached = sinks.where("execution and enclosing_method is not null").select("repo", scope().alias("scope"), F.col("id").alias("sink_id"), F.coalesce("raw", F.array_join("arguments", ",")).alias("text"))
    # A route's annotation stands before its method: the method that begins next in the file is the entry's.
    begins = seen.where("family = 'method-decl'").select("repo", "file", F.coalesce("start_line", "line").alias("begins"), F.concat_ws(".", F.coalesce("class", F.lit("")), "method").alias("next"))
    place = entries.withColumn("entry_id", F.concat_ws(":", "repo", "file", F.col("line").cast("string"), "mechanism", "channel")).withColumn("inner", F.when(F.col("enclosing_method").isNotNull(), scope()))
    after = place.where("inner is null").join(begins, ["repo", "file"]).where("begins between line and line + 5").groupBy("entry_id").agg(F.min_by("next", "begins").alias("next"))
    place = place.join(after, "entry_id", "left").withColumn("scope", F.coalesce("inner", "next")).where("scope is not null")
    found = resolve.shortest_strongest(resolve.tainted_paths(place.select("entry_id", "repo", "scope").distinct(), named, resolved, reached))
    first = place.groupBy("entry_id").agg(F.min(F.struct("ord", "file", "line")).alias("p"))
    return found.join(first, "entry_id").select(*found.columns, "p.ord", "p.file", "p.line")


def aggregate(s: Scan, bindings: DataFrame) -> dict[str, DataFrame]:
    """The fleet's tables over nodes with findings."""
    nodes = s.nodes
    text = [f.name for f in nodes.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in PLACE and f.name != "path"]
    edges, unmatched = calls.service_edges(nodes, s.repos, flat_bindings(bindings), text)
    edges = stored(calls.merge_openapi(edges, calls.openapi_edges(nodes, s.specs)), "edges")
    touches = stored(privacy.touchpoints(nodes), "touches")
    hits = stored(fleet.producer_hits(nodes, s.dependencies, flat_bindings(bindings)), "hits")
    resolved = fleet.resolve_coordinates(s.dependencies, s.identities.select("group_id", "artifact_id", "clone_path"))
    return {
        "service_calls": edges, "unmatched_calls": unmatched, "calls_by_confidence": calls.by_confidence(edges), "binding_coverage": calls.binding_coverage(bindings, edges),
        "queues": inventory.queue_graph(nodes), "data_stores": inventory.store_graph(nodes), "sql_executions": inventory.sql_executions(nodes), "buckets": inventory.bucket_counts(nodes),
        "sql_posture": inventory.posture_summary(nodes), "index": inventory.index_rows(nodes, s.repos), "auth_cards": inventory.auth_cards(nodes, s.repos), "crypto_cards": inventory.crypto_cards(nodes, s.repos),
        "routes": nodes.where("family = 'http-in'").select("repo", "method", "path", "file", "line"), "pii_touches": touches, "pii_lifecycle": privacy.lifecycle(touches), "pii_stages": privacy.by_stage(touches),
        "processing_activities": privacy.activities(touches), "pii_handlers": privacy.probable_handlers(nodes), "entry_points": nodes.where("family = 'entry-point'").select("repo", "file", "line", "mechanism", "channel", "externally_triggered"),
        "tainted_paths": nodes.where("family = 'tainted-path'").select("repo", "file", "line", "path_hops", "hops", "confidence", "search_truncated"), "payload_endpoints": nodes.where("family = 'raw-code-payload'").select("repo", "endpoint_path", "file", "field_line", "sink_symbol", "sink_line"),
        "producers": hits, "imports": s.producers, "libraries": fleet.library_consumers(s.dependencies), "coordinates": resolved, "dependency_kinds": fleet.dependency_summary(s.dependencies),
        "discovered_clients": fleet.discovered_clients(fleet.supply(s.dependencies, bindings), fleet.demand(nodes)), "notes": s.notes, "limits": source.limits_hit(s.notes),
    }


#: Reports by name: title, the tables that it shows, and how many rows of each.
REPORTS = {
    "service-calls": ("Service calls", ("calls_by_confidence", "service_calls", "unmatched_calls"), ROWS["catalogue"]),
    "queues": ("Queues", ("queues",), ROWS["catalogue"]),
    "data-stores": ("Data stores", ("data_stores", "sql_executions"), ROWS["catalogue"]),
    "taint": ("Sources and sinks", ("buckets", "sql_posture", "payload_endpoints", "tainted_paths", "entry_points"), ROWS["catalogue"]),
    "cards": ("Authentication and cryptography", ("auth_cards", "crypto_cards"), ROWS["catalogue"]),
    "pii": ("Personal data", ("pii_stages", "pii_lifecycle", "pii_handlers"), ROWS["lifecycle"]),
    "processing": ("Processing activities", ("processing_activities",), ROWS["ropa"]),
    "libraries": ("Libraries", ("dependency_kinds", "libraries", "coordinates", "binding_coverage", "discovered_clients"), ROWS["producers"]),
    "index": ("Repositories", ("index", "limits"), ROWS["catalogue"]),
}


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file at a path of any store that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_reports(tables: dict[str, DataFrame], out: str) -> None:
    """Every table as JSON lines, and the pages of REPORTS."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        catalogs.write_jsonl(catalogs.redacted(df), f"{out}/tables/{name}")
    for name, (title, shown, most) in REPORTS.items():
        parts = []
        for t in shown:
            df = spark.read.schema(tables[t].schema).json(f"{out}/tables/{t}")
            plain = [F.concat_ws(", ", c) if isinstance(df.schema[c].dataType, T.ArrayType) else F.col(c) for c in df.columns]
            parts += [f"## {t.replace('_', ' ').capitalize()}\n\n{df.count()} rows; at most {most} are shown.\n", markdown_table(df.select(*[p.alias(c) for p, c in zip(plain, df.columns, strict=True)]), df.columns, most)]
        write_text(spark, f"{out}/reports/{name}.md", page(title, *parts))


KEPT = ("repos", "dependencies", "identities", "specs", "producers", "notes")


def _finish(spark: SparkSession, s: Scan, bindings: DataFrame, out: str, timing: catalogs.Timing) -> dict[str, DataFrame]:
    with timing.phase("derive"):
        s.nodes = stored(findings(s.nodes), "findings")
    with timing.phase("aggregate"):
        tables = aggregate(s, bindings)
    with timing.phase("write"):
        catalogs.write_nodes(s.nodes, f"{out}/nodes")
        catalogs.write_catalogues(s.nodes, f"{out}/catalogues")
        write_reports(tables, out)
        bindings.write.mode("overwrite").parquet(f"{out}/bindings")
    noted = s.repos.select("name", "repo").join(s.notes.groupBy("repo").agg(F.collect_set("note").alias("n")), "repo", "left").select("name", F.coalesce("n", F.array().cast("array<string>")).alias("notes"))
    write_text(spark, f"{out}/manifest.json", catalogs.manifest(noted, timing))
    return tables


def build(spark: SparkSession, root: str, out: str, bindings: list[Binding] | None = None, indicators: list[str] | None = None, limit: int | None = None) -> dict[str, DataFrame]:
    """Scans root/group/repository and writes everything below out; gives the aggregated tables."""
    timing = catalogs.Timing()
    with timing.phase("scan"):
        s = scan(spark, root, bindings, indicators, limit)
        for name in KEPT:
            getattr(s, name).write.mode("overwrite").parquet(f"{out}/scan/{name}")
        derive.observations(s.nodes).write.mode("overwrite").parquet(f"{out}/scan/nodes")
    return _finish(spark, s, binding_table(spark, bindings or []), out, timing)


def rederive(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """Findings, tables and reports anew from what a build stored."""
    s = Scan(*[spark.read.parquet(f"{out}/scan/{name}") for name in ("nodes", *KEPT)])
    return _finish(spark, s, stored(spark.read.parquet(f"{out}/bindings"), "bindings"), out, catalogs.Timing())


def trace(spark: SparkSession, out: str, target: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A target's facts and its callers from four sources (the graph, producers, outbound nodes that name it, imports), and its page below out/traces."""
    nodes = spark.read.parquet(f"{out}/nodes")
    read = lambda name, schema: spark.read.schema(schema).json(f"{out}/tables/{name}")
    wanted = spark.range(1).select(F.lit(target).alias("target_repo"))
    edges = read("service_calls", "source_repo string, target_repo string, target_path string, confidence string, evidence string")
    if path:
        from tracelake.functions.paths import matches_filter

        edges = edges.where(matches_filter(F.col("target_path"), path) | (F.col("target_path") == "*"))
    hits = read("producers", "source_repo string, target_repo string, kind string, confidence string, evidence string")
    named = nodes.where("family in ('http-out', 'sql-payload-out') and target_repo is not null").select(F.col("repo").alias("source_repo"), "target_repo", F.concat(F.lit("node-"), "family").alias("kind"), "confidence", F.coalesce("target_repo_evidence", F.lit("declared target")).alias("evidence"))
    imports = spark.read.parquet(f"{out}/scan/producers").select("source_repo", "target_repo", "kind", F.lit("high").alias("confidence"), F.concat(F.lit("in "), "ref").alias("evidence"))
    upstream = fleet.trace_upstream(edges.drop("target_path"), hits.unionByName(imports).unionByName(named).where("source_repo != target_repo"), wanted)
    facts = fleet.target_facts(nodes, wanted).join(nodes.where("family = 'raw-code-payload'").groupBy("repo").agg(F.count(F.lit(1)).alias("n_payloads")), "repo", "left").na.fill(0)
    facts, upstream = stored(facts, "facts"), stored(upstream, "upstream")
    slug = spark.range(1).select(trace_slug(F.lit(target), F.lit(path or "")).alias("s")).first()["s"]
    write_text(spark, f"{out}/traces/{slug}.md", reports.trace_page(target, path, facts, upstream))
    return facts, upstream


def trace_batch(spark: SparkSession, out: str, most: int = 1000) -> DataFrame:
    """Pages of the targets that the payload catalogue names, at most so many, and an index of all pages below out/traces."""
    targets = reports.catalogue_targets(spark, f"{out}/tables/payload_endpoints").select("repo").distinct().orderBy("repo").limit(most).collect()
    for r in targets:
        trace(spark, out, r["repo"])
    found = reports.trace_headers(spark, f"{out}/traces/*.md") if targets else spark.createDataFrame([], "repo string, path string, upstream long")
    write_text(spark, f"{out}/traces/INDEX.md", page("Traces", markdown_table(found.where("repo is not null"), ["repo", "path"], ROWS["catalogue"])))
    return found
