"""Scans of checkouts beside the extraction: identities, producers, literals, public interfaces, commits.

All work on the table of files (repo, file, language, size, text) with column functions; nothing is read twice.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.text import redact
from tracelake.operators.routes import contained

SCANNED = ("java", "kt", "py", "js", "ts", "go", "yaml", "yml", "properties")
BUILD_FILES = ("pom.xml", "build.gradle", "build.gradle.kts", "package.json", "go.mod", "pyproject.toml", "requirements.txt")
PRODUCER_BYTES, LITERAL_BYTES = 400_000, 512_000
# What a public method's parameters and first lines say of its role.
SINK_HINTS = [
    (r"(?i)String\s+sql", "sink", "sql", "String SQL parameter"),
    (r"(?i)String\s+query", "sink", "sql", "String query parameter"),
    (r"(?i)String\s+exp(?:ression)?", "propagator", "expression", "Expression text"),
    (r"(?i)execute(?:Query|Update)?\s*\(", "sink", "sql", "JDBC execution"),
    (r"(?i)\.send\s*\(", "sink", "http", "HTTP client send"),
    (r"(?i)RestTemplate|WebClient|HttpClient", "propagator", "http", "HTTP client API"),
    (r"(?i)kafkaTemplate\.send", "sink", "queue", "Kafka publish"),
]
DEFAULT_HINT = ("propagator", "opaque", "Treat arguments as flowing to library internals")
PUBLIC_METHOD = r"(?m)^\s*public\s+(?:static\s+)?[\w.<>,\s\[\]]+\s+(\w+)\s*\(([^)]*)\)"


def _name() -> Column:
    return F.element_at(F.split("file", "/"), -1)


def _first(rx: str, column: str = "text") -> Column:
    return F.regexp_extract(column, rx, 1)


def identities(files: DataFrame) -> DataFrame:
    """repo, clone_path, ecosystem, group_id, artifact_id that manifests declare, of nine ecosystems."""
    name = _name()
    # A POM's own coordinates: what stands outside its parent and its lists.
    pom = F.regexp_replace("text", r"(?s)<(dependencies|dependencyManagement|build|profiles|modules|properties|reporting)>.*?</\1>", "")
    own = F.regexp_replace(pom, r"(?s)<parent>.*?</parent>", "")
    group = F.regexp_extract(own, r"<groupId>\s*([^<\s]+)", 1)
    parent = F.regexp_extract(pom, r"(?s)<parent>.*?<groupId>\s*([^<\s]+)", 1)
    kinds = [
        ("maven", name == "pom.xml", F.when(group != "", group).otherwise(parent), F.regexp_extract(own, r"<artifactId>\s*([^<\s]+)", 1)),
        ("gradle", name.isin("settings.gradle", "settings.gradle.kts"), F.lit(""), _first(r"rootProject\.name\s*=\s*[\"']([^\"']+)")),
        ("npm", name == "package.json", F.lit(""), F.coalesce(F.get_json_object("text", "$.name"), F.lit(""))),
        ("python", name == "pyproject.toml", F.lit(""), _first(r"(?ms)^\[(?:project|tool\.poetry)\][^\[]*?^name\s*=\s*[\"']([^\"']+)")),
        ("python", name == "setup.cfg", F.lit(""), _first(r"(?ms)^\[metadata\][^\[]*?^name\s*=\s*(\S+)")),
        ("cargo", name == "Cargo.toml", F.lit(""), _first(r"(?ms)^\[package\][^\[]*?^name\s*=\s*[\"']([^\"']+)")),
        ("composer", name == "composer.json", F.regexp_extract(F.get_json_object("text", "$.name"), r"^([^/]+)/", 1), F.regexp_extract(F.get_json_object("text", "$.name"), r"([^/]+)$", 1)),
        ("go", name == "go.mod", F.lit(""), _first(r"(?m)^module\s+(\S+)")),
        ("dotnet", name.endswith(".csproj"), F.lit(""), F.when(_first(r"<(?:PackageId|AssemblyName)>\s*([^<\s]+)") != "", _first(r"<(?:PackageId|AssemblyName)>\s*([^<\s]+)")).otherwise(F.regexp_replace(name, r"\.csproj$", ""))),
        ("ruby", name.endswith(".gemspec"), F.lit(""), _first(r"\.name\s*=\s*[\"']([^\"']+)")),
    ]
    out = F.array().cast("array<struct<ecosystem:string,group_id:string,artifact_id:string>>")
    for ecosystem, applies, group_id, artifact in kinds:
        out = F.when(applies, F.array(F.struct(F.lit(ecosystem).alias("ecosystem"), F.coalesce(group_id, F.lit("")).alias("group_id"), F.coalesce(artifact, F.lit("")).alias("artifact_id")))).otherwise(out)
    where = F.concat_ws("/", "repo", F.nullif(F.regexp_replace("file", r"/?[^/]+$", ""), F.lit("")))
    found = files.select("repo", where.alias("clone_path"), F.explode(out).alias("i")).select("repo", "clone_path", "i.*").where("artifact_id != ''")
    # A Gradle root's group stands in its properties or its build script.
    groups = files.select("repo", F.concat_ws("/", "repo", F.nullif(F.regexp_replace("file", r"/?[^/]+$", ""), F.lit(""))).alias("clone_path"), F.when(name == "gradle.properties", _first(r"(?m)^\s*group\s*=\s*[\"']?([^\"'\s]+)")).when(name.isin("build.gradle", "build.gradle.kts"), _first(r"(?m)^\s*group\s*=?\s*[\"']([^\"']+)")).alias("g"), name.alias("n")).where("g is not null and g != ''")
    best = groups.groupBy("clone_path").agg(F.min_by("g", F.when(F.col("n") == "gradle.properties", 0).otherwise(1)).alias("g"))
    joined = found.join(best, "clone_path", "left")
    return joined.select("repo", "clone_path", "ecosystem", F.when(F.col("ecosystem") == "gradle", F.coalesce("g", F.lit(""))).otherwise(F.col("group_id")).alias("group_id"), "artifact_id")


def producer_imports(files: DataFrame, bindings: DataFrame) -> DataFrame:
    """One hit for each repository, kind and binding: a source file that imports its client, or a build file that names its artifact.

    Imports and quoted names are pulled out of the files and reduced to distinct values before they meet the bindings.
    """
    rows = files.where(F.col("size") <= PRODUCER_BYTES)
    imports = rows.select("repo", "file", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:import|from)\s+([^\n;]{1,300})"), 1))).alias("text"))
    b = bindings.where("coalesce(import_prefix, '') != ''")
    met = contained(imports, b.select(F.col("import_prefix").alias("name"))).join(b.select(F.col("import_prefix").alias("name"), "target_repo"), "name")
    by_import = imports.join(met, "text").select("repo", "target_repo", F.lit("import").alias("kind"), "file")
    tokens = rows.where(_name().isin(*BUILD_FILES)).select("repo", "file", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9][A-Za-z0-9._\-]{1,120})"), 1))).alias("text"))
    a = bindings.where("coalesce(maven_artifact, '') != ''")
    by_build = tokens.join(a.select(F.col("maven_artifact").alias("text"), "target_repo"), "text").select("repo", "target_repo", F.lit("build").alias("kind"), "file")
    hits = by_import.unionByName(by_build).where("repo != target_repo")
    return hits.groupBy(F.col("repo").alias("source_repo"), "target_repo", "kind").agg(F.min("file").alias("ref"))


def literal_hits(files: DataFrame, target: str, needles: list[str]) -> DataFrame:
    """Quoted literals of other repositories' files that hold a needle: source_repo, evidence (redacted), ref."""
    own = [n for n in needles if n]
    suffix = F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))
    rows = files.where((F.col("repo") != target) & suffix.isin(*SCANNED) & (F.col("size") <= LITERAL_BYTES))
    if not own:
        return rows.where("false").select(F.col("repo").alias("source_repo"), F.lit("").alias("evidence"), F.lit("").alias("ref"))
    alt = "|".join(re.sub(r"([^A-Za-z0-9_/])", r"\\\1", n) for n in own)
    low = F.lower("text")
    any_of = F.lit(False)
    for n in own:
        any_of = any_of | F.contains(low, F.lit(n.lower()))
    lines = rows.where(any_of).select("repo", "file", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    hits = lines.select("repo", "file", "n", F.explode(F.regexp_extract_all("line", F.lit(rf"(?i)[\"']([^\"']{{0,512}}(?:{alt})[^\"']{{0,512}})[\"']"), 1)).alias("m"))
    return hits.select(F.col("repo").alias("source_repo"), F.substring(redact(F.col("m")), 1, 160).alias("evidence"), F.concat("file", F.lit(":"), (F.col("n") + 1).cast("string")).alias("ref"))


def java_public_api(files: DataFrame, most: int = 40) -> DataFrame:
    """repo, signature, role, sink_type, notes of public Java methods, by the first hint that fits: at most so many a repository."""
    rows = files.where(F.col("file").endswith(".java") & ~F.col("file").rlike(r"(^|/)(test|tests|generated)/"))
    found = rows.select("repo", "file", "text", F.posexplode(F.regexp_extract_all("text", F.lit(f"({PUBLIC_METHOD})"), 1)).alias("n", "m"))
    method, params = F.regexp_extract("m", PUBLIC_METHOD, 1), F.regexp_extract("m", PUBLIC_METHOD, 2)
    found = found.withColumns({"method": method, "params": params}).where(~F.col("method").isin("equals", "hashCode", "toString"))
    found = found.withColumn("snippet", F.substr("text", F.expr("locate(m, text)"), F.lit(400)))
    role, sink, notes = (F.lit(x) for x in DEFAULT_HINT)
    for rx, r, s, n in reversed(SINK_HINTS):
        hit = F.col("params").rlike(rx) | F.col("snippet").rlike(rx)
        role, sink, notes = F.when(hit, r).otherwise(role), F.when(hit, s).otherwise(sink), F.when(hit, n).otherwise(notes)
    order = Window.partitionBy("repo").orderBy("file", "n")
    out = found.select("repo", "file", "n", F.concat("method", F.lit("("), F.substring("params", 1, 60), F.lit(")")).alias("signature"), role.alias("role"), sink.alias("sink_type"), notes.alias("notes"))
    return out.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("repo", "file", "signature", "role", "sink_type", "notes")


def commits(refs: DataFrame) -> DataFrame:
    """repo, git_sha of tables of .git files (repo, file, text): HEAD's own hash, its ref's, or the packed ref's; null if it is none."""
    head = refs.where("file = '.git/HEAD'").select("repo", F.regexp_replace("text", r"^\s+|\s+$", "").alias("head"))
    named = head.withColumn("ref", F.regexp_extract("head", r"^ref:\s*(\S+)", 1))
    loose = refs.where("startswith(file, '.git/refs/')").select("repo", F.substr("file", F.lit(6)).alias("ref"), F.regexp_replace("text", r"^\s+|\s+$", "").alias("loose"))
    packed = refs.where("file = '.git/packed-refs'").select("repo", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^([0-9a-f]{40,64} \S+)$"), 1)).alias("l")).select("repo", F.regexp_extract("l", r" (\S+)$", 1).alias("ref"), F.regexp_extract("l", r"^(\S+)", 1).alias("packed"))
    both = named.join(loose, ["repo", "ref"], "left").join(packed, ["repo", "ref"], "left")
    sha = F.when(F.col("ref") == "", F.col("head")).otherwise(F.coalesce("loose", "packed"))
    return both.select("repo", F.when(sha.rlike("^[0-9a-f]{40}([0-9a-f]{24})?$"), sha).alias("git_sha"))

