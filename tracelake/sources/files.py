"""Checkouts and records as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.functions.paths import normalize_path
from tracelake.functions.text import MAX_FILE_BYTES, skip_reason
from tracelake.schema import RECORD, SCHEMA_VERSION

# Fixed values.
SKIP_DIRS = (
    ".git", ".idea", ".vscode", ".gradle", ".mvn", ".pytest_cache", "node_modules", "target", "build", "dist", "out", "bin",
    "vendor", ".terraform", "__pycache__", ".cache", ".tox", "coverage", ".nyc_output", ".next", ".nuxt", ".svelte-kit",
    "tmp", "temp", ".DS_Store", ".tmp_gitlab_archives",
)
LANGUAGES = {"java": "java", "kt": "kotlin", "scala": "scala", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "py": "python", "go": "go"}
CONFIG_SUFFIXES = ("properties", "yml", "yaml", "env")
TEST_SEGMENTS = r"test|tests|spec|specs|__tests__|fixtures?|examples?|samples?|sandbox|playground|local|demo|mock|mocks|stub|stubs|src/test|src/it|integration[-_]?test|qa[-_]?test|e2e|cypress|load[-_]?tests?|smoke[-_]?tests?|perf[-_]?tests?|acceptance[-_]?tests?"
TEST_FILES = r"[^/]+\.(?:spec|test|cy)\.(?:js|jsx|mjs|cjs|ts|tsx)|[^/]+_test\.go|test_[^/]+\.py|[^/]+_test\.py|[^/]+Tests?\.(?:java|kt)"
TEST_PATH = rf"(?i)(?:^|/)(?:{TEST_SEGMENTS}|(?-i:[a-zA-Z][a-zA-Z0-9]*Tests?))(?:/|$)|(?:^|/)(?:{TEST_FILES})$"
OPENAPI_NAMES = ("openapi.yaml", "openapi.yml", "swagger.yaml", "swagger.yml")
HELM_NAMES = ("values.yaml", "values.yml")
BUILD_MARKERS = {
    "pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle", "package.json": "npm", "go.mod": "go", "pyproject.toml": "python",
    "setup.py": "python", "requirements.txt": "python", "Cargo.toml": "cargo", "composer.json": "composer", "Gemfile": "bundler", "Dockerfile": "docker",
}
UNPARSED_MANIFESTS = {"Cargo.toml": "Rust", "Gemfile": "Ruby", "composer.json": "PHP"}


def language(path: Column) -> Column:
    """A file's language by its extension; `config` for configuration, null for others."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    by_suffix = F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), suffix)
    return F.when(suffix.isin(*CONFIG_SUFFIXES), "config").otherwise(by_suffix)


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_skipped(path: Column) -> Column:
    """A path below a directory that is never scanned; hidden ones but .github are not either."""
    directories = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(directories, lambda d: d.isin(*SKIP_DIRS) | (d.startswith(".") & (d != ".github")))


def _hidden(spark: SparkSession, root: str, most: int, depth: int = 24) -> list[tuple[str, int]]:
    """(path, size) of files that Spark's listing leaves out: names that begin with _, and .github, at any depth below the repositories."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, int] = {}
    below = root.rstrip("/") + "/*/*"
    for _ in range(depth):
        if not fs.globStatus(path(below)):
            break
        for status in fs.globStatus(path(below + "/{_*,.github}")):
            if status.isFile():
                found[status.getPath().toString()] = status.getLen()
            elif status.getPath().getName() not in SKIP_DIRS:
                inner = fs.listFiles(status.getPath(), True)
                while inner.hasNext():
                    each = inner.next()
                    found[each.getPath().toString()] = each.getLen()
        below += "/*"
    return [(p, n) for p, n in found.items() if n <= most]


def _read(batches):
    import pyarrow as pa
    from pyarrow import fs

    for b in batches:
        content = []
        for path in b.column(0).to_pylist():
            system, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
            with system.open_input_stream(name) as f:
                content.append(f.read())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(content, type=pa.binary())], ["path", "length", "content"])


def checkout(spark: SparkSession, root: str, most: int = MAX_FILE_BYTES, only: str | None = None, glob: str | None = None) -> DataFrame:
    """Files of root/group/repository: repo, file, language, size, text. Sizes are filtered before contents are read.

    Files whose names Spark's listing takes for hidden are listed apart and read by the executors.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    rows = reader.load(root).where(F.col("length") <= most).select("path", "length", "content")
    hidden = [] if glob else _hidden(spark, root, most)
    if hidden:
        rows = rows.unionByName(spark.createDataFrame(hidden, "path string, length long").repartition(max(1, len(hidden) // 200)).mapInArrow(_read, "path string, length long, content binary"))
    relative = F.regexp_replace(F.col("path"), r"^[a-z]+:/*", "/")
    rows = rows.withColumn("_p", F.split(F.substr(relative, F.lit(len(base) + 2)), "/")).where(F.size("_p") >= 3)
    rows = rows.select(F.concat_ws("/", F.col("_p")[0], F.col("_p")[1]).alias("repo"), F.array_join(F.slice("_p", F.lit(3), F.size("_p")), "/").alias("file"), F.col("length").alias("size"), "content")
    if only:
        rows = rows.where(F.contains("repo", F.lit(only)))
    kept = rows.where(~is_skipped(F.col("file")))
    return kept.select("repo", "file", language(F.col("file")).alias("language"), "size", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def screened(files: DataFrame, indicators: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Files to scan, and those passed over with the reason."""
    rows = files.withColumn("reason", skip_reason(F.col("text"), indicators))
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("repo", "file", "reason")


def scannable(files: DataFrame) -> DataFrame:
    """Source and configuration files that are no tests."""
    return files.where(F.col("language").isNotNull() & ~is_test_path(F.col("file")))


def indicators(spark: SparkSession, path: str) -> list[str]:
    """Words of an operator's list, one a line, # before comments."""
    rows = spark.read.text(path).select(F.trim("value").alias("w")).where("w != '' and not startswith(w, '#')")
    return [r["w"] for r in rows.limit(10_000).collect()]


def internal_patterns(spark: SparkSession, path: str | None = None, extra: list[str] | None = None, default: tuple[str, ...] = (r"^com\.acme\.",)) -> list[str]:
    """Patterns of the organisation's coordinates: a JSON list or {"patterns": [...]} of a file if there is one, else the default, and extra ones. A pattern that does not compile is an error."""
    import json
    import re

    patterns = list(default)
    if path:
        text = spark.read.text(path, wholetext=True).first()["value"]
        got = json.loads(text)
        patterns = list(got["patterns"] if isinstance(got, dict) else got)
    patterns += extra or []
    for p in patterns:
        re.compile(p)
    return patterns


def limits_hit(notes: DataFrame) -> DataFrame:
    """(limit, repos): how many repositories have notes (repo, note) of each limit that a scan ran into."""
    kinds = {"oversized line": "line length", "binary": "binary content", "matched configured indicator": "indicator", "parse failed": "parse", "timed out": "time"}
    hit = F.lit(None).cast("string")
    for text, kind in kinds.items():
        hit = F.when(F.contains("note", F.lit(text)), kind).otherwise(hit)
    return notes.withColumn("limit", hit).where("limit is not null").groupBy("limit").agg(F.count_distinct("repo").alias("repos"))


def build_systems(files: DataFrame) -> DataFrame:
    """Each repository's build systems by marker files at any depth."""
    name = F.element_at(F.split("file", "/"), -1)
    found = files.select("repo", F.element_at(F.create_map(*[F.lit(x) for kv in BUILD_MARKERS.items() for x in kv]), name).alias("system")).where("system is not null")
    return found.groupBy("repo").agg(F.sort_array(F.collect_set("system")).alias("build_systems"))


def frameworks(dependencies: DataFrame, tokens: dict[str, str]) -> DataFrame:
    """Each repository's frameworks: tokens that stand in a coordinate."""
    table = F.array(*[F.struct(F.lit(k).alias("token"), F.lit(v).alias("framework")) for k, v in tokens.items()])
    rows = dependencies.select("repo", F.lower(F.concat_ws(":", "group_id", "artifact_id")).alias("c"), F.explode(table).alias("t"))
    return rows.where(F.contains("c", F.col("t.token"))).groupBy("repo").agg(F.sort_array(F.collect_set("t.framework")).alias("frameworks"))


def unparsed_manifests(files: DataFrame) -> DataFrame:
    """A note for each manifest at a repository's top that no reader parses."""
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in UNPARSED_MANIFESTS.items() for x in kv]), F.col("file"))
    return files.select("repo", "file", kind.alias("kind")).where("kind is not null").select("repo", F.concat("file", F.lit(" present but "), "kind", F.lit(" dependencies are not parsed; the list is incomplete, not empty")).alias("note"))


def openapi_specs(files: DataFrame, most: int = 2_000_000) -> DataFrame:
    """target_repo, spec_path, paths, servers of OpenAPI documents."""
    name = F.element_at(F.split("file", "/"), -1)
    rows = files.where(name.isin(*OPENAPI_NAMES) & (F.col("size") <= most))
    found = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^\s{2,}(/[/\w{}.:$-]+)\s*:\s*$"), 1), lambda p: normalize_path(p))
    servers = F.regexp_extract_all("text", F.lit(r"(?im)^\s*-\s*url:\s*['\"]?(https?://[^'\"\s]+)"), 1)
    return rows.select(F.col("repo").alias("target_repo"), F.col("file").alias("spec_path"), F.array_sort(F.array_distinct(F.filter(found, lambda p: (p != "") & (p != "/")))).alias("paths"), F.slice(servers, 1, 5).alias("servers"))


def helm_hosts(files: DataFrame, most: int = 500_000) -> DataFrame:
    """(target_repo, host): hosts that Helm values name, without templates."""
    rows = files.where(F.element_at(F.split("file", "/"), -1).isin(*HELM_NAMES) & (F.col("size") <= most))
    found = F.regexp_extract_all("text", F.lit(r"(?im)^\s*(?:host|hostname|externalHost|ingress\.host)\s*:\s*['\"]?([^\s#'\"]+)"), 1)
    return rows.select(F.col("repo").alias("target_repo"), F.explode(found).alias("host")).where("host != '' and not startswith(host, '{{')").distinct()


def records(spark: SparkSession, path: str) -> DataFrame:
    """Repository records of JSON files, one a file; malformed ones and other schema versions are left out."""
    schema = T.StructType([*RECORD.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return rows.where(F.col("_corrupt_record").isNull() & (F.col("schema_version") == SCHEMA_VERSION)).drop("_corrupt_record")


def nodes(rows: DataFrame) -> DataFrame:
    """Nodes of records, tagged with group/name and their place in the record."""
    return rows.select(F.concat_ws("/", "group", "name").alias("_repo"), F.posexplode("nodes").alias("ord", "n")).select("ord", "n.*", "_repo").drop("repo").withColumnRenamed("_repo", "repo")


def edges(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("/", "group", "name").alias("repo"), F.explode("edges").alias("e")).select("repo", "e.*")


def dependencies(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("/", "group", "name").alias("repo"), F.posexplode("dependencies_internal").alias("ord", "d")).select("repo", "ord", F.col("d.groupId").alias("group_id"), F.col("d.artifactId").alias("artifact_id"), "d.version", "d.version_kind", "d.kind", "d.resolution")


def bindings(spark: SparkSession, path: str, allow_none: bool = False) -> DataFrame:
    """Client bindings of a configuration file; none at all is an error unless allowed."""
    schema = "bindings array<struct<target_repo:string,maven_artifact:string,import_prefix:string,paths:array<string>,payload_fields:array<string>,service_aliases:array<string>,class_patterns:array<string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("bindings").alias("b")).select("b.*").where("coalesce(target_repo, '') != ''")
    if not allow_none and rows.isEmpty():
        raise ValueError(f"no client bindings in {path}")
    return rows


def library_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("coordinate string, clone_path string, status string, consumers long, versions array<string>, notes string").json(path)
