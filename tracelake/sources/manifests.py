"""Dependencies that manifests declare: Maven, Gradle and its catalogs, Go, Python, npm."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.storage import stored

SCHEMA = "repo string, file string, group_id string, artifact_id string, version string, version_kind string, note string"
PROPERTY_HOPS, PARENT_HOPS = 8, 6

GRADLE = r"(?:implementation|api|compile|runtimeOnly|testImplementation)\s*[\(\s]+[\"']([A-Za-z0-9_.\-]+):([A-Za-z0-9_.\-]+)(?::([A-Za-z0-9_.\-+]+))?"
CATALOG_TOML = r"(?m)^\s*([A-Za-z0-9_.\-]{1,120})\s*=\s*\{[^}\n]{0,200}?module\s*=\s*[\"']([A-Za-z0-9_.\-]{1,120}):([A-Za-z0-9_.\-]{1,120})[\"']"
CATALOG_DSL = r"library\(\s*[\"']([A-Za-z0-9_.\-]{1,120})[\"']\s*,\s*[\"']([A-Za-z0-9_.\-]{1,120})[\"']\s*,\s*[\"']([A-Za-z0-9_.\-]{1,120})[\"']"
CATALOG_REF = r"\b(?:implementation|api|compile|runtimeOnly|testImplementation|compileOnly)\s*[\(\s]\s*libs\.([A-Za-z0-9_.]{1,120})"
REQUIREMENT = re.compile(r"\s*([A-Za-z0-9][A-Za-z0-9._\-]{0,120})\s*([<>=!~^][^;#]{0,120})?")


def _name(path: str = "file"):
    return F.element_at(F.split(path, "/"), -1)


def gradle(files: DataFrame) -> DataFrame:
    """Coordinates that build scripts spell out."""
    rows = files.where(_name().isin("build.gradle", "build.gradle.kts"))
    text = F.explode(F.regexp_extract_all("text", F.lit(f"({GRADLE})"), 1)).alias("m")
    version = F.regexp_extract("m", GRADLE, 3)
    return rows.select("repo", "file", text).select("repo", "file", F.regexp_extract("m", GRADLE, 1).alias("group_id"), F.regexp_extract("m", GRADLE, 2).alias("artifact_id"), version.alias("version"), F.when(version == "", "unresolved").otherwise("resolved").alias("version_kind"), F.lit(None).cast("string").alias("note"))


def alias_key(alias):
    return F.lower(F.regexp_replace(alias, "[-._]", ""))


def gradle_catalog(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Coordinates that build scripts name by a catalog's alias, and for each repository how many aliases no catalog has."""
    catalogs = files.where(F.col("file").rlike(r"\.versions\.toml$") | _name().isin("settings.gradle", "settings.gradle.kts"))
    entries = None
    for rx in (CATALOG_TOML, CATALOG_DSL):
        found = catalogs.select("repo", "file", F.posexplode(F.regexp_extract_all("text", F.lit(f"({rx})"), 1)).alias("at", "m"))
        got = found.select("repo", "file", "at", *[F.regexp_extract("m", rx, k).alias(n) for k, n in ((1, "alias"), (2, "group_id"), (3, "artifact_id"))])
        entries = got if entries is None else entries.unionByName(got)
    table = entries.withColumn("key", alias_key(F.col("alias"))).groupBy("repo", "key").agg(F.min_by(F.struct("group_id", "artifact_id"), F.struct("file", "at")).alias("c"))
    refs = files.where(_name().isin("build.gradle", "build.gradle.kts")).select("repo", "file", F.explode(F.regexp_extract_all("text", F.lit(CATALOG_REF), 1)).alias("alias")).withColumn("key", alias_key(F.col("alias")))
    hit = refs.join(table, ["repo", "key"]).select("repo", "file", "c.group_id", "c.artifact_id", F.lit("").alias("version"), F.lit("unresolved").alias("version_kind"), F.lit(None).cast("string").alias("note"))
    missed = refs.join(table, ["repo", "key"], "left_anti").groupBy("repo").agg(F.count(F.lit(1)).alias("n_unresolved"))
    return hit, missed


def go(files: DataFrame) -> DataFrame:
    """Modules that go.mod requires, in blocks or on lines of their own."""
    rows = files.where(_name() == "go.mod")
    blocks = F.array_join(F.regexp_extract_all("text", F.lit(r"(?s)\brequire\s*\(([^)]*)\)"), 1), "\n")
    lines = F.array_join(F.regexp_extract_all("text", F.lit(r"(?m)^\s*require\s+([^\s(]+\s+v\S+)"), 1), "\n")
    found = F.regexp_extract_all(F.concat(blocks, F.lit("\n"), lines), F.lit(r"(?m)^\s*([^\s/][^\s]*\s+v\S+)"), 1)
    m = rows.select("repo", "file", F.explode(found).alias("m"))
    return m.select("repo", "file", F.lit("").alias("group_id"), F.regexp_extract("m", r"^(\S+)", 1).alias("artifact_id"), F.regexp_extract("m", r"\s(v\S+)", 1).alias("version"), F.lit("resolved").alias("version_kind"), F.lit(None).cast("string").alias("note"))


def _python(texts: dict[str, str]) -> Iterator[tuple]:
    locked: dict[str, str] = {}
    for name in ("uv.lock", "poetry.lock"):
        if name in texts:
            try:
                locked = {str(p["name"]): str(p.get("version", "")) for p in tomllib.loads(texts[name]).get("package", []) if p.get("name")}
                break
            except tomllib.TOMLDecodeError as e:
                yield (name, "", "", "", "", f"{name} is present but could not be parsed ({type(e).__name__}); versions are ranges")
    if "pyproject.toml" not in texts:
        return
    try:
        project = tomllib.loads(texts["pyproject.toml"]).get("project") or {}
    except tomllib.TOMLDecodeError as e:
        yield ("pyproject.toml", "", "", "", "", f"pyproject.toml is present but could not be parsed ({type(e).__name__}); dependencies are incomplete")
        return
    for requirement in project.get("dependencies") or []:
        if m := REQUIREMENT.match(str(requirement)):
            spec = (m[2] or "").strip()
            yield ("pyproject.toml", "", m[1], locked.get(m[1], spec), "resolved" if m[1] in locked else "range" if spec else "unresolved", None)


def _npm(texts: dict[str, str]) -> Iterator[tuple]:
    locked: dict[str, str] = {}
    if "package-lock.json" in texts:
        try:
            lock = json.loads(texts["package-lock.json"])
            entries = [(k.split("node_modules/", 1)[1], v) for k, v in (lock.get("packages") or {}).items() if k.startswith("node_modules/")]
            for name, entry in [*entries, *(lock.get("dependencies") or {}).items()]:
                if name and (entry or {}).get("version"):
                    locked.setdefault(name, str(entry["version"]))
        except ValueError as e:
            yield ("package-lock.json", "", "", "", "", f"package-lock.json is present but could not be parsed ({type(e).__name__}); versions are ranges")
    if "package.json" not in texts:
        return
    try:
        manifest = json.loads(texts["package.json"])
    except ValueError as e:
        yield ("package.json", "", "", "", "", f"package.json is present but could not be parsed ({type(e).__name__}); dependencies are incomplete")
        return
    for section in ("dependencies", "devDependencies"):
        for name, spec in (manifest.get(section) or {}).items():
            yield ("package.json", "", name, locked.get(name, str(spec)), "resolved" if name in locked else "range", None)


def _parsed(files: DataFrame, names: tuple[str, ...], parse) -> DataFrame:
    """A parser over the manifests of each directory: a handful of capped files together."""
    rows = files.where(_name().isin(*names)).withColumn("dir", F.regexp_replace("file", r"[^/]+$", ""))
    grouped = rows.groupBy("repo", "dir").agg(F.map_from_entries(F.collect_set(F.struct(_name().alias("k"), F.col("text").alias("v")))).alias("texts"))

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                out += [(r["repo"], r["dir"] + got[0], *got[1:]) for got in parse(dict(r["texts"]))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.string()) for c in zip(*out, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return grouped.mapInArrow(run, SCHEMA)


def python(files: DataFrame) -> DataFrame:
    return _parsed(files, ("pyproject.toml", "uv.lock", "poetry.lock"), _python)


def npm(files: DataFrame) -> DataFrame:
    return _parsed(files, ("package.json", "package-lock.json"), _npm)


def _pom(text: str) -> dict | None:
    """What a POM says; None if it is malformed or declares entities."""
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        return None
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return None
    strip = lambda t: t.rsplit("}", 1)[-1]
    child = lambda e, n: next((c for c in e if strip(c.tag) == n), None)
    value = lambda e, n: ((child(e, n).text or "").strip() if e is not None and child(e, n) is not None else "")
    listed = lambda e: [d for d in (e if e is not None else []) if strip(d.tag) == "dependency"]
    parent, management = child(root, "parent"), child(root, "dependencyManagement")
    coordinate = lambda d: tuple(value(d, n) for n in ("groupId", "artifactId", "version"))
    return {
        "parent": coordinate(parent) if parent is not None else None,
        "group": value(root, "groupId") or value(parent, "groupId"), "artifact": value(root, "artifactId"), "version": value(root, "version") or value(parent, "version"),
        "properties": {strip(p.tag): (p.text or "").strip() for p in (child(root, "properties") if child(root, "properties") is not None else [])},
        "managed": {(d[0], d[1]): d[2] for d in map(coordinate, listed(child(management, "dependencies") if management is not None else None))},
        "declared": [coordinate(d) for d in listed(child(root, "dependencies"))],
    }


def maven(files: DataFrame) -> DataFrame:
    """Dependencies of POMs with versions resolved through properties, managed versions and parents (of the repository, else of the fleet).

    Each POM is parsed once to a row; parents are then joined level by level, PARENT_HOPS deep, and the inherited properties and
    managed versions are maps that the nearest POM wins in. `resolution` tells where a version came from.
    """
    poms = files.where(_name() == "pom.xml").select("repo", "file", "text")
    fields = "repo string, file string, grp string, artifact string, version string, parent_group string, parent_artifact string, properties map<string,string>, managed map<string,string>, declared array<struct<g:string,a:string,v:string>>"

    def run(batches):
        kinds = [pa.string()] * 7 + [pa.map_(pa.string(), pa.string())] * 2 + [pa.list_(pa.struct([("g", pa.string()), ("a", pa.string()), ("v", pa.string())]))]
        names = re.findall(r"(\w+) (?:string|map<[^>]*>|array<.*>)(?:, |$)", fields)
        for b in batches:
            out = []
            for r in b.to_pylist():
                if p := _pom(r["text"] or ""):
                    own = p["properties"] | {"project.version": p["version"], "project.groupId": p["group"], "version": p["version"]}
                    out.append((r["repo"], r["file"], p["group"], p["artifact"], p["version"], p["parent"][0] if p["parent"] else None, p["parent"][1] if p["parent"] else None, list(own.items()), [(f"{g}:{a}", v) for (g, a), v in p["managed"].items()], [{"g": g, "a": a, "v": v} for g, a, v in p["declared"]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    # Each level stands on its own: lineage that refers to the level before twice would double with every level.
    parsed = stored(poms.mapInArrow(run, fields), "poms")
    known = parsed.select(F.col("grp").alias("k_group"), F.col("artifact").alias("k_artifact"), F.col("repo").alias("k_repo"), F.col("file").alias("k_file"), F.col("properties").alias("k_properties"), F.col("managed").alias("k_managed"), F.col("parent_group").alias("k_pg"), F.col("parent_artifact").alias("k_pa"))
    rows = parsed.withColumn("tier", F.lit("literal"))
    merge = lambda near, far: F.map_concat(F.map_filter(far, lambda k, _: ~F.map_contains_key(near, k)), near)
    for _ in range(PARENT_HOPS):
        if rows.where("parent_artifact is not null").isEmpty():
            break
        met = rows.join(known, (F.col("parent_group") == F.col("k_group")) & (F.col("parent_artifact") == F.col("k_artifact")), "left")
        # A parent of the same repository comes before one of the fleet, then by name.
        best = met.groupBy("repo", "file").agg(F.min_by(F.struct("k_properties", "k_managed", "k_pg", "k_pa", "k_repo"), F.struct(F.col("k_repo") != F.col("repo"), F.col("k_repo"), F.col("k_file"))).alias("p"))
        rows = rows.join(best, ["repo", "file"], "left")
        found = F.col("p.k_repo").isNotNull()
        rows = stored(rows.select(
            "repo", "file", "grp", "artifact", "version", F.when(found, F.col("p.k_pg")).alias("parent_group"), F.when(found, F.col("p.k_pa")).alias("parent_artifact"),
            F.when(found, merge(F.col("properties"), F.col("p.k_properties"))).otherwise(F.col("properties")).alias("properties"),
            F.when(found, merge(F.col("managed"), F.col("p.k_managed"))).otherwise(F.col("managed")).alias("managed"), "declared",
            F.when(found & (F.col("p.k_repo") == F.col("repo")), "parent-in-repo").when(found, "parent-in-fleet").otherwise(F.col("tier")).alias("tier"),
        ), "poms")
    d = rows.select("repo", "file", "properties", "managed", "tier", F.explode("declared").alias("d"))

    def expanded(value):
        def hop(text, _):
            key = F.regexp_extract(text, r"\$\{([^}]+)\}", 1)
            return F.when((key != "") & F.map_contains_key("properties", key), F.replace(text, F.concat(F.lit("${"), key, F.lit("}")), F.element_at("properties", key))).otherwise(text)

        return F.aggregate(F.sequence(F.lit(1), F.lit(PROPERTY_HOPS)), value, hop)

    group = expanded(F.col("d.g"))
    d = d.withColumn("group_id", group).withColumn("raw", F.when(F.col("d.v") != "", F.col("d.v")).otherwise(F.coalesce(F.element_at("managed", F.concat_ws(":", group, F.col("d.a"))), F.lit(""))))
    d = d.withColumn("version", expanded(F.col("raw")))
    resolved = (F.col("version") != "") & ~F.contains("version", F.lit("${"))
    how = F.when(~resolved, "unresolved").when(F.col("d.v") == F.col("version"), "literal").when(F.col("d.v") != "", F.when(F.col("tier") == "literal", "property").otherwise(F.col("tier"))).otherwise(F.when(F.col("tier") == "literal", "managed").otherwise(F.col("tier")))
    return d.select("repo", "file", "group_id", F.col("d.a").alias("artifact_id"), F.when(resolved, F.col("version")).otherwise("").alias("version"), F.when(resolved, "resolved").otherwise("unresolved").alias("version_kind"), how.alias("resolution"))
