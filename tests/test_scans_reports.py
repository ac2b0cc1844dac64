from pyspark.sql import functions as F

from tracelake.operators.fleet import resolve_coordinates
from tracelake.sinks import reports
from tracelake.sources import scans

SCHEMA = "repo string, file string, language string, size long, text string"


def table(spark, rows):
    return spark.createDataFrame([(r, f, None, len(t), t) for r, f, t in rows], SCHEMA)


def test_identities(spark):
    rows = [
        ("g/m", "pom.xml", "<project><parent><groupId>pg</groupId><artifactId>pa</artifactId></parent><artifactId>own</artifactId><dependencies><dependency><groupId>x</groupId><artifactId>y</artifactId></dependency></dependencies></project>"),
        ("g/g", "settings.gradle", "rootProject.name = 'gr'"),
        ("g/g", "gradle.properties", "group = com.acme\n"),
        ("g/n", "web/package.json", '{"name": "@s/web"}'),
        ("g/p", "pyproject.toml", '[build]\nx = 1\n[project]\nversion = "1"\nname = "dist"\n'),
        ("g/p", "setup.cfg", "[metadata]\nname = cfg\n"),
        ("g/c", "Cargo.toml", '[package]\nname = "crate"\n'),
        ("g/o", "composer.json", '{"name": "v/pkg"}'),
        ("g/go", "go.mod", "module github.com/a/b\n"),
        ("g/d", "src/My.App.csproj", "<Project/>"),
        ("g/r", "x.gemspec", "s.name = 'gem'"),
        ("g/z", "package.json", "{broken"),
    ]
    got = {(r["ecosystem"], r["group_id"], r["artifact_id"], r["clone_path"]) for r in scans.identities(table(spark, rows)).collect()}
    assert got == {
        ("maven", "pg", "own", "g/m"), ("gradle", "com.acme", "gr", "g/g"), ("npm", "", "@s/web", "g/n/web"), ("python", "", "dist", "g/p"), ("python", "", "cfg", "g/p"),
        ("cargo", "", "crate", "g/c"), ("composer", "v", "pkg", "g/o"), ("go", "", "github.com/a/b", "g/go"), ("dotnet", "", "My.App", "g/d/src"), ("ruby", "", "gem", "g/r"),
    }
    wanted = spark.createDataFrame([("pg", "own"), ("other", "gem"), ("a", "b")], "group_id string, artifact_id string")
    tiers = {r["artifact_id"]: r["tier"] for r in resolve_coordinates(wanted, scans.identities(table(spark, rows))).collect()}
    assert tiers == {"own": "coordinate", "gem": "unique-name", "b": "unresolved"}


def test_producers_and_literals(spark):
    rows = [("g/a", "A.java", 'import com.acme.stock.Client;\nString u = "http://stock-api/v1?mail=a@b.cd";'), ("g/a", "build.gradle", "implementation 'com.acme:stock-client:1'"), ("g/stock", "S.java", "import com.acme.stock.X; \"stock-api\""), ("g/b", "b.md", '"stock-api"')]
    bindings = spark.createDataFrame([("g/stock", "stock-client", "com.acme.stock"), ("g/none", "", "")], "target_repo string, maven_artifact string, import_prefix string")
    got = {(r["source_repo"], r["target_repo"], r["kind"]) for r in scans.producer_imports(table(spark, rows), bindings).collect()}
    assert got == {("g/a", "g/stock", "import"), ("g/a", "g/stock", "build")}
    hits = scans.literal_hits(table(spark, rows), "g/stock", ["STOCK-api", ""]).collect()
    assert [(r["source_repo"], r["ref"]) for r in hits] == [("g/a", "A.java:2")] and "<redacted-email>" in hits[0]["evidence"]
    assert scans.literal_hits(table(spark, rows), "g/stock", []).collect() == []


def test_public_api(spark):
    rows = [("g/lib", "src/L.java", "  public void run(String sql) {}\n  public int size() { return 1; }\n  public String toString() { }\n"), ("g/lib", "test/T.java", "  public void t() {}\n")]
    got = scans.java_public_api(table(spark, rows))
    assert {(r["signature"], r["sink_type"]) for r in got.collect()} == {("run(String sql)", "sql"), ("size()", "opaque")}
    old = "# lib\n\n| a |\n| --- |\n| _TBD_ |\nnotes\n"
    new = reports.curated_library(old, got, "g/lib")
    assert "run(String sql)" in new and new.endswith("notes\n") and "_TBD_" not in new
    assert reports.curated_library("no table", got, "g/lib") == "no table"


def test_commits(spark):
    sha, other = "a" * 40, "b" * 40
    rows = [("g/a", ".git/HEAD", sha), ("g/b", ".git/HEAD", "ref: refs/heads/main\n"), ("g/b", ".git/refs/heads/main", other + "\n"), ("g/c", ".git/HEAD", "ref: refs/heads/x"), ("g/c", ".git/packed-refs", f"# pack\n{sha} refs/heads/x\n"), ("g/d", ".git/HEAD", "nonsense")]
    got = {r["repo"]: r["git_sha"] for r in scans.commits(table(spark, rows)).collect()}
    assert got == {"g/a": sha, "g/b": other, "g/c": sha, "g/d": None}


def test_trace_pages(spark, tmp_path):
    facts = spark.createDataFrame([("g/t", 1, 2, 3)], "repo string, n_inbound long, n_sql_sinks long, n_stores long")
    up = spark.createDataFrame([("g/t", "g/a", "graph", "high", "x|y"), ("g/t", "g/b", "graph", "low", "z"), ("g/o", "g/c", "graph", "low", "z")], "target_repo string, source_repo string, kind string, confidence string, evidence string")
    text = reports.trace_page("g/t", "/v1", facts, up)
    assert "x\\|y" in text and "g/c" not in text
    (tmp_path / "t.md").write_text(text)
    assert [tuple(r) for r in reports.trace_headers(spark, str(tmp_path)).collect()] == [("g/t", "/v1", 2)]
    (tmp_path / "c.jsonl").write_text('{"repo": "g/t", "endpoint_path": "/a"}\n{"repo": "g/t", "endpoint_path": "/a"}\n{}\n')
    assert reports.catalogue_targets(spark, str(tmp_path / "c.jsonl")).select(F.concat("repo", "endpoint_path")).first()[0] == "g/t/a"


def test_repo_page_and_limits(spark, tmp_path):
    from tracelake.sources import files

    nodes = spark.createDataFrame([("g/t", "sql", "sink", "F", 1, "high", "mail a@b.cd | x")], "repo string, family string, kind string, file string, line int, confidence string, raw string")
    text = reports.repo_page("g/t", nodes, "by hand")
    assert "<redacted-email> \\| x" in text and text.endswith("by hand")
    notes = spark.createDataFrame([("a", "parse failed: X"), ("a", "parse failed: Y"), ("b", "oversized line (> 5)"), ("c", "fine")], "repo string, note string")
    assert {(r["limit"], r["repos"]) for r in files.limits_hit(notes).collect()} == {("parse", 1), ("line length", 1)}
    (tmp_path / "p.json").write_text('{"patterns": ["^org[.]own"]}')
    assert files.internal_patterns(spark, str(tmp_path / "p.json"), ["x"]) == ["^org[.]own", "x"]


def test_config_keys_name_targets(spark):
    from tracelake.operators.calls import service_edges

    nodes = spark.createDataFrame(
        [("g/a", "F", 1, 1, "http-out", "sink", None, None, "call()", None, "app.stock.url", None), ("g/a", "F", 2, 2, "http-out", "sink", None, None, "call()", None, "none.known", None)],
        "repo string, file string, line int, ord long, family string, kind string, path string, host string, raw string, target_repo string, config_key string, client string",
    )
    repos = spark.createDataFrame([("g/a", "a", 1), ("g/stock", "stock", 2)], "repo string, name string, ord long")
    edges, broken = service_edges(nodes, repos)
    assert [(r["target_repo"], r["target_path"], r["confidence"]) for r in edges.collect()] == [("g/stock", "*", "medium")]
    assert [r["ref"] for r in broken.collect()] == ["F:2"]


def test_small_tables(spark):
    from pyspark.sql import functions as F

    from tracelake.functions import fields, paths, text
    from tracelake.sinks import catalogs
    from tracelake.sources import files

    marks = spark.createDataFrame([("g/a", "pom.xml"), ("g/a", "x/package.json"), ("g/b", "README.md")], "repo string, file string")
    assert {(r["repo"], tuple(r["build_systems"])) for r in files.build_systems(marks).collect()} == {("g/a", ("maven", "npm"))}
    deps = spark.createDataFrame([("g/a", "com.acme.x", "lib", "1"), ("g/b", "com.acme.x", "lib", "2"), ("g/b", "org.apache.y", "z", "1")], "repo string, group_id string, artifact_id string, version string")
    assert [tuple(r["frameworks"]) for r in files.frameworks(deps, {"apache": "apache"}).collect()] == [("apache",)]
    found = spark.createDataFrame([("com.acme.x", "lib", "g/lib")], "group_id string, artifact_id string, clone_path string")
    own = catalogs.library_map(deps, found, None, ["^com[.]acme"])
    assert [(r["coordinate"], r["clone_path"], r["consumers"], r["status"]) for r in own.collect()] == [("com.acme.x:lib", "g/lib", 2, "pending")]
    before = spark.createDataFrame([("com.acme.x:lib", "by/hand", "accepted", "n")], "coordinate string, clone_path string, status string, notes string")
    kept = catalogs.library_map(deps, found, before, ["^com[.]acme"]).first()
    assert (kept["clone_path"], kept["status"], kept["versions"]) == ("by/hand", "accepted", ["1", "2"])
    one = spark.createDataFrame([("org.acme.t:lib-a", "a\nb\nc", 4)], "c string, t string, at int")
    got = one.select(paths.clone_path(F.col("c")).alias("p"), text.line_of_offset(F.col("t"), F.col("at")).alias("n"), fields.is_internal(F.col("c"), ["acme"]).alias("i")).first()
    assert (got["p"], got["n"], got["i"]) == ("t/lib-a", 3, True)
