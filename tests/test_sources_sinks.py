import json

from pyspark.sql import functions as F

from tracelake.operators.inventory import queue_graph
from tracelake.schema import RECORD
from tracelake.sinks import catalogs
from tracelake.sources import files, manifests
from tracelake.streaming import records as stream

POM = "<project><groupId>com.acme</groupId><artifactId>{a}</artifactId><version>1</version>{x}</project>"


def tree(tmp_path, content):
    for name, text in content.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(tmp_path)


def test_checkout(spark, tmp_path):
    root = tree(tmp_path, {"g/r/src/A.java": "class A {}", "g/r/node_modules/x.js": "1", "g/r/.github/ci.yml": "a: b", "g/r/.hidden/x.py": "1", "g/r/src/latest/b.go": "package b", "g/r/src/test/T.java": "x", "g/s/bad.py": b"\xff\xfe ok", "g/s/big.py": "x" * 100, "g/s/pkg/__init__.py": "x = 1", "g/s/__pycache__/y.py": "1"})
    got = files.checkout(spark, root, most=50)
    assert sorted((r["repo"], r["file"], r["language"]) for r in got.collect()) == [("g/r", ".github/ci.yml", "config"), ("g/r", "src/A.java", "java"), ("g/r", "src/latest/b.go", "go"), ("g/r", "src/test/T.java", "java"), ("g/s", "bad.py", "python"), ("g/s", "pkg/__init__.py", "python")]
    assert "�" in got.where("file = 'bad.py'").first()["text"]
    assert "src/test/T.java" not in [r["file"] for r in files.scannable(got).collect()]
    assert files.checkout(spark, root, only="g/s").select("repo").distinct().count() == 1
    ok, skipped = files.screened(files.checkout(spark, root), ["CLASS a"])
    assert [r["file"] for r in skipped.collect() if r["reason"].startswith("matched")] == ["src/A.java"]


def test_test_paths(spark):
    cases = {"src/latest/x.go": False, "src/FooTest/x.java": True, "a/handler_test.go": True, "openapi.spec.yaml": False, "x/routes.spec.ts": True, "test/x.py": True, "protest/x.py": False}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", files.is_test_path(F.col("p")).alias("t")).collect()
    assert {r["p"]: r["t"] for r in rows} == cases


def test_manifests(spark, tmp_path):
    root = tree(
        tmp_path,
        {
            "g/r/build.gradle": "implementation 'com.acme:a:1.0'\napi(\"com.acme:b\")\nimplementation libs.stock.client\nimplementation(libs.none)",
            "g/r/gradle/libs.versions.toml": "[libraries]\nstock-client = { module = \"com.acme:stock-client\", version = \"1\" }\n",
            "g/go/go.mod": "module x\nrequire github.com/a/b v1.2.0\nrequire (\n  github.com/c/d v0.1.0 // indirect\n)\n",
            "g/py/pyproject.toml": '[project]\ndependencies = ["requests>=2", "plain", "locked"]\n',
            "g/py/uv.lock": '[[package]]\nname = "locked"\nversion = "9"\n',
            "g/bad/pyproject.toml": "[project",
            "g/js/package.json": json.dumps({"dependencies": {"x": "^1", "y": "2"}}),
            "g/js/package-lock.json": json.dumps({"packages": {"node_modules/x": {"version": "1.5"}}}),
            "g/rs/Cargo.toml": "[package]",
            "g/m/pom.xml": POM.format(a="parent", x="<properties><v>7</v></properties><dependencyManagement><dependencies><dependency><groupId>o</groupId><artifactId>managed</artifactId><version>${v}</version></dependency></dependencies></dependencyManagement>"),
            "g/m/child/pom.xml": POM.format(a="child", x="<parent><groupId>com.acme</groupId><artifactId>parent</artifactId><version>1</version></parent><dependencies><dependency><groupId>o</groupId><artifactId>managed</artifactId></dependency><dependency><groupId>o</groupId><artifactId>p</artifactId><version>${v}</version></dependency><dependency><groupId>o</groupId><artifactId>lit</artifactId><version>3</version></dependency><dependency><groupId>o</groupId><artifactId>gone</artifactId></dependency></dependencies>"),
            "g/m/bad/pom.xml": "<!DOCTYPE x><project/>",
        },
    )
    src = files.checkout(spark, root)
    assert sorted((r["artifact_id"], r["version"]) for r in manifests.gradle(src).collect()) == [("a", "1.0"), ("b", "")]
    hit, missed = manifests.gradle_catalog(src)
    assert [r["artifact_id"] for r in hit.collect()] == ["stock-client"] and missed.first()["n_unresolved"] == 1
    assert sorted((r["artifact_id"], r["version"]) for r in manifests.go(src).collect()) == [("github.com/a/b", "v1.2.0"), ("github.com/c/d", "v0.1.0")]
    py = manifests.python(src).collect()
    assert sorted((r["artifact_id"], r["version"], r["version_kind"]) for r in py if not r["note"]) == [("locked", "9", "resolved"), ("plain", "", "unresolved"), ("requests", ">=2", "range")]
    assert [r["repo"] for r in py if r["note"]] == ["g/bad"]
    assert sorted((r["artifact_id"], r["version_kind"]) for r in manifests.npm(src).collect()) == [("x", "resolved"), ("y", "range")]
    assert files.unparsed_manifests(src).count() == 1
    pom = {r["artifact_id"]: (r["version"], r["resolution"]) for r in manifests.maven(src).collect()}
    assert pom == {"managed": ("7", "parent-in-repo"), "p": ("7", "parent-in-repo"), "lit": ("3", "literal"), "gone": ("", "unresolved")}


def test_openapi_and_helm(spark, tmp_path):
    root = tree(tmp_path, {"g/r/openapi.yaml": "servers:\n  - url: https://a.b/c\npaths:\n  /v1/x/{id}:\n    get: {}\n  /:\n", "g/r/values.yaml": "host: svc.local\nhostname: {{ x }}\n"})
    src = files.checkout(spark, root)
    spec = files.openapi_specs(src).first()
    assert spec["paths"] == ["/v1/x/{}"] and spec["servers"] == ["https://a.b/c"]
    assert [r["host"] for r in files.helm_hosts(src).collect()] == ["svc.local"]


def record(name, sha="a", at="1", family="sql"):
    return {"schema_version": 2, "detection_version": 19, "derivation_version": 6, "group": "g", "name": name, "git_sha": sha, "analysed_at": at, "nodes": [{"family": family, "kind": "sink", "file": "F", "line": 1, "detail": {"raw": "x"}}], "notes": ["parse failed: F"]}


def test_records(spark, tmp_path):
    root = tree(tmp_path, {"repos/g/a.json": json.dumps(record("a")), "repos/g/b.json": json.dumps(record("b") | {"schema_version": 1}), "repos/g/c.json": "{broken"})
    got = files.records(spark, f"{root}/repos/*/*.json")
    assert [r["name"] for r in got.collect()] == ["a"]
    assert [(r["repo"], r["family"]) for r in files.nodes(got).collect()] == [("g/a", "sql")]
    m = json.loads(catalogs.manifest(got, catalogs.Timing(), tool="x"))
    assert m["unparsed_files"] == 1 and m["repos"] == 1


def test_index_and_catalogues(spark, tmp_path):
    edges = spark.createDataFrame([("g/a", "g/b"), ("g/c", "g/b")], "source_repo string, target_repo string")
    catalogs.write_index({"call_edge": edges}, str(tmp_path / "ix"), "sig")
    assert catalogs.open_index(spark, str(tmp_path / "ix"), "other", "call_edge") is None
    assert catalogs.open_index(spark, str(tmp_path / "none"), "sig") is None
    assert catalogs.open_index(spark, str(tmp_path / "ix"), "sig", "call_edge")["call_edge"].count() == 2
    nodes = spark.createDataFrame([("sql", "sink", None, "mail a@b.cd"), ("pii-log", "sink", None, "x")], "family string, kind string, execution boolean, raw string")
    catalogs.write_catalogues(nodes, str(tmp_path / "cat"))
    back = spark.read.json(str(tmp_path / "cat"))
    assert sorted((r["catalogue"], r["raw"]) for r in back.collect()) == [("pii-sinks", "x"), ("sql-sinks", "mail <redacted-email>")]


def test_markdown(spark):
    graph = queue_graph(spark.createDataFrame([("queue-pub", "kafka", "a|b", "g/a")], "family string, system string, topic string, repo string"))
    t = catalogs.markdown_table(graph.select("topic", "producers"), ["topic"], 5)
    assert "a\\|b" in t
    assert 't0(["ab"])' in catalogs.mermaid_topics(graph)
    first = catalogs.merged_with_manual(None, "one")
    assert catalogs.merged_with_manual("top\n" + first + "tail", "two") == "top\n" + first.replace("one", "two") + "tail"


def test_stream_keeps_the_newest(spark, tmp_path):
    inbox, table, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps(record(n)) for n in ("a", "b")))
    stream.upsert(stream.record_stream(spark, inbox), table, mark, buckets=4).awaitTermination(120)
    (tmp_path / "in/2.json").write_text(json.dumps(record("a", sha="new", at="2")))
    stream.upsert(stream.record_stream(spark, inbox), table, mark, buckets=4).awaitTermination(120)
    got = spark.read.parquet(table)
    assert sorted((r["name"], r["git_sha"]) for r in got.collect()) == [("a", "new"), ("b", "a")]
    now = spark.createDataFrame([("g/a", "new"), ("g/b", "changed")], "repo string, git_sha string")
    assert [r["repo"] for r in stream.pending(now, got, 19, 6).collect()] == ["g/b"]
    counts = stream.running_counts(spark.read.schema(RECORD).json(inbox))
    assert counts.first()["n"] == 3
