"""A small fleet from checkout to reports, and what can be asked of it afterwards."""

import json

import pytest

from tracelake.extractors.scan import Binding
from tracelake.plans import build

FLEET = {
    "shop/runner/pom.xml": "<project><groupId>com.acme</groupId><artifactId>runner-client</artifactId><version>1</version></project>",
    "shop/runner/src/Api.java": """import org.springframework.jdbc.core.JdbcTemplate;
class Api {
  private RunnerService service;
  @PostMapping("/v1/jobs/execute")
  public String run(String sql) { return service.run(sql); }
}
""",
    "shop/runner/src/RunnerService.java": """class RunnerService {
  private JdbcTemplate jdbcTemplate;
  private String sql = "SELECT * FROM jobs WHERE id = ?";
  public void run(String sql) { jdbcTemplate.execute(sql); }
}
""",
    "shop/caller/pom.xml": "<project><groupId>com.acme</groupId><artifactId>caller</artifactId><version>1</version><dependencies><dependency><groupId>com.acme</groupId><artifactId>runner-client</artifactId><version>1</version></dependency></dependencies></project>",
    "shop/caller/src/Caller.java": """class Caller {
  void go(String email) { restTemplate.postForObject("https://runner.prod.local/v1/jobs/execute", email, String.class); }
  void tell(String phoneNumber) { kafkaTemplate.send("updates", phoneNumber); }
}
""",
    "shop/listener/app.py": """class Listener:
    @app.get("/items")
    def items(self, email):
        return email
""",
    "shop/listener/old.py": 'import requests\nprint "old"\nrequests.get("https://runner.prod.local/v1/jobs/execute")\n',
    "shop/listener/src/In.java": 'class In {\n  @KafkaListener(topics = "updates")\n  void take(String phone) { }\n}\n',
    "shop/listener/application.properties": "spring.datasource.url=jdbc:postgresql://db1:5432/app\n",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root, out = tmp_path_factory.mktemp("fleet"), str(tmp_path_factory.mktemp("out"))
    for name, text in FLEET.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    bindings = [Binding("shop/runner", maven_artifact="runner-client", paths=("/v1/jobs/execute",), service_aliases=("runner",))]
    return out, build.build(spark, str(root), out, bindings)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_graph_queues_and_stores(built):
    _, t = built
    edges = rows(t["service_calls"], "source_repo", "target_repo", "target_path", "confidence")
    assert ("shop/caller", "shop/runner", "/v1/jobs/execute", "high") in edges
    assert ("shop/listener", "shop/runner", "/v1/jobs/execute", "high") in edges
    assert rows(t["queues"], "topic", "producers", "consumers") == [("updates", "shop/caller", "shop/listener")]
    assert ("jdbc:postgresql://db1:5432/app", "shop/listener") in rows(t["data_stores"], "store_key", "repos")


def test_findings(built):
    _, t = built
    paths = t["tainted_paths"].collect()
    assert [(r["repo"], r["path_hops"], r["hops"]) for r in paths] == [("shop/runner", ["Api.run", "RunnerService.run"], 1)]
    assert ("shop/runner", "http", "/v1/jobs/execute") in rows(t["entry_points"], "repo", "mechanism", "channel")
    assert any("old.py" in n and "parse failed" in n for _, n in rows(t["notes"], "repo", "note"))


def test_reports_are_written(built):
    import os

    out, t = built
    assert "| shop/caller | shop/runner |" in open(f"{out}/reports/service-calls.md").read()
    for name in build.REPORTS:
        text = open(f"{out}/reports/{name}.md").read()
        assert "untrusted data" in text
    found = json.load(open(f"{out}/manifest.json"))
    assert found["repos"] == 3 and found["unparsed_files"] == 1 and set(found["phases"]) == {"scan", "derive", "aggregate", "write"}
    assert {f"catalogue={b}" for b, in rows(t["buckets"], "bucket")} <= set(os.listdir(f"{out}/catalogues"))


def test_traces_of_all_sources(spark, built):
    out, _ = built
    facts, upstream = build.trace(spark, out, "shop/runner")
    assert [(r["n_inbound"], r["n_sql_sinks"]) for r in facts.collect()] == [(1, 1)]
    kinds = {r["kind"] for r in upstream.collect() if r["source_repo"] == "shop/caller"}
    assert {"graph", "producer-dependency", "producer-http-out"} <= kinds
    assert "shop/caller" in open(f"{out}/traces/shop-runner-root.md").read()
    build.trace_batch(spark, out)
    assert "Traces" in open(f"{out}/traces/INDEX.md").read()


def test_findings_are_derived_anew_from_stored_observations(spark, built):
    out, t = built
    before = rows(t["tainted_paths"], "repo", "line", "hops"), rows(t["service_calls"], "source_repo", "target_repo", "target_path", "confidence", "evidence")
    again = build.rederive(spark, out)
    assert (rows(again["tainted_paths"], "repo", "line", "hops"), rows(again["service_calls"], "source_repo", "target_repo", "target_path", "confidence", "evidence")) == before
