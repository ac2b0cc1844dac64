import pytest
from pyspark.sql import functions as F

from tracelake.functions.text import node_id
from tracelake.operators import derive, fleet, inventory, privacy, resolve, routes


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_fuzzy_prefers_the_more_specific_route(spark):
    out = spark.createDataFrame([("/v1/stock/dispatch",), ("/v1",), ("/{}",), ("/orders/{}/lines",), ("/search",)], "norm string")
    route = spark.createDataFrame([("/stock",), ("/stock/dispatch",), ("/v1",), ("/lines",), ("/{}",), ("/api/search",)], "norm string")
    want = [("/orders/{}/lines", "/lines", "low"), ("/search", "/api/search", "low"), ("/v1/stock/dispatch", "/stock/dispatch", "medium")]
    assert rows(routes.match_routes(out, route), "norm", "route_norm", "confidence") == want
    assert rows(routes.match_routes(out.repartition(7), route.orderBy(F.desc("norm"))), "norm", "route_norm", "confidence") == want


def test_equal_ties_are_all_kept(spark):
    out = spark.createDataFrame([("/a/b",)], "norm string")
    route = spark.createDataFrame([("/a/b/c",), ("/a/b/d",)], "norm string")
    assert len(routes.match_routes(out, route).collect()) == 2


def test_hosts(spark):
    repos = spark.createDataFrame([("g/stock-service", "stock-service", 0), ("g/order", "order", 1)], "repo string, name string, ord long")
    bindings = spark.createDataFrame([("g/pay", "Payments.internal"), ("g/x", "order"), ("g/y", "")], "target_repo string, alias string")
    hosts = spark.createDataFrame([("stock.prod.local",), ("payments.internal",), ("my-order-eu.local",), ("localhost",), ("other.host",), (None,)], "host string")
    got = routes.resolve_hosts(hosts, routes.aliases(repos, bindings), repos)
    assert rows(got, "host", "repo") == [("my-order-eu.local", "g/order"), ("payments.internal", "g/pay"), ("stock.prod.local", "g/stock-service")]


def test_config_targets(spark):
    index = spark.createDataFrame([("stock", "g/stock"), ("base", "g/base")], "alias string, repo string")
    keys = spark.createDataFrame([("app.Stock.base",), ("none.here",)], "config_key string")
    assert rows(routes.config_targets(keys, index), "config_key", "repo") == [("app.Stock.base", "g/stock")]


def test_queue_graph(spark):
    nodes = spark.createDataFrame([("queue-pub", "kafka", "t", "g/a"), ("queue-sub", "kafka", "t", "g/b"), ("queue-pub", "sqs", "u", "g/a")], "family string, system string, topic string, repo string")
    got = {r["topic"]: r for r in inventory.queue_graph(nodes).collect()}
    assert (got["t"]["producers"], got["t"]["consumers"], got["t"]["produce_only"]) == ("g/a", "g/b", False)
    assert got["u"]["produce_only"] and got["u"]["consumers"] == ""


def test_public_paths_count_only_after_the_pattern(spark):
    nodes = spark.createDataFrame([("g/a", 1, "http-in", None, "/early"), ("g/a", 2, "auth", "permit-all-config", None), ("g/a", 3, "http-in", None, "/late"), ("g/b", 1, "http-in", None, "/x")], "repo string, ord long, family string, pattern string, path string")
    assert rows(inventory.public_paths(nodes), "repo", "path") == [("g/a", "/late")]


def test_stages_of_a_field(spark):
    schema = "repo string, family string, field_name string, pii_classification string, file string, line int, confidence string, raw string"
    nodes = spark.createDataFrame(
        [
            ("g/a", "pii-field", "phoneNumber", "direct-pii", "F", 10, "medium", ""),
            ("g/a", "sql", None, None, "F", 40, "high", ""),
            ("g/a", "http-out", None, None, "F", 91, "high", ""),
            ("g/a", "pii-storage", None, "direct-pii", "F", 200, "low", ""),
            ("g/a", "pii-log", "phone", "direct-pii", "F", 300, "high", "deleteAll()"),
        ],
        schema,
    )
    got = rows(privacy.touchpoints(nodes), "stage", "field_key")
    assert got == [("collect", "phone"), ("delete", "phone"), ("log", "phone"), ("process", "phone"), ("store", "unknown")]


def test_carriers_and_spans(spark):
    f = spark.createDataFrame([("g", "F", 5, 1), ("g", "F", 20, 2), ("g", "G", 1, 3)], "repo string, file string, line int, ord long")
    c = spark.createDataFrame([("g", "F", 3, 9), ("g", "F", 8, 9), ("g", "F", 12, 9)], "repo string, file string, line int, ord long")
    assert rows(derive.payload_carriers(f, c), "line", "call_line") == [(5, 8), (20, 12)]
    s = spark.createDataFrame([("g", "F", 1, 500, "outer"), ("g", "F", 4, 6, "inner")], "repo string, file string, start_line int, end_line int, owner string")
    assert [r["owner"] for r in derive.enclosing(f, s).orderBy("ord").collect()] == ["inner", "outer", None]


def symbols(spark):
    methods = spark.createDataFrame([("r", "Svc", "find"), ("r", "SqlDao", "load"), ("r", "MemDao", "load"), ("r", "Util", "only")], "repo string, class string, method string")
    types = spark.createDataFrame([("r", "Svc", False), ("r", "Dao", True)], "repo string, class string, is_interface boolean")
    fields = spark.createDataFrame([("r", "Ctl", "svc", "Svc"), ("r", "Svc", "dao", "Dao")], "repo string, class string, field string, type string")
    supers = spark.createDataFrame([("r", "SqlDao", "Dao"), ("r", "MemDao", "Dao")], "repo string, class string, supertype string")
    return methods, types, fields, supers


def test_resolution_tiers(spark):
    calls = spark.createDataFrame([("r", 1, "Ctl", "find", "this.svc", None), ("r", 2, "Svc", "load", "s.dao", "s"), ("r", 3, "Ctl", "only", None, None), ("r", 4, "Ctl", "load", "x", None)], "repo string, call_id int, owner string, symbol string, receiver string, self_name string")
    got = rows(resolve.resolve_calls(calls, *symbols(spark)), "call_id", "tier", "to_class", "confidence")
    assert got == [(1, "T1", "Svc", "high"), (2, "T2", "MemDao", "low"), (2, "T2", "SqlDao", "low"), (3, "T3", "Util", "low")]


def chain(spark, hops, sinks=(("k", "c", "run(q)"),), entry="a"):
    entries = spark.createDataFrame([("e", "r", entry)], "entry_id string, repo string, scope string")
    decl = spark.createDataFrame([("r", s, [p]) for s, p in (("a", "x"), ("b", "y"), ("c", "q"), ("d", "z"))], "repo string, scope string, params array<string>")
    resolved = spark.createDataFrame([("r", s, t, [a], [p], "T1", c, k) for k, (s, t, a, p, c) in enumerate(hops)], "repo string, scope string, to_scope string, arguments array<string>, to_params array<string>, tier string, confidence string, ord long")
    found = spark.createDataFrame([(i, "r", s, t) for i, s, t in sinks], "sink_id string, repo string, scope string, text string")
    return entries, decl, resolved, found


def test_tainted_path_keeps_the_shortest_and_prunes_decoys(spark):
    hops = [("a", "b", "f(x)", "y", "high"), ("b", "c", "y + 1", "q", "medium"), ("a", "c", "other", "q", "high"), ("c", "a", "q", "x", "high"), ("a", "d", "x", "z", "low"), ("d", "b", "z", "y", "high")]
    got = resolve.shortest_strongest(resolve.tainted_paths(*chain(spark, hops))).collect()
    assert [(r["path"], r["n_hops"], r["confidence"], r["tainted_at_sink"]) for r in got] == [("a>b>c", 2, "medium", "q")]
    assert not got[0]["search_truncated"]


def test_truncation_is_marked(spark):
    hops = [("a", "b", "x", "y", "high"), ("b", "c", "y", "q", "high"), ("c", "d", "q", "z", "high")]
    paths = resolve.tainted_paths(*chain(spark, hops), max_explored=0)
    assert paths.collect() == [] or all(r["search_truncated"] for r in paths.collect())
    deep = resolve.tainted_paths(*chain(spark, hops, sinks=(("k", "b", "y"),)), max_depth=1).collect()
    assert [r["search_truncated"] for r in deep] == [True]


def test_discovery(spark):
    known = spark.createDataFrame([("g/a",), ("g/sub/a",)], "repo string")
    paths = spark.createDataFrame([("g/sub/a/client",), ("g/a",), ("x/y",)], "path string")
    assert rows(fleet.canonical_repos(paths, known), "path", "repo")[0] == ("g/a", "g/a")
    declaring = spark.createDataFrame([("g/stock-client",), ("g/lone-sdk",), ("g/a",)], "repo string")
    endpoints = spark.createDataFrame([("g/stock-service",), ("g/a",)], "repo string")
    assert rows(fleet.service_for_client(declaring, endpoints), "repo", "service") == [("g/stock-client", "g/stock-service")]


def test_incremental(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "1")], "repo string, git_sha string")
    before = spark.createDataFrame([("a", "1", 19, 6), ("b", "1", 19, 5), ("c", "1", 19, 6)], "repo string, git_sha string, detection_version int, derivation_version int")
    assert rows(fleet.incremental_plan(now, before, 19, 6), "repo", "action") == [("a", "skip"), ("b", "re-derive"), ("c", "analyse"), ("d", "analyse")]


@pytest.mark.parametrize("n", [1, 5])
def test_results_do_not_depend_on_partitions(spark, n):
    nodes = spark.createDataFrame([("g/a", f"F{k % 3}", k, "x" if k % 2 else None) for k in range(50)], "repo string, file string, line int, symbol string")
    ids = nodes.repartition(n).select(node_id(*[F.col(c) for c in ("repo", "file", "line")], F.lit("sql"), F.lit("sink"), F.col("symbol")).alias("id"))
    assert ids.distinct().count() == 50


def test_demand_counts_callers_and_classes_of_others(spark, monkeypatch):
    schema = "family string, kind string, repo string, file string, path string"
    nodes = [("http-in", "source", f"g/s{k}", "R.java", p) for k in range(4) for p in ("/stock", f"/own{k}")]
    nodes += [("http-out", "sink", r, f"{c}.java", p) for r, c, p in (("g/a", "A", "/stock"), ("g/s0", "B", "/stock"), ("g/s0", "B", "/own0"), ("g/s1", "C", "/own1"), ("g/s2", "A", "/own3"), ("g/s2", "D", "/own2"), ("g/a", "D", "/own2"))]
    tiles, counted = [], fleet.pairs.reached
    monkeypatch.setattr(fleet.pairs, "reached", lambda *x: tiles.append(1) or counted(*x, 2))
    got = rows(fleet.demand(spark.createDataFrame(nodes, schema)), "target_repo", "n_callers", "n_classes", "paths")
    assert got == [("g/s0", 1, 1, "/stock"), ("g/s1", 2, 2, "/stock"), ("g/s2", 2, 3, "/own2,/stock"), ("g/s3", 3, 2, "/own3,/stock")]
    assert len(tiles) == 2
