"""Queries over whole tables, against plain searches of the same rows."""

import os
import re
from collections import defaultdict

import pytest

from tracelake import registry
from tracelake.plans import queries as Q
from tracelake.plans.fleet import frame

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = re.compile("[A-Za-z_][A-Za-z0-9_]*")


def plain_paths(spark, node):
    """By depth-first search: (entry, sink, hops, path)."""
    decl, hops, sinks, entries = (spark.sql(x, node=node).collect() for x in (Q._DECL, Q._HOPS, Q._SINKS, Q._ENTRIES))
    params = {(r["repo"], r["scope"]): r["params"].split(",") for r in decl}
    out, at = defaultdict(list), defaultdict(list)
    for r in hops:
        if (r["repo"], r["to_scope"]) in params:
            out[r["repo"], r["scope"]].append(r)
    for r in sinks:
        at[r["repo"], r["scope"]].append(r)
    found = set()

    def walk(entry, repo, scopes, tainted, ords):
        for s in at[repo, scopes[-1]]:
            if tainted & set(NAMES.findall(s["text"])):
                found.add((entry, s["sink_id"], tuple(ords), ">".join(scopes)))
        for h in out[repo, scopes[-1]]:
            hit = {p for a, p in zip(h["arguments"].split(","), params[repo, h["to_scope"]], strict=True) if tainted & set(NAMES.findall(a))}
            if hit and h["to_scope"] not in scopes:
                walk(entry, repo, [*scopes, h["to_scope"]], hit, [*ords, h["ord"]])

    for r in entries:
        if (r["repo"], r["scope"]) in params:
            walk(r["entry_id"], r["repo"], [r["scope"]], set(params[r["repo"], r["scope"]]), [])
    return sorted((e, s, len(o), p) for e, s, o, p in found)


def test_tainted_paths_of_all_repositories_to_any_depth(spark):
    got = registry.queries()["tainted_paths_recursive"](spark, SF).collect()
    assert sorted((r["entry_id"], r["sink_id"], r["n_hops"], r["path"]) for r in got) == plain_paths(spark, frame(spark, SF, "node"))
    assert len({r["repo"] for r in got if not r["repo"].endswith("3")}) > 1
    assert not any(r["search_truncated"] for r in got)


def test_calls_of_all_repositories_are_resolved(spark):
    node = frame(spark, SF, "node")
    calls, methods, types, fields, supers = ([tuple(r) for r in spark.sql(x, node=node).collect()] for x in (Q._CALLS, Q._METHODS, Q._TYPES, Q._FIELDSQ, Q._SUPERS))
    kinds = {(r, c): i for r, c, i in types}
    held, named = set(methods), defaultdict(list)
    for r, c, m in methods:
        named[r, m].append(c)
    want = []
    for call_id, repo, owner, _, symbol, receiver, self_name, _ in calls:
        field = re.sub(r"^(this|self)\.", "", receiver or "")
        if self_name and field.startswith(self_name + "."):
            field = field[len(self_name) + 1 :]
        found = []
        for r, c, f, t in fields:
            if (r, c, f) == (repo, owner, field):
                if not kinds.get((repo, t)):
                    found += [("T1", t)] if (repo, t, symbol) in held else []
                else:
                    found += [("T2", k) for q, k, s in supers if (q, s) == (repo, t) and (repo, k, symbol) in held]
        if not found and len(named[repo, symbol]) == 1:
            found = [("T3", named[repo, symbol][0])]
        want += [(call_id, repo, tier, c) for tier, c in found]
    got = registry.queries()["call_resolution_tiers"](spark, SF).collect()
    assert sorted((r["call_id"], r["repo"], r["tier"], r["to_class"]) for r in got) == sorted(want)
    assert len({r["repo"] for r in got if not r["repo"].endswith("7")}) > 1


def test_lines_beyond_the_narrow_ones_count(spark, tmp_path):
    items = [(1, 5, 1, 1), (100, 5, 2, 2), (200, 6, 2, 1), (50, 10, 3, 1), (60, 13, 3, 1), (51, 10, 4, 1)]
    rows = [(o, p, s, n, "A") for o, p, s, n in items]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = lambda name: [tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()]
    assert got("queue_orphans") == [("topic-6", 0, 1)]
    assert got("trace_coverage_intersect") == [("g3/svc-3",)]
    assert got("trace_coverage_except") == [("g4/svc-4",)]
