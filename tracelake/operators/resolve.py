"""Calls resolved to declarations within a repository, and the paths that a tainted value takes along them."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.fields import carried, confidence_rank, receiver_field
from tracelake.storage import stored

#: Partial paths of an entry point that are followed; beyond it a search is marked as truncated.
MAX_EXPLORED = 20_000


def resolve_calls(calls: DataFrame, methods: DataFrame, types: DataFrame, fields: DataFrame, supertypes: DataFrame) -> DataFrame:
    """calls with tier, to_class, ambiguous and confidence, by the best tier that gives any target.

    calls: repo, call_id, owner (class), symbol, receiver, self_name. methods: repo, class, method. types: repo, class, is_interface.
    fields: repo, class, field, type. supertypes: repo, class, supertype. T1: the receiver's declared type has the method; T2: it
    is an interface whose implementations have it; T3: the repository declares the name once.
    """
    methods = methods.select("repo", "class", "method")
    named = methods.distinct()
    rows = calls.withColumn("_field", receiver_field(F.col("receiver"), F.col("self_name")))
    typed = rows.join(fields.select("repo", F.col("class").alias("owner"), F.col("field").alias("_field"), F.col("type").alias("_type")), ["repo", "owner", "_field"])
    typed = typed.join(types.select("repo", F.col("class").alias("_type"), "is_interface"), ["repo", "_type"], "left")
    target = named.select("repo", F.col("class").alias("to_class"), F.col("method").alias("symbol"))
    t1 = typed.where(~F.coalesce("is_interface", F.lit(False))).withColumn("to_class", F.col("_type")).join(target, ["repo", "to_class", "symbol"]).withColumns({"tier": F.lit("T1"), "ambiguous": F.lit(False)})
    impl = supertypes.select("repo", F.col("supertype").alias("_type"), F.col("class").alias("to_class")).distinct()
    t2 = typed.where("is_interface").join(impl, ["repo", "_type"]).join(target, ["repo", "to_class", "symbol"])
    t2 = t2.withColumns({"tier": F.lit("T2"), "ambiguous": F.count(F.lit(1)).over(Window.partitionBy("repo", "call_id")) > 1})
    out = [*calls.columns, "tier", "to_class", "ambiguous"]
    better = t1.select(*out).unionByName(t2.select(*out))
    once = methods.groupBy("repo", F.col("method").alias("symbol")).agg(F.count(F.lit(1)).alias("_n"), F.min("class").alias("to_class")).where("_n = 1").drop("_n")
    t3 = calls.join(better.select("repo", "call_id").distinct(), ["repo", "call_id"], "left_anti").join(once, ["repo", "symbol"]).withColumns({"tier": F.lit("T3"), "ambiguous": F.lit(False)})
    return better.unionByName(t3.select(*out)).withColumn("confidence", F.when(F.col("ambiguous"), "low").when(F.col("tier") == "T1", "high").when(F.col("tier") == "T2", "medium").otherwise("low"))


def tainted_paths(entries: DataFrame, declarations: DataFrame, resolved: DataFrame, sinks: DataFrame, max_depth: int | None = None, max_explored: int = MAX_EXPLORED) -> DataFrame:
    """Paths from entry points to sinks along which a value is passed on, by breadth-first joins.

    entries: entry_id, repo, scope. declarations: repo, scope, params. resolved: repo, scope, to_scope, arguments, to_params, tier,
    confidence, ord. sinks: sink_id, repo, scope, text. A partial path carries its scopes (none twice) and the tainted names; a hop
    needs an argument that mentions one, and taints the parameters at those places instead. Partial paths are never merged, since
    they block different scopes. A path ends where no new scope follows, so any depth is searched unless max_depth says otherwise. An entry with more than max_explored partial paths stops and is marked. Each level is written to
    the shared folder, which keeps lineage short.
    """

    def held(df: DataFrame) -> DataFrame:
        return stored(df, "taint")

    level = held(
        entries.join(declarations.groupBy("repo", "scope").agg(F.min("params").alias("params")), ["repo", "scope"])
        .where(F.size("params") > 0)
        .select("entry_id", "repo", "scope", F.col("params").alias("tainted"), F.array("scope").alias("scopes"), F.array().cast("array<struct<tier:string,confidence:string,ord:long>>").alias("hops"))
    )
    levels, counts, stopped = [level], None, []
    depths = count() if max_depth is None else range(max_depth)
    for _ in depths:
        step = level.join(resolved.select("repo", "scope", "to_scope", "arguments", "to_params", "tier", "confidence", "ord"), ["repo", "scope"]).where(~F.array_contains("scopes", F.col("to_scope")))
        names = F.zip_with("arguments", "to_params", lambda a, p: F.when(carried(a, F.col("tainted")).isNotNull(), p))
        step = step.where(F.exists("arguments", lambda a: carried(a, F.col("tainted")).isNotNull()))
        step = step.select("entry_id", "repo", F.col("to_scope").alias("scope"), F.array_distinct(F.array_compact(names)).alias("tainted"), F.array_append("scopes", F.col("to_scope")).alias("scopes"), F.array_append("hops", F.struct("tier", "confidence", F.col("ord").cast("long").alias("ord"))).alias("hops"))
        level = held(step)
        per_entry = level.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n"))
        counts = per_entry if counts is None else held(counts.unionByName(per_entry).groupBy("entry_id").agg(F.sum("n").alias("n")))
        if level.isEmpty():
            break
        levels.append(level)
        over = held(counts.where(F.col("n") > max_explored).select("entry_id"))
        if not over.isEmpty():
            stopped.append(over)
            level = level.join(over, "entry_id", "left_anti")
    else:
        stopped.append(level.select("entry_id").distinct())
    every = levels[0]
    for x in levels[1:]:
        every = every.unionByName(x)
    hit = carried(F.col("text"), F.col("tainted"))
    found = every.join(sinks.select("repo", "scope", "sink_id", "text"), ["repo", "scope"]).withColumn("tainted_at_sink", hit).where("tainted_at_sink is not null")
    weakest = F.coalesce(F.array_min(F.transform("hops", lambda h: confidence_rank(h["confidence"]))), F.lit(3))
    # The weakest link: of the hops of the least confidence the first.
    link = F.array_min(F.transform("hops", lambda h, i: F.struct(confidence_rank(h["confidence"]).alias("rank"), i.alias("at"), h["tier"].alias("tier"), h["ord"].alias("ord"))))
    out = found.select("entry_id", "sink_id", "repo", F.size("hops").cast("long").alias("n_hops"), weakest.alias("_rank"), link["ord"].alias("weakest_link"), link["tier"].alias("weakest_tier"), F.array_join("scopes", ">").alias("path"), "tainted_at_sink", F.transform("hops", lambda h: h["ord"]).alias("_ords"))
    out = out.withColumn("confidence", F.when(F.col("_rank") == 3, "high").when(F.col("_rank") == 2, "medium").otherwise("low"))
    cut = F.lit(False)
    if stopped:
        marks = stopped[0]
        for x in stopped[1:]:
            marks = marks.unionByName(x)
        out = out.join(marks.distinct().withColumn("_cut", F.lit(True)), "entry_id", "left")
        cut = F.coalesce("_cut", F.lit(False))
    return out.withColumn("search_truncated", cut).drop("_cut")


def shortest_strongest(paths: DataFrame) -> DataFrame:
    """One path for each entry and sink: the shortest, of those the strongest, then the first in order of calls."""
    order = Window.partitionBy("entry_id", "sink_id").orderBy("n_hops", F.desc("_rank"), "_ords")
    return paths.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_rank", "_ords")
