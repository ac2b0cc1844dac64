"""Routes, hosts and declared targets: which repository an outbound call means.

A route table has (repo, path, ...); an outbound table has a path or host column. Matching runs over distinct normalised paths,
so its cost follows the number of different paths and routes, not of call sites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import vocabulary as V
from tracelake.functions.fields import confidence_rank
from tracelake.functions.paths import match_label, name_aliases, normalize_path, significant_segments


def route_index(nodes: DataFrame, path: str = "path") -> DataFrame:
    """Inbound routes with their normalised path: sources of family http-in whose path is not empty or unknown."""
    rows = nodes.where((F.col("family") == "http-in") & (F.col("kind") == "source")).withColumn("norm", normalize_path(F.col(path)))
    return rows.where("norm != ''")


def distinct_norms(paths: DataFrame, column: str = "path") -> DataFrame:
    """(path, norm): each different path that names a destination once."""
    norms = paths.select(F.col(column).alias("path")).where("path is not null").distinct().withColumn("norm", normalize_path(F.col("path")))
    return norms.where(F.size(significant_segments(F.col("norm"))) > 0)


def _ends(norm: DataFrame, name: str) -> DataFrame:
    """A row for the first and one for the last significant segment: what a prefix or a suffix match shares."""
    sig = significant_segments(F.col("norm"))
    rows = norm.select(F.col("norm").alias(name), sig.alias(f"{name}_sig")).where(F.size(f"{name}_sig") > 0)
    first, last = F.col(f"{name}_sig")[0], F.element_at(f"{name}_sig", -1)
    return rows.withColumn("end", F.explode(F.array(F.struct(F.lit("p").alias("side"), first.alias("segment")), F.struct(F.lit("s").alias("side"), last.alias("segment")))))


def match_routes(outbound: DataFrame, routes: DataFrame) -> DataFrame:
    """(norm, route_norm, confidence): for each outbound normalised path its exact route, else the best fuzzy ones, ties kept.

    outbound and routes hold distinct norms. A fuzzy match shares the first or the last significant segment, so the theta join is
    an equi-join on that; the best is ranked by confidence, then by the smallest difference in length.
    """
    o, r = outbound.select("norm").distinct(), routes.select("norm").distinct()
    named = o.where(F.size(significant_segments(F.col("norm"))) > 0)
    exact = named.join(r, "norm").select("norm", F.col("norm").alias("route_norm"), F.lit("high").alias("confidence"))
    rest = named.join(r, "norm", "left_anti")
    pairs = _ends(rest, "norm").join(_ends(r, "route_norm"), "end").drop("end").distinct()
    label = match_label(F.col("norm"), F.col("route_norm"), F.col("norm_sig"), F.col("route_norm_sig"))
    scored = pairs.select("norm", "route_norm", label.alias("confidence"), (-F.abs(F.size("norm_sig") - F.size("route_norm_sig"))).alias("near")).where("confidence is not null")
    best = scored.groupBy("norm").agg(F.max(F.struct(confidence_rank(F.col("confidence")).alias("rank"), F.col("near"))).alias("best"))
    winners = scored.join(best, "norm").where((confidence_rank(F.col("confidence")) == F.col("best.rank")) & (F.col("near") == F.col("best.near")))
    return exact.unionByName(winners.select("norm", "route_norm", "confidence"))


def aliases(repos: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """(alias, repo, ord): names that repositories answer to. Of one alias, the latest repository (by ord) has it; a binding's alias only fills gaps."""
    own = repos.select("repo", "ord", F.explode(name_aliases(F.col("name"))).alias("alias"))
    best = own.groupBy("alias").agg(F.max_by("repo", "ord").alias("repo"), F.min("ord").alias("ord"))
    if bindings is None:
        return best
    more = bindings.select(F.lower("alias").alias("alias"), F.col("target_repo").alias("repo")).where("alias is not null and alias != ''")
    more = more.join(best, "alias", "left_anti").groupBy("alias").agg(F.min("repo").alias("repo")).withColumn("ord", F.lit((1 << 62)))
    return best.unionByName(more)


def contained(texts: DataFrame, names: DataFrame, suffix: bool = False) -> DataFrame:
    """texts (text) and names (name): the pairs in which the name stands in the text, or at its end, as an equi-join.

    All pieces of a text of a length that some name has are looked up. The lengths, at most as many as the longest name has
    characters, go to the driver; texts and names are distinct values and meet by a shuffle join however many there are.
    """
    t = texts.select("text").where("text is not null").distinct()
    n = names.select("name").where("name is not null and name != ''").distinct()
    lengths = sorted(r[0] for r in n.select(F.length("name")).distinct().collect())
    if not lengths:
        return t.where("false").select("text", F.lit("").alias("name"))
    fitting = F.filter(F.array(*[F.lit(k) for k in lengths]), lambda k: k <= F.length("text"))
    if suffix:
        pieces = F.transform(fitting, lambda k: F.substr("text", F.length("text") - k + 1, k))
    else:
        pieces = F.flatten(F.transform(fitting, lambda k: F.transform(F.sequence(F.lit(1), F.length("text") - k + 1), lambda i: F.substr("text", i, k))))
    return t.select("text", F.explode(F.array_distinct(pieces)).alias("name")).join(n, "name").select("text", "name")


def resolve_hosts(hosts: DataFrame, index: DataFrame, repos: DataFrame) -> DataFrame:
    """(host, repo) for distinct hosts: the whole host is an alias, else its first label is, else a repository's alias stands in it.

    The last step takes the first alias by ord that stands in the host.
    """
    h = hosts.select("host").where("host is not null").distinct().where(~F.col("host").isin(*V.NOISE_HOSTS)).withColumn("low", F.lower("host"))
    full = h.join(index.select(F.col("alias").alias("low"), F.col("repo").alias("full_repo")), "low", "left")
    label = full.withColumn("label", F.split("low", r"\.")[0]).join(index.select(F.col("alias").alias("label"), F.col("repo").alias("label_repo")), "label", "left")
    known = label.select("host", "low", F.coalesce("full_repo", "label_repo").alias("repo"))
    left = known.where("repo is null").select("host", "low")
    names = repos.select("repo", "ord", F.explode(name_aliases(F.col("name"))).alias("alias"))
    found = contained(left.select(F.col("low").alias("text")), names.select(F.col("alias").alias("name")))
    fallback = left.join(found, left["low"] == found["text"]).join(names, F.col("name") == F.col("alias")).groupBy("host").agg(F.min_by("repo", "ord").alias("repo"))
    return known.where("repo is not null").select("host", "repo").unionByName(fallback)


def config_targets(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(config_key, repo): of a configuration key's dotted segments, the first that is an alias."""
    parts = keys.select("config_key").distinct().select("config_key", F.posexplode(F.split(F.lower("config_key"), r"\.")).alias("pos", "alias"))
    return parts.join(index.select("alias", "repo"), "alias").groupBy("config_key").agg(F.min_by("repo", "pos").alias("repo"))
