"""Personal data: where fields are collected, processed, stored, logged, sent and deleted, and how they cross repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.fields import field_key, lookup
from tracelake.functions.paths import is_noise_path
from tracelake.functions.vocabulary import ROPA_CATEGORIES, ROPA_UNKNOWN
from tracelake.operators.calls import Graph, between, edges
from tracelake.schema import STAGES
from tracelake.storage import stored

NEAR_LINES = 80
DELETE_LINES = 30
DELETES = r"(?i)\b(delete|remove|erase|purge|forget)\w*\b"
TOUCH = ["repo", "stage", "family", "field_key", "pii_classification", "file", "line", "confidence"]
#: Families of nodes that hold a field.
OWN = ("pii-field", "pii-log", "pii-storage")
#: Stage that a field is in if a node of one of the families is near it.
PROBES = {"process": ("sql+near-pii-field", ("sql",)), "transmit": ("http-out+near-pii-field", ("http-out",)), "encrypt": ("crypto+near-pii-field", ("crypto-algorithm", "crypto-config"))}


def _touch(rows: DataFrame, stage: str) -> DataFrame:
    return rows.select("repo", F.lit(stage).alias("stage"), "family", field_key(F.col("field_name")).alias("field_key"), F.coalesce("pii_classification", F.lit("unknown")).alias("pii_classification"), "file", "line", "confidence")


def near(rows: DataFrame, others: DataFrame, lines: int) -> DataFrame:
    """rows that have one of the others within so many lines of the same file: a range semi-join on blocks of lines.

    Both sides are keyed by (repo, file, block of lines); a row looks into its own block and the next on either side, so a file
    of many nodes is not compared with itself as a whole.
    """
    size = lines + 1
    block = F.floor(F.col("line") / size)
    right = others.select(F.col("repo").alias("o_repo"), F.col("file").alias("o_file"), F.col("line").alias("o_line"), block.alias("o_block")).distinct()
    # Only lines count, so distinct places of the rows are joined and the rows found by them.
    places = rows.select("repo", "file", "line").distinct()
    left = places.withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    met = left.join(right, (F.col("repo") == F.col("o_repo")) & (F.col("file") == F.col("o_file")) & (F.col("block") == F.col("o_block")) & (F.abs(F.col("line") - F.col("o_line")) <= lines), "left_semi")
    return rows.join(met.select("repo", "file", "line").distinct(), ["repo", "file", "line"], "left_semi")


def _held(nodes: DataFrame) -> DataFrame:
    """The nodes that touchpoints are made of, with what they need of them, written once: each stage reads them again, and not what they are made from."""
    families = [*OWN, *(f for _, probes in PROBES.values() for f in probes)]
    rows = nodes.select("repo", "file", "line", "family", "field_name", "pii_classification", "confidence", F.coalesce(F.col("raw").rlike(DELETES), F.lit(False)).alias("deletes"))
    return stored(rows.where(F.col("family").isin(*families) | F.col("deletes")), "held")


def proximity_touches(nodes: DataFrame) -> DataFrame:
    """Touches of fields that have SQL, outbound calls or cryptography near: one for each (repo, field, stage, line), of low confidence."""
    return _proximity(_held(nodes))


def _proximity(nodes: DataFrame) -> DataFrame:
    fields = nodes.where("family = 'pii-field' and field_name is not null and field_name != ''")
    out = None
    for stage, (name, probes) in PROBES.items():
        rows = _touch(near(fields, nodes.where(F.col("family").isin(*probes)), NEAR_LINES), stage)
        one = rows.groupBy("repo", "field_key", "stage", "line").agg(F.min(F.struct("file", "pii_classification")).alias("f"))
        got = one.select("repo", "stage", F.lit(name).alias("family"), "field_key", "f.pii_classification", "f.file", "line", F.lit("low").alias("confidence"))
        out = got if out is None else out.unionByName(got)
    return out


def delete_touches(nodes: DataFrame) -> DataFrame:
    """Fields with text that deletes something near."""
    return _deletes(_held(nodes))


def _deletes(nodes: DataFrame) -> DataFrame:
    rows = nodes.where(F.col("family").isin(*OWN) & (F.coalesce("field_name", F.lit("")) != ""))
    return _touch(near(rows, nodes.where("deletes"), DELETE_LINES), "delete")


def touchpoints(nodes: DataFrame) -> DataFrame:
    """Every place where a field is handled, with its stage."""
    nodes = _held(nodes)
    named = F.coalesce("field_name", F.lit("")) != ""
    own = _touch(nodes.where((F.col("family") == "pii-field") & named), "collect").unionByName(_touch(nodes.where("family = 'pii-storage'"), "store")).unionByName(_touch(nodes.where("family = 'pii-log'"), "log"))
    return own.unionByName(_proximity(nodes)).unionByName(_deletes(nodes)).select(*TOUCH)


def lifecycle(touches: DataFrame) -> DataFrame:
    """Each field's touches and distinct repositories by stage."""
    return touches.groupBy("field_key", "pii_classification").agg(F.count(F.lit(1)).alias("n_touches"), *[F.count_distinct(F.when(F.col("stage") == s, F.col("repo"))).alias(f"n_{s}") for s in STAGES])


def by_stage(touches: DataFrame) -> DataFrame:
    """Touches by stage; stages without any have zero."""
    stages = touches.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in STAGES])).alias("stage"))
    return stages.join(touches.groupBy("stage").agg(F.count(F.lit(1)).alias("n")), "stage", "left").na.fill(0)


def activities(touches: DataFrame) -> DataFrame:
    """Processing activities: purposes, security notes and recipients by category, class and repository."""
    rows = touches.withColumn("category", lookup(F.col("pii_classification"), ROPA_CATEGORIES, ROPA_UNKNOWN))
    has = {s: F.bool_or(F.col("stage") == s).alias(f"has_{s}") for s in STAGES}
    g = rows.groupBy("category", "pii_classification", "repo").agg(*has.values(), F.sort_array(F.collect_set("field_key")).alias("keys"))
    note = lambda condition, text: F.when(condition, text)
    purposes = F.array_compact(F.array(note(F.col("has_collect") | F.col("has_process"), "Service delivery / API processing"), note(F.col("has_store"), "Persistence"), note(F.col("has_log"), "Operations and diagnostics (logging)"), note(F.col("has_transmit"), "Inter-service transmission")))
    security = F.array_compact(F.array(note(F.col("has_encrypt"), "Crypto operations near field (static)"), F.when(F.col("has_log"), "Review logging sinks for field").otherwise("Logging exposure not detected in static scan")))
    return g.select(
        "category", "pii_classification", "repo",
        F.when(F.size(purposes) > 0, F.array_join(purposes, "; ")).otherwise("Code references (stage unclear)").alias("purposes"),
        F.array_join(security, "; ").alias("security"),
        F.when(F.col("has_transmit"), "Internal services").otherwise("Not inferred").alias("recipients"),
        F.when(F.col("has_store"), "See repo config / data-store graph").otherwise("Not inferred from static scan").alias("retention"),
        F.array_join(F.slice("keys", 1, 20), ",").alias("field_keys"),
    )


def material_repos(touches: DataFrame, key: str) -> DataFrame:
    """Repositories that handle a field, not only declare something near it."""
    t = touches.where(F.col("field_key") == key)
    return t.where(F.col("family").isin("pii-field", "pii-log", "pii-storage", "queue-pub") | F.col("stage").isin("store", "log", "collect", "delete", "encrypt") | ((F.col("stage") == "transmit") & (F.col("confidence") != "low"))).select("repo").distinct()


def strong_repos(touches: DataFrame, key: str) -> DataFrame:
    """Repositories that log, store, delete, encrypt or queue a field."""
    t = touches.where(F.col("field_key") == key)
    return t.where(F.col("family").isin("pii-log", "pii-storage", "queue-pub", "queue-sub") | F.col("stage").isin("store", "log", "delete", "encrypt")).select("repo").distinct()


def queue_hops(nodes: DataFrame, touches: DataFrame, key: str) -> DataFrame:
    """Repositories between which a topic carries the field: each with its role and its number of hops to others on the topic.

    Every source of a topic hops to every target of it but itself, so roles say it all; pairs are not spelled out.
    """
    named = nodes.where(F.col("family").isin("queue-pub", "queue-sub") & (F.coalesce("topic", F.lit("?")) != "?") & (F.col("topic") != ""))
    roles = named.join(material_repos(touches, key), "repo", "left_semi").groupBy("topic", "repo").agg(F.bool_or(F.col("family") == "queue-pub").alias("gives"), F.bool_or(F.col("family") == "queue-sub").alias("takes"))
    sides = roles.groupBy("topic").agg(F.count_if("gives").alias("givers"), F.count_if("takes").alias("takers"))
    other = lambda both, n: F.when(F.col(both), F.col(n) - 1).otherwise(F.col(n))
    ends = F.array(F.struct(F.lit("source").alias("role"), F.when(F.col("gives"), other("takes", "takers")).alias("n_hops")), F.struct(F.lit("target").alias("role"), F.when(F.col("takes"), other("gives", "givers")).alias("n_hops")))
    return roles.join(sides, "topic").select(F.lit(key).alias("field_key"), F.col("topic").alias("via"), "repo", F.inline(ends)).where("n_hops > 0").withColumn("confidence", F.lit("medium"))


def http_hops(graph: Graph, touches: DataFrame, key: str) -> DataFrame:
    """High-confidence calls between repositories that both hold the field strongly; only these are spelled out."""
    strong = stored(strong_repos(touches, key), "strong")
    rows = edges(between(graph, strong, ~is_noise_path(F.col("target_path")), ("high", "openapi")))
    return rows.select(F.lit(key).alias("field_key"), "source_repo", "target_repo", F.col("target_path").alias("via"), "confidence")


def flow_by_class(nodes: DataFrame) -> DataFrame:
    rows = nodes.where(F.col("family").isin("pii-field", "pii-log", "pii-storage"))
    return rows.groupBy(F.coalesce("pii_classification", F.lit("unknown")).alias("pii_class")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repo").alias("n_repos"))


def top_fields(nodes: DataFrame, most: int = 25) -> DataFrame:
    rows = nodes.where(F.col("family").isin("pii-field", "pii-log", "pii-storage") & F.col("field_name").isNotNull())
    return rows.groupBy(F.lower("field_name").alias("field")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "field").limit(most)


def probable_handlers(nodes: DataFrame) -> DataFrame:
    """Repositories with personal data and both inbound and outbound calls."""
    pii = F.col("family").isin("pii-field", "pii-log", "pii-storage")
    counts = nodes.groupBy("repo").agg(F.count_if(pii).alias("n_pii"), F.count_if(pii & F.col("pii_classification").isin("sensitive", "special-category-gdpr")).alias("n_sensitive"), F.count_if(F.col("family") == "http-in").alias("n_in"), F.count_if(F.col("family") == "http-out").alias("n_out"))
    return counts.where("n_pii > 0 and n_in > 0 and n_out > 0")
