"""Queues, data stores, taint buckets, indexes and cards: what repositories hold, counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelake.functions.fields import auth_maturity, crypto_maturity, store_key
from tracelake.functions.vocabulary import WEAK_CARD_ALGORITHMS

COUNTED = ("http-in", "http-out", "sql", "queue-pub", "queue-sub", "data-store", "crypto-algorithm", "auth", "pii-field", "pii-log", "pii-storage", "raw-code-payload")


def joined_set(value: Column, condition: Column | None = None) -> Column:
    """Distinct values, sorted, comma-joined; '' for none."""
    return F.array_join(F.sort_array(F.collect_set(value if condition is None else F.when(condition, value))), ",")


def queue_graph(nodes: DataFrame) -> DataFrame:
    """Topics with their systems, producers and consumers."""
    rows = nodes.where(F.col("family").isin("queue-pub", "queue-sub"))
    produces = F.col("family") == "queue-pub"
    out = rows.groupBy("topic").agg(joined_set(F.col("system")).alias("systems"), joined_set(F.col("repo"), produces).alias("producers"), joined_set(F.col("repo"), ~produces).alias("consumers"), F.count_distinct(F.when(produces, F.col("repo"))).alias("n_producers"), F.count_distinct(F.when(~produces, F.col("repo"))).alias("n_consumers"))
    return out.withColumns({"produce_only": F.col("n_consumers") == 0, "consume_only": F.col("n_producers") == 0})


def store_rows(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("family") == "data-store") & (F.col("kind") == "store")).withColumn("store_key", store_key(F.col("vendor"), F.col("url"), F.col("bucket"))).where("store_key is not null")


def store_graph(nodes: DataFrame) -> DataFrame:
    """Data stores with the repositories that touch them and the first sighting."""
    first = F.struct("ord")
    return store_rows(nodes).groupBy("store_key").agg(F.min_by("vendor", first).alias("vendor"), joined_set(F.col("repo")).alias("repos"), F.count_distinct("repo").alias("n_repos"), F.min_by(F.concat_ws(":", "file", F.col("line").cast("string")), first).alias("sample"))


def stores_by_vendor(nodes: DataFrame) -> DataFrame:
    return store_graph(nodes).groupBy("vendor").agg(F.count(F.lit(1)).alias("n_stores"), F.sum("n_repos").alias("n_links"))


def sql_executions(nodes: DataFrame) -> DataFrame:
    """Execution sinks by repository."""
    return nodes.where((F.col("family") == "sql") & (F.col("kind") == "sink") & F.coalesce("execution", F.lit(True))).groupBy("repo").agg(F.count(F.lit(1)).alias("n_sql"))


def bucket() -> Column:
    """The catalogue that a node belongs to, or null."""
    f, kind = F.col("family"), F.col("kind")
    execution = F.coalesce("execution", F.lit(True))
    same = ("file", "http-out", "crypto-algorithm", "crypto-key-source", "pii-field", "data-class-field", "raw-code-payload", "config-security", "crypto-config")
    return (
        F.when((f == "sql") & (kind == "source"), "sql-sources")
        .when((f == "sql") & execution, "sql-sinks")
        .when(f == "sql", "sql-orm-sinks")
        .when((f == "data-store") & (kind == "store"), "data-store")
        .when(f.isin("pii-log", "pii-storage"), "pii-sinks")
        .when(f.isin(*same), f)
    )


def bucket_counts(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("bucket", bucket()).where("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("repo").alias("n_repos"), F.count_if(F.col("confidence") == "high").alias("n_high"))


def posture_summary(nodes: DataFrame) -> DataFrame:
    """SQL sinks by how their statements are parameterised."""
    return nodes.where((F.col("family") == "sql") & (F.col("kind") == "sink")).groupBy(F.coalesce("parameterised", F.lit("unknown")).alias("posture")).agg(F.count(F.lit(1)).alias("n_sinks"), F.count_distinct("repo").alias("n_repos"))


def index_rows(nodes: DataFrame, repos: DataFrame) -> DataFrame:
    """One row a repository: counts by family, and uses of weak algorithms."""
    weak = (F.col("family") == "crypto-algorithm") & F.upper("algorithm").isin(*WEAK_CARD_ALGORITHMS)
    counts = nodes.groupBy("repo").agg(*[F.count_if(F.col("family") == f).alias("n_" + f.replace("-", "_")) for f in COUNTED], F.count_if(weak).alias("n_weak_crypto"))
    return repos.select("repo", "grp", "primary_language").join(counts, "repo", "left").na.fill(0)


def by_language(repos: DataFrame) -> DataFrame:
    return repos.groupBy("primary_language").agg(F.count(F.lit(1)).alias("n_repos"), joined_set(F.col("grp")).alias("groups"))


def by_group(repos: DataFrame) -> DataFrame:
    return repos.groupBy("grp").agg(F.count(F.lit(1)).alias("n_repos"), joined_set(F.col("primary_language")).alias("languages"))


def language_breakdown(files: DataFrame) -> DataFrame:
    """files (repo, language, ord): the most common language, the first seen on a tie."""
    counts = files.groupBy("repo", "language").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    best = F.max_by("language", F.struct(F.col("n"), (-F.col("first")).alias("f")))
    return counts.groupBy("repo").agg(best.alias("primary_language"), F.sum("n").alias("n_files"))


def most_common(df: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """(key, value, n): each key's most frequent values, the first seen on a tie."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("_first"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "_first")
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).drop("_first")


def public_paths(nodes: DataFrame, most: int = 10) -> DataFrame:
    """(repo, path, rank): inbound paths that come after a permit-all or anonymous pattern in their repository's order."""
    opens = (F.col("family") == "auth") & F.col("pattern").isin("permit-all-config", "is-anonymous")
    order = Window.partitionBy("repo").orderBy("ord")
    rows = nodes.where(F.col("family").isin("auth", "http-in")).withColumn("open", F.max(F.when(opens, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = rows.where("family = 'http-in' and open = 1 and path is not null and path != ''")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select("repo", "path", "rank")


def auth_cards(nodes: DataFrame, repos: DataFrame) -> DataFrame:
    """Each repository's patterns, inbound endpoints and maturity."""
    rows = nodes.where(F.col("family").isin("auth", "http-in"))
    counts = rows.groupBy("repo").agg(F.count_if(F.col("family") == "http-in").alias("n_http_in"), F.sort_array(F.collect_set(F.when(F.col("family") == "auth", F.coalesce("pattern", F.lit("unknown"))))).alias("p"))
    cards = repos.select("repo").join(counts, "repo", "left").select("repo", F.coalesce("n_http_in", F.lit(0)).alias("n_http_in"), F.coalesce("p", F.array().cast("array<string>")).alias("p"))
    return cards.select("repo", "n_http_in", F.array_join("p", ",").alias("patterns"), auth_maturity(F.col("p"), F.col("n_http_in")).alias("maturity"))


def crypto_cards(nodes: DataFrame, repos: DataFrame) -> DataFrame:
    """Each repository's algorithms, key sources, weak uses and maturity."""
    f, algorithm = F.col("family"), F.upper(F.coalesce("algorithm", F.lit("?")))
    weak = algorithm.isin(*WEAK_CARD_ALGORITHMS) | F.contains(algorithm, F.lit("MD5")) | F.contains(algorithm, F.lit("SHA1"))
    keys = f.isin("crypto-config", "config-security")
    counts = nodes.where(f.isin("crypto-algorithm", "crypto-config", "config-security")).groupBy("repo").agg(F.count_if(f == "crypto-algorithm").alias("n_algorithms"), F.count_if(keys).alias("n_key_sources"), F.count_if((f == "crypto-algorithm") & weak).alias("n_weak"))
    cards = repos.select("repo").join(counts, "repo", "left").na.fill(0)
    return cards.withColumn("maturity", crypto_maturity(F.col("n_algorithms"), F.col("n_key_sources")))


def top_algorithms(nodes: DataFrame, most: int = 15) -> DataFrame:
    rows = nodes.where("family = 'crypto-algorithm'").withColumn("algo", F.upper(F.coalesce("algorithm", F.lit("?"))))
    return most_common(rows, "repo", "algo", most)


def family_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("family").agg(F.count(F.lit(1)).alias("n"))


def baseline_drops(counts: DataFrame, baseline: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Families whose count fell by more than the tolerated share of the baseline."""
    both = baseline.select("family", F.col("n").alias("was")).join(counts, "family", "left").na.fill(0, ["n"])
    return both.where(F.col("n") < F.col("was") * (1 - tolerance)).select("family", "was", "n")
