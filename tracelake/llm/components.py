"""Connected components of a graph of links, by alternating large and small stars.

Each round is two aggregations and joins by node. Links are written to the shared folder after each round, so lineage stays
short and a lost executor costs one round at most. Nothing is collected but the number of changed links. A node of many links
is a hot key of a join whose large side Spark can split; minima are taken map-side first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import stored

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: a node's larger neighbours are linked to the smallest of node and neighbours. Small star: the node and its smaller neighbours are."""
    ends = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        ends = ends.unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    met = ends.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b): any ids that can be ordered. Gives (node, component), the component's smallest node; a node without links has no row."""
    now = stored(links.select("a", "b").where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    size = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for _ in range(MAX_ROUNDS):
        if not size[0]:
            break
        now = stored(_star(_star(now, True), False), "links")
        again = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(again) == tuple(size):
            break
        size = again
    else:
        raise RuntimeError(f"components not settled after {MAX_ROUNDS} rounds")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
