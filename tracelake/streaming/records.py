"""Records as they arrive: a file stream that keeps the newest record of each repository, and running counts of families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake.operators.fleet import incremental_plan
from tracelake.schema import RECORD, SCHEMA_VERSION


def record_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """New record files (one JSON line each) below a path; other schema versions are left out."""
    return spark.readStream.schema(RECORD).option("maxFilesPerTrigger", per_trigger).json(path).where(F.col("schema_version") == SCHEMA_VERSION)


def upsert(stream: DataFrame, table: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the newest record (by analysed_at) of each repository in a Parquet table partitioned by a hash of its name.

    A batch rewrites only the partitions that it has repositories of. A batch that runs again gives the same table.
    """

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("part", F.pmod(F.xxhash64("group", "name"), F.lit(buckets)).cast("int")).persist()
        try:
            parts = [r["part"] for r in rows.select("part").distinct().collect()]  # at most `buckets`
            if not parts:
                return
            fs = spark._jvm.org.apache.hadoop.fs.Path(table)
            there = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
            old = spark.read.schema(rows.schema).parquet(table).where(F.col("part").isin(parts)) if there else rows.limit(0)
            every = old.unionByName(rows)
            newest = every.groupBy("part", "group", "name").agg(F.max_by(F.struct(*[c for c in every.columns if c not in ("part", "group", "name")]), F.coalesce("analysed_at", F.lit(""))).alias("r"))
            merged = newest.select("part", "group", "name", "r.*").select(*rows.columns)
            staged = f"{table}__staged"
            merged.write.mode("overwrite").partitionBy("part").parquet(staged)
            spark.read.schema(rows.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(table)
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(stream: DataFrame) -> DataFrame:
    """Nodes by family over all records so far."""
    return stream.select(F.explode("nodes").alias("n")).groupBy(F.col("n.family").alias("family")).agg(F.count(F.lit(1)).alias("n"))


def pending(now: DataFrame, table: DataFrame, detection: int, derivation: int) -> DataFrame:
    """Repositories that a next run must analyse or derive anew, against the table that upsert() keeps."""
    before = table.select(F.concat_ws("/", "group", "name").alias("repo"), "git_sha", "detection_version", "derivation_version")
    return incremental_plan(now, before, detection, derivation).where("action != 'skip'")
