"""The corpus pipeline: quality rules, language identification, near-duplicate removal and packing of the table documents.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and all but the last return the columns of
documents. run() writes each stage's result as Parquet in the shared folder and reads it again as the next one's docs. Rows are
judged as rows: a null or repeated doc_id neither drops a row nor joins it with another. A stage begins by having the executors
give back the heap that the stages before it left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import language_crf, near_copies, packing, quality_rules
from tracelake.llm.common import collect_garbage, quoted, stored, table
from tracelake.llm.queries import vocabulary

#: A document goes if no language has this share of its words: it is in none, or switches between several.
LEAST_SHARE = 0.5
#: Languages whose documents stay; None: all that the table's own labels teach.
LANGUAGES: list[str] | None = None
#: Pre-tokens that a worker remembers while packing: fewer than packing by itself does, since other stages share the executors.
MEMO = 50_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rule and the trained verdict.

    A null or empty text, or one of fewer than ten words, goes; very long texts are judged whole; repeated rows get one verdict;
    without labels the base rule decides; an empty table stays empty; columns of any name are carried on as they are.
    """
    collect_garbage(spark)
    return quality_rules.kept_rows(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose words are mostly of one language that is kept.

    A text that is null or without a letter goes; very long texts are labelled whole; repeated rows get one verdict; without a
    learned language no row stays; an empty table stays empty; columns of any name are carried on as they are.
    """
    collect_garbage(spark)
    return language_crf.rows_in_a_language(docs, LEAST_SHARE, LANGUAGES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: SimHash links, completed by an exact join of five-word shingles at a similarity of 0.8.

    It is the one with the smallest doc_id; rows without doc_id come last, and of equal ones the first read. All texts without
    words are one group; very long texts are compared whole; rows that share a doc_id are grouped by their texts only; an empty
    table stays empty; columns of any name are carried on as they are. Texts are not shuffled where few rows go.
    """
    collect_garbage(spark)
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc")), "rows")
    groups = near_copies.near_copies(rows.select("row", F.col("doc.text").alias("text")))
    order = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("doc_id"), F.col("row").alias("row"))
    shared = groups.join(groups.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group"), "group", "left_semi")
    members = stored(shared.join(rows.select("row", order.alias("order")), "row"), "members")
    first = members.groupBy("group").agg(F.min("order").alias("first"))
    gone = stored(members.join(first, "group").where("row != first.row").select("row"), "gone")
    return rows.join(near_copies.few(gone), "row", "left_anti").select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their places in sequences.

    A null or empty text is one piece that holds the end id; a longer text than a sequence is cut into pieces; repeated rows, and
    rows without doc_id, are packed each; an empty table gives no rows; other columns are not read.
    """
    collect_garbage(spark)
    return packing.pack_digests(docs, vocabulary(), memo=MEMO)


STAGES = [("quality_rules", quality), ("language_id", language), ("simhash_near_dedup", near_duplicates), ("best_fit_packing", pack)]
#: No stage of the four can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
