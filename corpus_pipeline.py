"""A training corpus from ``documents``, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns rows of docs; what it
returns is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, langid, mixing, secrets, simhash
from quarry.llm.common import WORD, Scratch, table

#: A document's language is known if it is at least as likely as all others together.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.keep_identified(docs, model, LEAST_SCORE)


def keyed(spark: SparkSession, docs: DataFrame, stage: str) -> DataFrame:
    """docs with a unique key of each row, __row; written, so that it is the same whenever it is read."""
    return Scratch(spark, stage).write(docs.withColumn("__row", F.monotonically_increasing_id()))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the smallest doc_id (null is last, of equal ones any)."""
    rows = keyed(spark, docs, "dedup")
    groups = simhash.near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text")).select(F.col("doc_id").alias("__row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    first = rows.select("__row", "doc_id").join(groups, "__row").groupBy("component_id").agg(F.min(order).alias("x")).select("x.__row")
    return rows.join(first, "__row", "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, each by its own text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a secret go."""
    return secrets.scan(docs, out="__spans").where(F.size("__spans") == 0).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words it takes of each (repeats counted)."""
    # what is taken of a row follows from its doc_id, source and size: one match for each row, nulls included
    taken = mixing.mix(docs.select("doc_id", "source", "text")).where("taken > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), "size", "target", "taken").distinct()
    own = [c for c in docs.columns if c not in ("size", "target", "taken")]
    rows = docs.select(*own, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("__size"))
    same = rows["doc_id"].eqNullSafe(taken["__id"]) & rows["source"].eqNullSafe(taken["__source"]) & (rows["__size"] == taken["size"])
    return rows.join(taken, same).select(*own, "size", "target", "taken")


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("secret scans", secret_scan), ("mixing sources", mixture)]

#: No stage before the last can be expressed in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return docs
