"""Profiles of a corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions import urls as ux
from quarry.plans.sections import scaled_budget


def totals(pages: DataFrame) -> DataFrame:
    """One row: documents, domains, average and largest text length."""
    size = F.length(tx.text_or_empty(F.col("text")))
    return pages.agg(F.count("*").alias("document_count"), F.countDistinct(ux.authority(F.col("url"))).alias("domain_count"), F.round(F.coalesce(F.avg(size), F.lit(0.0)), 2).alias("avg_text_length"), F.coalesce(F.max(size), F.lit(0)).alias("max_text_length"))


def top(rows: DataFrame, key: str, most: int | None = None) -> DataFrame:
    """(key, n), the most frequent first, ties by key."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), key).limit(most) if most else n


def top_terms(pages: DataFrame, most: int = 30, shortest: int = 2) -> DataFrame:
    """By document frequency."""
    tokens = tx.tokenize(F.concat_ws(" ", tx.text_or_empty(F.col("title")), tx.text_or_empty(F.col("text"))))
    return top(pages.select(F.explode(tokens).alias("term")).where(F.length("term") >= shortest), "term", most)


def top_ranked(pages: DataFrame, ranks: DataFrame, most: int = 10) -> DataFrame:
    rows = pages.join(ranks.select(F.col("id").alias("doc_id"), "rank"), "doc_id", "left").select("title", "url", F.round(F.coalesce("rank", F.lit(0.0)), 8).alias("pagerank"))
    return rows.orderBy(F.desc("pagerank"), "url").limit(most)


def progress(sections: DataFrame, pages: DataFrame, scale: float = 1.0) -> DataFrame:
    """Indexed pages of each planned section against its budget; sections without pages stay."""
    n = pages.groupBy("section").agg(F.count("*").alias("n"))
    rows = sections.join(n, sections["key"] == n["section"], "left")
    target = scaled_budget(F.col("max_pages"), scale)
    count = F.coalesce("n", F.lit(0))
    return rows.select("key", target.alias("target"), count.alias("indexed_count"), F.round(F.least(count / F.greatest(target, F.lit(1)), F.lit(1.0)), 4).alias("indexed_progress"))


def accept_within_budget(items: DataFrame, budgets: DataFrame, initial: DataFrame, seq: str = "seq") -> DataFrame:
    """The first B items of each section in order of ``seq``, counting what was written before; sections without a budget pass.

    Ranks inside a hot section come from counts of slices: each slice of seq is
    ranked by itself and offset by the rows before it, so no task holds a section.
    """
    sliced = items.withColumn("__slice", F.floor(F.col(seq) / 100_000))
    before = sliced.groupBy("section", "__slice").agg(F.count("*").alias("c"))
    before = before.withColumn("__before", F.coalesce(F.sum("c").over(Window.partitionBy("section").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    ranked = sliced.withColumn("__r", F.row_number().over(Window.partitionBy("section", "__slice").orderBy(seq))).join(before, ["section", "__slice"])
    limits = budgets.withColumnRenamed("key", "section").join(initial.select("section", F.col("n").alias("__done")), "section", "left").select("section", "budget", F.coalesce("__done", F.lit(0)).alias("__done"))
    rows = ranked.join(limits, "section", "left").where("budget is null or __before + __r + __done <= budget")
    return rows.select(*items.columns)
