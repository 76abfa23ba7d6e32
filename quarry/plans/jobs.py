"""Whole jobs from files to files: cleaning, indexing, profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import urls as ux
from quarry.operators import analytics, clean, graph, index, suggest
from quarry.plans.schema import coerce_pages, doc_id
from quarry.plans.tables import written
from quarry.sources import jsonl, reports
from quarry.sources.store import Store


def clean_jsonl(spark: SparkSession, source: str, target: str) -> str:
    """Cleans a crawl; returns the report.  Blank lines are no input records, yet count as dropped,
    so that the duplicates reported are fewer by their number, and none if that leaves none."""
    lines = written(jsonl.with_line_numbers(jsonl.read_lines(spark, source)), "lines")
    n = {r["problem"]: r["n"] for r in lines.groupBy("problem").agg(F.count("*").alias("n")).collect()}
    items = coerce_pages(lines.where("problem is null").select("line_no", "item.*")).columns
    rows = lines.where("problem is null").select("line_no", "item.*").withColumns({c: F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("anchors", "outgoing_links")})
    kept, dropped = clean.clean(rows)
    kept = written(kept, "kept")
    jsonl.write_pages(kept.orderBy("line_no").select(*items), target, "overwrite")
    reasons = {r["reason"]: r["n"] for r in dropped.collect()} | {k: v for k, v in n.items() if k}
    total, out = sum(n.values()) - n.get("blank_line", 0), kept.count()
    duplicates = total - out - sum(v for k, v in reasons.items() if k != "duplicate_url")
    reasons = {k: v for k, v in reasons.items() if k != "duplicate_url"} | ({"duplicate_url": duplicates} if duplicates > 0 else {})
    facets = clean.counts_by(kept)
    part = lambda f: facets.where(F.col("facet") == f).orderBy(F.desc("n"), "key").select("key", "n")
    removed = spark.createDataFrame(sorted(reasons.items()), "key string, n long")
    return reports.sections("Crawl data cleaning report", {"Input": source, "Output": target, "Input records": total, "Output records": out, "Removed records": total - out}, {"Removed records": removed, "Section distribution": part("section"), "File type distribution": part("filetype"), "Top domains": part("domain")})


def edges_of(pages: DataFrame, kind: str = "index") -> DataFrame:
    links = pages.select("doc_id", F.posexplode("outgoing_links").alias("pos", "url")).withColumnRenamed("doc_id", "src")
    known = pages.select("url", F.col("doc_id").alias("id"))
    return graph.index_edges(links, known) if kind == "index" else graph.raw_edges(links, known)


def build_index(spark: SparkSession, source: str, target: str, store: str, last: bool = False) -> index.Index:
    """Reads pages, keeps the first (or last) of a url, ranks, stores snapshots and suggestions, writes the index."""
    rows = jsonl.read_pages(spark, source).withColumn("seq", F.monotonically_increasing_id())
    pages = written(clean.dedupe(rows, F.col("url"), "seq", "last" if last else "first").drop("first_seq").withColumn("doc_id", doc_id(F.col("url"))), "pages")
    ranks = graph.pagerank(pages.select(F.col("doc_id").alias("id")), edges_of(pages), iterations=12, tolerance=1e-6)
    shop = Store(spark, store)
    shop.add_snapshots(pages)
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    shop.append("suggestions", suggest.strongest(suggest.upsert(suggest.from_documents(pages).withColumn("updated_at", now))))
    index.build(written(clean.index_projection(pages, ranks), "docs")).save(target)
    return index.Index.load(spark, target)


def profile(spark: SparkSession, source: str) -> str:
    """The analytics report of a page file."""
    pages = written(jsonl.read_pages(spark, source).withColumn("doc_id", doc_id(F.col("url"))), "pages")
    edges = edges_of(pages, "raw")
    ranks = graph.pagerank(pages.select(F.col("doc_id").alias("id")), edges)
    one = analytics.totals(pages).first()
    best = analytics.top_ranked(pages, ranks).select(F.concat_ws(" ", "title", "url").alias("page"), "pagerank")
    return reports.sections("Corpus profile", {"Input": source, "Documents": one["document_count"], "Domains": one["domain_count"], "Edges": edges.count(), "Average text length": one["avg_text_length"], "Largest text length": one["max_text_length"]}, {
        "Domains": analytics.top(pages.select(ux.authority(F.col("url")).alias("domain")), "domain", 20), "File types": analytics.top(pages, "filetype"), "Top terms": analytics.top_terms(pages), "Top PageRank": best})
