"""Cleaning and deduplicating crawled pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.functions import urls as ux
from quarry.plans.tables import computed

# Statuses that count as success, and caps of the quality tuple.
SUCCESS, LONGEST = (200, 202), 2_000_000


def rejection_reason(url: Column, status: Column, filetype: Column, title: Column, text: Column, html: Column) -> Column:
    """The first reason that applies; null if the row stays. ``status`` is the raw value, 200 if missing."""
    blank = lambda c: F.trim(tx.text_or_empty(c)) == ""
    number = F.coalesce(status.cast("string"), F.lit("200")).try_cast("int")
    return (
        F.when(tx.text_or_empty(url) == "", "empty_url")
        .when(~ux.is_web_url(url), "invalid_url")
        .when(ux.is_service_url(url), "service_url")
        .when(number.isNull(), "invalid_status")
        .when(~number.isin(*SUCCESS), "non_success_status")
        .when((F.lower(F.coalesce(F.nullif(filetype, F.lit("")), F.lit("html"))) == "html") & blank(title) & blank(text) & blank(html), "empty_html_shell")
    )


def quality(status: Column, text: Column, html: Column, title: Column, links: Column) -> Column:
    """Compared field by field: success, text, html and title lengths, number of links."""
    size = lambda c: F.length(tx.text_or_empty(c))
    return F.struct(
        F.when(status.cast("string").try_cast("int") == 200, 1).otherwise(0).alias("ok"), F.least(size(text), F.lit(LONGEST)).alias("text_len"), F.least(size(html), F.lit(LONGEST)).alias("html_len"),
        size(title).alias("title_len"), F.coalesce(F.size(links), F.lit(0)).alias("n_links"),
    )


def dedupe(rows: DataFrame, key: Column, seq: str, policy: str = "first", best: Column | None = None) -> DataFrame:
    """One row a key: ``first``, ``last`` or ``best`` (the largest ``best``, the first of equals).

    Winners are found by an aggregation of (key, seq) that is summed before the
    shuffle, so one hot key is no hot task; payloads then meet them by ``seq``.
    ``first_seq`` is the first occurrence, by which ``last`` keeps its order.
    """
    narrow = rows.select(key.alias("__key"), F.col(seq).alias("__seq"), (best if best is not None else F.lit(0)).alias("__best"))
    win = {"first": F.min("__seq"), "last": F.max("__seq"), "best": -F.max(F.struct("__best", (-F.col("__seq")).alias("s")))["s"]}[policy]
    winners = narrow.groupBy("__key").agg(win.alias(seq), F.min("__seq").alias("first_seq")).drop("__key")
    return rows.join(winners, seq)


def normalise_documents(pages: DataFrame) -> DataFrame:
    """Text and title of rows that are no html."""
    kind = F.lower(F.coalesce(F.nullif(F.col("filetype"), F.lit("")), F.lit("html")))
    plain, other = pages.where(kind == "html"), pages.where(kind != "html")
    clean = other.withColumn("text", tx.clean_document_text(F.col("text"), kind))
    return plain.unionByName(clean.withColumn("title", tx.document_title(F.col("url"), kind, F.col("text"), F.col("title"))))


def judged(pages: DataFrame) -> DataFrame:
    """pages with reason, key and quality."""
    c = F.col
    return computed(pages, reason=rejection_reason(c("url"), c("status"), c("filetype"), c("title"), c("text"), c("html")), key=ux.canonical_key(c("url")), quality=quality(c("status"), c("text"), c("html"), c("title"), c("outgoing_links")))


def clean(pages: DataFrame, seq: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """(kept rows in input order, dropped: reason and count). Outgoing links of kept rows are filtered and deduplicated."""
    rows = judged(normalise_documents(pages))
    good = rows.where("reason is null")
    kept = dedupe(good, F.col("key"), seq, "best", F.col("quality")).drop("reason", "key", "quality", "first_seq")
    counted = rows.groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("reason").isNull(), F.col("key"))).alias("keys"))
    dropped = counted.select(F.coalesce("reason", F.lit("duplicate_url")).alias("reason"), F.when(F.col("reason").isNull(), F.col("n") - F.col("keys")).otherwise(F.col("n")).alias("n")).where("n > 0")
    return kept.withColumn("outgoing_links", ux.ordered_distinct_links(F.col("outgoing_links"))), dropped


def counts_by(kept: DataFrame, domains: int = 30) -> DataFrame:
    """(facet, key, n): sections, file types and statuses, and the most frequent domains."""
    unknown = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unknown"))
    facets = F.explode(F.array(*[F.struct(F.lit(n).alias("facet"), c.alias("key")) for n, c in (("section", unknown("section")), ("filetype", F.lower(unknown("filetype"))), ("status", unknown("status")), ("domain", F.lower(ux.authority(F.col("url")))))]))
    n = kept.select(facets.alias("x")).groupBy("x.facet", "x.key").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "key"))
    return n.withColumn("r", rank).where((F.col("facet") != "domain") | (F.col("r") <= domains)).drop("r")


def index_projection(pages: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """What an index stores of a page: no html, trimmed links and anchors, rank (0 if it has none)."""
    from quarry.plans.schema import doc_id

    rows = pages.drop("html").withColumns({"doc_id": doc_id(F.col("url")), "outgoing_links": ux.indexed_links(F.col("outgoing_links")), "anchors": F.slice(F.transform("anchors", lambda a: F.left(a, F.lit(512))), 1, 128)})
    rows = rows.withColumn("snapshot_path", F.concat("doc_id", F.lit(".html")))
    if ranks is None:
        return rows.withColumn("pagerank", F.lit(0.0))
    return rows.join(ranks.select(F.col("id").alias("doc_id"), "rank"), "doc_id", "left").withColumn("pagerank", F.coalesce("rank", F.lit(0.0))).drop("rank")
