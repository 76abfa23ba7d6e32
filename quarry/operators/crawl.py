"""Fetched responses to page rows and links to follow: what a crawler does after the network."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import html as hx
from quarry.functions import text as tx
from quarry.functions import urls as ux
from quarry.operators import frontier
from quarry.plans.tables import computed
from quarry.sources.documents import extract

MAX_BODY, MAX_DOWNLOAD = 1 << 20, 3 << 20


def guarded(responses: DataFrame, budgets: DataFrame, counts: DataFrame, section: Callable[[Column, Column], Column], site: ux.Site = ux.Site()) -> DataFrame:
    """Responses that are kept: by url, by section budget, and, of pages, those that came whole.

    Pages may have any size.  One that announces more than MAX_DOWNLOAD and holds less than it announces is a broken
    download; documents whose download was stopped stay, and ``parse`` leaves their text empty.
    """
    told, got = F.coalesce(F.col("content_length").try_cast("long"), F.lit(0)), F.coalesce(F.length("body").cast("long"), F.lit(0))
    whole = ux.is_document_url(F.col("url")) | (told <= MAX_DOWNLOAD) | (got >= told)
    return frontier.within_budget(responses.where(~ux.should_drop(F.col("url"), site)).where(whole), budgets, counts, section)


def parse(responses: DataFrame) -> DataFrame:
    """Page rows of responses (url, status, content_type, content_disposition, body binary, section, category, fetched_at).

    Documents are read by type, sitemaps give links only, everything else is html. Html and sitemaps are read whole;
    documents above MAX_BODY, or announced (content_length, if there) above MAX_DOWNLOAD, have a row with empty text.
    """
    body = F.decode("body", "UTF-8")
    told = F.coalesce(F.col("content_length").try_cast("long"), F.lit(0)) if "content_length" in responses.columns else F.lit(0)
    large = F.coalesce(F.length("body") > MAX_BODY, F.lit(False)) | (told > MAX_DOWNLOAD)
    kind = F.coalesce(ux.document_type(F.col("url"), F.col("content_type")), F.when(ux.looks_like_xml(body, F.col("content_type")), "xml").otherwise("html"))
    rows = computed(responses, filetype=kind, source=body, large=large)
    same = ["url", "status", "content_type", "filetype", "section", "category", "fetched_at"]
    none = F.array().cast("array<string>")
    documents = rows.where(~F.col("filetype").isin("xml", "html")).withColumn("x", extract("body", "filetype"))
    documents = documents.withColumn("text", F.when(F.col("large"), "").otherwise(tx.clean_document_text(F.col("x.text"), F.col("filetype"))))
    documents = documents.select(*same, tx.document_title(F.col("url"), F.col("filetype"), F.col("text"), F.lit(""), F.col("content_disposition"), F.col("x.title")).alias("title"), "text", F.lit("").alias("html"), none.alias("anchors"), none.alias("outgoing_links"))
    h = F.col("source")
    pages = rows.where(F.col("filetype") == "html").select(*same, hx.page_title(h).alias("title"), hx.visible_text(h).alias("text"), h.alias("html"), hx.anchor_texts(h).alias("anchors"), hx.all_links(h, F.col("url")).alias("outgoing_links"))
    maps = rows.where(F.col("filetype") == "xml").select(*same, F.lit("").alias("title"), F.lit("").alias("text"), F.lit("").alias("html"), none.alias("anchors"), hx.all_links(h, F.col("url")).alias("outgoing_links"))
    return documents.unionByName(pages).unionByName(maps)


def follow(pages: DataFrame, budgets: DataFrame, counts: DataFrame, section: Callable[[Column, Column], Column], site: ux.Site = ux.Site(), least: float = ux.MIN_SCORE) -> DataFrame:
    """Links to request next: not the page itself, allowed, worth it, of sections with budget left."""
    links = pages.select(F.col("url").alias("page"), F.explode("outgoing_links").alias("url")).where(ux.canonical_key(F.col("page")) != ux.canonical_key(F.col("url")))
    return frontier.within_budget(frontier.select(links, least, site), budgets, counts, section)
