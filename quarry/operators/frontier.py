"""Choosing what to crawl next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import urls as ux


def canonical(urls: DataFrame) -> DataFrame:
    """The distinct canonical urls. Canonicalising is the dear part: done once for each spelling, in a generator, through which no later filter is moved."""
    return urls.select("url").distinct().select(F.explode(F.array(ux.canonical_url(F.col("url")))).alias("url")).where("url <> ''").distinct()


def candidates(urls: DataFrame, site: ux.Site = ux.Site()) -> DataFrame:
    """(url, kind, score) of the canonical form of each distinct url; urls: url."""
    rows = canonical(urls).select("url", F.explode(F.array(ux.url_kind(F.col("url"), site))).alias("kind"))
    return rows.withColumn("score", ux.kind_score(F.col("kind")))


def select(urls: DataFrame, least: float = ux.MIN_SCORE, site: ux.Site = ux.Site()) -> DataFrame:
    """Candidates worth crawling; ``ordered`` sorts them."""
    return candidates(urls, site).where((F.col("score") >= least) & ~F.col("kind").isin(*ux.NEVER_CRAWLED))


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("score"), ux.authority(F.col("url")), "url")


def expand(pages: DataFrame, site: ux.Site = ux.Site(), least: float = ux.MIN_SCORE, most: int = 180_000) -> DataFrame:
    """The best links of crawled pages (url, outgoing_links) that are not crawled yet; refresh pages come again."""
    written = canonical(pages)
    refresh = written.where((F.lower(ux.authority(F.col("url"))) == site.refresh_host) & F.regexp_replace(ux.url_path(F.col("url")), "/+$", "").isin(*site.refresh_paths)) if site.refresh_host else written.limit(0)
    links = select(pages.select(F.explode("outgoing_links").alias("url")), least, site)
    fresh = links.join(written.join(refresh, "url", "left_anti"), "url", "left_anti")
    again = candidates(refresh, site).where(F.col("score") >= least)
    return ordered(fresh.unionByName(again).dropDuplicates(["url"])).limit(max(most, 0))


def within_budget(urls: DataFrame, budgets: DataFrame, counts: DataFrame, section) -> DataFrame:
    """Links of sections with budget left; ``section`` maps (host, is_document) to a key."""
    rows = urls.withColumn("section", section(ux.host_of(F.col("url")), ux.is_document_url(F.col("url"))))
    left = budgets.join(counts, budgets["key"] == counts["section"], "left").select(F.col("key").alias("section"), (F.col("budget") - F.coalesce("n", F.lit(0))).alias("left"))
    return rows.join(left, "section", "left").where("left is null or left > 0").drop("left")


def listing_pages(totals: DataFrame, per_page: int = 24) -> DataFrame:
    """(url, page) for pages 2 to the last of each listing; totals: url, total."""
    last = F.ceil(F.col("total") / per_page)
    return totals.where(last >= 2).select("url", F.explode(F.sequence(F.lit(2).cast("long"), last)).alias("page"))
