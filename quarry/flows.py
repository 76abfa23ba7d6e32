"""Queries of sources, sinks, stores, streams and whole jobs: each writes the driver's tables to the shared folder and reads them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import views as vw
from quarry.functions import text as tx
from quarry.functions import urls as ux
from quarry.operators import crawl, frontier, search
from quarry.plans import jobs, pipeline, sections
from quarry.plans.query_language import Query, parse_query
from quarry.plans.schema import DEFAULTS, coerce_pages
from quarry.plans.tables import shared_folder
from quarry.queries import _CANONICAL, _CRAWL, SEARCHES, _crawl, query, search_ctes
from quarry.sources import jsonl
from quarry.sources.store import Store
from quarry.streaming import ingest


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _digest(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


# ---------------------------------------------------------------- sources and sinks


@query("SELECT url, sha256(html) AS html_sha256, 'html' AS filetype, CAST(200 AS INTEGER) AS status FROM pages")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as JSON lines and back, defaults put in while reading."""
    at = _folder(spark, "jsonl")
    jsonl.write_pages(vw.table(spark, sf_dir, "pages").select("url", "html"), at)
    return jsonl.read_pages(spark, at).select("url", _digest("html").alias("html_sha256"), "filetype", "status")


def _lines(spark: SparkSession, sf_dir: str) -> str:
    """documents as a damaged file: lines left blank, cut or not objects."""
    n, at = F.col("doc_id"), _folder(spark, "lines")
    page = F.to_json(F.struct(F.concat(F.lit("https://a.example.com/"), n % 50).alias("url"), "text", F.when(n % 3 > 0, F.col("lang")).alias("section")))
    line = F.when(n % 7 == 0, " ").when(n % 11 == 0, F.left(page, F.length(page) - 1)).when(n % 13 == 0, "[1]").otherwise(page)
    vw.table(spark, sf_dir, "documents").select(line.alias("value")).write.text(at)
    return at


_LINES = "l AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'blank_line' WHEN doc_id % 11 = 0 THEN 'bad_json' WHEN doc_id % 13 = 0 THEN 'not_object' END AS problem FROM documents)"


@query(f"WITH {_LINES} SELECT coalesce(problem, 'none') AS problem, count(*) AS n FROM l GROUP BY 1")
def jsonl_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the lines of a file."""
    return jsonl.read_lines(spark, _lines(spark, sf_dir)).groupBy(F.coalesce("problem", F.lit("none")).alias("problem")).agg(F.count("*").alias("n"))


@query(f"WITH {_LINES} SELECT CASE WHEN problem IS NULL AND doc_id % 3 > 0 THEN coalesce(nullif(lang, ''), 'unknown') ELSE 'unknown' END AS section, count(*) AS n FROM l WHERE problem IS NULL OR problem <> 'blank_line' GROUP BY 1")
def sections_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each section in an earlier output."""
    return jsonl.section_counts(spark, _lines(spark, sf_dir))


@query(f"WITH {_LINES} SELECT DISTINCT 'https://a.example.com/' || doc_id % 50 AS url FROM l WHERE problem IS NULL")
def urls_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jsonl.written_urls(spark, _lines(spark, sf_dir))


@query(f"SELECT doc_id::VARCHAR AS url, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '{DEFAULTS['section']}' END AS section, CASE WHEN lang IS NULL AND doc_id % 2 = 0 THEN '{DEFAULTS['section']}' END AS none, 'web' AS category, CAST(CASE WHEN doc_id % 5 = 0 THEN 200 ELSE doc_id % 1000 END AS INTEGER) AS status, 0 AS n_anchors FROM documents WHERE lang IS NOT NULL")
def page_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of another shape as pages: numbers as text, values that are none, columns that are not there."""
    n = F.col("doc_id")
    rows = vw.table(spark, sf_dir, "documents").where("lang is not null").select(n.alias("url"), F.when(n % 2 == 0, F.col("lang")).alias("section"), F.when(n % 5 == 0, "x").otherwise((n % 1000).cast("string")).alias("status"))
    return coerce_pages(rows, "web").select("url", "section", F.lit(None).cast("string").alias("none"), "category", "status", F.size("anchors").alias("n_anchors"))


@query(f"WITH {_CRAWL}, w AS (SELECT key, max(length(text)) AS text_len FROM j WHERE reason IS NULL GROUP BY key) SELECT key AS url_key, CAST(text_len AS INTEGER) AS text_len FROM w")
def clean_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaning job from file to file: the best page of each url."""
    source, target = _folder(spark, "crawl"), _folder(spark, "clean")
    jsonl.write_pages(_crawl(spark, sf_dir).drop("line_no"), source)
    jobs.clean_jsonl(spark, source, target)
    return jsonl.read_pages(spark, target).select(ux.canonical_key(F.col("url")).alias("url_key"), F.length("text").alias("text_len"))


# ---------------------------------------------------------------- text and urls with escapes


@query(f"SELECT doc_id, trim({vw.normal('text')} || ' é — — A') AS text FROM documents")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named, decimal and hexadecimal entities of every text."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" &eacute; &mdash; &#8212; &#x41;"))
    return vw.table(spark, sf_dir, "documents").select("doc_id", tx.normalize_space(text).alias("text"))


@query("SELECT page_id, lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) || '/a?q=a+b+' || page_id || '&x=%C3%A9%7E' AS canonical FROM (SELECT page_id, url FROM pages)".replace("%7E", "~"))
def canonical_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments that are written in several ways have one spelling."""
    p = vw.table(spark, sf_dir, "pages")
    space = F.when(F.col("page_id") % 2 == 0, "%20").otherwise("+")
    url = F.concat(F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.lit("/a?x=%c3%a9%7E&q=a"), space, F.lit("b"), space, F.col("page_id").cast("string"))
    return p.select("page_id", ux.canonical_url(url).alias("canonical"))


# ---------------------------------------------------------------- crawling without the network


@query(f"SELECT url, CASE WHEN page_id % 5 = 0 THEN 'xml' ELSE 'html' END AS filetype, CASE WHEN page_id % 5 = 0 THEN '' ELSE {vw.TITLE} END AS title, sha256(CASE WHEN page_id % 5 = 0 THEN '' ELSE {vw.TEXT} END) AS text_sha256, CASE WHEN page_id % 5 = 0 THEN 0 ELSE len({vw.ANCHORS}) END AS n_anchors FROM pages")
def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses as pages, by their content type."""
    kind = F.when(F.col("page_id") % 5 == 0, "application/xml").otherwise("text/html; charset=utf-8")
    rows = vw.table(spark, sf_dir, "pages").select("url", F.encode("html", "UTF-8").alias("body"), kind.alias("content_type"), F.lit("").alias("content_disposition"), F.lit(200).alias("status"), F.lit("main").alias("section"), F.lit("web").alias("category"), F.lit("").alias("fetched_at"))
    return crawl.parse(rows).select("url", "filetype", "title", _digest("text").alias("text_sha256"), F.size("anchors").cast("long").alias("n_anchors"))


@query("""WITH h AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS h FROM pages), p AS (SELECT url, 0 AS part FROM pages WHERE page_id % 10 = 0 UNION ALL SELECT s || h || '/sitemap.xml', 1 FROM h CROSS JOIN (VALUES ('https://'), ('http://')) x(s) UNION ALL SELECT url, 2 FROM pages)
SELECT url, CAST(min(part) AS INTEGER) AS part FROM p GROUP BY url""")
def start_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds, sitemaps and known urls, each once where it comes first."""
    p = vw.table(spark, sf_dir, "pages")
    hosts = p.select(ux.authority(F.col("url")).alias("domain")).distinct()
    return sections.start_urls(p.where("page_id % 10 = 0").select("url", F.col("page_id").alias("pos")), sections.sitemap_seeds(hosts), p)


@query("WITH t AS (SELECT source AS url, count(*) AS total FROM documents GROUP BY source) SELECT url, unnest(range(2, 1 + CAST(ceil(total / 24) AS BIGINT))) AS page FROM t")
def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The further pages of a listing of each source's documents."""
    totals = vw.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("url")).agg(F.count("*").alias("total"))
    return frontier.listing_pages(totals)


# ---------------------------------------------------------------- the store


@query("""SELECT CAST(page_id AS VARCHAR) AS doc_id, sha256(CASE WHEN page_id % 2 = 0 THEN '<pre>' || replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</pre>' ELSE html END) AS html_sha256 FROM pages""")
def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored copies, the escaped text where there is no html; a second run overwrites none."""
    store = Store(spark, _folder(spark, "store"))
    p = vw.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("doc_id"), F.col("html").alias("text"), F.when(F.col("page_id") % 2 == 1, F.col("html")).alias("html"))
    store.add_snapshots(p)
    store.add_snapshots(p.withColumn("html", F.lit("other")))
    return store.table("snapshots").select("doc_id", _digest("html").alias("html_sha256"))


@query("SELECT user_id AS id, max_by(event_type, event_id) AS interests, max(event_id) AS version FROM events GROUP BY user_id")
def latest_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's latest version among appended ones."""
    store = Store(spark, _folder(spark, "store"))
    rows = vw.table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("interests"), F.col("event_id").alias("version"))
    for part in (0, 1):
        store.append("users", rows.where(F.col("version") % 2 == part))
    return store.users().select("id", "interests", "version")


@query("SELECT 'sign' AS username, max(user_id) AS id FROM events WHERE event_id % 40 = 27")
def session_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose session it is; half of the sessions have ended, this one has not."""
    store = Store(spark, _folder(spark, "store"))
    e = vw.table(spark, sf_dir, "events")
    store.append("users", e.select(F.col("user_id").alias("id"), F.lit("sign").alias("username")).distinct())
    store.append("sessions", e.select((F.col("event_id") % 40).alias("token"), "user_id", (F.col("event_id") < 20).alias("ended")))
    return store.user_of_session("27").select("username", "id")


# ---------------------------------------------------------------- search beside the page of results


@query(f"""{search_ctes(SEARCHES['search_title'])}, k AS (SELECT 'filetype' AS facet, filetype AS key, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'section', section, count(*) FROM f GROUP BY 2)
SELECT facet, key, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, key) AS r FROM k WHERE key IS NOT NULL) WHERE r <= CASE facet WHEN 'filetype' THEN 20 ELSE 12 END AND key <> ''""")
def facets_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.remote_facets(search.matches(vw.index_of(spark, sf_dir), parse_query(SEARCHES["search_title"])))


_CHAIN = Query("  the   erly thble ", size=20)


@query(f"{search_ctes(Query('the erly thble'))} SELECT doc_id, round(score, 6) AS score FROM f ORDER BY score DESC, doc_id LIMIT 20")
def component_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search as a chain of components, retrieval replaced by one of a fixed day."""
    def retrieve_of_day(c: pipeline.Context) -> pipeline.Context:
        c.hits, c.facets, c.totals = search.search(c.index, c.query, as_of=F.lit(vw.AS_OF).cast("timestamp"), history=c.history)
        return c

    chain = [retrieve_of_day if c is pipeline.retrieve else c for c in pipeline.DEFAULT]
    return pipeline.run(pipeline.Context(_CHAIN, vw.index_of(spark, sf_dir)), chain).hits.select("doc_id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- streams


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, one file or a folder of files, as a stream of files."""
    at = f"{sf_dir}/{name}.parquet"
    rows = spark.readStream.schema(vw.table(spark, sf_dir, name).schema)
    if vw.is_folder(spark, at):
        return rows.parquet(at)
    return rows.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)  # a stream's path must be a folder


def _appended(spark: SparkSession, items: DataFrame) -> DataFrame:
    at = _folder(spark, "stream")
    ingest.append_to(items, f"{at}/rows", f"{at}/log", "parquet").awaitTermination()
    return spark.read.schema(items.schema).parquet(f"{at}/rows")


def _rolled_up(spark: SparkSession, items: DataFrame) -> DataFrame:
    at = _folder(spark, "stream")
    ingest.roll_up(items, f"{at}/rows", f"{at}/log").awaitTermination()
    return spark.read.schema(items.schema).parquet(f"{at}/rows")


@query(f"SELECT DISTINCT c AS url_key FROM {_CANONICAL.replace('FROM pages', 'FROM (SELECT page_id, url FROM pages UNION ALL SELECT page_id, split_part(url, chr(63), 1) FROM pages)')}")
def stream_distinct_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each canonical url once, however it is spelt."""
    urls = F.explode(F.array("url", F.substring_index("url", "?", 1))).alias("url")
    return _appended(spark, ingest.distinct_urls(_stream(spark, sf_dir, "pages").select(urls))).select("url_key")


@query("SELECT seq, section FROM (SELECT doc_id AS seq, coalesce(nullif(lang, ''), 'unknown') AS section, row_number() OVER (PARTITION BY coalesce(nullif(lang, ''), 'unknown') ORDER BY doc_id) AS r FROM documents) WHERE r <= CASE section WHEN 'en' THEN 35 WHEN 'de' THEN 10 ELSE r END")
def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first documents of each section within its budget, what was written before counted."""
    items = _stream(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("lang").alias("section"))
    return _appended(spark, ingest.within_budget(items, {"en": 40, "de": 10}, {"en": 5}))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and type."""
    rows = _rolled_up(spark, ingest.windowed_counts(_stream(spark, sf_dir, "events")))
    return rows.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("SELECT event_type AS term, 2.0::DOUBLE * count(*) AS weight FROM events GROUP BY 1")
def stream_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running weights of suggested terms."""
    return _rolled_up(spark, ingest.suggestion_weights(_stream(spark, sf_dir, "events").select(F.col("event_type").alias("term"), F.lit(2.0).alias("weight"))))
