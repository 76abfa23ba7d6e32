"""One query for each operator family over the driver's tables, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import views as vw
from quarry.functions import html as hx
from quarry.functions import scoring as sc
from quarry.functions import text as tx
from quarry.functions import urls as ux
from quarry.operators import analytics, clean, frontier, graph, index, search, suggest
from quarry.plans import sections
from quarry.plans.query_language import Query, parse_query, site_prefixes, wildcard_regex
from quarry.plans.schema import doc_id

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return register


def _joined(c, sep: str = " "):
    return F.array_join(c, sep)


# ---------------------------------------------------------------- text


@query(f"WITH {vw.D} SELECT doc_id, unnest({vw.TOKENS.format('text')}) AS token FROM d")
def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.documents(spark, sf_dir).select("doc_id", F.explode(tx.tokenize(F.col("text"))).alias("token"))


_RUNS = ("南开大学", "计算机网络和数据库课程", "信息检索 CARSI abc_1", "")


@query("""
WITH r AS (SELECT * FROM (VALUES (0, '南开大学'), (1, '计算机网络和数据库课程'), (2, '信息检索')) t(id, s)),
g AS (SELECT id, s[i:i + n - 1] AS token FROM (SELECT id, s, unnest(range(1, 5)) AS n FROM r) CROSS JOIN range(1, 12) x(i) WHERE i + n - 1 <= length(s) UNION SELECT id, s FROM r WHERE length(s) <= 8
  UNION SELECT 2, 'carsi' UNION SELECT 2, 'abc_1') SELECT DISTINCT CAST(id AS BIGINT) AS id, token FROM g""")
def tokenize_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(_RUNS)), "id long, s string")
    return rows.select("id", F.explode(tx.tokenize(F.col("s"))).alias("token"))


@query(f"WITH {vw.D} SELECT doc_id, {vw.normal('text')} AS text FROM d")
def normalize_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.documents(spark, sf_dir).select("doc_id", tx.normalize_space(F.col("text")).alias("text"))


@query(rf"""
WITH {vw.D}, x AS (SELECT doc_id, text AS raw, {vw.normal('text')} AS c FROM d)
SELECT doc_id, CASE WHEN c = '' THEN false WHEN contains(left(lower(c), 240), '�') OR contains(left(lower(c), 240), 'jfif') OR contains(left(lower(c), 240), '[content types].xml') OR contains(left(lower(c), 240), '[content_types].xml') THEN NOT regexp_matches(c, '[一-鿿]')
  WHEN length(regexp_replace(c, '[\p{{Cc}}\p{{Cf}}\p{{Co}}\p{{Zl}}\p{{Zp}}]', '', 'g')) / length(c) < 0.85 THEN true ELSE length(c) >= 30 AND length(regexp_replace(c, '[^\p{{L}}\p{{N}}]', '', 'g')) / length(c) < 0.12 END AS is_binary FROM x""")
def binary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.documents(spark, sf_dir).select("doc_id", tx.is_binary_text(F.col("text")).alias("is_binary"))


@query()
def title_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = vw.documents(spark, sf_dir)
    return d.select("doc_id", tx.document_title(F.col("url"), F.col("filetype"), F.col("text"), F.col("title")).alias("title"))


@query()
def title_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = vw.documents(spark, sf_dir)
    return d.select("doc_id", F.round(tx.title_score(F.col("title"), 30), 6).alias("score"), tx.is_opaque_title(F.col("title")).alias("opaque"), tx.has_title_signal(F.col("title")).alias("signal"))


@query(f"""
WITH {vw.D}, x AS (SELECT doc_id, {vw.normal('text')} AS t FROM d),
y AS (SELECT doc_id, t, greatest(coalesce(least(nullif(instr(lower(t), 'the'), 0), nullif(instr(lower(t), 'nicht'), 0)), 1) - 1 - 60, 0) AS s FROM x)
SELECT doc_id, t[s + 1:s + 180] || CASE WHEN s + 180 < length(t) THEN '...' ELSE '' END AS snippet FROM y""")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.documents(spark, sf_dir).select("doc_id", tx.snippet(F.col("text"), "the nicht").alias("snippet"))


@query(f"""
WITH {vw.D}, o AS (SELECT doc_id, list_transform(regexp_extract_all(title || ' ' || left(text, 2000), '[A-Za-z0-9_]+'), lambda x: lower(x)) AS w FROM d),
u AS (SELECT doc_id, term, min(pos) AS pos FROM (SELECT doc_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM o) WHERE length(term) >= 2 AND term NOT IN ('http','https','www','edu','cn','html','htm') AND NOT regexp_matches(term, '^[0-9]+$') GROUP BY doc_id, term)
SELECT doc_id, CAST(r AS INTEGER) AS pos, term FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS r FROM u) WHERE r < 8""")
def doc_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.documents(spark, sf_dir).select("doc_id", F.posexplode(tx.suggestion_terms(F.col("title"), F.col("text"))).alias("pos", "term"))


# ---------------------------------------------------------------- urls and html


@query("""SELECT page_id, CASE WHEN contains(split_part(url, '?', 1), '.') AND length(regexp_extract(split_part(url, '?', 1), '\\.([^.]*)$', 1)) BETWEEN 1 AND 5 THEN lower(regexp_extract(split_part(url, '?', 1), '\\.([^.]*)$', 1)) ELSE 'html' END AS filetype FROM pages""".replace("\\\\", "\\"))
def infer_filetype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.table(spark, sf_dir, "pages").select("page_id", tx.infer_filetype(F.col("url")).alias("filetype"))


_CANONICAL = r"""(SELECT page_id, url, lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) || coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#;]*)', 1), ''), '/') || CASE WHEN q = '' THEN '' ELSE '?' || q END AS c
  FROM (SELECT page_id, url, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda a: regexp_matches(a, '^[^=]*=.') AND NOT regexp_matches(lower(a), '^(utm_|spm)'))), '&') AS q FROM pages))"""


@query(f"SELECT page_id, c AS canonical FROM {_CANONICAL}")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.table(spark, sf_dir, "pages").select("page_id", ux.canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, c AS canonical FROM {_CANONICAL}")
def canonical_url_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.table(spark, sf_dir, "pages").select("page_id", ux.canonical_url_exact(F.col("url")).alias("canonical"))


_KINDS = (("https://a.example.com/2025/0522/c17471a596037/page.htm?utm_source=x&b=2", 0), ("https://a.example.com/17471/list2.htm", 1), ("https://a.example.com/_visitcount?siteId=1", 2), ("https://a.example.com/files/a.pdf", 3), ("https://a.example.com/sitemap.xml", 4), ("https://a.example.com/", 5), ("https://a.example.com/about.htm", 6), ("https://a.example.com/x/y/z", 7), ("https://a.example.com/login", 8), ("ftp://a.example.com/", 9), ("http://b.example.com/anime/a12345", 10))
_VALUES = "(VALUES " + ", ".join(f"({i}, '{u}')" for u, i in _KINDS) + ") t(id, url)"
_KIND = r"""CASE WHEN NOT regexp_matches({0}, '^https?://[^/?#]') OR regexp_matches({0}, '/login|/logout|/admin|/wp-admin|/search\?|/\?.*page=|_visitcount(?:[?#].*)?$|/_wp3services/|/api/tracking|(?i)\.(?:zip|rar|7z|tar|gz|bz2|xz|iso|dmg|exe|msi|mp4|mp3|avi|mov|wmv)(?:[?#].*)?$') THEN 'blocked'
  WHEN regexp_matches(lower({0}), '/_visitcount|/_wp3services|/api/tracking|/search(?:\?|/)|/login|/logout|/admin|/wp-admin') THEN 'service' WHEN regexp_matches({1}, '/sitemap(_index)?\.xml$') THEN 'sitemap'
  WHEN regexp_matches(lower({0}), '\.(?:pdf|doc|docx|xls|xlsx|txt)(?:[?#].*)?$') THEN 'document'
  WHEN regexp_matches({1}, '(?i)/\d{{4}}/\d{{4}}/c\d+a\d+/page\.htm|/\d{{4}}/\d{{2}}/\d{{2}}/\d+\.s?html|/(?:info|content)/\d+/\d+\.(?:htm|html|shtml|psp)|/(?:anime|comic|game|novel)/[acgn]\d{{3,}}/?$') THEN 'detail'
  WHEN regexp_matches({1}, '(?i)/(?:\d+/)?list\d*\.(?:htm|html|shtml|psp)$') THEN 'list' WHEN {1} IN ('/', '/main.htm', '/index.htm', '/index.html', '/default.htm') THEN 'home'
  WHEN length({1}) - length(replace({1}, '/', '')) <= 2 AND regexp_matches({1}, '\.(?:htm|html|shtml|psp)$') THEN 'section' ELSE 'content' END"""
_PATH = "regexp_extract({0}, '^[a-z]+://[^/?#]*([^?#;]*)', 1)"
_SCORE = "CASE kind WHEN 'list' THEN 0.10 WHEN 'section' THEN 0.45 WHEN 'content' THEN 0.65 WHEN 'home' THEN 0.70 WHEN 'sitemap' THEN 0.75 WHEN 'document' THEN 0.90 WHEN 'detail' THEN 1.00 ELSE 0.0 END::DOUBLE"


@query(f"SELECT page_id, kind, {_SCORE} AS score FROM (SELECT page_id, {_KIND.format('c', _PATH.format('c'))} AS kind FROM {_CANONICAL})")
def url_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vw.table(spark, sf_dir, "pages").select("page_id", ux.canonical_url(F.col("url")).alias("url")).select("page_id", ux.url_kind(F.col("url")).alias("kind"))
    return rows.withColumn("score", ux.kind_score(F.col("kind")))


_FIXED = f"(SELECT page_id, c, {_KIND.format('c', _PATH.format('c'))} AS kind FROM {_CANONICAL.replace('FROM pages', 'FROM (SELECT id AS page_id, url FROM ' + _VALUES + ')')})"


@query(f"SELECT CAST(page_id AS BIGINT) AS id, CASE WHEN page_id = 9 THEN 'blocked' ELSE kind END AS kind FROM {_FIXED}")
def url_kind_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, u) for u, i in _KINDS], "id long, url string").select("id", ux.canonical_url(F.col("url")).alias("url")).select("id", ux.url_kind(F.col("url")).alias("kind"))


@query(f"SELECT c AS url, kind, score FROM (SELECT DISTINCT c, kind, {_SCORE} AS score FROM (SELECT c, {_KIND.format('c', _PATH.format('c'))} AS kind FROM {_CANONICAL})) WHERE score >= 0.45 AND kind NOT IN ('blocked', 'service', 'list')")
def frontier_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.ordered(frontier.select(vw.table(spark, sf_dir, "pages")))


@query(rf"""
WITH l AS (SELECT DISTINCT unnest({vw.LINKS}) AS url FROM pages), n AS (SELECT row_number() OVER () AS page_id, url FROM l),
c AS (SELECT DISTINCT c, {_KIND.format('c', _PATH.format('c'))} AS kind FROM {_CANONICAL.replace('FROM pages', 'FROM n')}),
k AS (SELECT c, kind, {_SCORE} AS score FROM c), w AS (SELECT DISTINCT c FROM {_CANONICAL})
SELECT k.c AS url, kind, score FROM k ANTI JOIN w ON k.c = w.c WHERE score >= 0.45 AND kind NOT IN ('blocked', 'service', 'list') ORDER BY score DESC, regexp_extract(k.c, '://([^/?#]*)', 1), k.c LIMIT 180000""")
def frontier_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.expand(vw.pages(spark, sf_dir).select("url", "outgoing_links"))


_SERVICE = r"(regexp_matches(lower(url), '_visitcount|/_wp3services/|/api/tracking|/wp-admin') OR regexp_matches(lower({0}), '(^|/)(login|logout|admin|search)(/|$)|login|logout|/admin/|(^|/)search[^/]*$'))".format(_PATH.format("url"))


@query(f"SELECT CAST(id AS BIGINT) AS id, {_SERVICE} AS service, NOT regexp_matches(url, '^https?://[^/?#]') OR regexp_matches(url, '/login|/_visitcount') AS dropped FROM {_VALUES}")
def service_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, u) for u, i in _KINDS], "id long, url string")
    return rows.select("id", ux.is_service_url(F.col("url")).alias("service"), (~ux.is_web_url(F.col("url")) | F.col("url").rlike("/login|/_visitcount")).alias("dropped"))


@query(r"SELECT page_id, NOT regexp_matches(url, '^(?i:https?)://[^/?#]+') OR regexp_matches(url, '/login|/logout|/admin|/wp-admin|/search\?|/\?.*page=|_visitcount(?:[?#].*)?$|/_wp3services/|/api/tracking|(?i)\.(?:zip|rar|7z|tar|gz|bz2|xz|iso|dmg|exe|msi|mp4|mp3|avi|mov|wmv)(?:[?#].*)?$') AS dropped FROM pages")
def deny_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.table(spark, sf_dir, "pages").select("page_id", ux.should_drop(F.col("url")).alias("dropped"))


@query("SELECT DISTINCT s || regexp_extract(url, '://([^/?#]*)', 1) || '/sitemap.xml' AS url FROM pages CROSS JOIN (VALUES ('https://'), ('http://')) x(s)")
def sitemap_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = vw.table(spark, sf_dir, "pages").select(ux.authority(F.col("url")).alias("domain")).distinct()
    return sections.sitemap_seeds(hosts)


_HOSTS = tuple((i, n, n.title(), n, 100 * (i + 1), 1, 1, 1.0, 1, False, [], [d]) for i, (n, d) in enumerate((("com", "example.com"), ("net", "example.net"), ("org", "example.org"))))


@query("SELECT page_id, CASE WHEN regexp_matches(h, '(^|\\.)example\\.com$') THEN 'com' WHEN regexp_matches(h, '(^|\\.)example\\.net$') THEN 'net' WHEN regexp_matches(h, '(^|\\.)example\\.org$') THEN 'org' ELSE 'main' END AS section FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h FROM pages)")
def section_for_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    section = sections.section_of(_HOSTS, "example")
    return vw.table(spark, sf_dir, "pages").select("page_id", section(ux.host_of(F.col("url")), ux.is_document_url(F.col("url"))).alias("section"))


@query(f"SELECT page_id, {vw.TITLE} AS title, {vw.TEXT} AS text, len({vw.ANCHORS}) AS n_anchors FROM pages")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.pages(spark, sf_dir).select("page_id", "title", "text", F.size("anchors").cast("long").alias("n_anchors"))


@query()
def html_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vw.table(spark, sf_dir, "pages").select("page_id", hx.parse_html("html", "url").alias("x"))
    return p.select("page_id", "x.title", F.length("x.text").alias("text_len"), F.size("x.anchors").alias("n_anchors"), F.size("x.links").alias("n_links"))


@query(f"SELECT page_id, unnest({vw.ANCHORS}) AS anchor FROM pages")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.table(spark, sf_dir, "pages").select("page_id", F.explode(hx.anchor_texts(F.col("html"))).alias("anchor"))


@query(f"SELECT DISTINCT page_id, unnest({vw.LINKS}) AS link FROM pages")
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.table(spark, sf_dir, "pages").select("page_id", F.explode(hx.anchor_links(F.col("html"), F.col("url"))).alias("link"))


@query()
def links_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.table(spark, sf_dir, "pages").select("page_id", F.explode(hx.all_links(F.col("html"), F.col("url"))).alias("link"))


# ---------------------------------------------------------------- cleaning


def _crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as crawled rows with what cleaning rejects: service urls, bad statuses, empty shells, spellings of one url."""
    d = vw.table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    url = F.when(n % 17 == 0, F.concat(F.lit("https://a.example.com/login?n="), n)).when(n % 19 == 0, F.lit("")).when(n % 23 == 0, F.lit("mailto:x")).otherwise(F.concat(F.lit("https://A.example.com:443/p/"), n % 300, F.lit(".html?utm_source=x&b=2#top")))
    blank = n % 13 == 0
    return d.select(n.alias("line_no"), url.alias("url"), F.when(blank, "").otherwise(F.left("text", F.lit(20))).alias("title"), F.when(blank, " ").otherwise(F.col("text")).alias("text"), F.lit("").alias("html"), F.array().cast("array<string>").alias("anchors"), F.array().cast("array<string>").alias("outgoing_links"), F.lit("html").alias("filetype"), F.col("lang").alias("section"), F.col("source").alias("category"), F.when(n % 11 == 0, "404").when(n % 29 == 0, "x").otherwise("200").alias("status"))


_CRAWL = """c AS (SELECT doc_id AS line_no, CASE WHEN doc_id % 17 = 0 THEN 'https://a.example.com/login?n=' || doc_id WHEN doc_id % 19 = 0 THEN '' WHEN doc_id % 23 = 0 THEN 'mailto:x' ELSE 'https://A.example.com:443/p/' || doc_id % 300 || '.html?utm_source=x&b=2#top' END AS url,
  CASE WHEN doc_id % 13 = 0 THEN '' ELSE left(text, 20) END AS title, CASE WHEN doc_id % 13 = 0 THEN ' ' ELSE text END AS text, lang AS section, CASE WHEN doc_id % 11 = 0 THEN '404' WHEN doc_id % 29 = 0 THEN 'x' ELSE '200' END AS status FROM documents),
j AS (SELECT *, 'https://a.example.com/p/' || line_no % 300 || '.html?b=2' AS key, CASE WHEN url = '' THEN 'empty_url' WHEN url = 'mailto:x' THEN 'invalid_url' WHEN contains(url, '/login') THEN 'service_url' WHEN status = 'x' THEN 'invalid_status' WHEN status = '404' THEN 'non_success_status' WHEN trim(title) = '' AND trim(text) = '' THEN 'empty_html_shell' END AS reason FROM c)"""


@query(f"WITH {_CRAWL} SELECT line_no, reason FROM j")
def clean_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.judged(_crawl(spark, sf_dir)).select("line_no", "reason")


@query(f"WITH {_CRAWL} SELECT line_no, CASE WHEN status = '200' THEN 1 ELSE 0 END AS ok, least(length(text), 2000000) AS text_len, 0 AS html_len, length(title) AS title_len, 0 AS n_links FROM j")
def clean_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.judged(_crawl(spark, sf_dir)).select("line_no", "quality.*")


@query(f"WITH {_CRAWL} SELECT line_no, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY length(text) DESC, length(title) DESC, line_no) AS r FROM j WHERE reason IS NULL) WHERE r = 1")
def dedupe_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.judged(_crawl(spark, sf_dir)).where("reason is null")
    return clean.dedupe(rows, F.col("key"), "line_no", "best", F.col("quality")).select("line_no", "key")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.dedupe(vw.table(spark, sf_dir, "documents"), F.col("text"), "doc_id", "first").select("doc_id")


@query("SELECT max(doc_id) AS doc_id, min(doc_id) AS first_seq FROM documents GROUP BY text")
def dedupe_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.dedupe(vw.table(spark, sf_dir, "documents"), F.col("text"), "doc_id", "last").select("doc_id", "first_seq")


@query(f"""WITH {_CRAWL}, k AS (SELECT count(*) - count(DISTINCT key) AS n FROM j WHERE reason IS NULL)
SELECT reason, count(*) AS n FROM j WHERE reason IS NOT NULL GROUP BY reason UNION ALL SELECT 'duplicate_url', n FROM k WHERE n > 0""")
def clean_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean(_crawl(spark, sf_dir))[1]


@query(f"""WITH {_CRAWL}, w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY length(text) DESC, length(title) DESC, line_no) AS r FROM j WHERE reason IS NULL) WHERE r = 1)
SELECT 'section' AS facet, section AS key, count(*) AS n FROM w GROUP BY section UNION ALL SELECT 'filetype', 'html', count(*) FROM w UNION ALL SELECT 'status', status, count(*) FROM w GROUP BY status UNION ALL SELECT 'domain', 'a.example.com:443', count(*) FROM w""")
def clean_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.counts_by(clean.clean(_crawl(spark, sf_dir))[0])


@query("SELECT DISTINCT sha1(url) AS doc_id, sha1(url) || '.html' AS snapshot_path, 0.0::DOUBLE AS pagerank FROM pages")
def index_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clean.index_projection(vw.pages(spark, sf_dir).drop("doc_id").dropDuplicates(["url"]))
    return rows.select("doc_id", "snapshot_path", "pagerank")


# ---------------------------------------------------------------- graph


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes are urls; links point at whatever they resolve to."""
    p = vw.pages(spark, sf_dir)
    edges = p.select(F.col("url").alias("src"), F.explode("outgoing_links").alias("dst"))
    return p.select(F.col("url").alias("id")), edges


def _hosts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Links between pages of one site: page n of a host links to pages n // 2 and n // 3, n counted by page_id."""
    p = vw.table(spark, sf_dir, "pages").select("page_id", "url")
    urls = p.groupBy("url").agg(F.min("page_id").alias("page_id")).select("url", doc_id(F.col("url")).alias("id"), "page_id")
    n = F.col("page_id")
    to = F.posexplode(F.array(F.floor(n / 2), F.floor(n / 3), n, F.floor(n / 2))).alias("pos", "to")
    links_ = urls.select(F.col("id").alias("src"), to).join(urls.select(F.col("page_id").alias("to"), "url"), "to").select("src", "pos", "url")
    return links_, urls.select("url", "id")


_LINKED = """u AS (SELECT url, min(page_id) AS page_id, sha1(url) AS id FROM pages GROUP BY url),
l AS (SELECT a.id AS src, x.pos, b.id AS dst FROM u a CROSS JOIN (VALUES (0), (1), (2), (3)) x(pos) JOIN u b ON b.page_id = CASE x.pos WHEN 1 THEN a.page_id // 3 WHEN 2 THEN a.page_id ELSE a.page_id // 2 END)"""


@query(f"WITH {_LINKED} SELECT src, dst, count(*) AS times FROM l GROUP BY src, dst")
def edges_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.raw_edges(*_hosts(spark, sf_dir)).groupBy("src", "dst").agg(F.count("*").alias("times"))


@query(f"WITH {_LINKED} SELECT DISTINCT src, dst FROM l WHERE src <> dst")
def edges_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.index_edges(*_hosts(spark, sf_dir))


def _pagerank_sql(rounds: int) -> str:
    out = f"""WITH p AS (SELECT url, {vw.LINKS} AS ls FROM pages), e AS (SELECT DISTINCT url, i, dst FROM (SELECT url AS url, unnest(list_distinct(ls)) AS dst, 0 AS i FROM p)),
e2 AS (SELECT url AS src, dst, count(*) AS t FROM (SELECT p.url, unnest(list_distinct(ls)) AS dst FROM p) GROUP BY 1, 2), nd AS (SELECT DISTINCT id FROM (SELECT url AS id FROM pages UNION ALL SELECT dst FROM e2)),
dg AS (SELECT src, sum(t) AS g FROM e2 GROUP BY src), n AS (SELECT count(*) AS n FROM nd), r0 AS (SELECT nd.id, 1.0::DOUBLE / n.n AS r, dg.g IS NULL AS dangling FROM nd LEFT JOIN dg ON dg.src = nd.id, n)"""
    for i in range(1, rounds + 1):
        out += f""", s{i} AS (SELECT dst, sum(r * t / g) AS got FROM e2 JOIN dg USING (src) JOIN r{i - 1} ON r{i - 1}.id = src GROUP BY dst),
r{i} AS MATERIALIZED (SELECT id, 0.15 / n + 0.85 * (SELECT sum(r) FROM r{i - 1} WHERE dangling) / n + 0.85 * coalesce(got, 0) AS r, dangling FROM r{i - 1} LEFT JOIN s{i} ON dst = id, n)"""
    return out + f" SELECT id, round(r * 1000, 6) AS rank FROM r{rounds}"


@query(_pagerank_sql(5))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = graph.pagerank(*_graph(spark, sf_dir), iterations=5, tolerance=0.0)
    return ranks.select("id", F.round(F.col("rank") * 1000, 6).alias("rank"))


# ---------------------------------------------------------------- index


@query(f"WITH {vw.STATS} SELECT term, df FROM v")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.index_of(spark, sf_dir).df


@query(f"WITH {vw.STATS} SELECT n, round(avg_tt, 6) AS avg_title, 1.0::DOUBLE AS avg_anchors, round(avg_xt, 6) AS avg_text, (SELECT count(*) FROM v) AS vocabulary FROM st")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = vw.index_of(spark, sf_dir)
    words = ix.df.agg(F.count("*").alias("vocabulary"))
    return ix.stats.crossJoin(words).select("n", *[F.round(f"avg_{f}", 6).alias(f"avg_{f}") for f in index.FIELDS], "vocabulary")


@query(f"WITH {vw.TOK}, p AS (SELECT doc_id, tt, xt, unnest(al) AS term FROM tok) SELECT term, doc_id, list_contains(tt, term) AS in_title, list_contains(xt, term) AS in_text FROM p")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vw.index_of(spark, sf_dir).postings.select("term", "doc_id", "in_title", "in_text")


@query(f"WITH {vw.STATS} SELECT term, df, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf FROM v, st")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = vw.index_of(spark, sf_dir)
    return ix.df.crossJoin(F.broadcast(ix.stats)).select("term", "df", F.round(sc.smoothed_idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(f"WITH {vw.STATS} SELECT term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS bm25_idf, round(2.5 * ln(1 + (n - df + 0.5) / (df + 0.5)) / (1 + 1.5), 6) AS average_score, round(2.0 * ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS tfidf FROM v, st")
def weighting_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    ix = vw.index_of(spark, sf_dir)
    n, df, one = F.col("n"), F.col("df"), F.lit(10.0)
    return ix.df.crossJoin(F.broadcast(ix.stats)).select("term", F.round(sc.idf(n, df), 6).alias("bm25_idf"), F.round(sc.bm25f(n, df, one, one), 6).alias("average_score"), F.round(sc.tfidf(n, df, 2.0), 6).alias("tfidf"))


# ---------------------------------------------------------------- search


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def search_ctes(q: Query, history: tuple[str, ...] = ()) -> str:
    """WITH list of which ``f`` has the matching documents with features and score."""
    plan = parse_query(q)
    positive = list(plan.positive)
    inside = "(" + ", ".join(map(_quoted, positive)) + ")" if positive else "('')"
    wild = "|".join(f"(?:{wildcard_regex(w)})" for w in plan.wildcards)
    picked = f"term IN {inside}" + (f" OR regexp_matches(term, {_quoted('(?i)' + wild)})" if wild else "")
    has = lambda terms, col="al": " OR ".join([f"list_contains({col}, {_quoted(t)})" for t in terms] or ["false"])
    terms = [*plan.terms, *plan.title_terms]
    ok = ["(" + has(terms) + " OR NOT (SELECT any_cand FROM ca))"] if terms else []
    if plan.site:
        ok.append("(" + " OR ".join(f"starts_with(url, {_quoted(p)})" for p in site_prefixes(plan.site)) + ")")
    ok += [f"lower(filetype) = {_quoted(plan.filetype.lower())}"] if plan.filetype else []
    ok += [f"{k} = {_quoted(v)}" for k in ("section", "category") if (v := getattr(plan, k))]
    ok += [f"left(fetched_at, 10) >= '{plan.after}'"] if plan.after else []
    ok += [f"left(fetched_at, 10) <= '{plan.before}'"] if plan.before else []
    ok += [f"contains(lower(url), {_quoted(t)})" for t in plan.url_terms]
    ok += ["NOT (" + has(plan.excluded) + ")"] if plan.excluded else []
    ok += [f"list_contains(tt, {_quoted(t)})" for t in plan.title_terms]
    ok += [f"contains(combined, {_quoted(p.lower())})" for p in plan.phrases]
    ok += [f"regexp_matches(combined, {_quoted('(?i)' + p)})" for p in plan.regexes]
    if (positive or wild) and not plan.phrases and not plan.regexes:
        ok.append("coalesce(hit, 0) > 0")
    phrase = " + ".join([f"CASE WHEN contains(lower(title), {_quoted(p.lower())}) THEN 2.5 WHEN contains(combined, {_quoted(p.lower())}) THEN 1.2 ELSE 0 END" for p in plan.phrases] or ["0"])
    tterms = plan.title_terms or plan.terms
    title = "(" + " + ".join(f"list_contains(tt, {_quoted(t)})::INT" for t in tterms) + f") / {len(tterms)}" if tterms else "0"
    extra = " + ".join([f"contains(lower(url), {_quoted(t)})::INT" for t in plan.url_terms] or ["0"])
    weights: dict[str, int] = {}
    for h in history:
        for t in tx.tokens_of(h):
            weights[t] = weights.get(t, 0) + 1
    personal = "(" + " + ".join([f"{w} * list_contains(al, {_quoted(t)})::INT" for t, w in weights.items()] or ["0"]) + f") / {max(sum(weights.values()), 1)}"
    norm = lambda x, a: f"2.5 / (1 + 1.5 * (0.25 + 0.75 * greatest(len({x}), 1) / {a}))"
    floor = "CASE WHEN s <= 0 THEN 0.05 + personal ELSE s END" if plan.phrases or plan.regexes else "s"
    return f"""WITH {vw.STATS}, q AS MATERIALIZED (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM v, st WHERE {picked}),
nq AS (SELECT count(*) FILTER (WHERE term NOT IN {inside}) + {len(positive)} AS n_terms FROM q),
bm AS (SELECT p.doc_id, count(*) AS hit, sum(CASE WHEN list_contains(tt, q.term) THEN 3.2 * idf * {norm('tt', 'avg_tt')} ELSE 0 END + CASE WHEN list_contains(xt, q.term) THEN idf * {norm('xt', 'avg_xt')} ELSE 0 END) AS b
  FROM (SELECT doc_id, tt, xt, unnest(al) AS term FROM tok) p JOIN q ON p.term = q.term, st GROUP BY p.doc_id),
qu AS (SELECT doc_id, count(*) AS uh FROM tok JOIN (SELECT term FROM q UNION SELECT unnest([{', '.join(map(_quoted, positive))}]::VARCHAR[])) x ON contains(lower(url), x.term) GROUP BY doc_id),
ca AS (SELECT bool_or({has(terms)}) AS any_cand, {'CASE WHEN bool_or(' + has(terms) + ') THEN count(*) FILTER (WHERE ' + has(terms) + ') ELSE count(*) END' if terms else 'count(*)'} AS total_candidates FROM tok),
g AS (SELECT tok.*, total_candidates, coalesce(b, 0)::DOUBLE AS bm25, ({phrase})::DOUBLE AS phrase, ({title})::DOUBLE AS title_f, least((coalesce(uh, 0) + {extra}) / greatest(n_terms, 1), 1.0)::DOUBLE AS url_f, 1.0::DOUBLE / n AS pagerank,
  (CASE WHEN DATE '2026-01-01' - CAST(left(fetched_at, 10) AS DATE) <= 30 THEN 1.0 WHEN DATE '2026-01-01' - CAST(left(fetched_at, 10) AS DATE) <= 365 THEN 0.5 ELSE 0.15 END)::DOUBLE AS freshness, least({personal}, 1.0)::DOUBLE AS personal
  FROM tok LEFT JOIN bm USING (doc_id) LEFT JOIN qu USING (doc_id), st, nq, ca WHERE {' AND '.join(ok) or 'true'}),
h AS (SELECT *, bm25 + phrase + title_f + 0.35 * url_f + 0.15 * pagerank + 0.08 * freshness + 0.2 * personal AS s FROM g), f AS (SELECT *, {floor} AS score FROM h)"""


def _found(spark: SparkSession, sf_dir: str, q: Query, history: tuple[str, ...] = ()) -> DataFrame:
    return search.matches(vw.index_of(spark, sf_dir), parse_query(q), as_of=F.lit(vw.AS_OF).cast("timestamp"), history=list(history))


#: One query for each part of the language.
SEARCHES = {
    "search_normal": Query("the erly thble"), "search_missing_term": Query("zzzzqq"), "search_phrase": Query('"of the"'), "search_term_and_phrase": Query('erly "of the"'), "search_wildcard": Query("thbl*"), "search_wildcard_mark": Query("thbl?"),
    "search_regex": Query("/ing[a-z]* of/"), "search_title": Query("title:the erly"), "search_exclude": Query("erly -nicht -anan"), "search_inurl": Query("inurl:src1 erly"), "search_site": Query("site:src3.example.com the"),
    "search_filetype": Query("filetype:txt nicht"), "search_section": Query("die", section="de"), "search_category": Query("category:src2 the"), "search_date": Query("after:2024-06-01 before:2025-03-01 the"), "search_filters_only": Query("section:fr"),
}


def _search(q: Query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _found(spark, sf_dir, q).select("doc_id", F.round("score", 6).alias("score"))

    return run


for _name, _q in SEARCHES.items():
    query(f"{search_ctes(_q)} SELECT doc_id, round(score, 6) AS score FROM f", _name)(_search(_q))


@query(f"{search_ctes(SEARCHES['search_term_and_phrase'])}, t AS (SELECT count(*) AS total_matches FROM f) SELECT total_matches, total_candidates FROM t, ca")
def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(vw.index_of(spark, sf_dir), SEARCHES["search_term_and_phrase"], as_of=F.lit(vw.AS_OF).cast("timestamp"))[2]


_TOP = Query("the erly thble nicht", size=20)


@query(f"{search_ctes(_TOP)} SELECT doc_id, round(score, 6) AS score FROM f ORDER BY score DESC, doc_id LIMIT 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a ranked page of results."""
    return search.hits(_found(spark, sf_dir, _TOP), _TOP, vw.index_of(spark, sf_dir).docs).select("doc_id", F.round("score", 6).alias("score"))


@query(f"{search_ctes(_TOP)} SELECT doc_id, round(score, 6) AS score FROM f ORDER BY score DESC, doc_id LIMIT 10 OFFSET 20")
def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hits(_found(spark, sf_dir, _TOP), _TOP, vw.index_of(spark, sf_dir).docs, page=3, size=10).select("doc_id", F.round("score", 6).alias("score"))


_FEATURES, _HISTORY = Query('"of the" erly title:the'), ("erly the", "the nicht")


@query(f"{search_ctes(_FEATURES, _HISTORY)} SELECT doc_id, round(bm25, 6) AS bm25, round(phrase, 6) AS phrase, round(title_f, 6) AS title, round(url_f, 6) AS url, round(pagerank, 6) AS pagerank, round(freshness, 6) AS freshness, round(personal, 6) AS personal, round(score, 6) AS score FROM f")
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir, _FEATURES, _HISTORY)
    return found.select("doc_id", *[F.round(f"f_{k}", 6).alias(k) for k in sc.WEIGHTS], F.round("score", 6).alias("score"))


_FACET_SQL = " UNION ALL ".join(f"SELECT '{f}' AS facet, {c} AS key, count(*) AS n FROM {{0}} GROUP BY 2" for f, c in (("filetype", "filetype"), ("domain", "regexp_extract(url, '://([^/?#]*)', 1)"), ("category", "category"), ("section", "section")))
_RANKED = "SELECT facet, key, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, key) AS r FROM ({0})) WHERE r <= CASE WHEN facet IN ('filetype', 'domain') THEN 8 ELSE 12 END"


@query(f"{search_ctes(SEARCHES['search_title'])} {_RANKED.format(_FACET_SQL.format('f'))}")
def facets_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facets(_found(spark, sf_dir, SEARCHES["search_title"]), vw.index_of(spark, sf_dir).docs)


@query(f"WITH {vw.D} {_RANKED.format(_FACET_SQL.format('d'))}")
def facets_empty_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facets(_found(spark, sf_dir, SEARCHES["search_missing_term"]), vw.index_of(spark, sf_dir).docs)


@query("SELECT event_id AS id, CASE WHEN days <= 30 THEN 1.0 WHEN days <= 365 THEN 0.5 ELSE 0.15 END::DOUBLE AS freshness FROM (SELECT event_id, greatest(floor((epoch_us(TIMESTAMP '2024-06-01 12:00:00') - epoch_us(ts)) / 86400000000), 0) AS days FROM events)")
def freshness_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vw.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), sc.freshness(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("2024-06-01 12:00:00").cast("timestamp")).alias("freshness"))


_COS = "the erly zzzzqq"


@query(f"""WITH {vw.STATS}, w AS (SELECT v.term, ln((1 + n) / (1 + df)) + 1 AS i FROM v, st), qn AS (SELECT sqrt(sum(coalesce(i, 1) ** 2)) AS qn FROM (VALUES ('the'), ('erly'), ('zzzzqq')) t(term) LEFT JOIN w USING (term)),
p AS (SELECT doc_id, f, term FROM (SELECT doc_id, 1.8 AS f, unnest(tt) AS term FROM tok UNION ALL SELECT doc_id, 1.0, unnest(xt) FROM tok)),
c AS (SELECT doc_id, f, sum(CASE WHEN term IN ('the', 'erly') THEN i * i ELSE 0 END) / nullif(sqrt(sum(i * i)) * any_value(qn), 0) AS cos FROM p JOIN w USING (term), qn GROUP BY doc_id, f)
SELECT d.doc_id, round(coalesce(sum(f * cos), 0), 6) AS score FROM d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""")
def cosine_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.cosine_rank(vw.index_of(spark, sf_dir), _COS).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""{search_ctes(_TOP)} SELECT doc_id, round(greatest({', '.join('(' + ' + '.join(f"{b} * CAST(list_contains({a}, '{t}') AS INTEGER)" for t in parse_query(_TOP).positive) + ')' for a, b in (('tt', 3.0), ('xt', 1.0)))}) + ln(1 + 0.15 * pagerank), 6)::DOUBLE AS score FROM f""")
def remote_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.remote_score(vw.index_of(spark, sf_dir), parse_query(_TOP)).select("doc_id", F.round("score", 6).alias("score"))


# ---------------------------------------------------------------- analytics and plan


@query(f"WITH {vw.D}, n AS (SELECT unnest(list_distinct(list_concat({vw.TOKENS.format('title')}, {vw.TOKENS.format('text')}))) AS term FROM d) SELECT term, count(*) AS n FROM n WHERE length(term) >= 2 GROUP BY term ORDER BY n DESC, term LIMIT 30")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top_terms(vw.documents(spark, sf_dir))


@query(f"WITH {vw.D} SELECT count(*) AS document_count, count(DISTINCT regexp_extract(url, '://([^/?#]*)', 1)) AS domain_count, round(avg(length(text)), 2) AS avg_text_length, max(length(text)) AS max_text_length FROM d")
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.totals(vw.documents(spark, sf_dir)).withColumn("max_text_length", F.col("max_text_length").cast("long"))


@query("SELECT regexp_extract(url, '://([^/?#]*)', 1) AS domain, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, domain LIMIT 20")
def top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.top(vw.table(spark, sf_dir, "pages").select(ux.authority(F.col("url")).alias("domain")), "domain", 20)


_PLAN = ("en", 1000), ("de", 100), ("fr", 5000), ("none", 10)


def _plan(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_PLAN), "key string, max_pages long")


_PLAN_SQL = "pl AS (SELECT * FROM (VALUES ('en', 1000), ('de', 100), ('fr', 5000), ('none', 10)) t(key, max_pages))"


@query(f"WITH {_PLAN_SQL}, c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT key, CAST(greatest(floor(max_pages * 0.5), 1) AS BIGINT) AS target, coalesce(n, 0) AS indexed_count, round(least(coalesce(n, 0) / greatest(floor(max_pages * 0.5), 1), 1.0), 4) AS indexed_progress FROM pl LEFT JOIN c ON key = lang")
def topic_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.progress(_plan(spark), vw.documents(spark, sf_dir), 0.5)


@query("SELECT CAST(160000 * 2 AS BIGINT) AS target_pages, CAST(8 AS BIGINT) AS section_count, CAST(8 AS BIGINT) AS seed_count")
def plan_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.summary(sections.dimension(spark), 2.0)


@query(f"WITH {_PLAN_SQL}, x AS (SELECT doc_id AS seq, lang AS section, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) SELECT seq, section FROM x LEFT JOIN pl ON key = section WHERE max_pages IS NULL OR r + CASE section WHEN 'en' THEN 900 ELSE 0 END <= max_pages")
def section_budget_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = vw.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("lang").alias("section"))
    done = spark.createDataFrame([("en", 900)], "section string, n long")
    return analytics.accept_within_budget(items, _plan(spark).withColumnRenamed("max_pages", "budget"), done)


# ---------------------------------------------------------------- users


@query(f"WITH {vw.LOG} SELECT id, user_id, query, created_at FROM lg WHERE user_id = 8 ORDER BY id DESC LIMIT 50")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.history(vw.queries_log(spark, sf_dir), 8, 50)


@query(f"WITH {vw.LOG} SELECT query AS term, count(*) AS weight, max(id) AS last_id FROM lg WHERE user_id = 8 AND query LIKE 'c%' GROUP BY query")
def personal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.personal_counts(vw.queries_log(spark, sf_dir), 8, "C")


_LOGGED = f"""{vw.LOG}, sg AS (SELECT query AS term, 2.0 AS weight, 'query' AS source, created_at FROM lg WHERE user_id IS NULL UNION ALL
  SELECT term, 1.0, 'query_term', created_at FROM (SELECT unnest({vw.TOKENS.format('query')}) AS term, created_at FROM lg WHERE user_id IS NULL) WHERE length(term) >= 2),
up AS (SELECT term, sum(weight)::DOUBLE AS weight, max_by(source, created_at || source) AS source, max(created_at) AS updated_at FROM sg GROUP BY term)"""


def _suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.upsert(suggest.from_queries(vw.queries_log(spark, sf_dir)).withColumnRenamed("created_at", "updated_at"))


@query(f"WITH {_LOGGED} SELECT * FROM up")
def suggest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suggestions(spark, sf_dir)


@query(f"""WITH {_LOGGED}, own AS (SELECT query AS term, 0 AS part, row_number() OVER (ORDER BY count(*) DESC, max(id) DESC) AS n FROM lg WHERE user_id = 8 AND query LIKE 'c%' GROUP BY query ORDER BY n LIMIT 10),
gl AS (SELECT term, 1 AS part, row_number() OVER (ORDER BY weight DESC, updated_at DESC, term) AS n FROM up WHERE term LIKE 'c%' ORDER BY n LIMIT 10),
o AS (SELECT term, min(part * 100 + n) AS pos FROM (SELECT * FROM own UNION ALL SELECT * FROM gl) GROUP BY term) SELECT CAST(r AS INTEGER) AS rank, term FROM (SELECT term, row_number() OVER (ORDER BY pos) AS r FROM o) WHERE r <= 10""")
def suggest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.prefix_suggestions(_suggestions(spark, sf_dir), vw.queries_log(spark, sf_dir), "c", 10, 8)


@query(f"""WITH {vw.LOG}, r AS (SELECT user_id, query, row_number() OVER (PARTITION BY user_id ORDER BY id DESC) AS r FROM lg WHERE user_id IS NOT NULL)
SELECT user_id, string_agg(query, '|' ORDER BY r) FILTER (WHERE r <= 29) AS terms FROM (SELECT user_id, query, r FROM r UNION ALL SELECT DISTINCT user_id, 'interest ' || user_id, 0 FROM r) GROUP BY user_id""")
def user_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = vw.queries_log(spark, sf_dir)
    users = log.where("user_id is not null").select(F.col("user_id").alias("id")).distinct().withColumn("interests", F.concat(F.lit(" interest "), F.col("id").cast("string")))
    return suggest.user_terms(users, log).select("user_id", _joined(F.col("terms"), "|").alias("terms"))


@query(f"""WITH {vw.TOK}, h AS (SELECT user_id, term, count(*) AS w FROM (SELECT user_id, unnest({vw.TOKENS.format('query')}) AS term FROM (SELECT user_id, event_type || ' the ' || CASE WHEN event_id % 2 = 0 THEN 'erly' ELSE 'nicht' END AS query FROM events)) GROUP BY user_id, term),
t AS (SELECT user_id, sum(w) AS total FROM h GROUP BY user_id) SELECT user_id, doc_id, round(least(sum(w) / any_value(total), 1.0), 6) AS score FROM (SELECT doc_id, unnest(al) AS term FROM tok) JOIN h USING (term) JOIN t USING (user_id) GROUP BY user_id, doc_id""")
def interest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = vw.table(spark, sf_dir, "events")
    log = e.select("user_id", F.concat("event_type", F.lit(" the "), F.when(F.col("event_id") % 2 == 0, "erly").otherwise("nicht")).alias("query"))
    docs = vw.index_of(spark, sf_dir).postings.where("in_title or in_text").select("doc_id", F.array("term").alias("tokens"))
    return suggest.interest_scores(log, docs, 6)


from quarry import flows  # noqa: E402, F401  registers the queries of sources, stores and streams
