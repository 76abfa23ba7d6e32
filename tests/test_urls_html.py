from pyspark.sql import functions as F

from quarry.functions import html as hx
from quarry.functions import urls as ux
from quarry.operators import frontier
from quarry.plans import sections
from tests.conftest import one

S = F.col("s")
SITE = ux.Site(suffixes=("example.edu",))


def kinds(spark, *urls):
    rows = spark.createDataFrame([(u,) for u in urls], "s string").select(ux.canonical_url(S).alias("c"))
    return [r[0] for r in rows.coalesce(1).select(ux.url_kind(F.col("c"), SITE)).collect()]


def test_canonical(spark):
    urls = ["HTTPS://CS.EXAMPLE.EDU:443/2025/0522/c17471a596037/page.htm?utm_source=x&b=2", "http://u:p@h:8080?z=1&a=2&a=1&e=#f", "ftp://x/", "", None, "https://h/p;params?spm=1", "http://h:80"]
    want = ["https://cs.example.edu/2025/0522/c17471a596037/page.htm?b=2", "http://h:8080/?a=1&a=2&z=1", "", "", "", "https://h/p", "http://h/"]
    assert one(spark, ux.canonical_url(S), *urls) == want
    assert one(spark, ux.canonical_url_exact(S), *urls) == want


def test_kinds(spark):
    assert kinds(spark, "https://cs.example.edu/2025/0522/c17471a596037/page.htm", "https://a.example.edu/17471/list2.htm", "https://a.example.edu/x.pdf", "https://other.org/", "https://a.example.edu/login", "https://a.example.edu/api/tracking/x", "https://a.example.edu/search/", "https://a.example.edu/", "https://a.example.edu/a.htm", "https://a.example.edu/a/b/c") == ["detail", "list", "document", "blocked", "blocked", "blocked", "service", "home", "section", "content"]


def test_service_urls(spark):
    base = "https://a.example.edu"
    service = ["/_visitcount?siteId=1", "/search.jsp?q=test", "/search_result.jsp?q=test", "/wxy/Login.aspx?style=1", "/virexp/prepare_login", "/login"]
    assert all(one(spark, ux.is_service_url(S), *[base + u for u in service]))
    assert one(spark, ux.is_service_url(S), base + "/2026/0525/a.shtml") == [False]


def test_drop(spark):
    got = one(spark, ux.should_drop(S, ux.Site(dead_hosts=("dead.example.edu",))), "https://dead.example.edu/x", "https://a/x.zip", "https://a/_visitcount", "https://a/file.PPT", "mailto:x", "https://a/p")
    assert got == [True, True, True, False, True, False]


def test_select_and_expand(spark):
    b = "https://a.example.edu"
    links = [f"{b}/1/list89.psp", f"{b}/_visitcount?x=1", f"{b}/a.pdf", f"{b}/2025/0522/c1a2/page.htm", f"{b}/2025/0522/c1a2/page.htm?utm_source=q"]
    rows = frontier.ordered(frontier.select(spark.createDataFrame([(u,) for u in links], "url string"), site=SITE)).collect()
    assert [r.url for r in rows] == [f"{b}/2025/0522/c1a2/page.htm", f"{b}/a.pdf"]
    pages = spark.createDataFrame([(f"{b}/a.pdf", links), (f"{b}/anime", [])], "url string, outgoing_links array<string>")
    got = [r.url for r in frontier.expand(pages, ux.Site(suffixes=("example.edu",), refresh_host="a.example.edu")).collect()]
    assert got == [f"{b}/2025/0522/c1a2/page.htm", f"{b}/anime"]
    assert frontier.expand(pages, SITE, most=0).count() == 0


def test_budget_and_listing(spark):
    urls = spark.createDataFrame([("https://news.example.edu/x",), ("https://library.example.edu/y",)], "url string")
    budgets, counts = spark.createDataFrame([("news", 5), ("library", 5)], "key string, budget long"), spark.createDataFrame([("news", 5)], "section string, n long")
    assert [r.section for r in frontier.within_budget(urls, budgets, counts, sections.section_of()).collect()] == ["library"]
    totals = spark.createDataFrame([("u", 60), ("v", 24)], "url string, total long")
    assert [(r.url, r.page) for r in frontier.listing_pages(totals).orderBy("page").collect()] == [("u", 2), ("u", 3)]


def test_links_and_filters(spark):
    links = ["https://n/a.shtml?utm_source=x", "https://n/a.shtml", "https://n/_visitcount?x", "javascript:void(0)"]
    rows = spark.createDataFrame([(links,)], "l array<string>")
    assert rows.select(ux.ordered_distinct_links(F.col("l"))).first()[0] == links[:1]
    many = spark.createDataFrame([(["http://a/" + "x" * 3000, "http://a/base64,q", "ftp://a", *[f"http://a/{i}" for i in range(80)]],)], "l array<string>")
    assert many.select(ux.indexed_links(F.col("l"))).first()[0] == [f"http://a/{i}" for i in range(64)]


def test_resource_links(spark):
    body = r'<a href="/openlist/d/resource/anime/a424242/x"> {"dbId":"a542203"} {\"dbId\":\"N777\"}'
    assert one(spark, ux.resource_links(S, "http://r.example.edu"), body) == [["http://r.example.edu/anime/a424242", "http://r.example.edu/anime/a542203", "http://r.example.edu/novel/n777"]]


def test_sections(spark):
    key = sections.section_of()
    assert one(spark, key(S, F.lit(False)), "news.example.edu", "www.news.example.edu", "xnews.example.edu", "example.edu") == ["news", "news", "main", "main"]
    assert one(spark, key(S, F.lit(True)), "files.other.edu") == ["academic"]
    plan = sections.dimension(spark, keys=("news", "schools"))
    assert {r.key: r.budget for r in sections.budgets(plan, 2).collect()} == {"news": 72000, "schools": 84000}
    assert sections.seeds(sections.dimension(spark)).count() == 8 and "news" in sections.format_table(plan)
    try:
        sections.dimension(spark, keys=("nothing",))
        raise AssertionError
    except ValueError:
        pass


HTML = """<html><head><title>A &amp; B</title><script>var x="<p>no</p>";</script></head><body><!-- no --><a href="/ok.html"> One <b>two</b></a><a href="javascript:x">js</a>
<div data-url="/data/page.htm">t</div><img src="/i.avif"><a href="http：//bad">bad</a> see https://n.example.edu/abs.html, and /root/path.html</body></html>"""


def test_html(spark):
    assert one(spark, hx.page_title(S), HTML, None) == ["A & B", ""]
    assert one(spark, hx.visible_text(S), HTML)[0].startswith("A & B One two js t")
    assert one(spark, hx.anchor_texts(S), HTML) == [["One two", "js", "bad"]]
    base = F.lit("https://n.example.edu/x/y")
    found = one(spark, hx.all_links(S, base), HTML)[0]
    assert {"https://n.example.edu/ok.html", "https://n.example.edu/data/page.htm", "https://n.example.edu/abs.html", "https://n.example.edu/root/path.html"} <= set(found)
    assert not [u for u in found if u.endswith((".avif", ".js"))]
    rows = spark.createDataFrame([(HTML, "https://n.example.edu/x/y")], "h string, u string").select(hx.parse_html("h", "u").alias("x")).select("x.*").first()
    assert rows.title == "A & B" and rows.anchors[0] == "One two" and "no" not in rows.text.split() and rows.links[0] == "https://n.example.edu/ok.html"
    assert one(spark, hx.asset_links(S, base), '<script src="/a.js"></script><link href="b.css">') == [["https://n.example.edu/a.js"]]


def test_xml(spark):
    assert one(spark, ux.looks_like_xml(S), " <?xml version", "<urlset>", "<html>", None) == [True, True, False, False]


def test_canonical_urls_are_those_of_pythons_parser(spark):
    urls = ["http://A.com:80/x?q=a%20b", "http://a.com/x?q=a+b", "https://a.com?b=2&a=%C3%A9&a=*~", "http://a.com/?x=100%&y=%zz", "http://a.com/a;p=1?x=1", "http://a.com/?utm_a=1&%75tm_b=2&z=1#f", "http://a.com/?a=1=2&b=&c", "ftp://a.com", "", None, "http://u@a.com:8080/p?k=/:@&k=%2F"]
    got = [(r.a, r.b) for r in spark.createDataFrame([(u,) for u in urls], "u string").select(ux.canonical_url(F.col("u")).alias("a"), ux.canonical_url_exact(F.col("u")).alias("b")).collect()]
    assert [a for a, _ in got] == [b for _, b in got]
    assert got[0][0] == got[1][0] == "http://a.com/x?q=a+b"


def test_types_of_responses(spark):
    office = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
    rows = [("http://a.com/d", office), ("http://a.com/s", "application/xml; charset=utf-8"), ("http://a.com/f", "application/rss+xml"), ("http://a.com/h", "text/html"), ("http://a.com/x", "application/xhtml+xml"), ("http://a.com/p.pdf", ""), ("http://a.com/q", "application/pdf")]
    df = spark.createDataFrame(rows, "url string, kind string")
    got = [(r.d, r.x) for r in df.select(ux.document_type(F.col("url"), F.col("kind")).alias("d"), ux.looks_like_xml(F.lit("<p>"), F.col("kind")).alias("x")).collect()]
    assert got == [("docx", False), (None, True), (None, True), (None, False), (None, False), ("pdf", False), ("pdf", False)]
