import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.functions import scoring as sc
from quarry.operators import analytics, clean, graph, index, search, suggest
from quarry.plans.query_language import Query
from quarry.plans.schema import PAGE, coerce_pages, doc_id
from quarry.sources import documents, jsonl, reports
from quarry.sources.store import Store
from quarry.streaming import ingest

N, J = "https://news.example.edu/a.html", "https://jwc.example.edu/course.pdf"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(N, "南开大学人工智能论坛", "论坛讨论信息检索和搜索引擎。", ["学术新闻"], "html", "news", "新闻资讯", "2026-05-21T00:00:00+00:00"), (J, "课程安排", "计算机网络和数据库课程。", [], "pdf", "academic", "教学招生", "")]
    return spark.createDataFrame(rows, "url string, title string, text string, anchors array<string>, filetype string, section string, category string, fetched_at string").withColumn("doc_id", doc_id(F.col("url")))


@pytest.fixture(scope="module")
def ix(pages):
    built = index.build(pages, materialise=lambda d: d.persist())
    return built


def urls(ix, q, **k):
    hits, facets, totals = search.search(ix, Query(q, **k))
    return [r.url for r in hits.collect()], facets, totals


def test_modes_of_search(ix):
    assert urls(ix, '"信息检索"')[0] == [N]
    assert urls(ix, "计?", filetype="pdf")[0] == [J]
    assert urls(ix, "/计.*网/")[0] == [J]
    assert urls(ix, "/(/")[0] == []
    found, facets, totals = urls(ix, "site:https://news.example.edu/ title:人工智能 信息检索")
    assert found == [N] and facets.count() > 0 and totals.first().total_matches == 1
    assert urls(ix, "论坛 -课程")[0] == [N] and urls(ix, "不存在的词 zzz")[0] == []
    assert urls(ix, "after:2026-06-01 课程 论坛")[0] == [J]
    assert urls(ix, "inurl:news")[0] == [N]


def test_explanation_and_floor(ix):
    hit = search.search(ix, Query('"信息检索"'))[0].first()
    assert hit.explanation.bm25 > 0 and hit.matched_terms and hit.snapshot_path == hit.doc_id + ".html"
    found = search.matches(ix, search.parse_query(Query('"信息检索"')), weights=dict.fromkeys(sc.WEIGHTS, 0.0), history=["信息检索"]).first()
    assert abs(found.score - 1.05) < 1e-9


def test_facets_of_nothing(ix):
    rows = search.search(ix, Query("zzz"))[1].where("facet = 'section'").collect()
    assert {(r.key, r.n) for r in rows} == {("news", 1), ("academic", 1)}


def test_window(ix):
    q = Query("课程 论坛", page=1, size=10)
    found = search.matches(ix, search.parse_query(q))
    assert search.windowed(found, q, ix.docs, 1).count() == 1 and search.windowed(found, Query("x", page=2), ix.docs, 10).count() == 0


def test_title_counts_more(spark):
    rows = spark.createDataFrame([("1", "普通校园通知", "信息检索课程安排"), ("2", "信息检索学术论坛", "普通新闻内容")], "doc_id string, title string, text string")
    assert search.cosine_rank(index.build(rows), "信息检索").orderBy(F.desc("score")).first().doc_id == "2"


def test_bm25(spark):
    low, high = spark.range(1).select(sc.bm25f(F.lit(10), F.lit(2), F.lit(20), F.lit(20.0)), sc.bm25f(F.lit(10), F.lit(2), F.lit(20), F.lit(20.0), 3.0, 3.0)).first()
    assert abs(low - math.log(1 + 8.5 / 2.5)) < 1e-9 and abs(high - 7.408) < 1e-3


def test_freshness(spark):
    as_of = F.lit("2026-06-01 00:00:00").cast("timestamp")
    rows = spark.createDataFrame([("2026-05-21T00:00:00+00:00",), ("2026-01-01T00:00:00Z",), ("2020-01-01",), ("",), (None,), ("later",), ("2027-01-01",)], "s string")
    assert [r[0] for r in rows.coalesce(1).select(sc.freshness(F.col("s"), as_of)).collect()] == [1.0, 0.5, 0.15, 0.0, 0.0, 0.0, 1.0]


def brute_rank(edges, nodes, d=0.85, rounds=30, tol=1e-8):
    nodes = sorted(set(nodes) | {x for e in edges for x in e})
    out = {n: [b for a, b in edges if a == n] for n in nodes}
    r = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(rounds):
        base = (1 - d) / len(nodes) + d * sum(r[n] for n in nodes if not out[n]) / len(nodes)
        new = dict.fromkeys(nodes, base)
        for n in nodes:
            for t in out[n]:
                new[t] += d * r[n] / len(out[n])
        delta = sum(abs(new[n] - r[n]) for n in nodes)
        r = new
        if delta < tol:
            break
    return r


def test_pagerank(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "b"), ("b", "c"), ("b", "d")]
    nodes = ["a", "b", "c", "e"]
    got = {r.id: r["rank"] for r in graph.pagerank(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string")).collect()}
    want = brute_rank(edges, nodes)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and got["b"] > got["a"]
    assert graph.pagerank(spark.createDataFrame([], "id string"), spark.createDataFrame([], "src string, dst string")).count() == 0


def test_edges(spark):
    links = spark.createDataFrame([("a", i, u) for i, u in enumerate(["ub", "ua", "ub", "zz", "uc"])], "src string, pos int, url string")
    known = spark.createDataFrame([("ua", "a"), ("ub", "b"), ("uc", "c")], "url string, id string")
    assert sorted(r.dst for r in graph.raw_edges(links, known).collect()) == ["a", "b", "b", "c"]
    assert [r.dst for r in graph.index_edges(links, known, 1).collect()] == ["b"]


def crawl(spark):
    b = "https://n.example.edu"
    rows = [(1, f"{b}/a.shtml?utm_source=x", "short", "x", "", "html"), (2, f"{b}/a.shtml", "long", "x" * 50, "", "html"), (3, f"{b}/_visitcount?s=1", "t", "x", "", "html"), (4, f"{b}/search.jsp?q=1", "t", "x", "", "html"), (5, f"{b}/empty.htm", " ", "", "", "html"), (6, f"{b}/file.pdf", "Course plan", "", "", "pdf")]
    df = spark.createDataFrame(rows, "line_no long, url string, title string, text string, html string, filetype string")
    return df.withColumns({"anchors": F.array().cast("array<string>"), "outgoing_links": F.array(F.lit(f"{b}/a.shtml?utm_source=x"), F.lit(f"{b}/a.shtml"), F.lit("javascript:void(0)")), "content_type": F.lit(""), "section": F.lit("news"), "category": F.lit("c"), "fetched_at": F.lit(""), "status": F.lit(200)})


def test_cleaning_job(spark, tmp_path):
    kept, dropped = clean.clean(crawl(spark))
    rows = {r.line_no: r for r in kept.collect()}
    assert sorted(rows) == [2, 6] and rows[2].title == "long" and rows[6].filetype == "pdf" and len(rows[2].outgoing_links) == 1
    assert {r.reason: r.n for r in dropped.collect()} == {"service_url": 2, "empty_html_shell": 1, "duplicate_url": 1}
    report = reports.sections("Cleaning", {"input": 6}, {"Removed": dropped, "Sections": clean.counts_by(kept).where("facet = 'section'").select("key", "n")})
    assert "- `service_url`: 2" in report and "- `news`: 2" in report


def test_dedupe_policies(spark):
    rows = spark.createDataFrame([(1, "k", 5), (2, "k", 9), (3, "k", 9), (4, "j", 1)], "seq long, k string, q int")
    pick = lambda p: sorted(r.seq for r in clean.dedupe(rows, F.col("k"), "seq", p, F.struct("q")).collect())
    assert pick("first") == [1, 4] and pick("last") == [3, 4] and pick("best") == [2, 4]


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "p.jsonl")
    with open(path, "w") as f:
        f.write('{"url":"https://a/1","section":"news","status":"200"}\n\n{"url":"https://a/2"}\n')
    rows = jsonl.read_pages(spark, path).orderBy("url").collect()
    assert [r.section for r in rows] == ["news", "main"] and rows[1].status == 200 and rows[1].anchors == []
    with open(path, "a") as f:
        f.write('not json\n[1]\n')
    problems = sorted(str(r.problem) for r in jsonl.read_lines(spark, path).collect())
    assert problems == ["None", "None", "bad_json", "blank_line", "not_object"]
    assert {r.section: r.n for r in jsonl.section_counts(spark, path).collect()} == {"news": 1, "unknown": 3}
    assert jsonl.written_urls(spark, path).count() == 2 and jsonl.read_pages(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception):
        jsonl.read_pages(spark, path).collect()
    assert jsonl.first_existing(spark, None, str(tmp_path / "none"), path) == path
    jsonl.write_pages(coerce_pages(spark.createDataFrame([("https://b/1",)], "url string")), str(tmp_path / "out"))
    assert jsonl.read_pages(spark, str(tmp_path / "out")).first().url == "https://b/1" and len(PAGE.fields) == 12


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def test_documents(spark, tmp_path):
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    pptx = office({"ppt/slides/slide1.xml": f'<p xmlns:a="{a}"><a:t>信息检索课程</a:t><a:t>数据库使用方法</a:t></p>', "docProps/core.xml": '<c xmlns:dc="d"><dc:title>信息检索课程 数据库使用方法</dc:title></c>'})
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    docx = office({"word/document.xml": f'<w:d xmlns:w="{w}"><w:p><w:t>Hello</w:t><w:t> there</w:t></w:p><w:p><w:t>again</w:t></w:p></w:d>'})
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    xlsx = office({"xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>name</t></si></sst>', "xl/worksheets/sheet1.xml": f'<w xmlns="{s}"><c t="s"><v>0</v></c><c><v>7</v></c></w>'})
    for name, body in (("a.pptx", pptx), ("b.docx", docx), ("c.xlsx", xlsx), ("d.txt", "plain\ttext".encode()), ("e.ppt", b"\x00\x01"), ("f.docx", b"broken")):
        (tmp_path / name).write_bytes(body)
    rows = {r.path[-6:]: r for r in documents.read_documents(spark, str(tmp_path)).collect()}
    texts = {k: r.text for k, r in rows.items()}
    assert texts["a.pptx"] == "信息检索课程 数据库使用方法" and texts["b.docx"] == "Hello there again" and texts["c.xlsx"] == "name 7" and texts["/d.txt"] == "plain text" and texts["/e.ppt"] == "" and texts["f.docx"] == ""
    assert rows["a.pptx"].metadata_title == "信息检索课程 数据库使用方法"
    assert documents.xml_text(b"<a", {"x"}) == ""


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.append("users", spark.createDataFrame([(1, "alice", "信息检索", 1), (1, "alice", "new", 2)], "id long, username string, interests string, version long"))
    assert s.users().first().interests == "new"
    s.append("sessions", spark.createDataFrame([("t1", 1, False), ("t2", 1, False), ("t2", 1, True)], "token string, user_id long, ended boolean"))
    assert s.user_of_session("t1").first().username == "alice" and s.user_of_session("t2").count() == 0
    page = spark.createDataFrame([("d", "<b>", ""), ("e", "x", "<html>")], "doc_id string, text string, html string")
    s.add_snapshots(page)
    s.add_snapshots(page.withColumn("html", F.lit("other")))
    assert s.snapshot("d").first().html == "<pre>&lt;b&gt;</pre>" and s.table("snapshots").count() == 2


def test_suggestions(spark):
    log = spark.createDataFrame([(1, 7, "private_term", "t1"), (2, None, "public_term", "t2"), (3, 7, "private_term", "t3"), (4, 7, "Pub", "t4")], "id long, user_id long, query string, created_at string")
    shared = suggest.upsert(suggest.from_queries(log).withColumnRenamed("created_at", "updated_at"))
    assert {(r.term, r.weight) for r in shared.collect()} == {("public_term", 3.0)}
    get = lambda p, u=None: [r.term for r in suggest.prefix_suggestions(shared, log, p, 10, u).orderBy("rank").collect()]
    assert get("p") == ["public_term"] and get("P", 7) == ["private_term", "Pub", "public_term"] and get("%_term") == ["public_term"]
    users = spark.createDataFrame([(7, " likes "), (8, "")], "id long, interests string")
    assert {r.user_id: r.terms for r in suggest.user_terms(users, log, 3).collect()} == {7: ["likes", "Pub", "private_term"], 8: []}
    hits = spark.createDataFrame([(1, "The title", "body"), (6, "late", "x")], "rank int, title string, text string")
    assert [r.term for r in suggest.of_hits(hits).orderBy("rank").collect()] == ["the", "title", "body"]


def test_budget(spark):
    items = spark.createDataFrame([(i, "news" if i % 2 else "free") for i in range(10)], "seq long, section string")
    budgets, done = spark.createDataFrame([("news", 4)], "key string, budget long"), spark.createDataFrame([("news", 2)], "section string, n long")
    assert sorted(r.seq for r in analytics.accept_within_budget(items, budgets, done).collect()) == [0, 1, 2, 3, 4, 6, 8]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"https://a/{i % 5}?utm_source={i}", "news" if i % 2 else "") for i in range(12)]
    source = spark.createDataFrame(rows, "seq long, url string, section string").coalesce(1)
    source.write.json(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(source.schema).json(str(tmp_path / "in"))
    ingest.append_to(ingest.distinct_urls(stream()), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(60)
    assert spark.read.json(str(tmp_path / "out")).count() == 5
    ingest.append_to(ingest.within_budget(stream(), {"news": 4}, {"news": 1}), str(tmp_path / "out2"), str(tmp_path / "c2")).awaitTermination(60)
    got = spark.read.json(str(tmp_path / "out2")).groupBy("section").count().collect()
    assert {r.section: r["count"] for r in got} == {"news": 3, "unknown": 6}
    done = []
    ingest.until(stream(), 5, lambda b, e: done.extend(b.collect()), str(tmp_path / "c3"), lambda: len(done)).awaitTermination(60)
    assert len(done) == 5
    q = ingest.suggestion_weights(stream().select(F.col("section").alias("term"), F.lit(1.0).alias("weight"))).writeStream.outputMode("update").format("memory").queryName("weights").option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.term: r.weight for r in spark.table("weights").collect()} == {"": 6.0, "news": 6.0}


def test_index_round_trip(spark, ix, tmp_path):
    ix.save(str(tmp_path / "ix"), 4)
    again = index.Index.load(spark, str(tmp_path / "ix"))
    assert again.df.count() == ix.df.count() and urls(again, '"信息检索"')[0] == [N]
    assert ix.postings.groupBy("term").count().join(ix.df, "term").where("count <> df").count() == 0
    assert index.postings_of(ix.docs).exceptAll(ix.postings).count() == 0


def test_projection(spark, pages):
    full = pages.withColumns({"html": F.lit("x"), "outgoing_links": F.array(F.lit("http://a"))}).drop("doc_id")
    ranks = spark.createDataFrame([("none", 0.5)], "id string, rank double")
    rows = clean.index_projection(full, ranks).collect()
    assert len(rows) == 2 and rows[0].pagerank == 0.0 and "html" not in rows[0].asDict()
