import json
import threading
import urllib.request

import pytest
from pyspark.sql import functions as F

from quarry import web
from quarry.api import Service
from quarry.operators import crawl
from quarry.plans import jobs, pipeline, sections
from quarry.sources.store import Store

B = "https://news.example.edu"


def lines(*rows):
    return "".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows)


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    path = tmp_path_factory.mktemp("crawl") / "raw.jsonl"
    page = lambda n, **k: {"url": f"{B}/{n}.html", "title": f"Title {n}", "text": f"body of {n} information retrieval", "html": f"<p>{n}</p>", "anchors": [n], "outgoing_links": [f"{B}/a.html", f"{B}/c.html"], "section": "news", "category": "x", "fetched_at": "2026-05-21T00:00:00+00:00", "status": 200} | k
    path.write_text(lines(page("a"), "", page("a", text="longer body of a with many words"), page("c"), page("login"), page("d", status="500"), "{broken", "[1]", page("e", status=202)))
    return str(path)


@pytest.fixture(scope="module")
def service(spark, corpus, tmp_path_factory):
    folder = tmp_path_factory.mktemp("built")
    report = jobs.clean_jsonl(spark, corpus, f"{folder}/clean")
    ix = jobs.build_index(spark, f"{folder}/clean", f"{folder}/index", f"{folder}/store")
    s = Service(spark, ix, Store(spark, f"{folder}/store"))
    s.report, s.profile_report = report, jobs.profile(spark, f"{folder}/clean")
    return s


def test_reports(service):
    r = service.report
    assert "- Input records: 8" in r and "- Output records: 3" in r and "- `service_url`: 1" in r and "- `non_success_status`: 1" in r and "- `bad_json`: 1" in r and "- `not_object`: 1" in r and "- `blank_line`: 1" in r and "duplicate_url" not in r  # one duplicate less one blank line
    assert "- Documents: 3" in service.profile_report and "- Edges: 6" in service.profile_report


def test_service(spark, service):
    out = service.search("longer words")
    assert out["total"] == 1 and out["results"][0]["url"] == f"{B}/a.html" and out["suggestions"]
    service.search("private words", user_id=5)
    assert "longer words" in service.suggest("longer") and service.suggest("private") == [] and service.suggest("private", 5) == ["private words"]
    assert [r["query"] for r in service.history(5)] == ["private words"] and len(service.history()) == 2
    assert service.stats()["documents"] == 3 and service.health()["status"] == "ok" and service.facets("section:news")
    doc = out["results"][0]["doc_id"]
    assert service.snapshot(doc) == "<p>a</p>" and service.snapshot("none") is None
    service.store.append("users", spark.createDataFrame([(5, "u", "old", 0)], "id long, username string, interests string, version long"))
    service.profile(5, " new  things ")
    assert service.terms_of(5)[0] == "new things" and service.terms_of(None) == []
    service.click(doc, "u", "t", 5)
    assert service.store.table("click_logs").count() == 1
    assert {s["key"]: s["indexed_count"] for s in service.topics()["sections"]}["news"] == 3
    assert service.crawl_plan(2.0)["target_pages"] == 320000 and [n for n, _ in service.pipeline()] == ["normalise_query", "retrieve", "suggest_terms"]
    for bad in ({"page": 0}, {"size": 51}):
        with pytest.raises(ValueError):
            service.search("x", **bad)


def test_routes(spark, service):
    def get(target, **k):
        status, _, body = web.answer(service, k.pop("method", "GET"), target, **k)
        return status, json.loads(body)

    status, found = get("/api/search?q=longer+words&size=5")
    assert status == 200 and found["total"] == 1 and found["results"][0]["url"] == f"{B}/a.html"
    assert [get(f"/api/search?q=x&{bad}")[0] for bad in ("page=0", "size=51", "size=x")] == [422] * 3
    assert get("/api/crawl-plan?scale_factor=30")[0] == 422 and get("/api/crawl-plan?scale_factor=2")[1]["target_pages"] == 320000
    logged = service.store.table("query_logs").count()
    assert get("/api/facets?q=words&section=news")[0] == 200 and service.store.table("query_logs").count() == logged
    assert get("/api/health")[1]["documents"] == 3 and get("/api/pipeline")[1][0]["name"] == "normalise_query" and get("/nothing")[0] == get("/snapshot/none")[0] == 404
    assert web.answer(service, "GET", f"/snapshot/{found['results'][0]['doc_id']}") == (200, "text/html; charset=utf-8", b"<p>a</p>")
    assert get("/api/click", method="POST", body=b"[1]")[0] == get("/api/click", method="POST", body=b"{")[0] == get("/api/click", method="POST", body=b"{}")[0] == 422
    assert get("/api/profile", method="POST", body=b'{"interests": "maps"}')[0] == 401
    service.store.append("users", spark.createDataFrame([(6, "v", "old", 0)], "id long, username string, interests string, version long"))
    service.store.append("sessions", spark.createDataFrame([("t0", 6)], "token string, user_id long"))
    assert get("/api/profile", method="POST", body=b'{"interests": "maps"}', session="t0")[0] == 200 and service.terms_of(6)[0] == "maps"


def test_served(service):
    server = web.server(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/health", timeout=60) as r:
        assert r.status == 200 and json.load(r)["status"] == "ok"
    server.shutdown()


def test_components_are_replaceable(service):
    seen = []

    def count(c):
        """counts"""
        seen.append(c.totals.first().total_matches)
        return c

    pipeline.run(pipeline.Context(pipeline.Query(" body  of "), service.index), (pipeline.normalise_query, pipeline.retrieve, count))
    assert seen == [3]


def test_responses(spark):
    rows = [(f"{B}/p.html", b"<title>T</title><a href='/q.html'>q</a>", "text/html", "10"), (f"{B}/sitemap.xml", b"<?xml version='1.0'?><urlset><loc>https://news.example.edu/r.html</loc></urlset>", "", None), (f"{B}/notes.txt", b"Meeting notes of the board", "", None), (f"{B}/big.html", b"x", "", str(5 << 20)), (f"{B}/x.zip", b"x", "", None)]
    df = spark.createDataFrame(rows, "url string, body binary, content_type string, content_length string").withColumns({"status": F.lit(200), "content_disposition": F.lit(None).cast("string"), "category": F.lit("c"), "fetched_at": F.lit("")})
    budgets, counts = spark.createDataFrame([("news", 10)], "key string, budget long"), spark.createDataFrame([], "section string, n long")
    pages = {r.url: r for r in crawl.parse(crawl.guarded(df, budgets, counts, sections.section_of())).collect()}
    assert set(pages) == {r[0] for r in rows[:3]}
    assert pages[f"{B}/p.html"].title == "T" and pages[f"{B}/p.html"].outgoing_links == [f"{B}/q.html"] and pages[f"{B}/sitemap.xml"].outgoing_links == [f"{B}/r.html"] and pages[f"{B}/notes.txt"].title == "notes"
    again = crawl.parse(crawl.guarded(df, budgets, counts, sections.section_of()))
    assert {r.url for r in crawl.follow(again, budgets, counts, sections.section_of()).collect()} == {f"{B}/q.html", f"{B}/r.html"}
    full = spark.createDataFrame([("news", 10)], "section string, n long")
    assert crawl.follow(again, budgets, full, sections.section_of()).count() == 0
