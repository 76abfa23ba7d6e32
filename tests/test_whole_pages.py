from pyspark.sql import functions as F

from quarry.operators import crawl
from quarry.plans import sections

B = "https://news.example.edu"


def test_pages_are_read_whole_and_large_documents_keep_a_row(spark):
    long = lambda n: b"<title>T</title><p>" + b"word " * (n // 5) + b"last</p><a href='/end.html'>end</a>"
    rows = [(f"{B}/two.html", long(2 << 20), None), (f"{B}/four.html", long(4 << 20), str(4 << 20)), (f"{B}/two.txt", b"Notes " * (2 << 18), None), (f"{B}/five.txt", b"Notes", str(5 << 20)), (f"{B}/small.txt", b"Meeting notes of the board", None)]
    df = spark.createDataFrame(rows, "url string, body binary, content_length string").withColumns({"content_type": F.lit(""), "status": F.lit(200), "content_disposition": F.lit(None).cast("string"), "category": F.lit("c"), "fetched_at": F.lit("")})
    budgets, counts = spark.createDataFrame([("news", 10)], "key string, budget long"), spark.createDataFrame([], "section string, n long")
    got = {r.url: r for r in crawl.parse(crawl.guarded(df, budgets, counts, sections.section_of())).collect()}
    assert got.keys() == {r[0] for r in rows}
    for name in ("two", "four"):
        page = got[f"{B}/{name}.html"]
        assert "last" in page.text[-20:] and page.outgoing_links == [f"{B}/end.html"]
    assert got[f"{B}/two.txt"].text == got[f"{B}/five.txt"].text == "" and got[f"{B}/small.txt"].text
