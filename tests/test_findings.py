"""What the reviewer's larger tables showed."""

import os
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quarry import queries as base
from quarry.operators import index, search, suggest
from quarry.plans.query_language import Query, parse_query
from tests.oracle import SF, compare, connect


@pytest.fixture(scope="module")
def foldered(spark, tmp_path_factory):
    """documents, pages and events as folders of several files, and SQL over the same rows."""
    at = tmp_path_factory.mktemp("foldered")
    for t in ("documents", "pages", "events"):
        spark.read.parquet(f"{SF}/{t}.parquet").repartition(3).write.parquet(f"{at}/{t}.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["stream_budget", "stream_distinct_urls", "stream_hourly", "stream_weights"])
def test_streams_read_tables_that_are_folders(spark, foldered, name):
    compare(spark, connect(), lambda s, _: base.QUERIES[name](s, foldered), base.SQL[name])


def test_f5_a_key_is_kept_once_over_all_files_of_a_folder(spark, tmp_path):
    urls = ["http://A.example.com/x?b=2&a=1", "http://a.example.com:80/x?a=1&b=2", "http://a.example.com/x#top", "https://b.example.com", "https://b.example.com/?utm_source=z", None]
    rows = spark.createDataFrame(list(enumerate(urls * 2)), "page_id long, url string").withColumn("html", F.lit(""))
    rows.repartition(5, "page_id").write.parquet(f"{tmp_path}/in/pages.parquet")
    os.symlink(f"{tmp_path}/in", f"{tmp_path}/linked")
    got = [r.url_key for r in base.QUERIES["stream_distinct_urls"](spark, f"{tmp_path}/linked").collect()]
    assert sorted(got, key=str) == [None, "http://a.example.com/x", "http://a.example.com/x?a=1&b=2", "https://b.example.com/"]


@pytest.fixture(scope="module")
def texts(spark):
    words = F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.concat(F.lit("w"), ((F.col("id") * 7 + i * i) % 90).cast("string")))
    rows = spark.range(300).select(F.format_string("d%03d", "id").alias("doc_id"), F.concat(F.lit("https://a.example.com/"), "id").alias("url"), F.array_join(F.slice(words, 1, 3), " ").alias("title"), F.array_join(words, " ").alias("text"), F.array(F.element_at(words, 5), F.lit("anchor only")).alias("anchors"))
    return rows.select("*", F.lit("txt").alias("filetype"), F.lit("s").alias("section"), F.when(F.col("doc_id") < "d030", "rare").otherwise("c").alias("category"), F.lit("").alias("fetched_at"))


@pytest.fixture(scope="module")
def saved(spark, texts, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("index") / "ix")
    patch = pytest.MonkeyPatch()
    patch.setattr(index, "FILE_CHARS", 4_000)
    patch.setattr(index, "SEGMENT_POSTINGS", 1_000)
    index.build(texts).save(at, 2)
    patch.undo()
    return at


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_f10_postings_are_made_where_the_documents_are(spark, texts, saved):
    docs = index.tokenised(texts)
    assert "Exchange" not in _plan(index.exploded_postings(docs)).split("== Physical Plan ==")[1]
    assert index.exploded_postings(docs).exceptAll(index.postings_of(docs)).isEmpty() and index.postings_of(docs).exceptAll(index.exploded_postings(docs)).isEmpty()
    ix = index.Index.load(spark, saved)
    some, none = ({r.doc_id: tuple(round(x, 9) for x in r[1:]) for r in index.norms_of(ix.postings, ix.df, ix.stats, n).collect()} for n in (20, 0))
    assert some == none and len(some) == 300


def test_f9_files_grow_with_the_text_and_segments_are_sorted(spark, saved):
    parts = spark.read.parquet(f"{saved}/postings").select("term", "doc_id", F.input_file_name().alias("file"))
    assert parts.select("file").distinct().count() >= 5 and spark.read.parquet(f"{saved}/docs").select(F.input_file_name()).distinct().count() >= 10
    assert parts.groupBy("doc_id").agg(F.countDistinct("file").alias("n")).where("n > 1").isEmpty()
    for name in [r.file for r in parts.select("file").distinct().collect()]:
        rows = [tuple(r) for r in spark.read.parquet(name).coalesce(1).select("term", "doc_id").collect()]
        assert rows == sorted(rows)
    found = search.matches(index.Index.load(spark, saved), parse_query(Query("w1 w4")))
    assert found.count() == found.select("doc_id").distinct().count() > 0


def test_f8_the_saved_index_searches_as_the_one_in_memory(spark, texts, saved):
    q = parse_query(Query('category:rare w1 w4 w9 w16'))
    got, want = ({r.doc_id: round(r.score, 9) for r in search.matches(ix, q).collect()} for ix in (index.Index.load(spark, saved), index.build(texts)))
    assert got == want and got and max(got) < "d030"
    assert "combined" not in spark.read.parquet(f"{saved}/docs").columns  # no second copy of each text


def test_f7_texts_of_a_phrase_are_not_joined(spark, saved):
    ix, q = index.Index.load(spark, saved), Query('w1 "w4 w9"')
    found = search.matches(ix, parse_query(q))
    joined = [x for x in _plan(found).split("== Physical Plan ==")[0].split("== Optimized Logical Plan ==")[1].splitlines() if "Project" in x]
    assert joined and not [x for x in joined if "combined" in x.split("[", 1)[1] and "__phrase" not in x]
    hits, _, totals = search.search(ix, q)
    assert "/matches-" in "".join(totals.inputFiles())  # matched once
    assert totals.first().total_matches == hits.count() == found.count() > 0


def test_f6_facets_of_no_match_count_the_saved_documents(spark, saved):
    ix = index.Index.load(spark, saved)
    rows = search.facets(search.matches(ix, parse_query(Query("zzz"))), ix.docs)
    assert {(r.key, r.n) for r in rows.where("facet = 'category'").collect()} == {("rare", 30), ("c", 270)}
    assert not [f for f in ix.docs.inputFiles() if "tokenised" in f] and not os.path.exists(f"{saved}/tokenised")
    assert len(ix.docs.inputFiles()) >= 10  # by the text's size, not a fixed number


@pytest.mark.parametrize("block, rows", [(1024, 200_000), (2, 200_000), (2, 0)])
def test_f1_interest_scores_equal_the_plain_join(spark, monkeypatch, block, rows):
    monkeypatch.setattr(suggest, "BLOCK", block)
    monkeypatch.setattr(suggest, "BROADCAST_ROWS", rows)
    log = [(1, "a b"), (1, "a"), (2, "b c"), (3, "zzz"), (4, "a b"), (5, None), (None, "a"), *[(100 + i, "a d") for i in range(20)]]
    docs = [(i, ["a", "x"] if i % 2 else ["b", "a", f"only{i}"]) for i in range(40)] + [(50, ["c"]), (51, ["x"]), (52, []), (53, None), (None, ["c", "d"]), (50, ["c"])]
    weights, total, want = Counter(), Counter(), Counter()
    for user, q in log:
        for t in dict.fromkeys((q or "").split()):
            weights[user, t] += user is not None
            total[user] += 1
    for doc, tokens in docs:
        for (user, t), w in weights.items():
            if w and t in (tokens or []):
                want[user, doc] += w * tokens.count(t)
    got = suggest.interest_scores(spark.createDataFrame(log, "user_id long, query string"), spark.createDataFrame(docs, "doc_id long, tokens array<string>"), 6)
    assert got.columns == ["user_id", "doc_id", "score"]
    assert sorted(map(repr, got.collect())) == sorted(repr(Row(user_id=u, doc_id=d, score=round(min(w / total[u], 1.0), 6))) for (u, d), w in want.items())


@pytest.mark.parametrize("whole", [2, 0])
def test_f6_postings_are_made_where_the_files_of_documents_lie(spark, texts, tmp_path, monkeypatch, whole):
    for k, v in (("FILE_CHARS", 4_000), ("SEGMENT_POSTINGS", 1_000), ("WHOLE", whole)):
        monkeypatch.setattr(index, k, v)
    made, seen = index.exploded_postings, []
    built = index.build(texts)
    monkeypatch.setattr(index, "exploded_postings", lambda docs: seen.append((_plan(docs), docs.rdd.getNumPartitions())) or made(docs))
    sizes = {k: spark.conf.get(f"spark.sql.files.{k}") for k in ("maxPartitionBytes", "openCostInBytes")}
    built.save(str(tmp_path), 2)
    assert sizes == {k: spark.conf.get(f"spark.sql.files.{k}") for k in sizes}  # the caller's settings stay
    (plan, parts), files = seen[0], len(spark.read.parquet(f"{tmp_path}/docs").inputFiles())
    assert ("Exchange" in plan) == (whole == 0) and (parts == files >= 10 or whole == 0)
    ix = index.Index.load(spark, str(tmp_path))
    assert ix.postings.exceptAll(built.postings).isEmpty() and built.postings.exceptAll(ix.postings).isEmpty()
    assert search.facets(search.matches(ix, parse_query(Query("zzz"))), ix.docs).where("facet = 'category' and n = 270").count() == 1


def test_f8_a_category_is_searched_alike_where_files_are_dealt_out(spark, texts, saved, tmp_path, monkeypatch):
    for k, v in (("FILE_CHARS", 4_000), ("SEGMENT_POSTINGS", 1_000), ("WHOLE", 0)):
        monkeypatch.setattr(index, k, v)
    index.build(texts).save(str(tmp_path), 2)
    lie, dealt = (index.Index.load(spark, at) for at in (saved, str(tmp_path)))
    files = [len(ix.postings.inputFiles()) for ix in (lie, dealt)]
    assert files[0] == len(lie.docs.inputFiles()) > files[1]
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in search.matches(ix, parse_query(Query("category:rare w1 w4"))).collect()) for ix in (lie, dealt))
    assert a == b and a and max(a)[0] < "d030"


def test_f9_a_segment_has_the_postings_of_one_file_of_documents(spark, saved):
    ix = index.Index.load(spark, saved)
    of = {r.doc_id: r.file for r in ix.docs.select("doc_id", F.input_file_name().alias("file")).collect()}
    parts = ix.postings.select("doc_id", F.input_file_name().alias("file")).distinct().collect()
    held = {f: {of[r.doc_id] for r in parts if r.file == f} for f in {r.file for r in parts}}
    assert len(of) == 300 and len(held) >= 10 and all(len(x) == 1 for x in held.values())


def _beside(spark, texts, at, pieces):
    """An index beside documents of so many files."""
    texts.repartition(pieces, "doc_id").write.parquet(f"{at}/documents")
    pages = spark.read.parquet(f"{at}/documents")
    index.write_beside(index.in_pieces(spark).read.parquet(f"{at}/documents"), f"{at}/ix", 2)
    return index.Index.load(spark, f"{at}/ix", index.tokenised(pages))


@pytest.mark.parametrize("pieces, largest, shuffled", [(6, 48 << 20, False), (1, 48 << 20, True), (6, 1_000, True)])
def test_f8_documents_stay_where_they_are(spark, texts, tmp_path, monkeypatch, pieces, largest, shuffled):
    made, seen = index.exploded_postings, []
    monkeypatch.setattr(index, "exploded_postings", lambda docs: seen.append(_plan(docs)) or made(docs))
    monkeypatch.setattr(index, "LARGEST_CHARS", largest)
    monkeypatch.setattr(index, "PIECE_BYTES", 1_000)  # else small files are read together
    ix = _beside(spark, texts, tmp_path, pieces)
    assert sorted(os.listdir(tmp_path / "ix")) == ["df", "norms", "postings", "stats"]  # no copy of the texts
    assert ("Exchange" in seen[0].split("== Physical Plan ==")[1]) == shuffled
    built = index.build(texts)
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    for t in ("postings", "df", "stats", "norms"):
        assert rows(getattr(ix, t)) == rows(getattr(built, t))
    q = parse_query(Query("category:rare w1 w4"))
    a, b = (rows(search.matches(i, q).select("doc_id", "score")) for i in (ix, built))
    assert a == b and a and max(a)[0] < "d030"


def test_f8_an_empty_table_has_an_index(spark, texts, tmp_path):
    ix = _beside(spark, texts.limit(0), tmp_path, 2)
    assert ix.postings.isEmpty() and ix.stats.first().n == 0 and search.matches(ix, parse_query(Query("category:rare w1"))).isEmpty()


@pytest.mark.parametrize("q", ['"w4 w9"', "/w4.w9/", "-w4 section:s", "w4*", '"w4 w" -w16', "section:s"])
def test_f8_searches_without_terms_take_flags_from_the_postings(spark, texts, tmp_path, q):
    ix, plan = _beside(spark, texts, tmp_path, 4), parse_query(Query(q))
    found = search.matches(ix, plan, history=["w1 w25", "w1"])
    assert "array_distinct" not in _plan(found).split("== Physical Plan ==")[1]  # no text is tokenised
    words = {r.doc_id: (r.title.split(), r.text.split(), [t for a in r.anchors for t in a.split()]) for r in texts.collect()}
    fits = {'"w4 w9"': lambda t: "w4 w9" in t, "/w4.w9/": lambda t: "w4 w9" in t, '"w4 w"': lambda t: "w4 w" in t, "w4*": lambda t: any(w.startswith("w4") for w in t.split())}
    for part in fits:
        if part in q:
            words = {d: x for d, x in words.items() if fits[part](" ".join([*x[0], *x[2], *x[1]]))}
    for t in plan.excluded:
        words = {d: x for d, x in words.items() if not any(t in f for f in x)}
    got = {r.doc_id: r for r in found.collect()}
    assert got.keys() == words.keys() and 0 < len(got) <= 300
    for d, (title, text, _) in words.items():
        assert abs(got[d].f_personal - sum(w for t, w in {"w1": 2, "w25": 1}.items() if t in title or t in text) / 3) < 1e-9


def test_f9_flags_and_lengths_are_sorted_as_two_numbers(spark):
    largest = 2**31 - 1
    rows = [(t, d, *[bool(i >> k & 1) for k in range(3)], *n) for i, (t, d, *n) in enumerate([("b", 2, 1, 0, largest), ("a", 9, largest, 7, 1), ("b", 1, 0, largest, 3), ("a", 1, largest, largest, largest), ("é", 0, 0, 0, 0), ("", 5, 2, 4, 6), ("a", 10, 0, 1, 0), ("B", 3, 1, 1, 1)])]
    df = spark.createDataFrame(rows, "term string, doc_id long, in_title boolean, in_anchors boolean, in_text boolean, len_title int, len_anchors int, len_text int").coalesce(1)
    out = index._sorted(df)
    assert [tuple(r) for r in out.collect()] == sorted(rows) and out.dtypes == df.dtypes
    held = [x for x in _plan(out).split("== Physical Plan ==")[1].splitlines() if "Sort [" in x or "Project [" in x]
    assert "Sort [" in held[1] and held[2].count(" AS ") == 2  # what is sorted: term, doc_id and two numbers
