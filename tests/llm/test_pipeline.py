"""The pipeline stage by stage against brute force on the smallest tables."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import langid, mixing
from tests.llm.test_operators import brute_fingerprint, brute_leaks, brute_spans, components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    # what the stages must stand: nulls in every column, an extra column, repeated texts
    extra = spark.createDataFrame([(9001, None, None, None, None), (9002, "12345 !!", "en", None, 8), (9003, docs.first().text, "en", "src1", 1)], docs.schema)
    docs = docs.unionByName(extra).withColumn("component_id", F.lit("clash"))
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        out.append((docs, after := f(spark, docs, SF)))
        after.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out[-1] = (out[-1][0], docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert before.columns == after.columns and before.dtypes == after.dtypes


def test_language_stage(stages):
    before, after = stages[0]
    gone = ids(before) - ids(after)
    assert {9001, 9002} <= gone and len(gone) <= 3 and langid.held_out is not None


def test_near_dedup_stage(stages):
    before, after = stages[1]
    f = {r.doc_id: brute_fingerprint(r.text) for r in before.select("doc_id", "text").collect()}
    n = sorted(f)
    first = components(n, [(a, b) for a in n for b in n if a < b and (f[a] ^ f[b]).bit_count() <= 4])
    assert ids(after) == set(first.values())


def test_decontamination_stage(spark, stages):
    before, after = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    shingle = lambda t: {tuple(w[i : i + 5]) for w in [re.sub(r"[\W_]+", " ", (t or "").lower()).split()] for i in range(len(w) - 4)}
    known = set().union(*(shingle(t) for _, t in items))
    rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
    maybe = [(i, t) for i, t in rows if shingle(t) & known]
    assert ids(before) - ids(after) == {d for d, _ in brute_leaks(maybe, items)}


def test_secret_stage(stages):
    before, after = stages[3]
    rows = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
    assert ids(before) - ids(after) == {i for i, t in rows.items() if brute_spans(t)}  # no unusual strings beside in this table


def test_mixture_stage(stages):
    before, after = stages[4]
    sizes, source = Counter(), {}
    for r in before.select("doc_id", "source", "text").collect():
        sizes[r.source] += len((r.text or "").encode().split())
        source[r.doc_id] = r.source
    order = [*sorted(s for s in sizes if s is not None), *([None] if None in sizes else [])]
    want = mixing.targets(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken = Counter()
    for r in after.collect():
        assert 0 < r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 2 for s in sizes)


def test_run_is_the_stages(spark, stages):
    assert corpus_pipeline.ORACLE_SQL is None
    small = corpus_pipeline.run(spark, SF)
    assert small.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "target", "taken"] and small.count() > 0
