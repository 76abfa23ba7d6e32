"""Search: a parsed query and an index become one DataFrame of matches.

Where a query asks for terms, its candidates come from the postings: ``term IN``
the query's own terms, which skips row groups of the sorted files, becomes one row
of flags for each document that has any; only these documents are looked up, and
only their short columns.  Texts are read for one page of results.  Phrases and
regular expressions without a term, which may start and end within words, and
queries of filters only are tests on the documents themselves, to whose matches
the flags are joined.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quarry.functions import scoring as sc
from quarry.functions import text as tx
from quarry.functions import urls as ux
from quarry.operators.index import FIELDS, Index
from quarry.plans.query_language import Mode, Plan, Query, parse_query, site_prefixes, wildcard_regex, with_aliases
from quarry.plans.schema import FIELDS as SPEC
from quarry.plans.tables import written

BOOSTS = {f.name: f.boost for f in SPEC if f.scorable}
# Facet sizes, matched terms shown, phrase scores.
FACETS = {"filetype": 8, "domain": 8, "category": 12, "section": 12}
REMOTE_FACETS = {"filetype": 20, "category": 12, "section": 12}
MATCHED, PHRASE_TITLE, PHRASE_TEXT = 12, 2.5, 1.2


def structured(plan: Plan) -> Column:
    """Site, file type, section, category, dates and url terms: filters that reach the scan."""
    c, out = F.col, F.lit(True)
    if plan.site:
        prefixes = site_prefixes(plan.site) or (plan.site,)
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | c("url").startswith(p)
        out = out & hit
    if plan.filetype:
        out = out & (F.lower("filetype") == plan.filetype.lower())
    for k in ("section", "category"):
        if v := getattr(plan, k):
            out = out & (c(k) == v)
    day = F.left(tx.text_or_empty(c("fetched_at")), F.lit(10))  # dates compare as strings; none passes
    if plan.after:
        out = out & ((day == "") | (day >= plan.after))
    if plan.before:
        out = out & ((day == "") | (day <= plan.before))
    for t in plan.url_terms:
        out = out & F.contains(F.lower("url"), F.lit(t))
    return out


class Located:
    """Tests of a document's terms on the flags that ``rows`` takes from the postings."""

    def __init__(self, terms):
        self.number = {t: i for i, t in enumerate(dict.fromkeys(terms))}

    def has(self, t: str, f: str) -> Column:
        return F.col(f"__{f}_{self.number[t]}") if t in self.number else F.lit(False)

    def size(self, f: str) -> Column:
        return F.col(f"__len_{f}")

    def any(self, terms) -> Column:
        """Any field holds any of the terms."""
        out = F.lit(False)
        for t in terms:
            for f in FIELDS:
                out = out | self.has(t, f)
        return out

    def added(self, docs: DataFrame, postings: DataFrame) -> DataFrame:
        """docs with lengths and flags; documents with none of the terms stay."""
        if not self.number:
            return docs
        rows = docs.join(self.rows(postings), "doc_id", "left")
        return rows.fillna(False, [f"__{f}_{i}" for i in self.number.values() for f in FIELDS])

    def rows(self, postings: DataFrame) -> DataFrame:
        """doc_id, field lengths and a flag for each term and field, of documents with any of the terms."""
        flags = [F.coalesce(F.bool_or(F.when(F.col("term") == t, F.col(f"in_{f}"))), F.lit(False)).alias(f"__{f}_{i}") for t, i in self.number.items() for f in FIELDS]
        return postings.where(F.col("term").isin(*self.number)).groupBy("doc_id").agg(*[F.max(f"len_{f}").alias(f"__len_{f}") for f in FIELDS], *flags)


def history_weights(history: list[str]) -> dict[str, int]:
    """How often each token occurs in a user's queries."""
    weights: dict[str, int] = {}
    for q in history:
        for t in tx.tokens_of(q):
            weights[t] = weights.get(t, 0) + 1
    return weights


def regex_test(pattern: str) -> Column:
    """Found anywhere in the lower-cased text, in either case; an invalid pattern matches nothing."""
    try:
        re.compile(pattern)
    except re.error:
        return F.lit(False)
    return F.col("combined").rlike(f"(?iu){pattern}")


def known_terms(index: Index, plan: Plan) -> dict[str, int]:
    """Document frequencies of the query's own terms: at most as many rows as the query has terms."""
    terms = list(plan.positive)
    return {r["term"]: r["df"] for r in index.df.where(F.col("term").isin(terms)).collect()} if terms else {}


def candidate_terms(plan: Plan, df: dict[str, int]) -> list[str]:
    """Documents with any of them are candidates; if there is none, all are."""
    return [t for t in (*plan.terms, *plan.title_terms) if df.get(t)]


def candidate_total(index: Index, plan: Plan) -> DataFrame:
    """One row: total_candidates."""
    terms = candidate_terms(plan, known_terms(index, plan))
    rows = index.postings.where(F.col("term").isin(*terms)).select("doc_id").distinct() if terms else index.docs
    return rows.agg(F.count("*").alias("total_candidates"))


def expanded_terms(index: Index, plan: Plan) -> DataFrame:
    """(term, df) of vocabulary terms that any wildcard fits."""
    pattern = "|".join(f"(?:{wildcard_regex(w)})" for w in plan.wildcards)
    return index.df.where(F.col("term").rlike(f"(?i){pattern}")) if plan.wildcards else index.df.limit(0)


def term_score(plan: Plan, df: dict[str, int], stats, tests: Located, model) -> Column:
    """Over the query's own terms; ``stats`` is the row of index.stats, ``model`` scores one term of one field."""
    out = F.lit(0.0)
    for t in plan.positive:
        if df.get(t):
            for f in FIELDS:
                out = out + F.when(tests.has(t, f), model(F.lit(stats["n"]), F.lit(df[t]), tests.size(f), F.lit(stats[f"avg_{f}"]), BOOSTS[f])).otherwise(0.0)
    return out


def interest(weights: dict[str, int], tests: Located) -> Column:
    """The weighted share of a user's query tokens that the document has."""
    hit = F.lit(0.0)
    for t, w in weights.items():
        hit = hit + F.when(tests.has(t, "title") | tests.has(t, "text"), float(w)).otherwise(0.0)
    return F.least(hit / max(sum(weights.values()), 1), F.lit(1.0))


def phrase_score(plan: Plan) -> Column:
    out = F.lit(0.0)
    for p in plan.phrases:
        out = out + F.when(F.contains(F.lower("title"), F.lit(p.lower())), PHRASE_TITLE).when(F.contains("combined", F.lit(p.lower())), PHRASE_TEXT).otherwise(0.0)
    return out


def title_share(plan: Plan, tests: Located) -> Column:
    terms = plan.title_terms or plan.terms
    hit = F.lit(0)
    for t in terms:
        hit = hit + tests.has(t, "title").cast("int")
    return hit / len(terms) if terms else F.lit(0.0)


#: What of a document is looked up for ranking.
SHORT = ("doc_id", "url", "filetype", "section", "category", "fetched_at")


def matches(index: Index, plan: Plan, as_of: Column | None = None, history: list[str] | None = None, ranks: DataFrame | None = None, weights: dict[str, float] = sc.WEIGHTS, model=sc.bm25f, extra=None) -> DataFrame:
    """All matching documents: their short columns, the features (f_*), score and matched terms.

    ranks: (id, rank) from PageRank; without it every document has 1/n, as a graph without edges gives.
    model: scores one term of one field, (n, df, length, average, boost) -> Column.
    extra: more columns by name from the term tests.
    """
    positive, told = list(plan.positive), history_weights(history or [])
    known, stats = known_terms(index, plan), index.stats.first()  # a few rows: they become constants of the plan
    terms = candidate_terms(plan, known)
    by_terms = bool(terms) or bool(positive and not plan.phrases and not plan.regexes and not plan.wildcards)
    tests = Located([*positive, *plan.excluded, *told])
    ok = (tests.any(terms) if terms else F.lit(True)) & (~tests.any(plan.excluded) if plan.excluded else F.lit(True))
    for t in plan.title_terms:
        ok = ok & tests.has(t, "title")
    own = tests.any(positive)
    if not plan.phrases and not plan.regexes and positive and not plan.wildcards:
        ok = ok & own
    phrase = phrase_score(plan).alias("__phrase")  # where the texts are: they are not joined
    wanted = structured(plan)
    for p in plan.phrases:
        wanted = wanted & F.contains("combined", F.lit(p.lower()))
    for p in plan.regexes:
        wanted = wanted & regex_test(p)
    if by_terms:
        rows = index.docs.where(wanted).select(*SHORT, phrase).join(tests.rows(index.postings).where(ok), "doc_id")
    else:
        rows = tests.added(index.docs.where(wanted).select(*SHORT, phrase), index.postings).where(ok)
    url_hits = F.lit(0)
    for t in [*positive, *plan.url_terms]:
        url_hits = url_hits + F.contains(F.lower("url"), F.lit(t.lower())).cast("int")
    terms_found = F.filter(F.array(*[F.when(tests.any([t]), F.lit(t)) for t in positive]), lambda t: t.isNotNull()) if positive else F.array().cast("array<string>")
    if plan.wildcards:
        more = expanded_terms(index, plan).where(~F.col("term").isin(positive)) if positive else expanded_terms(index, plan)
        n_terms = more.agg(F.count("*").alias("__n_terms"))
        part = F.lit(0.0)
        hit = index.postings.join(more, "term")
        for f in FIELDS:
            part = part + F.when(F.col(f"in_{f}"), model(F.lit(stats["n"]), F.col("df"), F.col(f"len_{f}"), F.lit(stats[f"avg_{f}"]), BOOSTS[f])).otherwise(0.0)
        per_doc = hit.groupBy("doc_id").agg(F.sum(part).alias("__more"), F.array_sort(F.collect_set("term")).alias("__terms"))
        needed = plan.mode is Mode.WILDCARD or not (plan.phrases or plan.regexes)
        rows = rows.join(per_doc, "doc_id", "left" if positive or not needed else "inner").crossJoin(F.broadcast(n_terms))
        wild, wild_score, wild_terms = F.col("__more").isNotNull(), F.coalesce("__more", F.lit(0.0)), F.coalesce("__terms", F.array().cast("array<string>"))
        n_all = F.col("__n_terms") + len(positive)
        rows = rows.where(own | wild) if needed else rows
        # an expanded term in the url need not be in the text: every vocabulary term that fits is tried, in urls of matches which a wildcard fits
        pattern = "|".join(f"(?:{wildcard_regex(w)})" for w in plan.wildcards)
        tried = rows.where(F.col("url").rlike(f"(?i){pattern}")).select("doc_id", F.lower("url").alias("u")).withColumn("i", F.explode(F.sequence(F.lit(1), F.length("u"))))
        lengths = more.select(F.length("term").alias("size")).where(F.col("size") <= 2048).distinct()  # so at most 2048 rows
        parts = tried.join(F.broadcast(lengths), F.col("i") + F.col("size") - 1 <= F.length("u")).select("doc_id", F.substring("u", F.col("i"), F.col("size")).alias("term")).distinct()
        in_url = parts.join(more.select("term"), "term", "left_semi").groupBy("doc_id").agg(F.count("*").alias("__in_url"))
        rows = rows.join(in_url, "doc_id", "left")
        url_hits = url_hits + F.coalesce("__in_url", F.lit(0))
    else:
        wild_score, wild_terms, n_all = F.lit(0.0), F.array().cast("array<string>"), F.lit(len(positive))
    if ranks is None:
        rank = F.lit(1.0 / max(stats["n"], 1))
    else:
        rows = rows.join(ranks.select(F.col("id").alias("doc_id"), F.col("rank").alias("__rank")), "doc_id", "left")
        rank = F.coalesce("__rank", F.lit(0.0))
    features = {
        "bm25": term_score(plan, known, stats, tests, model) + wild_score, "phrase": F.col("__phrase"), "title": title_share(plan, tests), "url": F.least(url_hits / F.greatest(n_all, F.lit(1)), F.lit(1.0)),
        "pagerank": rank, "freshness": sc.freshness(F.col("fetched_at"), as_of if as_of is not None else F.current_timestamp()), "personal": interest(told, tests),
    }
    more_columns = extra(tests) if extra else {}
    rows = rows.select(*SHORT, *[c.alias(f"f_{k}") for k, c in features.items()], F.concat(terms_found, wild_terms).alias("matched_terms"), *[c.alias(k) for k, c in more_columns.items()])
    score = sc.total({k: F.col(f"f_{k}") for k in features}, weights)
    if plan.phrases or plan.regexes:
        score = F.when(score <= 0, sc.FLOOR + F.col("f_personal")).otherwise(score)
    return rows.withColumn("score", score)


#: A page up to so many rows is looked up by its ids.
LOOKED_UP = 10_000


def hits(found: DataFrame, query: Query, docs: DataFrame, page: int | None = None, size: int | None = None) -> DataFrame:
    """One page of results, best first, ties by doc_id: ranks are cut first, then titles and texts of that page are read from ``docs``."""
    size = size or query.size
    offset = (max(page, 1) - 1) * size if page else query.offset
    ranked = found.orderBy(F.desc("score"), "doc_id").offset(offset).limit(size)
    texts = docs.select("doc_id", "title", "text")
    if size <= LOOKED_UP:
        rows = ranked.collect()  # one page
        ranked = found.sparkSession.createDataFrame(rows, found.schema)
        texts = texts.where(F.col("doc_id").isin([r["doc_id"] for r in rows]))
    top = texts.join(ranked, "doc_id").orderBy(F.desc("score"), "doc_id")
    return top.select("doc_id", "url", F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), tx.snippet(F.col("text"), query.q).alias("snippet"), "score", F.col("f_pagerank").alias("pagerank"), "filetype", "fetched_at", "section", "category", F.concat("doc_id", F.lit(".html")).alias("snapshot_path"), F.slice("matched_terms", 1, MATCHED).alias("matched_terms"), sc.explain({k: F.col(f"f_{k}") for k in sc.WEIGHTS}).alias("explanation"))


def _counted(rows: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """(facet, key, n), summed before the shuffle."""
    keys = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), (ux.authority(F.col("url")) if f == "domain" else F.col(f)).alias("key")) for f in sizes])).alias("x")
    return rows.select(keys).groupBy("x.facet", "x.key").agg(F.count("*").alias("n"))


def _most_frequent(n: DataFrame, sizes: dict[str, int]) -> DataFrame:
    most = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("facet"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "key"))).where(F.col("rank") <= most)


def facets(found: DataFrame, everything: DataFrame) -> DataFrame:
    """(facet, key, n, rank) of the matches; of the whole corpus if there are none."""
    n = written(_counted(found, FACETS), "facets")  # matched once; what is written is a row for each key
    return _most_frequent(_counted(everything, FACETS) if n.isEmpty() else n, FACETS)


def remote_facets(found: DataFrame) -> DataFrame:
    """The same as a search server's profile gives it: of the matches only, other sizes; null is no key, and the empty key, which counts in the cut, never shows."""
    n = _counted(found, REMOTE_FACETS).where("key is not null")
    return _most_frequent(n, REMOTE_FACETS).where("key <> ''")


def search(index: Index, query: Query, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, facets, totals) as three DataFrames; the matches' short columns are written once for the three."""
    plan = parse_query(query)
    found = written(matches(index, plan, **options), "matches")
    totals = found.agg(F.count("*").alias("total_matches")).crossJoin(candidate_total(index, plan))  # one row each
    return hits(found, query, index.docs), facets(found, index.docs), totals


def windowed(found: DataFrame, query: Query, docs: DataFrame, window: int = 200_000) -> DataFrame:
    """Beyond the result window nothing is fetched; a page across its edge is cut."""
    left = max(window - query.offset, 0)
    return hits(found, query, docs, size=min(query.size, left)) if left else hits(found.limit(0), query, docs)


def remote_score(index: Index, plan: Plan, history: list[str] | None = None, ranks: DataFrame | None = None, aliases=with_aliases) -> DataFrame:
    """The profile of a search server: the best field counts, PageRank adds ln(1 + 0.15 pr); approximate by design.

    ``aliases`` puts the names of sections and categories that the documents carry for those asked for.
    """
    boosts = {"title": 3.0, "anchors": 2.0, "text": 1.0}
    best = lambda tests: {f"__{f}": sum((F.when(tests.has(t, f), b).otherwise(0.0) for t in plan.positive), F.lit(0.0)) for f, b in boosts.items()}
    found = matches(index, aliases(plan), ranks=ranks, history=history, extra=best)
    return found.withColumn("score", F.greatest(*[f"__{f}" for f in boosts]) + 0.4 * F.col("f_personal") + F.log1p(0.15 * F.col("f_pagerank"))).drop(*[f"__{f}" for f in boosts])


def cosine_rank(index: Index, query: str) -> DataFrame:
    """The TF-IDF ranker: cosines of title x 1.8, anchors x 1.4 and text, plus PageRank and a user boost, if the documents have them.

    Norms are a table of the index; a query touches the postings of its own terms.
    """
    terms = tx.tokens_of(query)
    n = index.stats.first()["n"]
    df = {r["term"]: r["df"] for r in index.df.where(F.col("term").isin(terms)).collect()} if terms else {}  # at most one row for each term
    weight = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
    asked = math.sqrt(sum(w * w for w in weight.values()) + len(terms) - len(df))  # a term without idf weighs 1
    square = F.lit(0.0)
    for t, w in sorted(weight.items()):
        square = F.when(F.col("term") == t, w * w).otherwise(square)
    dots = index.postings.where(F.col("term").isin(list(df))).groupBy("doc_id").agg(*[F.sum(F.when(F.col(f"in_{f}"), square).otherwise(0.0)).alias(f"dot_{f}") for f in FIELDS])
    boost = {"title": 1.8, "anchors": 1.4, "text": 1.0}
    lexical = F.lit(0.0)
    for f in FIELDS:
        lexical = lexical + boost[f] * F.coalesce(F.col(f"dot_{f}") / F.nullif(F.col(f"norm_{f}") * asked, F.lit(0.0)), F.lit(0.0))
    scored = dots.join(index.norms, "doc_id").select("doc_id", lexical.alias("lexical"))
    extra = [F.coalesce(F.col(c), F.lit(0.0)) if c in index.docs.columns else F.lit(0.0) for c in ("pagerank", "user_boost")]
    return index.docs.join(scored, "doc_id", "left").select("doc_id", (F.coalesce("lexical", F.lit(0.0)) + 0.15 * extra[0] + 0.20 * extra[1]).alias("score"))
