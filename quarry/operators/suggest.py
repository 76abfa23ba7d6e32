"""Users' logs, suggestions and interests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as tx
from quarry.plans.tables import written

#: Rows of the suggestion log; the table itself is its roll-up.
SUGGESTION = "term string, weight double, source string, updated_at string"
#: Users and documents in a block of scores, and rows of a table of terms or classes that is broadcast.
BLOCK, BROADCAST_ROWS = 1024, 200_000


def from_documents(docs: DataFrame, source: str = "index") -> DataFrame:
    """Suggestion rows of documents (title, text): eight tokens each, weight 1."""
    return docs.select(F.explode(tx.suggestion_terms(F.col("title"), F.col("text"))).alias("term")).select("term", F.lit(1.0).alias("weight"), F.lit(source).alias("source"))


def from_queries(log: DataFrame) -> DataFrame:
    """Suggestion rows of anonymous queries (user_id, query): the query weighs 2, its longer tokens 1."""
    q = F.trim(tx.text_or_empty(F.col("query")))
    rows = log.where("user_id is null").where(q != "")
    whole = rows.select(q.alias("term"), F.lit(2.0).alias("weight"), F.lit("query").alias("source"), "created_at")
    parts = rows.select(F.explode(F.filter(tx.tokenize(q), lambda t: F.length(t) >= 2)).alias("term"), F.lit(1.0).alias("weight"), F.lit("query_term").alias("source"), "created_at")
    return whole.unionByName(parts)


def upsert(*logs: DataFrame) -> DataFrame:
    """Weights add up; source and time are those of the last entry."""
    rows = logs[0]
    for more in logs[1:]:
        rows = rows.unionByName(more)
    rows = rows.withColumn("term", F.trim("term")).where("term <> ''")
    last = F.max(F.struct("updated_at", "source"))
    return rows.groupBy("term").agg(F.sum("weight").alias("weight"), last.alias("last")).select("term", "weight", F.col("last.source").alias("source"), F.col("last.updated_at").alias("updated_at"))


def strongest(suggestions: DataFrame, most: int = 20_000) -> DataFrame:
    return suggestions.orderBy(F.desc("weight"), "term").limit(most)


def like(column: str, prefix: str):
    """SQL LIKE 'prefix%' with ASCII case folded; % and _ in the prefix are wildcards."""
    fold = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.like(fold(F.col(column)), fold(F.lit(prefix.strip().replace("\\", "\\\\") + "%")))


def personal_counts(log: DataFrame, user_id: int, prefix: str = "") -> DataFrame:
    """(term, weight, last_id) of a user's queries."""
    return log.where((F.col("user_id") == user_id) & like("query", prefix)).groupBy(F.col("query").alias("term")).agg(F.count("*").alias("weight"), F.max("id").alias("last_id"))


def prefix_suggestions(suggestions: DataFrame, log: DataFrame, prefix: str = "", limit: int = 10, user_id: int | None = None) -> DataFrame:
    """(rank, term): a user's own queries by frequency, then everyone's terms by weight; each once."""
    shared = suggestions.where(like("term", prefix)).orderBy(F.desc("weight"), F.desc("updated_at"), "term").limit(limit)
    rows = shared.select("term", F.lit(1).alias("part"), F.row_number().over(Window.orderBy(F.desc("weight"), F.desc("updated_at"), "term")).alias("n"))
    if user_id is not None:
        own = personal_counts(log, user_id, prefix).orderBy(F.desc("weight"), F.desc("last_id")).limit(limit)
        rows = rows.unionByName(own.select("term", F.lit(0).alias("part"), F.row_number().over(Window.orderBy(F.desc("weight"), F.desc("last_id"))).alias("n")))
    first = rows.groupBy("term").agg(F.min(F.struct("part", "n")).alias("at"))  # twice ``limit`` rows at most
    return first.select(F.row_number().over(Window.orderBy("at")).alias("rank"), "term").where(F.col("rank") <= limit)


def history(log: DataFrame, user_id: int | None = None, limit: int = 100) -> DataFrame:
    """The newest queries of a user, or of all."""
    rows = log if user_id is None else log.where(F.col("user_id") == user_id)
    return rows.orderBy(F.desc("id")).limit(limit)


def user_terms(users: DataFrame, log: DataFrame, limit: int = 30) -> DataFrame:
    """(user_id, terms): interests first, then the last queries, ``limit`` in all."""
    recent = log.where("user_id is not null").withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("id")))).where(F.col("r") <= limit)
    queries = recent.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "query"))), lambda x: x["query"]).alias("queries"))
    own = F.trim(tx.text_or_empty(F.col("interests")))
    rows = users.select(F.col("id").alias("user_id"), F.when(own != "", F.array(own)).otherwise(F.array().cast("array<string>")).alias("own")).join(queries, "user_id", "left")
    return rows.select("user_id", F.slice(F.concat("own", F.coalesce("queries", F.array().cast("array<string>"))), 1, limit).alias("terms"))


def interest_scores(history_rows: DataFrame, docs: DataFrame, digits: int | None = None) -> DataFrame:
    """(user_id, doc_id, score): weighted share of a user's tokens in a document; history: user_id, query; docs: doc_id, tokens.

    Documents with the same of the asked-for terms form a class, which a user scores once.  Classes become rows of
    single documents at the very end, each task a block of users times a block of documents, so that what is shuffled
    and held grows with the blocks and not with the rows.  Scores are rounded to ``digits``, if given.
    """
    weights = history_rows.where("user_id is not null").select("user_id", F.explode(tx.tokenize(F.col("query"))).alias("term")).groupBy("user_id", "term").agg(F.count("*").alias("w"))
    weights = written(weights, "weights")
    terms = written(weights.select("term").distinct().withColumn("t", F.monotonically_increasing_id()), "terms")
    has = docs.select("doc_id", F.explode("tokens").alias("term")).join(_small(terms), "term")
    members = written(has.groupBy("doc_id").agg(F.sort_array(F.collect_list("t")).alias("has")), "members")
    classes = written(members.groupBy("has").agg(F.count("*").alias("n")), "classes")
    users = weights.groupBy("user_id").agg(F.sum("w").alias("total"))
    n_users, n_docs = users.count(), members.count()
    score = F.least(F.sum("w") / F.greatest(F.first("total"), F.lit(1)), F.lit(1.0))
    asked = weights.join(_small(terms), "term").join(users, "user_id")
    scored = asked.join(_small(classes.select("has", F.explode("has").alias("t"))), "t").groupBy("user_id", "has").agg((score if digits is None else F.round(score, digits)).alias("score"))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.ceil(n / BLOCK))
    of_users = scored.groupBy("has", part("user_id", F.lit(max(n_users, 1))).alias("u")).agg(F.collect_list(F.struct("user_id", "score")).alias("users"))
    of_docs = members.join(_small(classes), "has").groupBy("has", part("doc_id", F.col("n")).alias("d")).agg(F.collect_list(F.struct("doc_id")).alias("docs"))  # of a struct a null stays
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_users * n_docs / (64 * BLOCK * BLOCK)))
    pairs = of_users.join(of_docs, "has").repartition(n, "has", "u", "d")
    return pairs.select("docs", F.explode("users").alias("x")).select("x.user_id", "x.score", F.explode("docs").alias("y")).select("user_id", "y.doc_id", "score")


def _small(rows: DataFrame) -> DataFrame:
    """Broadcast if its rows, which are counted, are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def of_hits(hits: DataFrame, most_hits: int = 5, per_hit: int = 4, limit: int = 12) -> DataFrame:
    """(rank, term): suggestions of a result page; hits: rank, title, snippet or text."""
    rows = hits.where(F.col("rank") <= most_hits).select("rank", F.posexplode(tx.suggestion_terms(F.col("title"), F.col("text"), per_hit)).alias("pos", "term"))
    first = rows.groupBy("term").agg(F.min(F.struct("rank", "pos")).alias("at"))
    return first.select(F.row_number().over(Window.orderBy("at")).alias("rank"), "term").where(F.col("rank") <= limit)
