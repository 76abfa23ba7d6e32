"""What an application calls: one method for each route of a search service, plain values out."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.operators import analytics, search, suggest
from quarry.operators.index import Index
from quarry.plans import pipeline, sections
from quarry.plans.query_language import Query, parse_query
from quarry.sources.store import Store

LARGEST_PAGE = 50


def _now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f")


@dataclass
class Service:
    spark: SparkSession
    index: Index
    store: Store

    def _query(self, q: str, **k) -> Query:
        query = Query(q, **k)
        if query.page < 1 or not 1 <= query.size <= LARGEST_PAGE:
            raise ValueError("page starts at 1; size is 1 to 50")
        return query

    def _rows(self, df) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]  # pages of results and roll-ups only

    def user_of(self, session: str | None) -> int | None:
        row = self.store.user_of_session(session).select("id").first() if session else None
        return row["id"] if row else None

    def terms_of(self, user_id: int | None) -> list[str]:
        if user_id is None:
            return []
        rows = suggest.user_terms(self.store.users().where(F.col("id") == user_id), self.store.table("query_logs")).collect()
        return rows[0]["terms"] if rows else []

    def search(self, q: str, user_id: int | None = None, log: bool = True, **k) -> dict:
        """Results, facets and totals; logs the query, and if it is anonymous offers it as a suggestion."""
        context = pipeline.run(pipeline.Context(self._query(q, **k), self.index, self.terms_of(user_id)))
        totals = context.totals.first()
        if log:
            row = [(int(datetime.now().timestamp() * 1e6), user_id, q, context.query.mode, context.query.site, context.query.filetype, totals["total_matches"], _now())]
            entry = self.spark.createDataFrame(row, "id long, user_id long, query string, mode string, site string, filetype string, result_count int, created_at string")
            self.store.append("query_logs", entry)
            self.store.append("suggestions", suggest.from_queries(entry).withColumnRenamed("created_at", "updated_at"))
        return {"results": self._rows(context.hits), "facets": self._rows(context.facets), "total": totals["total_matches"], "total_candidates": totals["total_candidates"], "suggestions": [r["term"] for r in context.suggestions.orderBy("rank").collect()]}

    def facets(self, q: str, **k) -> list[dict]:
        return self._rows(search.facets(search.matches(self.index, parse_query(self._query(q, **k))), self.index.docs))

    def suggest(self, prefix: str, user_id: int | None = None, limit: int = 10) -> list[str]:
        rows = suggest.prefix_suggestions(suggest.upsert(self.store.table("suggestions")), self.store.table("query_logs"), prefix, limit, user_id)
        return [r["term"] for r in rows.orderBy("rank").collect()]

    def stats(self) -> dict:
        return {"documents": self.index.docs.count(), "vocabulary": self.index.df.count(), "facets": self._rows(search.facets(self.index.docs, self.index.docs))}

    def topics(self, plan=sections.EXAMPLE) -> dict:
        return {"sections": self._rows(analytics.progress(sections.dimension(self.spark, plan), self.index.docs)), "categories": self._rows(analytics.top(self.index.docs, "category"))}

    def crawl_plan(self, scale: float = 1.0, plan=sections.EXAMPLE) -> dict:
        if not 0.01 <= scale <= 20:
            raise ValueError("scale is 0.01 to 20")
        return sections.summary(sections.dimension(self.spark, plan), scale).first().asDict()

    def history(self, user_id: int | None = None, limit: int = 100) -> list[dict]:
        return self._rows(suggest.history(self.store.table("query_logs"), user_id, limit))

    def click(self, doc_id: str, url: str, title: str, user_id: int | None = None) -> None:
        self.store.append("click_logs", self.spark.createDataFrame([(user_id, doc_id, url, title, _now())], "user_id long, doc_id string, url string, title string, created_at string"))

    def profile(self, user_id: int, interests: str) -> None:
        rows = self.store.users().where(F.col("id") == user_id)
        self.store.append("users", rows.withColumns({"interests": F.lit(" ".join(interests.split())), "version": F.coalesce("version", F.lit(0)) + 1}))

    def snapshot(self, doc_id: str) -> str | None:
        row = self.store.snapshot(doc_id).first()
        return row["html"] if row else None

    def pipeline(self) -> list[tuple[str, str]]:
        return pipeline.describe()

    def health(self) -> dict:
        return {"status": "ok", "documents": self.index.docs.count()}
