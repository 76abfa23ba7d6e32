"""The relational store as tables of a folder: append-only logs and roll-ups.

Updates are appended versions, the latest wins; sessions end by a row as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.sources.jsonl import exists

SCHEMAS = {
    "users": "id long, username string, interests string, created_at string, version long",
    "sessions": "token string, user_id long, created_at string, ended boolean",
    "query_logs": "id long, user_id long, query string, mode string, site string, filetype string, result_count int, created_at string",
    "click_logs": "id long, user_id long, doc_id string, url string, title string, created_at string",
    "suggestions": "term string, weight double, source string, updated_at string",
    "snapshots": "doc_id string, html string",
}


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        at = f"{self.path}/{name}"
        return self.spark.read.schema(SCHEMAS[name]).parquet(at) if exists(self.spark, at) else self.spark.createDataFrame([], SCHEMAS[name])

    def append(self, name: str, rows: DataFrame) -> None:
        kinds = self.table(name).schema
        rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds.fields]).write.mode("append").parquet(f"{self.path}/{name}")

    def users(self) -> DataFrame:
        """The latest version of each."""
        last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.coalesce("version", F.lit(0)))))
        return self.table("users").withColumn("r", last).where("r = 1").drop("r")

    def user_of_session(self, token: str) -> DataFrame:
        live = self.table("sessions").where(F.col("token") == token).groupBy("token").agg(F.max("user_id").alias("id"), F.max(F.coalesce("ended", F.lit(False))).alias("ended")).where("not ended")
        return self.users().join(live.select("id"), "id")

    def add_snapshots(self, pages: DataFrame) -> None:
        """html by doc_id, or the escaped text if there is none; what is there is never overwritten."""
        escaped = F.coalesce(F.col("text"), F.lit(""))
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            escaped = F.replace(escaped, F.lit(a), F.lit(b))
        html = F.coalesce(F.nullif("html", F.lit("")), F.concat(F.lit("<pre>"), escaped, F.lit("</pre>")))
        new = pages.select("doc_id", html.alias("html")).dropDuplicates(["doc_id"])
        self.append("snapshots", new.join(self.table("snapshots").select("doc_id"), "doc_id", "left_anti"))

    def snapshot(self, doc_id: str) -> DataFrame:
        return self.table("snapshots").where(F.col("doc_id") == doc_id)
