"""Schemas and defaults of the page table and the search fields."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXTS = T.ArrayType(T.StringType())
PAGE = T.StructType([T.StructField(n, t) for n, t in (
    ("url", T.StringType()), ("title", T.StringType()), ("text", T.StringType()), ("html", T.StringType()), ("anchors", TEXTS), ("outgoing_links", TEXTS),
    ("content_type", T.StringType()), ("filetype", T.StringType()), ("section", T.StringType()), ("category", T.StringType()), ("fetched_at", T.StringType()), ("status", T.IntegerType()))])
DEFAULTS = {"content_type": "text/html", "filetype": "html", "section": "main", "category": "general", "status": 200}


@dataclass(frozen=True)
class SearchField:
    name: str
    kind: str
    boost: float = 1.0
    stored: bool = True
    indexed: bool = True
    scorable: bool = False


# Boosts that scores depend on.
FIELDS = (
    SearchField("title", "text", 3.2, scorable=True), SearchField("anchors", "text", 2.0, scorable=True), SearchField("text", "text", 1.0, scorable=True),
    SearchField("url", "keyword"), SearchField("filetype", "keyword"), SearchField("section", "keyword"), SearchField("category", "keyword"),
    SearchField("fetched_at", "date"), SearchField("status", "integer"), SearchField("pagerank", "float"),
)


def coerce_pages(rows: DataFrame, category: str = DEFAULTS["category"]) -> DataFrame:
    """Rows of any shape as pages: missing columns and nulls get defaults, values are cast."""
    def column(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType):
            default = F.array().cast("array<string>")
        elif f.name == "fetched_at":
            default = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
        else:
            default = F.lit(category if f.name == "category" else DEFAULTS.get(f.name, ""))
        value = F.col(f.name).try_cast(f.dataType) if f.name in rows.columns else F.lit(None)
        return F.coalesce(value.cast(f.dataType), default.cast(f.dataType)).alias(f.name)

    return rows.select(*map(column, PAGE.fields))


def doc_id(url: Column) -> Column:
    return F.sha1(url.cast("binary"))
