"""The crawl plan: a small dimension of sections with budgets, hosts and seeds.

The rows are a parameter.  ``EXAMPLE`` has the shape and the budgets of a
campus crawl on reserved host names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "ord int, key string, label string, category string, max_pages long, priority int, depth_limit int, politeness_delay double, concurrency int, document_first boolean, seeds array<string>, domains array<string>"
# Section budgets.
_ROWS = (("news", "announcements", 36000, 100, 8, 0.7, 2, False), ("main", "portal", 14000, 90, 7, 0.8, 2, False), ("schools", "departments", 42000, 80, 8, 0.9, 2, False), ("academic", "teaching", 26000, 75, 8, 0.9, 2, True), ("research", "research", 18000, 70, 7, 0.9, 2, True), ("library", "library", 8000, 65, 7, 0.9, 2, True), ("anime", "media", 12000, 62, 7, 1.0, 1, False), ("services", "services", 4000, 60, 6, 1.0, 1, False))
EXAMPLE = tuple((i, k, k.title(), c, n, p, d, w, t, f, [f"https://{k}.example.edu/"], [f"{k}.example.edu"]) for i, (k, c, n, p, d, w, t, f) in enumerate(_ROWS))


def dimension(spark: SparkSession, rows=EXAMPLE, keys: tuple[str, ...] | None = None) -> DataFrame:
    """The chosen sections; an unknown key is an error."""
    if unknown := set(keys or ()) - {r[1] for r in rows}:
        raise ValueError(f"unknown sections: {sorted(unknown)}")
    return spark.createDataFrame([r for r in rows if not keys or r[1] in keys], SCHEMA)


def scaled_budget(max_pages: Column, scale: float = 1.0) -> Column:
    return F.greatest(F.floor(max_pages * max(scale, 0.01)), F.lit(1)).cast("long")


def budgets(sections: DataFrame, scale: float = 1.0) -> DataFrame:
    return sections.select("key", scaled_budget(F.col("max_pages"), scale).alias("budget"))


def summary(sections: DataFrame, scale: float = 1.0) -> DataFrame:
    return sections.agg(F.sum(scaled_budget(F.col("max_pages"), scale)).alias("target_pages"), F.count("*").alias("section_count"), F.sum(F.size("seeds")).cast("long").alias("seed_count"))


def seeds(sections: DataFrame, column: str = "seeds") -> DataFrame:
    """Seed urls (or domains) in plan order, each once."""
    rows = sections.select("ord", F.posexplode(column).alias("pos", "value"))
    return rows.groupBy("value").agg(F.min(F.struct("ord", "pos")).alias("at")).orderBy("at").select("value")


def sitemap_seeds(domains: DataFrame) -> DataFrame:
    """Both schemes of every domain (column ``domain``)."""
    return domains.where("domain <> ''").select(F.explode(F.array(*[F.concat(F.lit(s), F.col("domain"), F.lit("/sitemap.xml")) for s in ("https://", "http://")])).alias("url"))


def start_urls(*parts: DataFrame) -> DataFrame:
    """(url, part): the urls of all parts, each once, with the first part that has it; in order of part, pos if a part has it, url.

    Parts are given in the order in which they are to be requested, such as seeds, sitemaps, expanded links.
    """
    rows = [p.select("url", F.lit(i).alias("part"), (F.col("pos") if "pos" in p.columns else F.lit(0)).cast("long").alias("pos")) for i, p in enumerate(parts)]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    first = out.where("url <> ''").groupBy("url").agg(F.min(F.struct("part", "pos")).alias("at"))
    return first.orderBy("at", "url").select("url", "at.part")


def section_of(rows=EXAMPLE, root: str = "example.edu"):
    """(host, is_document) -> section key: the first section whose domain is the host or above it.

    Sections are plan parameters, a handful of rows: the join is a CASE.
    """
    def key(host: Column, is_document: Column) -> Column:
        out = F.when(host == root, "main").when(is_document, "academic").otherwise("main")
        for r in sorted(rows, key=lambda r: -r[0]):
            fits = F.lit(False)
            for d in r[11]:
                fits = fits | (host == d) | host.endswith(f".{d}")
            out = F.when(fits, r[1]).otherwise(out)
        return out

    return key


def format_table(sections: DataFrame, scale: float = 1.0) -> str:
    lines = [f"{'section':<12}{'category':<15}{'target':>8}{'delay':>7}{'conc':>6}{'seeds':>7}"]
    for r in sections.withColumn("n", scaled_budget(F.col("max_pages"), scale)).orderBy("ord").collect():
        lines.append(f"{r['key']:<12}{r['category']:<15}{r['n']:>8}{r['politeness_delay']:>7}{r['concurrency']:>6}{len(r['seeds']):>7}")
    return "\n".join(lines)
