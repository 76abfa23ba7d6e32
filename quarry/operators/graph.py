"""Link graphs and PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.tables import written


def raw_edges(links: DataFrame, urls: DataFrame) -> DataFrame:
    """(src, dst) for each link to a known url; self-links and repeats stay. links: src, pos, url; urls: url, id."""
    return links.join(urls.select("url", F.col("id").alias("dst")), "url").select("src", "dst")


def index_edges(links: DataFrame, urls: DataFrame, most: int = 64) -> DataFrame:
    """As raw_edges without self-links and repeats, the first ``most`` targets of a page in link order."""
    found = links.join(urls.select("url", F.col("id").alias("dst")), "url").where("src <> dst")
    first = found.groupBy("src", "dst").agg(F.min("pos").alias("pos"))
    return first.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("pos", "dst"))).where(F.col("r") <= most).select("src", "dst")


def node_set(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Sources, targets and nodes without edges."""
    return nodes.select("id").unionByName(edges.select(F.col("src").alias("id"))).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 30, tolerance: float = 1e-8, keep: int = 2) -> DataFrame:
    """(id, rank). Repeated edges weigh more; nodes without links spread their rank evenly.

    Each round is written, which ends its lineage and survives lost executors;
    contributions are summed before the shuffle on the target, so a page that
    everything links to is no hot task.  The only values that reach the driver
    are the node count, the dangling mass and the L1 change.
    """
    nodes = written(node_set(nodes, edges), "nodes")
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    weighted = written(edges.groupBy("src", "dst").agg(F.count("*").alias("times")).join(degree, "src").select("src", "dst", (F.col("times") / F.col("degree")).alias("share")), "edges")
    ranks = written(nodes.join(degree.select(F.col("src").alias("id"), "degree"), "id", "left").select("id", F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("delta"), F.col("degree").isNull().alias("dangling")), "ranks")
    dangling = ranks.where("dangling").agg(F.sum("rank")).first()[0] or 0.0
    for _ in range(iterations):
        base = (1 - damping) / n + damping * dangling / n
        passed = weighted.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        new = F.lit(base) + damping * F.coalesce("got", F.lit(0.0))
        ranks = written(ranks.join(passed, "id", "left").select("id", new.alias("rank"), F.abs(new - F.col("rank")).alias("delta"), "dangling"), "ranks")
        delta, dangling = ranks.agg(F.sum("delta"), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))).first()
        if delta < tolerance:
            break
    return ranks.select("id", "rank")
