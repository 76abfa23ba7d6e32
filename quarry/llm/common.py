"""Shared pieces: shared-folder tables, bounded Arrow slices, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII whitespace as the word rule has it: bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Spark's setting that removes a query's shuffle files when it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
UPPER_AZ, LOWER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables in the folder that driver and executors share.

    The folder is ``spark.checkpoint.dir``; only where that is unset (a single
    machine, tests) a temporary folder is made and registered instead.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, sc = spark, spark.sparkContext
        base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            at = sc._jsc.sc().getCheckpointDir()
            base = at.get() if at.isDefined() else None
        if not base:
            if not sc.master.startswith("local"):  # each machine would write to a disk of its own
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="quarry-")
            sc.setCheckpointDir(base)
            atexit.register(shutil.rmtree, base, True)
        self.path, self.n, self.tables = f"{base}/{name}-{uuid.uuid4().hex}", 0, []

    def write(self, df: DataFrame) -> DataFrame:
        """Writes df and reads it back: the lineage ends here, a lost executor costs nothing before it, and the shuffle files that led here go."""
        self.n += 1
        at, before = f"{self.path}/{self.n}", self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(at)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(at)
        out.scratch_path = at
        self.tables.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing reads any more."""
        for df in tables:
            if at := getattr(df, "scratch_path", None):
                remove(self.spark, at)
        self.tables = [t for t in self.tables if not any(t is df for df in tables)]

    def keep_only(self, *tables: DataFrame) -> None:
        """Removes all tables but those that a lazy result still reads."""
        self.drop(*[t for t in self.tables if not any(t is df for df in tables)])


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000):
    """Cuts a batch so that a slice holds about ``most`` bytes of the column (one row at least)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1
    for a, b in zip(np.r_[0, cut], np.r_[cut, batch.num_rows], strict=True):
        yield batch.slice(int(a), int(b - a))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's UTF-8 bytes; null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def parts_for(rows: int, most: int, least: int = 64) -> int:
    """How many buckets keep each below ``most`` rows."""
    return max(least, -(-rows // most))


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of all nodes in ``edges`` (src, dst); label is one node of the component.

    Randomised contraction: in each round every node picks the smallest hash
    in its closed neighbourhood and the graph is contracted onto the picks, so
    a constant share of the nodes goes whatever the graph looks like (chains
    and stars too) and the rounds are logarithmic.  Minima are summed before
    the shuffle, and each join reads written tables on both sides, so that a
    hub's rows can be split by AQE.  Nothing but a row count reaches the driver.
    """
    e = scratch.write(edges.where("src <> dst").selectExpr("src v", "dst w").unionByName(edges.where("src <> dst").selectExpr("dst v", "src w")).distinct())
    labels = scratch.write(e.select(F.col("v").alias("node")).distinct().withColumn("label", F.col("node")))
    turn = 0
    while not e.isEmpty():
        turn += 1
        h = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)).alias("h"), F.col(c).alias("x"))
        pick = scratch.write(e.groupBy("v").agg(F.min(h("w")).alias("m")).select("v", F.least(F.col("m"), h("v"))["x"].alias("p")))
        near = e.join(pick, "v").select(F.col("p").alias("a"), "w")
        # nothing between the two joins needs the rows of one key together
        half = scratch.write(near.distinct())
        new = scratch.write(half.join(pick.selectExpr("v w", "p b"), "w").where("a <> b").selectExpr("a v", "b w").distinct())
        moved = scratch.write(labels.join(pick.selectExpr("v label", "p"), "label", "left").select("node", F.coalesce("p", "label").alias("label")))
        scratch.drop(e, pick, half, labels)
        e, labels = new, moved
    scratch.drop(e)
    return labels
