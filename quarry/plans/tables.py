"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder is registered only where none is set."""
    sc = spark.sparkContext
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
    return base


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written and read back: its lineage ends here."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def computed(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with columns that are computed once for each row: no later filter or projection is moved through a
    generator, so that dear expressions are not copied into them."""
    kept = [c for c in rows.columns if c not in columns]
    x = F.explode(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))).alias("__x")
    return rows.select(*kept, x).select(*kept, "__x.*")
