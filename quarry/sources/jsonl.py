"""JSONL sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans.schema import PAGE, coerce_pages

#: As it is parsed: scalars of any JSON type come as text and are cast afterwards.
RAW = T.StructType([T.StructField(f.name, f.dataType if isinstance(f.dataType, T.ArrayType) else T.StringType()) for f in PAGE.fields])


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Strict: bad JSON fails the job; blank lines are skipped; a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], PAGE)
    return coerce_pages(spark.read.schema(RAW).option("mode", "FAILFAST").json(path))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Tolerant: (line, problem, item); problem is blank_line, bad_json, not_object or null."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    body = F.trim("line")
    item = F.from_json("line", RAW, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    valid = F.try_parse_json(body).isNotNull()
    problem = F.when(body == "", "blank_line").when(~valid, "bad_json").when(~body.startswith("{"), "not_object")
    return lines.select("line", problem.alias("problem"), item.alias("item"))


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """Order of the file: partition and offset as one growing number."""
    return lines.withColumn("line_no", F.monotonically_increasing_id())


def write_pages(pages: DataFrame, path: str, mode: str = "append") -> None:
    pages.select(F.to_json(F.struct(*[f.name for f in PAGE.fields if f.name in pages.columns])).alias("value")).write.mode(mode).text(path)


def first_existing(spark: SparkSession, *paths: str | None) -> str | None:
    """The input to use: explicit, clean, raw or sample, whichever is there first."""
    return next((p for p in paths if p and exists(spark, p)), None)


def section_counts(spark: SparkSession, path: str) -> DataFrame:
    """(section, n) of what was written before; lines without a section, or bad ones, count as unknown."""
    if not exists(spark, path):
        return spark.createDataFrame([], "section string, n long")
    rows = read_lines(spark, path).where("problem is null or problem <> 'blank_line'")
    return rows.groupBy(F.coalesce(F.nullif(F.col("item.section"), F.lit("")), F.lit("unknown")).alias("section")).agg(F.count("*").alias("n"))


def written_urls(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], "url string")
    return read_lines(spark, path).where("problem is null").select("item.url").where("url <> ''").distinct()
