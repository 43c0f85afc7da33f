"""Captured pages, scorer replies and run state."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsieve.schemas import PAGE, RUN_DEFAULTS, RUN_STATE


def read_pages(spark: SparkSession, path: str, schema: T.StructType = PAGE) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def stream_pages_source(
    spark: SparkSession, path: str, schema: T.StructType = PAGE, max_files: int = 1000
) -> DataFrame:
    """Pages as they arrive; ``max_files`` bounds one micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def reply_content(df: DataFrame, body: str = "body") -> DataFrame:
    """Reply text out of a chat completion body; null where the call failed."""
    first = F.variant_get(F.try_parse_json(F.col(body)), "$.choices[0].message.content", "string")
    return df.withColumn("reply", first).drop(body)


def read_replies(spark: SparkSession, path: str, body: str = "body") -> DataFrame:
    """``(url, reply)`` from a Parquet table of completion bodies per URL."""
    return reply_content(spark.read.parquet(path), body)


def with_run_defaults(stored: DataFrame) -> DataFrame:
    """Run state over the defaults.

    Columns the stored table lacks get their default. Columns it has are left as
    they are, nulls included, and so are columns not known here.
    """
    absent = {
        f.name: F.lit(RUN_DEFAULTS[f.name]).cast(f.dataType)
        if not isinstance(RUN_DEFAULTS[f.name], list)
        else F.array(*[F.lit(v) for v in RUN_DEFAULTS[f.name]]).cast(f.dataType)
        for f in RUN_STATE
        if f.name not in stored.columns
    }
    return stored.withColumns(absent) if absent else stored


def read_run_state(spark: SparkSession, path: str) -> DataFrame:
    """Run state of a folder whose files may have been written by different versions.

    Files are grouped by the columns they have, each group takes the defaults of what it lacks, and a null that a
    file holds stays null. Only names of files and columns reach the driver.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    names = sorted(r[0] for r in files.load(path).select("path").collect())
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(spark.read.parquet(name).schema.json(), []).append(name)
    parts = [with_run_defaults(spark.read.parquet(*found)) for found in groups.values()]
    if not parts:
        return with_run_defaults(spark.read.parquet(path))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
