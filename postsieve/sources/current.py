"""Current rows by key, in buckets: a batch of upserts rewrites the buckets of its keys, and readers merge nothing.

``rows/batch_id=<n>/bucket=<b>`` holds bucket ``b`` as batch ``n`` left it, ``state/batch_id=<n>`` names the buckets that
batch rewrote. The latest batch that names a bucket has its rows. A batch counts once its state is written, so one that
failed leaves no trace and is done again; earlier batches stay readable until their folders are deleted. One writer at a
time; what a run saves by itself, beside others, goes to the log of :mod:`postsieve.sources.store` first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsieve.operators.keyed import last_per_key, same_keys
from postsieve.session import materialise

# Buckets of a new table; so many numbers at most reach the driver. Take enough that one is a small share of a table.
BUCKETS = 256
_META = T.StructType([T.StructField("key", T.StringType()), T.StructField("buckets", T.IntegerType())])
_STATE = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("batch_id", T.LongType())])


def init_current(rows: DataFrame, path: str, key: str = "job_url", buckets: int = BUCKETS) -> None:
    """Create an empty table for rows of these columns, unless it exists; ``key`` and ``buckets`` stay what they are then."""
    spark = rows.sparkSession
    rows.limit(0).write.mode("ignore").parquet(f"{path}/schema")
    spark.createDataFrame([(key, buckets)], _META).write.mode("ignore").parquet(f"{path}/meta")
    spark.createDataFrame([], _STATE).write.mode("ignore").partitionBy("batch_id").parquet(f"{path}/state")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _meta(spark: SparkSession, path: str) -> tuple[str, int]:
    meta = spark.read.schema(_META).parquet(f"{path}/meta").first()
    return meta["key"], meta["buckets"]


def _folders(spark: SparkSession, path: str, before: int | None, buckets: list[int] | None) -> list[str]:
    """Where the rows of the given buckets are, as batches before ``before`` left them; one folder a bucket at most."""
    state = spark.read.schema(_STATE).parquet(f"{path}/state")
    if before is not None:
        state = state.filter(F.col("batch_id") < before)
    if buckets is not None:
        state = state.filter(F.col("bucket").isin(buckets))
    latest = state.groupBy("bucket").agg(F.max("batch_id").alias("batch_id")).collect()
    return [f"{path}/rows/batch_id={r['batch_id']}/bucket={r['bucket']}" for r in sorted(latest)]


def _rows(spark: SparkSession, path: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    schema = spark.read.parquet(f"{path}/schema").schema
    folders = _folders(spark, path, before, buckets)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_batch(batch: DataFrame, path: str, batch_id: int, order: list[str]) -> None:
    """Insert or replace whole rows by key; of several rows of a key in the batch the last by ``order`` counts.

    Columns of ``order`` need not be columns of the table. Batches are numbered upwards and done one after another; doing
    the last one again replaces it. Only the buckets of the batch's keys are read and written. A null key is a key.
    """
    spark = batch.sparkSession
    key, n = _meta(spark, path)
    columns = spark.read.parquet(f"{path}/schema").columns
    newest = last_per_key(batch, [key], order).select(*columns, _bucket(key, n).alias("_bucket"))
    newest = materialise(newest, "newest")
    buckets = [r[0] for r in newest.select("_bucket").distinct().collect()]
    old = _rows(spark, path, batch_id, buckets)
    kept = same_keys(old, newest.select(key), [key], "left_anti").withColumn("_bucket", _bucket(key, n))
    merged = kept.unionByName(newest).withColumnRenamed("_bucket", "bucket").hint("rebalance", "bucket")
    writer = merged.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket")
    writer.parquet(f"{path}/rows/batch_id={batch_id}")
    state = spark.createDataFrame([(b,) for b in buckets], "bucket int").coalesce(1)
    state.write.mode("overwrite").parquet(f"{path}/state/batch_id={batch_id}")


def read_current(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame:
    """The row of every key, as the last batch left it, or batch ``as_of``: a plain scan of one folder a bucket."""
    return _rows(spark, path, None if as_of is None else as_of + 1)
