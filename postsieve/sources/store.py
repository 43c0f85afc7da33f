"""The postings store: an append-only log of batches, merged when read.

``log/writer=<id>/batch_id=<n>/`` holds what batch ``n`` of a writer saved, ``keys/`` the titles and companies it
saved, by run. A writer is one stream or one call that saves; it numbers its own batches, and writing one replaces
that folder alone. A batch that is run again leaves no trace of its first attempt, and no writer touches what another
saved. The last write of a posting is the one saved last, as ``saved_at`` has it (the clock of the driver that wrote).
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsieve.operators.keyed import last_per_key
from postsieve.schemas import POSTING, POSTING_COLUMNS

LOG = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("job_key", T.StringType()),
        T.StructField("saved_at", T.LongType()),
        *POSTING.fields,
    ]
)
PLACE = [T.StructField("writer", T.StringType()), T.StructField("batch_id", T.LongType())]
LOG_WITH_BATCH = T.StructType([*LOG.fields, *PLACE])
KEYS = T.StructType(
    [T.StructField("run_id", T.StringType()), T.StructField("job_key", T.StringType()), *PLACE, T.StructField("bucket", T.IntegerType())]
)
# What decides which write of a posting is the last; total but for repeated rows.
WRITE_ORDER = ["saved_at", "batch_id", "seq", "run_id", "writer"]
# Folders the keys of a batch are dealt to by run, so that a reader opens those of its runs only.
BUCKETS = 256


def _log(path: str) -> str:
    return f"{path.rstrip('/')}/log"


def _keys(path: str) -> str:
    return f"{path.rstrip('/')}/keys"


def _bucket(run_id: Column) -> Column:
    return F.pmod(F.xxhash64(run_id), F.lit(BUCKETS)).cast("int")


def _empty(spark: SparkSession, path: str, mode: str) -> None:
    for folder, schema, parts in ((_log(path), LOG_WITH_BATCH, ["writer", "batch_id"]), (_keys(path), KEYS, ["writer", "batch_id", "bucket"])):
        writer = spark.createDataFrame([], schema).write.mode(mode).partitionBy(*parts)
        writer.option("partitionOverwriteMode", "static").parquet(folder)


def init_store(spark: SparkSession, path: str) -> None:
    """Create the store unless it exists."""
    _empty(spark, path, "ignore")


def clear_postings(spark: SparkSession, path: str) -> None:
    """Delete all postings; the store stays."""
    _empty(spark, path, "overwrite")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_WITH_BATCH).parquet(_log(path))


def read_keys(spark: SparkSession, path: str, runs: DataFrame | None = None) -> DataFrame:
    """``run_id, job_key`` and the batch of every posting saved; of the given runs only, if any are given.

    The runs' buckets, at most ``BUCKETS`` numbers, are looked up first, so that no other folder is read.
    """
    keys = spark.read.schema(KEYS).parquet(_keys(path))
    if runs is None:
        return keys
    buckets = [r[0] for r in runs.select(_bucket(F.col("run_id"))).distinct().collect()]
    return keys.filter(F.col("bucket").isin(buckets)).join(runs.select("run_id").distinct(), "run_id", "left_semi")


def append_batch(postings: DataFrame, path: str, batch_id: int, writer: str = "main") -> None:
    """Save a batch of a writer; repeating it changes nothing but the time it was saved."""
    spark = postings.sparkSession
    place = f"writer={writer}/batch_id={batch_id}"
    target = f"{_log(path)}/{place}"
    stamped = postings.withColumn("saved_at", F.lit(time.time_ns() // 1000))
    stamped.select(*[F.col(f.name).cast(f.dataType.simpleString()) for f in LOG]).write.mode("overwrite").parquet(target)
    keys = spark.read.schema(LOG).parquet(target).select("run_id", "job_key", _bucket(F.col("run_id")).alias("bucket"))
    writer_ = keys.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer_.partitionBy("bucket").parquet(f"{_keys(path)}/{place}")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Current postings: the last write of each ``job_url``."""
    return last_per_key(read_log(spark, path), ["job_url"], WRITE_ORDER).select(*POSTING_COLUMNS)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """All postings, by ``job_url``."""
    return read_store(spark, path).orderBy("job_url")


def compact_store(spark: SparkSession, path: str, new_path: str) -> None:
    """Copy the store without overwritten rows; what each run saved stays known, also of rows left out."""
    kept = last_per_key(read_log(spark, path), ["run_id", "job_url"], WRITE_ORDER)
    kept.hint("rebalance", "writer", "batch_id").write.partitionBy("writer", "batch_id").parquet(_log(new_path))
    keys = read_keys(spark, path).hint("rebalance", "writer", "batch_id", "bucket")
    keys.write.partitionBy("writer", "batch_id", "bucket").parquet(_keys(new_path))


def upsert_postings(
    target: DataFrame, batch: DataFrame, key: str = "job_url", order: tuple[str, ...] = ("seq", "run_id")
) -> DataFrame:
    """``target`` with the rows of ``batch`` inserted or replaced whole; the last write wins.

    Within each side the last row of a key counts, and ``batch`` goes before ``target``.
    """
    both = target.withColumn("_side", F.lit(0)).unionByName(batch.withColumn("_side", F.lit(1)))
    return last_per_key(both, [key], ["_side", *order]).drop("_side")


def count_postings(postings: DataFrame) -> DataFrame:
    return postings.agg(F.count(F.lit(1)).alias("n_postings"))
