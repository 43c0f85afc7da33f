"""First, last and numbered rows per key, safe for keys that hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.session import materialise

def _top(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. Every map task sends at most one row per key."""
    return _top(df, keys, [F.col(c) for c in order], 1, "_rank").drop("_rank")


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _top(df, keys, [F.col(c).desc() for c in order], 1, "_rank").drop("_rank")


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null being equal to null; the key columns appear once, as ``left`` has them."""
    renamed = right.select(*[F.col(c).alias(f"_right_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for key in keys:
        same = same & left[key].eqNullSafe(renamed[f"_right_{key}"])
    return left.join(renamed, same, how).drop(*[f"_right_{c}" for c in keys])


def ordered_chunks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Split the rows of each key into runs of consecutive rows, numbered by ``_chunk``.

    Rows are range partitioned by key and order, so a large key spans many chunks and
    no task holds it whole. The range bounds come from a sample: the result is
    written, since drawing it anew could move a row to another chunk.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("_chunk", F.spark_partition_id())
    return materialise(ranged, "chunks")


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Exact 1-based rank within each key, whatever the size of the key."""
    chunked = ordered_chunks(df, keys, order)
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # One row per key and chunk.
    offsets = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = offsets.select(*keys, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = chunked.withColumn("_local", F.row_number().over(local)).alias("r")
    same = F.col("r._chunk") == F.col("o._chunk")
    for key in keys:
        same = same & F.col(f"r.{key}").eqNullSafe(F.col(f"o.{key}"))
    return ranked.join(offsets.alias("o"), same).select(
        *[F.col(f"r.{c}") for c in df.columns],
        (F.col("_local") + F.col("_offset")).cast("bigint").alias(name),
    )


def first_n_per_key(df: DataFrame, keys: list[str], order: list[str], n: int, name: str) -> DataFrame:
    """The first ``n`` rows of each key with their rank. Every map task sends at most ``n`` rows per key."""
    return _top(df, keys, [F.col(c) for c in order], n, name).withColumn(name, F.col(name).cast("bigint"))
