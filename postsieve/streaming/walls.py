"""Login walls over a stream of visits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from postsieve.operators.platforms import AUTH_WALL_PATTERNS, before_walls, first_walls

KEYS = ["run_id", "platform_idx"]


def _folder(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def _init(spark: SparkSession, path: str, visits: T.StructType, keys: list[str], order: str) -> tuple[T.StructType, T.StructType]:
    """Schemas of the visits and the walls, whose empty tables are made unless they exist."""
    batch = T.StructField("batch_id", T.LongType())
    walls = T.StructType([*[visits[k] for k in keys], T.StructField("_wall", visits[order].dataType), batch])
    both = T.StructType([*visits.fields, batch]), walls
    for name, schema in zip(("visits", "walls"), both, strict=True):
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("batch_id").parquet(_folder(path, name))
    return both


def stream_skip_walled(
    visits: DataFrame,
    path: str,
    checkpoint: str,
    keys: list[str] = KEYS,
    order: str = "seq",
    url: str = "url",
    patterns: list[str] = AUTH_WALL_PATTERNS,
) -> StreamingQuery:
    """Keep the visits before the first walled page of their platform, and stop when all is read.

    ``path`` holds the ``visits`` kept and the ``walls``: one row for a platform of a run when a wall is found, and one more
    if an earlier one turns up later. Every micro-batch is compared with the walls known by then, its own included, so what
    comes after a wall is dropped in whatever batch it arrives. Each batch writes its own folders, and run again after a
    failure it replaces them. A visit that arrives before its platform's wall is kept; :func:`read_visits` leaves it out
    once the wall is known. Visits without a key have no platform and are all kept, as in
    :func:`operators.platforms.skip_walled_platform`, and so are those without a place.
    """
    spark = visits.sparkSession
    _, wall_schema = _init(spark, path, visits.schema, keys, order)
    walls_at, visits_at = _folder(path, "walls"), _folder(path, "visits")

    def save(batch: DataFrame, batch_id: int) -> None:
        stored = batch.sparkSession.read.schema(wall_schema).parquet(walls_at)
        earlier = _lowest(stored.filter(F.col("batch_id") < batch_id), keys)
        batch.persist()  # read twice: its walls, its visits
        try:
            # No platform is written twice but for a wall before the one known.
            found = before_walls(first_walls(batch, keys, order, url, patterns), earlier, keys, "_wall")
            found.hint("rebalance").write.mode("overwrite").parquet(f"{walls_at}/batch_id={batch_id}")
            now = batch.sparkSession.read.schema(wall_schema).parquet(walls_at).filter(F.col("batch_id") <= batch_id)
            before_walls(batch, _lowest(now, keys), keys, order).write.mode("overwrite").parquet(f"{visits_at}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    writer = visits.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def _lowest(walls: DataFrame, keys: list[str]) -> DataFrame:
    return walls.groupBy(*keys).agg(F.min("_wall").alias("_wall"))


def read_visits(
    spark: SparkSession, path: str, visits: T.StructType, keys: list[str] = KEYS, order: str = "seq"
) -> DataFrame:
    """Visits kept by the stream, without those that a wall found in a later batch cuts off.

    ``visits`` is the schema of the stream. Whatever the order of arrival, the rows are those of the batch rule.
    """
    kept_schema, wall_schema = _init(spark, path, visits, keys, order)
    kept = spark.read.schema(kept_schema).parquet(_folder(path, "visits")).drop("batch_id")
    walls = spark.read.schema(wall_schema).parquet(_folder(path, "walls"))
    return before_walls(kept, _lowest(walls, keys), keys, order)
