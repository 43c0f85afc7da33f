"""Pages and links as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from postsieve.operators.capture import capture
from postsieve.streaming.thin import thin


def stream_capture(pages: DataFrame) -> DataFrame:
    """Links or text of every new page; stateless, so any number of tasks share the work."""
    return capture(pages)


def stream_dedup(links: DataFrame, keys: list[str] = ["run_id", "url"], ttl: tuple[str, str] | None = None) -> DataFrame:
    """Each URL once per run.

    State grows with the number of distinct URLs and is kept in RocksDB on the
    executors. ``ttl``, a time column and a delay, lets a URL return after the delay
    and bounds the state. A URL that most pages show is thinned out before the shuffle.
    """
    thinned = thin(links, keys, 1)
    if ttl is None:
        return thinned.dropDuplicates(keys)
    return thinned.withWatermark(*ttl).dropDuplicatesWithinWatermark(keys)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is available now to a Parquet table, exactly once; then stop."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(availableNow=True).start(path)
