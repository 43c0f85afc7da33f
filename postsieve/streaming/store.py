"""Postings saved as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postsieve.plans.curate import select_new
from postsieve.sources.store import append_batch, init_store, read_keys


def stream_upsert(postings: DataFrame, store: str, checkpoint: str, target: int = 50) -> StreamingQuery:
    """Save a stream of postings (``run_id, seq`` and the posting) and stop when all is read.

    Each micro-batch keeps the first of each title and company that its run has not saved yet, up to the target. What
    a run has saved is looked up by its keys alone: the log is not read. The stream's own id, kept with its checkpoint,
    names the writer, so a batch run again after a failure replaces its own folder and no other, and sees what other
    writers and its own earlier batches saved.
    """
    init_store(postings.sparkSession, store)

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        writer = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch.persist()  # read twice: its runs, its rows
        try:
            saved = read_keys(spark, store, batch.select("run_id"))
            earlier = saved.filter((F.col("writer") != writer) | (F.col("batch_id") < batch_id))
            append_batch(select_new(batch, earlier, target), store, batch_id, writer)
        finally:
            batch.unpersist()

    writer = postings.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
