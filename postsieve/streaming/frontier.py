"""The crawl frontier over a stream of listing pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from postsieve.operators.stop import MAX_DUPES, MAX_PAGES
from postsieve.plans.incremental import add_pages, init_frontier


def stream_frontier(
    listing: DataFrame,
    path: str,
    checkpoint: str,
    visited: DataFrame | None = None,
    max_dupes: int = MAX_DUPES,
    max_pages: int = MAX_PAGES,
) -> StreamingQuery:
    """Keep the frontier at ``path`` up to date with a stream of listing pages, and stop when all is read.

    Each micro-batch goes through :func:`plans.incremental.add_pages` under its own number, whatever the order in which
    pages arrive; read the result with :func:`plans.incremental.read_frontier`. A batch that failed part way leaves nothing
    that counts and is done again from the checkpoint, so a stream may be stopped and restarted at any point. One folder
    and one checkpoint belong together: a new checkpoint would number its batches from 0 again.
    """
    init_frontier(listing, path)

    def add(batch: DataFrame, batch_id: int) -> None:
        add_pages(batch, path, batch_id, visited, max_dupes, max_pages)

    writer = listing.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
