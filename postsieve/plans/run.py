"""A whole run over captured tables: frontier, details, replies, curation, store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.plans.crawl import crawl_frontier
from postsieve.plans.curate import curate
from postsieve.session import materialise
from postsieve.sources.store import append_batch, init_store, read_keys


def run_captured(
    listing: DataFrame,
    details: DataFrame,
    replies: DataFrame,
    store: str,
    rejected: str,
    writer: str = "run",
    batch_id: int = 0,
    target: int = 50,
    visited: DataFrame | None = None,
) -> DataFrame:
    """Take runs from listing pages to stored postings and return their frontier.

    ``listing`` is as in :func:`crawl_frontier`, ``details`` (``url, platform``) names the detail pages captured, and
    ``replies`` (``url, reply``) what the scorer said of them. Links without a detail page are left out, details without
    a reply are rejects. What the store knows of a run counts; saving the same batch again replaces it.
    """
    spark = listing.sparkSession
    init_store(spark, store)
    frontier = materialise(crawl_frontier(listing, visited), "frontier")
    seen = frontier.select("run_id", "seq", "url").join(details.select("url", "platform"), "url")
    saved = read_keys(spark, store, seen.select("run_id"))
    earlier = saved.filter((F.col("writer") != writer) | (F.col("batch_id") < batch_id))
    postings, rejects = curate(seen, replies, earlier, target)
    append_batch(postings, store, batch_id, writer)
    rejects.write.mode("overwrite").parquet(f"{rejected.rstrip('/')}/writer={writer}/batch_id={batch_id}")
    return frontier
