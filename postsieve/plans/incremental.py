"""The frontier kept up to date as listing pages arrive in batches.

Keywords of a run are taken in order, and all that one hands to the next is what has been visited. Pages that arrive
therefore change nothing before the first keyword they belong to: a batch keeps the frontier of its runs up to there, and
crawls only from there on, with the kept links as visited. Runs without new pages are not read at all.

Below the folder, ``pages`` holds the pages that may be used (never more than the page cap per keyword), ``frontier`` the
links, and ``runs`` the runs that a batch has renewed, each by batch and dealt to buckets by run. What the latest batch of a
run has written is its state; a batch counts once its ``runs`` are there, so one that failed is done again without a trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsieve.operators.keyed import first_n_per_key, same_keys
from postsieve.operators.stop import MAX_DUPES, MAX_PAGES
from postsieve.operators.visits import crawl_seq
from postsieve.plans import crawl
from postsieve.session import materialise

KEYWORD = ["run_id", "platform_pos", "keyword_idx"]
ORDER = ["platform_pos", "keyword_idx", "page_no", "pos"]
# Folders that the state is dealt to by run; so many numbers at most reach the driver.
BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _schemas(pages: T.StructType) -> dict[str, T.StructType]:
    places = [T.StructField("pos", T.IntegerType()), T.StructField("url", T.StringType()), T.StructField("seq", T.LongType())]
    tables = {"pages": [*pages], "frontier": [*[f for f in pages if f.name != "links"], *places], "runs": [pages["run_id"]]}
    parts = [T.StructField("batch_id", T.LongType()), T.StructField("bucket", T.IntegerType())]
    return {name: T.StructType([*fields, *parts]) for name, fields in tables.items()}


def init_frontier(listing: DataFrame, path: str) -> None:
    """Create the folder for listings of these types (``run_id, platform_pos, keyword_idx, page_no, links``), unless it exists."""
    # By types alone, as the listing may be a stream.
    pages = listing.sparkSession.createDataFrame([], listing.select(*KEYWORD, "page_no", "links").schema)
    pages.write.mode("ignore").parquet(f"{path}/schema")
    for name, schema in _schemas(pages.schema).items():
        empty = listing.sparkSession.createDataFrame([], schema)
        empty.write.mode("ignore").partitionBy("batch_id", "bucket").parquet(f"{path}/{name}")


def _read(spark: SparkSession, path: str, name: str, before: int | None, buckets: list[int] | None) -> DataFrame:
    """All that batches before ``before`` wrote, of the given buckets only, with ``batch_id``."""
    schema = _schemas(spark.read.parquet(f"{path}/schema").schema)[name]
    rows = spark.read.schema(schema).parquet(f"{path}/{name}")
    if before is not None:
        rows = rows.filter(F.col("batch_id") < before)
    return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))


def _state(spark: SparkSession, path: str, name: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The rows of each run that its latest batch has written."""
    latest = _read(spark, path, "runs", before, buckets).groupBy("run_id").agg(F.max("batch_id").alias("batch_id"))
    return same_keys(_read(spark, path, name, before, buckets), latest, ["run_id", "batch_id"], "left_semi").drop("batch_id", "bucket")


def _write(rows: DataFrame, path: str, name: str, batch_id: int) -> None:
    dealt = rows.withColumn("bucket", _bucket()).hint("rebalance", "bucket")
    writer = dealt.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket")
    writer.parquet(f"{path}/{name}/batch_id={batch_id}")


def add_pages(
    batch: DataFrame,
    path: str,
    batch_id: int,
    visited: DataFrame | None = None,
    max_dupes: int = MAX_DUPES,
    max_pages: int = MAX_PAGES,
) -> None:
    """Bring the frontier of the runs of some listing pages up to date.

    The frontier of a run is then that of :func:`crawl.crawl_frontier` over all its pages so far. A page that comes again
    replaces the one before; of one that comes twice in a batch, one counts. ``visited`` (``run_id, url``) is what the runs
    had visited to begin with, the same for all batches; limits too must stay the same. Batches are numbered upwards and
    added one after another; adding one again replaces it. Null runs and keywords are runs and keywords; a null array of
    links counts as no links.
    """
    spark = batch.sparkSession
    links = F.coalesce("links", F.array().cast("array<string>"))
    batch = batch.select(*KEYWORD, "page_no", links.alias("links")).dropDuplicates([*KEYWORD, "page_no"])
    batch = materialise(batch, "batch")
    since = batch.groupBy("run_id").agg(F.min(F.struct("platform_pos", "keyword_idx")).alias("since"))
    since = materialise(since, "since")
    buckets = [r[0] for r in since.select(_bucket()).distinct().collect()]

    known = same_keys(_state(spark, path, "pages", batch_id, buckets), since.select("run_id"), ["run_id"], "left_semi")
    kept = same_keys(known, batch.select(*KEYWORD, "page_no"), [*KEYWORD, "page_no"], "left_anti")
    pages = first_n_per_key(kept.unionByName(batch), KEYWORD, ["page_no"], max_pages, "_rank").drop("_rank")
    pages = materialise(pages, "pages")

    place = F.struct("platform_pos", "keyword_idx")
    old = same_keys(_state(spark, path, "frontier", batch_id, buckets), since, ["run_id"])
    settled = materialise(old.filter(place < F.col("since")).drop("since", "seq"), "settled")
    rest = same_keys(pages, since, ["run_id"]).filter(place >= F.col("since")).drop("since")
    before = settled.select("run_id", "url")
    if visited is not None:
        before = before.unionByName(same_keys(visited.select("run_id", "url"), since.select("run_id"), ["run_id"], "left_semi"))
    found = crawl.crawl_frontier(rest, materialise(before, "before"), max_dupes, max_pages)
    found = settled.unionByName(found.select(*settled.columns))

    _write(pages, path, "pages", batch_id)
    _write(crawl_seq(found, ORDER), path, "frontier", batch_id)
    _write(since.select("run_id"), path, "runs", batch_id)


def read_frontier(spark: SparkSession, path: str) -> DataFrame:
    """``(run_id, platform_pos, keyword_idx, page_no, pos, url, seq)``: the frontier of all runs as of the last batch."""
    return _state(spark, path, "frontier")
