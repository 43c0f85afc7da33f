"""When a keyword stops: too many seen links in a row, or the page cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.operators.keyed import first_n_per_key, ordered_chunks, same_keys

# Limits of a keyword.
MAX_DUPES = 5
MAX_PAGES = 10

KEYWORD = ["run_id", "platform_idx", "keyword_idx"]


def first_sights(links: DataFrame, keyword: list[str], page: str = "page_no", pos: str = "pos") -> DataFrame:
    """Where each URL is first seen within its keyword, as ``page`` and ``pos``.

    Two minima per keyword and URL, hashed and combined before the shuffle.
    """
    at = [F.min(page).alias(page), F.min_by(pos, page).alias(pos)]
    return links.groupBy(*keyword, "url").agg(*at)


def page_counts(
    pages: DataFrame, firsts: DataFrame, keyword: list[str] = KEYWORD, page: str = "page_no"
) -> DataFrame:
    """Links, new links and seen links of every listing page.

    ``pages`` has one row per page with ``n_links`` (distinct links on it), and
    ``firsts`` the links not visited before with the page that shows them first.
    Pages without links are kept.
    """
    new = firsts.groupBy(*keyword, page).agg(F.count(F.lit(1)).alias("n_new"))
    counted = same_keys(pages, new, [*keyword, page], "left").withColumn("n_new", F.coalesce("n_new", F.lit(0)))
    return counted.withColumn("n_dup", F.col("n_links") - F.col("n_new"))


def _increment() -> Column:
    """What a page adds to the counter of its keyword; nothing where it has new links."""
    return F.when(F.col("n_new") > 0, F.lit(0)).otherwise(F.greatest("n_dup", F.lit(1))).cast("bigint")


def _counter(pages: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """``_run``: increments since the last page with new links; ``_resets``: such pages so far."""
    so_far = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    stretch = (
        Window.partitionBy(*partition, "_resets").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    pages = pages.withColumn("_resets", F.sum(F.when(F.col("n_new") > 0, 1).otherwise(0)).over(so_far))
    return pages.withColumn("_run", F.sum(_increment()).over(stretch))


def consecutive_dupes(pages: DataFrame, keyword: list[str] = KEYWORD, page: str = "page_no") -> DataFrame:
    """Running count ``consec`` of seen links since the last page with new ones.

    A page with new links sets the counter to 0; any other adds its seen links, an
    empty page 1. Counted within chunks of consecutive pages, then carried from chunk
    to chunk, so that one keyword may hold any number of pages.
    """
    columns = pages.columns
    counted = _counter(ordered_chunks(pages, keyword, [page]), [*keyword, "_chunk"], [page])
    # One row per keyword and chunk: its resets, and the count at its end.
    ends = counted.groupBy(*keyword, "_chunk").agg(
        F.max("_resets").alias("_n"), F.max_by("_run", page).alias("_tail")
    )
    earlier = Window.partitionBy(*keyword).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_island", F.sum(F.when(F.col("_n") > 0, 1).otherwise(0)).over(earlier))
    island = Window.partitionBy(*keyword, "_island").orderBy("_chunk")
    carried = F.sum("_tail").over(island.rowsBetween(Window.unboundedPreceding, 0))
    before = Window.partitionBy(*keyword).orderBy("_chunk")
    ends = ends.withColumn("_end", carried).withColumn("_carry", F.coalesce(F.lag("_end").over(before), F.lit(0)))
    joined = same_keys(counted, ends.select(*keyword, "_chunk", "_carry"), [*keyword, "_chunk"])
    carry = F.when(F.col("_resets") == 0, F.col("_carry")).otherwise(F.lit(0))
    return joined.withColumn("consec", (F.col("_run") + carry).cast("bigint")).select(*columns, "consec")


def stop_points(
    pages: DataFrame,
    keyword: list[str] = KEYWORD,
    page: str = "page_no",
    max_dupes: int = MAX_DUPES,
    max_pages: int = MAX_PAGES,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Pages up to the cap with ``ordinal``, ``consec`` and ``stopped``.

    The cap ends a keyword whatever its pages hold, so pages past it are cut in every
    map task and the windows below see at most ``max_pages`` rows per keyword. A keyword
    that a resumed run goes on with starts from its saved counters: ``carried`` has
    ``consec`` and ``pages`` of such keywords, one row each.
    """
    capped = first_n_per_key(pages, keyword, [page], max_pages, "ordinal")
    start = F.lit(0)
    if carried is not None:
        saved = carried.select(*keyword, F.col("consec").alias("_consec"), F.col("pages").alias("_pages"))
        capped = same_keys(capped, saved, keyword, "left")
        capped = capped.withColumn("ordinal", (F.col("ordinal") + F.coalesce("_pages", F.lit(0))).cast("bigint"))
        start = F.coalesce("_consec", F.lit(0))
    counted = _counter(capped, keyword, [page])
    before = F.when(F.col("_resets") == 0, start).otherwise(F.lit(0))
    counted = counted.withColumn("consec", (F.col("_run") + before).cast("bigint")).drop("_consec", "_pages")
    so_far = Window.partitionBy(*keyword).orderBy(page).rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col("consec") >= max_dupes) | (F.col("ordinal") >= max_pages)
    return counted.withColumn("stopped", F.max(hit).over(so_far)).drop("_run", "_resets")


def keyword_stop(
    pages: DataFrame,
    keyword: list[str] = KEYWORD,
    page: str = "page_no",
    max_dupes: int = MAX_DUPES,
    max_pages: int = MAX_PAGES,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Pages whose links are used: those before the page that trips a limit."""
    return stop_points(pages, keyword, page, max_dupes, max_pages, carried).filter(~F.col("stopped")).drop("stopped")
