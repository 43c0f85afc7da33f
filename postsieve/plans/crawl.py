"""From listing pages to the ordered frontier of detail links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.operators.links import link_rows
from postsieve.operators.stop import KEYWORD, MAX_DUPES, MAX_PAGES, first_sights, keyword_stop, page_counts, stop_points
from postsieve.operators.keyed import first_n_per_key, same_keys
from postsieve.operators.visits import crawl_seq, drop_visited
from postsieve.session import materialise


def listing_counts(
    listing: DataFrame, visited: DataFrame | None = None, keyword: list[str] = KEYWORD, page: str = "page_no"
) -> tuple[DataFrame, DataFrame]:
    """Per-page counts and first sights, each keyword on its own.

    ``listing`` has one row per page with its distinct ``links``; it is read twice and
    should be a stored table. A link is new where its keyword shows it first, unless
    ``visited`` (``run_id, url``) has it.
    """
    pages = listing.select(*keyword, page, F.size("links").cast("bigint").alias("n_links"))
    firsts = first_sights(link_rows(listing, [*keyword, page]), keyword, page)
    if visited is not None:
        firsts = drop_visited(firsts, visited, [c for c in ("run_id", "url") if c in visited.columns])
    return page_counts(pages, firsts, keyword, page), firsts


def keyword_frontier(
    listing: DataFrame,
    visited: DataFrame | None = None,
    keyword: list[str] = KEYWORD,
    run: list[str] = ["run_id"],
    page: str = "page_no",
) -> DataFrame:
    """New links of the pages used, numbered in crawl order per run.

    Keywords are taken one by one: a link two keywords show is listed under both. See
    :func:`crawl_frontier` for the form that carries visits from keyword to keyword.
    """
    counts, firsts = listing_counts(listing, visited, keyword, page)
    kept = keyword_stop(counts, keyword, page).select(*keyword, page)
    links = same_keys(firsts, kept, [*keyword, page], "left_semi")
    return crawl_seq(links, [c for c in keyword if c not in run] + [page, "pos"], run)


def crawl_frontier(
    listing: DataFrame,
    visited: DataFrame | None = None,
    max_dupes: int = MAX_DUPES,
    max_pages: int = MAX_PAGES,
    max_rounds: int | None = None,
) -> DataFrame:
    """The frontier of whole runs, visits carried from keyword to keyword.

    ``listing`` has ``run_id, platform_pos, keyword_idx, page_no, links``. Every link
    used is visited before the next page is looked at, so a link is new only if no
    page used earlier in the run showed it, while links of a page that trips a limit
    stay unvisited. Where a keyword stops therefore depends on where the earlier ones
    stopped. The stops are found by iteration: guess, count, correct, count again,
    until nothing moves. Each round settles at least the next keyword of every run,
    most runs settle in a few rounds, and a round reads only runs that moved in the
    one before. The tables it reads are written once and hold a row per keyword and
    link.
    """
    keyword = ["run_id", "platform_pos", "keyword_idx"]
    used = first_n_per_key(listing, keyword, ["page_no"], max_pages, "ordinal")
    used = materialise(used.select(*keyword, "page_no", "ordinal", "links"), "listing")
    pages = used.select(*keyword, "page_no", "ordinal", F.size("links").cast("bigint").alias("n_links"))
    firsts = first_sights(link_rows(used, [*keyword, "ordinal"]), keyword, "ordinal")
    if visited is not None:
        firsts = drop_visited(firsts, visited)
    firsts = materialise(firsts.withColumn("_kw", F.struct("platform_pos", "keyword_idx")), "firsts")

    def fresh(seen: DataFrame, stops: DataFrame) -> DataFrame:
        """First sights that no earlier keyword has used up, given the stops."""
        taken = same_keys(seen, stops, keyword).filter(F.col("ordinal") < F.col("stop_at"))
        owner = taken.groupBy("run_id", "url").agg(F.min("_kw").alias("_owner"))
        joined = same_keys(seen, owner, ["run_id", "url"], "left")
        return joined.filter(F.col("_owner").isNull() | (F.col("_owner") >= F.col("_kw")))

    # The page that reaches the cap is never used; a keyword with fewer pages uses all.
    never = F.lit(max_pages).cast("bigint")
    stops = pages.select(*keyword).distinct().withColumn("stop_at", never)
    rounds, active, moving = 0, None, True
    while moving:
        if rounds == max_rounds:
            raise RuntimeError(f"stops still move after {rounds} rounds")
        some = (lambda df: df) if active is None else (lambda df: same_keys(df, active, ["run_id"], "left_semi"))
        counts = page_counts(some(pages).drop("page_no"), fresh(some(firsts), stops), keyword, "ordinal")
        marked = stop_points(counts, keyword, "ordinal", max_dupes, max_pages)
        first_stop = F.coalesce(F.min(F.when(F.col("stopped"), F.col("ordinal"))), never)
        found = marked.groupBy(*keyword).agg(first_stop.alias("_found"))
        moved = F.coalesce(F.col("_found") != F.col("stop_at"), F.lit(False))
        merged = same_keys(stops, found, keyword, "left").withColumn("moved", moved)
        merged = materialise(
            merged.select(*keyword, F.coalesce("_found", "stop_at").alias("stop_at"), "moved"), "stops"
        )
        stops, active = merged.drop("moved"), merged.filter("moved").select("run_id")
        rounds, moving = rounds + 1, not active.isEmpty()
    links = same_keys(fresh(firsts, stops), stops, keyword).filter(F.col("ordinal") < F.col("stop_at"))
    links = same_keys(links, pages.select(*keyword, "ordinal", "page_no"), [*keyword, "ordinal"])
    links = links.select(*keyword, "page_no", "pos", "url")
    return crawl_seq(links, ["platform_pos", "keyword_idx", "page_no", "pos"])
