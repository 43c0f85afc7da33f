"""What was visited, what is still pending, and which runs are active."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.operators.keyed import number_rows, same_keys
from postsieve.schemas import STOPPED


def drop_visited(links: DataFrame, visited: DataFrame, keys: list[str] = ["run_id", "url"]) -> DataFrame:
    """Links not visited yet."""
    return links.join(visited.select(*keys), keys, "left_anti")


def mark_visited(visited: DataFrame, urls: DataFrame, keys: list[str] = ["run_id", "url"]) -> DataFrame:
    """Visited set with ``urls`` added, whether or not their posting qualified."""
    return visited.select(*keys).union(urls.select(*keys)).distinct()


def crawl_seq(df: DataFrame, order: list[str], keys: list[str] = ["run_id"], name: str = "seq") -> DataFrame:
    """Number the rows of a run in crawl order, from 1."""
    return number_rows(df, keys, order, name)


def enqueue(pending: DataFrame, new: DataFrame, keys: list[str] = ["run_id"]) -> DataFrame:
    """Append ``new`` behind ``pending``; both carry ``seq``, whose places may start anywhere and leave gaps."""
    last = pending.groupBy(*keys).agg(F.max("seq").alias("_last"))
    first = new.groupBy(*keys).agg(F.min("seq").alias("_first"))
    moved = same_keys(same_keys(new, first, keys, "left"), last, keys, "left")
    # The first new link takes the place after the last pending one.
    place = F.coalesce(F.col("seq") + F.col("_last") + 1 - F.col("_first"), F.col("seq"))
    return pending.unionByName(moved.withColumn("seq", place).drop("_last", "_first"))


def pop_processed(pending: DataFrame, done: DataFrame, keys: list[str] = ["run_id", "url"]) -> DataFrame:
    """Pending links minus those processed; order is kept by ``seq``."""
    return drop_visited(pending, done, keys)


def is_active(status: Column) -> Column:
    return ~status.isin(*STOPPED)


def active_run_filter(
    events: DataFrame, runs: DataFrame, keys: list[str] = ["run_id", "active_tab_id"]
) -> DataFrame:
    """Events of runs still going and of the tab that drives them."""
    active = runs.filter(is_active(F.col("status"))).select(*keys)
    return events.join(active, keys, "left_semi")


def drop_stopped(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of runs that are not stopped; runs without a state, or whose status is null, count as going on."""
    stopped = runs.filter(~is_active(F.col("status"))).select("run_id")
    return rows.join(stopped, "run_id", "left_anti").select(*rows.columns)


def run_start(runs: DataFrame, visited: DataFrame, pending: DataFrame) -> DataFrame:
    """How each run starts: resumed where something was done and it is not finished.

    Adds ``resumed`` and the ``status`` a resumed run takes up.
    """
    seen = visited.groupBy("run_id").agg(F.count(F.lit(1)).alias("_visited"))
    todo = pending.groupBy("run_id").agg(F.count(F.lit(1)).alias("_pending"))
    joined = runs.join(seen, "run_id", "left").join(todo, "run_id", "left")
    n_seen, n_todo = F.coalesce("_visited", F.lit(0)), F.coalesce("_pending", F.lit(0))
    progress = (F.col("collected") > 0) | (n_seen > 0) | (n_todo > 0)
    finished = (F.col("status") == "done") | (F.col("collected") >= F.col("target"))
    status = F.when(n_todo > 0, F.lit("visiting_detail")).otherwise(F.lit("searching"))
    return joined.withColumns({"resumed": progress & ~finished, "status": status}).drop("_visited", "_pending")


def resume_pending(starts: DataFrame, pending: DataFrame, visited: DataFrame) -> DataFrame:
    """Links a resumed run goes on with: pending ones not visited meanwhile."""
    resumed = starts.filter("resumed").select("run_id")
    return drop_visited(pending.join(resumed, "run_id", "left_semi"), visited)
