"""Run state and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.operators.keyed import last_per_key
from postsieve.sources.tables import with_run_defaults


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def merge_run_state(current: DataFrame, partial: DataFrame, at_ms: Column | None = None) -> DataFrame:
    """Run state with the columns of ``partial`` laid over it, by ``run_id``.

    A run in ``partial`` takes all columns given there, nulls included; a run not known
    before starts from the defaults. Changed runs are stamped with ``at_ms``.
    """
    current = with_run_defaults(current)
    given = [c for c in partial.columns if c != "run_id"]
    fresh = with_run_defaults(partial.select("run_id"))
    fresh = fresh.join(current.select("run_id"), "run_id", "left_anti")
    base = current.unionByName(fresh, allowMissingColumns=True)
    patch = partial.select("run_id", F.struct(*given).alias("_patch"))
    merged = base.join(patch, "run_id", "left")
    changed = F.col("_patch").isNotNull()
    values = {
        c: F.when(changed, F.col(f"_patch.{c}")).otherwise(F.col(c)) if c in base.columns else F.col(f"_patch.{c}")
        for c in given
    }
    values["last_updated"] = F.when(changed, now_ms() if at_ms is None else at_ms).otherwise(F.col("last_updated"))
    return merged.withColumns(values).drop("_patch")


def latest_run_state(log: DataFrame, order: list[str] = ["last_updated"]) -> DataFrame:
    """Current state of each run out of an append-only log of states."""
    return last_per_key(log, ["run_id"], order)


def reset_run_state(runs: DataFrame, at_ms: Column | None = None) -> DataFrame:
    """Default state for each run."""
    reset = with_run_defaults(runs.select("run_id").distinct())
    return reset.withColumn("last_updated", now_ms() if at_ms is None else at_ms)


def run_progress(postings: DataFrame, runs: DataFrame) -> DataFrame:
    """``collected`` of each run against its ``target``.

    ``runs`` has ``run_id, status, target`` and, for ``has_progress``, ``n_visited``.
    """
    counts = postings.groupBy("run_id").agg(F.count(F.lit(1)).alias("collected"))
    runs = runs.drop("collected").join(counts, "run_id", "left")
    runs = runs.withColumn("collected", F.coalesce("collected", F.lit(0)).cast("bigint"))
    share = F.round(100.0 * F.col("collected") / F.nullif(F.col("target"), F.lit(0)))
    return runs.select(
        "run_id",
        "collected",
        F.col("target").cast("bigint").alias("target"),
        F.when(share > 100, F.lit(100)).otherwise(share).cast("bigint").alias("pct"),
        F.concat_ws("/", F.col("collected"), F.col("target")).alias("progress"),
        ((F.col("status") == "done") | (F.col("collected") >= F.col("target"))).alias("is_done"),
        ((F.col("collected") > 0) | (F.col("n_visited") > 0)).alias("has_progress"),
    )
