"""Attempts at scorer calls: what was answered, what is due again and when, what is given up."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.operators.keyed import first_n_per_key, same_keys

# A call is made at most four times, with waits of 1, 2 and 4 seconds between.
MAX_ATTEMPTS = 4
FIRST_WAIT = 1.0


def call_states(
    attempts: DataFrame,
    keys: list[str] = ["url"],
    order: list[str] = ["at"],
    as_of: dt.datetime | Column | None = None,
    max_attempts: int = MAX_ATTEMPTS,
    first_wait: float = FIRST_WAIT,
) -> DataFrame:
    """How each call stands: ``keys, attempts, answered, gave_up, reply, last_error, last_at, next_at``.

    ``attempts`` has a row per attempt with ``keys``, the time ``at``, and ``reply`` or else ``error``; a null reply is a
    failure. They count in ``order``, up to the first that was answered and ``max_attempts`` at most; what a log holds
    beyond is ignored, as are attempts after ``as_of`` and those without a time. ``next_at`` is when an open call is due:
    ``first_wait`` seconds after its first failure, and twice the wait after each further one. A key may have any number
    of attempts: every task sends on the first few.
    """
    known = attempts.filter(F.col("at").isNotNull())
    if as_of is not None:
        known = known.filter(F.col("at") <= (as_of if isinstance(as_of, Column) else F.lit(as_of)))
    first = first_n_per_key(known, keys, order, max_attempts, "_n")
    rows = first.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("_n", "at", "reply", "error"))).alias("_rows"),
        F.min(F.when(F.col("reply").isNotNull(), F.col("_n"))).alias("_answer"),
    )
    n = F.coalesce("_answer", F.size("_rows")).cast("int")
    last = rows.withColumns({"attempts": n, "_last": F.element_at("_rows", n), "answered": F.col("_answer").isNotNull()})
    gave_up = ~F.col("answered") & (F.col("attempts") >= max_attempts)
    wait = (F.pow(F.lit(2.0), F.col("attempts") - 1) * int(first_wait * 1_000_000)).cast("bigint")
    due = F.timestamp_micros(F.unix_micros(F.col("_last.at").cast("timestamp")) + wait).cast(attempts.schema["at"].dataType)
    return last.select(
        *keys,
        "attempts",
        "answered",
        gave_up.alias("gave_up"),
        F.col("_last.reply").alias("reply"),
        F.when(~F.col("answered"), F.col("_last.error")).alias("last_error"),
        F.col("_last.at").alias("last_at"),
        F.when(~F.col("answered") & ~gave_up, due).alias("next_at"),
    )


def open_calls(calls: DataFrame, states: DataFrame, keys: list[str] = ["url"]) -> DataFrame:
    """Calls neither answered nor given up, with the number of their next ``attempt`` and ``next_at``, null if never made."""
    known = states.select(*keys, "attempts", "next_at", (F.col("answered") | F.col("gave_up")).alias("_closed"))
    joined = same_keys(calls, known, keys, "left").filter(~F.coalesce("_closed", F.lit(False)))
    return joined.withColumn("attempt", F.coalesce("attempts", F.lit(0)) + 1).drop("attempts", "_closed")


def due_calls(calls: DataFrame, attempts: DataFrame, now: dt.datetime, keys: list[str] = ["url"], **limits) -> DataFrame:
    """Calls to make at ``now``, as the attempts up to then have it: new ones, and failed ones whose wait is over.

    Adds ``attempt``, the number of the next attempt. ``limits`` are those of :func:`call_states`.
    """
    found = open_calls(calls, call_states(attempts, keys, as_of=now, **limits), keys)
    return found.filter(F.col("next_at").isNull() | (F.col("next_at") <= F.lit(now))).drop("next_at")
