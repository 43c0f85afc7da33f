"""From detail pages to stored postings."""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.operators.dedup import cut_at_target, dedup_title_company, drop_saved_keys
from postsieve.operators.replies import parse_reply_strict, rejects, to_posting
from postsieve.operators.attempts import FIRST_WAIT, MAX_ATTEMPTS, call_states, open_calls
from postsieve.operators.scoring import Scorer, build_prompt, score_batch, score_from_table, try_batch
from postsieve.operators.keyed import first_n_per_key, same_keys
from postsieve.operators.visits import drop_stopped
from postsieve.session import materialise
from postsieve.sources.ledger import append_attempts, init_ledger, read_attempts
from postsieve.sources.store import append_batch, init_store, read_keys


def select_new(postings: DataFrame, saved: DataFrame | None = None, target: int = 50) -> DataFrame:
    """What a run saves: first of each title and company, not saved before, up to the target.

    ``saved`` (``run_id, job_key``, one row per posting saved) counts towards the target.
    """
    first = dedup_title_company(postings)
    if saved is None:
        return cut_at_target(first, target)
    fresh = first_n_per_key(drop_saved_keys(first, saved), ["run_id"], ["seq"], target, "_rank")
    done = saved.groupBy("run_id").agg(F.count(F.lit(1)).alias("_done"))
    room = F.lit(target) - F.coalesce("_done", F.lit(0))
    return fresh.join(done, "run_id", "left").filter(F.col("_rank") <= room).drop("_rank", "_done")


def curate(
    details: DataFrame, replies: DataFrame, saved: DataFrame | None = None, target: int = 50
) -> tuple[DataFrame, DataFrame]:
    """Postings to save and rejects of details whose replies are captured.

    ``details`` has ``run_id, seq, url, platform``, ``replies`` has ``url, reply`` in the order of ``reply_seq`` if there
    is such a column; of several replies to one URL the last counts. Replies are joined and parsed once, and written.
    """
    judged = materialise(parse_reply_strict(score_from_table(details, replies)), "judged")
    return select_new(to_posting(judged, "run_id", "seq"), saved, target), rejects(judged)


def score_in_waves(
    details: DataFrame,
    scorer: Scorer,
    store: str,
    rejected: str,
    target: int = 50,
    wave: int = 100,
    calls: int | None = None,
    runs: Callable[[], DataFrame] | None = None,
) -> int:
    """Score details in crawl order until each run has its target; returns the number of waves.

    Spark cannot stop a scorer half way, so details go through it in waves of ``seq``
    ranges, each twice as wide as the one before: runs that have reached the target
    drop out, and no run pays for more than about twice the calls it needs. Only the
    wave number lives on the driver. ``details`` is a stored table with ``run_id, seq,
    url, platform, text`` whose ``seq`` numbers each run from 1, gaps allowed; a wave
    reads its own range of it, the first also what has no number or one below 1. Each
    wave is dealt out by URL to ``calls`` tasks (as many as the cluster has cores), so
    that the scorer works in parallel however the details are stored. Postings go to
    ``store``, replies without a posting to ``rejected``, one folder per wave and call;
    what others saved for a run counts. ``runs``, if given, is asked for run states
    (``run_id, status``) before every wave: no further call is made for a run that was
    stopped meanwhile, while what it has saved stays; runs without a state go on.
    After a failure, call again with the details not judged yet.
    """
    spark = details.sparkSession
    init_store(spark, store)
    writer, low, n = uuid.uuid4().hex, None, 0
    calls = calls or spark.sparkContext.defaultParallelism
    place = F.coalesce("seq", F.lit(0))
    while True:
        keys = read_keys(spark, store).filter((F.col("writer") != writer) | (F.col("batch_id") < n))
        full = keys.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= target)
        left = details if low is None else details.filter(F.col("seq") > low)
        todo = same_keys(left, full.select("run_id"), ["run_id"], "left_anti")
        if runs is not None:
            todo = materialise(drop_stopped(todo, runs()), "todo")
        if todo.isEmpty():
            return n
        high = (low or 0) + wave
        part = todo.filter(place <= high).repartition(calls, F.xxhash64("url"))
        # Written, so that the scorer runs once for postings and rejects alike.
        scored = materialise(score_batch(build_prompt(part).drop("text"), scorer), "scored")
        judged = parse_reply_strict(scored)
        append_batch(select_new(to_posting(judged, "run_id", "seq"), keys, target), store, n, writer)
        rejects(judged).write.mode("overwrite").parquet(f"{rejected.rstrip('/')}/writer={writer}/batch_id={n}")
        low, wave, n = high, wave * 2, n + 1


def score_with_retries(
    details: DataFrame,
    scorer: Scorer,
    ledger: str,
    max_attempts: int = MAX_ATTEMPTS,
    first_wait: float = FIRST_WAIT,
    calls: int | None = None,
    now: Callable[[], float] = time.time,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """Details with ``reply``, null where the scorer never answered, and ``attempts, gave_up, last_error``.

    Calls are made in rounds: all that are due go to the scorer at once, dealt out by URL to ``calls`` tasks, and every
    attempt is written to the ``ledger``. A failed call is due again after 1, 2 and 4 seconds and given up after
    ``max_attempts``, so a round more is made at most for each. Rows carry ``attempt``, the number of the call, for the
    scorer to see. Repeated URLs are called once. After a failure, or later on, call again: attempts in the ledger count,
    answered calls are not made anew, and a round that was not written is made again. Feed the result to
    :func:`replies.parse_reply_strict`; a call given up is a reject that stays replayable under a new ledger.
    """
    spark = details.sparkSession
    init_ledger(spark, ledger)
    calls = calls or spark.sparkContext.defaultParallelism
    wanted = materialise(build_prompt(first_n_per_key(details, ["url"], ["text"], 1, "_n").drop("_n")).drop("text"), "calls")
    limits = {"max_attempts": max_attempts, "first_wait": first_wait}
    round_ = (read_attempts(spark, ledger).agg(F.max("round")).first()[0] or 0) + 1
    while True:
        waiting = materialise(open_calls(wanted, call_states(read_attempts(spark, ledger), **limits)), "waiting")
        left, soonest = waiting.agg(F.count(F.lit(1)), F.min(F.coalesce(F.unix_micros("next_at"), F.lit(0)))).first()
        if not left:
            break
        if soonest / 1e6 > now():
            sleep(soonest / 1e6 - now())
        due = waiting.filter(F.coalesce(F.unix_micros("next_at"), F.lit(0)) <= int(max(now() * 1e6, soonest)))
        tried = materialise(try_batch(due.drop("next_at").repartition(calls, F.xxhash64("url")), scorer), "tried")
        # The wait runs from when the calls of a round have ended.
        at = F.lit(dt.datetime.fromtimestamp(now(), dt.timezone.utc)).cast("timestamp")
        append_attempts(tried.withColumn("at", at), ledger, round_)
        round_ += 1
    states = call_states(read_attempts(spark, ledger), **limits).select("url", "reply", "attempts", "gave_up", "last_error")
    return same_keys(details, states, ["url"])
