"""Attempts at scorer calls against a simulation, and scorers that fail."""

import datetime as dt
import random

import pandas as pd
import pytest

from postsieve.operators import attempts, replies
from postsieve.plans import curate
from postsieve.session import new_dir
from postsieve.sources import ledger

START = dt.datetime(2024, 1, 1)
SCHEMA = "url string, at timestamp, reply string, error string"


def simulate(rows, as_of=None):
    """Attempts one by one: answered, given up, or due again after 1, 2 and 4 seconds."""
    out = {}
    for url, at, reply, error in sorted(rows, key=lambda r: (r[1] is None, r[1] or START)):
        n, answered, *_ = state = out.get(url, (0, False, None, None, None))
        if at is None or (as_of and at > as_of) or answered or n == 4:
            if state[0]:
                out[url] = state
            continue
        due = None if reply is not None or n == 3 else at + dt.timedelta(seconds=2**n)
        out[url] = (n + 1, reply is not None, reply, error if reply is None else None, due)
    return out


@pytest.fixture(scope="module")
def log():
    rng = random.Random(4)
    rows = []
    for url in [*(f"u{k}" for k in range(60)), None]:
        for second in rng.sample(range(100), rng.randrange(0, 9)):
            good = rng.random() < 0.2
            rows.append((url, START + dt.timedelta(seconds=second), f"r{second}" if good else None, None if good else f"e{second}"))
    # One call with most of the attempts.
    rows += [("hot", START + dt.timedelta(milliseconds=k), None, f"e{k}") for k in range(3000)] + [("none", None, "r", None)]
    return rows


@pytest.mark.parametrize("after", [None, 0, 30, 60])
def test_states_as_of_a_time(spark, log, after):
    as_of = None if after is None else START + dt.timedelta(seconds=after)
    found = attempts.call_states(spark.createDataFrame(log, SCHEMA), as_of=as_of).collect()
    got = {r.url: (r.attempts, r.answered, r.reply, r.last_error, r.next_at) for r in found}
    want = simulate(log, as_of)
    assert got == want
    assert all(r.gave_up == (r.attempts == 4 and not r.answered) for r in found)
    assert want["hot"][0] == (4 if after != 0 else 1)


def test_due_calls(spark, log):
    now = START + dt.timedelta(seconds=40)
    urls = [None, "hot", "never", *(f"u{k}" for k in range(60))]
    found = attempts.due_calls(spark.createDataFrame([(u, 1) for u in urls], "url string, x int"), spark.createDataFrame(log, SCHEMA), now)
    states = simulate(log, now)
    want = {}
    for u in urls:
        n, answered, _, _, due = states.get(u, (0, False, None, None, now))
        if not answered and n < 4 and due <= now:
            want[u] = n + 1
    assert {r.url: r.attempt for r in found.collect()} == want
    assert want["never"] == 1 and "hot" not in want


def scorer():
    """Answers from the call on that the URL names; some raise, some return nothing. Travels to the workers by value."""

    def flaky(frame: pd.DataFrame) -> pd.Series:
        needed = frame["url"].str.extract(r"(\d+)$")[0].astype(int)
        if (frame["url"].str.startswith("raise") & (frame["attempt"] < needed)).any():
            raise TimeoutError("busy")
        return pd.Series([f"answer {a}" if a >= n else OSError("down") if n % 2 else None for a, n in zip(frame["attempt"], needed)])

    return flaky


class Clock:
    def __init__(self):
        self.time, self.slept = START.replace(tzinfo=dt.timezone.utc).timestamp(), []

    def now(self):
        return self.time

    def sleep(self, seconds):
        self.slept.append(round(seconds, 3))
        self.time += seconds


def details_of(spark, urls):
    return spark.createDataFrame([("r", k, u, "Indeed", "text") for k, u in enumerate(urls, 1)], "run_id string, seq int, url string, platform string, text string")


def test_a_failing_scorer_is_called_again_until_it_answers_or_is_given_up(spark):
    path, clock = new_dir(spark, "ledger"), Clock()
    urls = ["a1", "a2", "a3", "a4", "a5", "a6", "a2"]
    found = curate.score_with_retries(details_of(spark, urls), scorer(), path, now=clock.now, sleep=clock.sleep)
    got = {r.url: (r.reply, r.attempts, r.gave_up, r.last_error) for r in found.collect()}
    assert found.count() == len(urls)
    for n in range(1, 5):
        assert got[f"a{n}"] == (f"answer {n}", n, False, None)
    assert got["a5"] == (None, 4, True, "OSError: down") and got["a6"] == (None, 4, True, "no reply")
    assert clock.slept == [1, 2, 4]
    log = ledger.read_attempts(spark, path)
    assert log.count() == 1 + 2 + 3 + 4 + 4 + 4
    assert {r["count"] for r in log.filter("url = 'a2'").groupBy("round").count().collect()} == {1}
    judged = replies.parse_reply_strict(found)
    assert {r.url for r in replies.replayable(replies.rejects(judged)).collect()} == {"a5", "a6"}


def test_a_scorer_that_raises_fails_for_its_batch(spark):
    path, clock = new_dir(spark, "ledger"), Clock()
    found = curate.score_with_retries(details_of(spark, ["a1", "raise3"]), scorer(), path, calls=1, now=clock.now, sleep=clock.sleep)
    assert {(r.url, r.reply, r.attempts) for r in found.collect()} == {("a1", "answer 3", 3), ("raise3", "answer 3", 3)}
    errors = ledger.read_attempts(spark, path).filter("reply is null").select("error").distinct().collect()
    assert [r.error for r in errors] == ["TimeoutError: busy"]


def test_a_ledger_is_taken_up_again(spark):
    path, clock = new_dir(spark, "ledger"), Clock()
    ledger.init_ledger(spark, path)
    at = START + dt.timedelta(seconds=-1.5)
    rows = [("a2", at, None, "down"), ("a1", at, "old answer", None), *[("a9", at, None, "down")] * 4]
    ledger.append_attempts(spark.createDataFrame(rows, SCHEMA), path, 7)
    found = curate.score_with_retries(details_of(spark, ["a1", "a2", "a9"]), scorer(), path, calls=8, now=clock.now, sleep=clock.sleep)
    got = {r.url: (r.reply, r.attempts, r.gave_up) for r in found.collect()}
    assert got == {"a1": ("old answer", 1, False), "a2": ("answer 2", 2, False), "a9": (None, 4, True)}
    assert clock.slept == [] and {r["round"] for r in ledger.read_attempts(spark, path).select("round").distinct().collect()} == {7, 8}
    again = curate.score_with_retries(details_of(spark, ["a1", "a2", "a9"]), scorer(), path, now=clock.now, sleep=clock.sleep)
    assert {r.url: r.reply for r in again.collect()} == {u: r[0] for u, r in got.items()}
    assert ledger.read_attempts(spark, path).agg({"round": "max"}).first()[0] == 8


def test_no_details(spark):
    assert curate.score_with_retries(details_of(spark, ["a1"]).limit(0), scorer(), new_dir(spark, "ledger")).collect() == []
