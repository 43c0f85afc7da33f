"""Upserts into buckets against a dictionary, and what a batch reads and writes."""

import os
import random

from pyspark.sql import functions as F

from postsieve.session import new_dir
from postsieve.sources import current, store

SCHEMA = "job_url string, title string, seq int, run_id string"


def batch_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(spark, buckets=8):
    path = new_dir(spark, "current")
    current.init_current(batch_of(spark, []).select("job_url", "title"), path, buckets=buckets)
    return path


def rows_of(df):
    found = [(r.job_url, r.title) for r in df.collect()]
    assert len(found) == len(dict(found))
    return dict(found)


def test_batches_against_a_dictionary(spark):
    rng, path, want = random.Random(1), table(spark), [{}]
    for batch_id in range(4):
        keys = [None, *(f"u{k}" for k in range(60))]
        rows = [(rng.choice(keys), rng.choice(["a", "b", None]) and f"{batch_id}-{k}", k, "r") for k in range(40)]
        current.upsert_batch(batch_of(spark, rows), path, batch_id, ["seq", "run_id"])
        want.append(want[-1] | {url: title for url, title, *_ in sorted(rows, key=lambda r: r[2])})
        assert rows_of(current.read_current(spark, path)) == want[-1]
    # Earlier states stay readable, and the last batch may be done again with other rows.
    assert [rows_of(current.read_current(spark, path, n)) for n in range(4)] == want[1:]
    current.upsert_batch(batch_of(spark, [("u1", "again", 1, "r")]), path, 3, ["seq"])
    assert rows_of(current.read_current(spark, path)) == want[3] | {"u1": "again"}


def test_only_the_buckets_of_a_batch_are_read_and_written(spark, monkeypatch):
    path, read = table(spark, 16), []
    current.upsert_batch(batch_of(spark, [(f"u{k}", "old", k, "r") for k in range(2000)]), path, 0, ["seq"])
    rows = current._rows

    def watched(*args):
        found = rows(*args)
        read.append(found.inputFiles())
        return found

    monkeypatch.setattr(current, "_rows", watched)
    current.upsert_batch(batch_of(spark, [("u7", "new", 1, "r")]), path, 1, ["seq"])
    one = len(read[0])
    # Another 2,000 keys in the other buckets: the same batch reads as much as before.
    bucket = batch_of(spark, [("u7", "", 0, "")]).select(current._bucket("job_url", 16)).first()[0]
    more = batch_of(spark, [(f"v{k}", "old", k, "r") for k in range(2000)]).filter(current._bucket("job_url", 16) != bucket)
    current.upsert_batch(more, path, 2, ["seq"])
    current.upsert_batch(batch_of(spark, [("u7", "newer", 1, "r")]), path, 3, ["seq"])
    assert len(read[-1]) == one == 1
    size = lambda files: sum(os.path.getsize(f.removeprefix("file://")) for f in files)
    assert abs(size(read[-1]) - size(read[0])) < 100
    assert {b for b in os.listdir(f"{path}/rows/batch_id=3") if "=" in b} == {f"bucket={bucket}"}
    assert rows_of(current.read_current(spark, path))["u7"] == "newer"
    plan = current.read_current(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_a_batch_without_state_does_not_count(spark):
    path = table(spark)
    current.upsert_batch(batch_of(spark, [("u", "old", 1, "r")]), path, 0, ["seq"])
    # As after a failure between rows and state.
    bucket = batch_of(spark, [("u", "", 0, "")]).select(current._bucket("job_url", 8)).first()[0]
    batch_of(spark, [("u", "half", 1, "r")]).select("job_url", "title").write.parquet(f"{path}/rows/batch_id=1/bucket={bucket}")
    assert rows_of(current.read_current(spark, path)) == {"u": "old"}
    current.upsert_batch(batch_of(spark, [("u", "whole", 1, "r")]), path, 1, ["seq"])
    assert rows_of(current.read_current(spark, path)) == {"u": "whole"}


def test_empty_batches(spark):
    path = table(spark)
    assert rows_of(current.read_current(spark, path)) == {}
    current.upsert_batch(batch_of(spark, []), path, 0, ["seq"])
    assert rows_of(current.read_current(spark, path)) == {}


def test_equals_the_upsert_of_whole_tables(spark):
    rows = [(f"u{k % 7}", f"t{k}", k, "r") for k in range(30)]
    path = table(spark)
    for n, part in enumerate((rows[:20], rows[20:])):
        current.upsert_batch(batch_of(spark, part), path, n, ["seq", "run_id"])
    whole = store.upsert_postings(batch_of(spark, rows[:20]), batch_of(spark, rows[20:]))
    assert rows_of(current.read_current(spark, path)) == rows_of(whole.select("job_url", F.col("title")))
