"""The stop rule over pages that arrive late, early, twice or never."""

import datetime as dt
import random

import pytest

from postsieve.streaming.pages import append_to
from postsieve.streaming.stop import stream_ordered_stop_rule

from test_stop import simulate_keyword

SCHEMA = "keyword string, page_no int, n_links int, n_new int, captured_at timestamp"
START = dt.datetime(2024, 1, 1)


def run(spark, folder, batches, **options):
    """Rows out of each batch ``(keyword, page, n_links, n_new, minute)`` in turn; the query is stopped after every one."""
    out = []
    for k, rows in enumerate(batches):
        full = [(*r[:4], None if r[4] is None else START + dt.timedelta(minutes=r[4])) for r in rows]
        spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        found = stream_ordered_stop_rule(arriving, ["keyword"], **options)
        append_to(found, f"{folder}/out", f"{folder}/state").awaitTermination()
        rows_now = {(r.keyword, r.page_no, r.ordinal, r.consec) for r in spark.read.parquet(f"{folder}/out").collect()}
        out.append(rows_now - set().union(*out))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_what_the_batch_rule_gives(spark, tmp_path, seed):
    rng = random.Random(seed)
    keywords = {f"k{i}": [(p, n, rng.choice([0, 0, n])) for p, n in enumerate(rng.choices([0, 1, 2, 3], k=rng.randrange(1, 30)), 1)] for i in range(40)}
    keywords[None] = [(1, 2, 2), (2, 9, 0), (3, 1, 1)]
    rows = [(k, *p, 0) for k, pages in keywords.items() for p in pages]
    rng.shuffle(rows)
    # Some come twice, in the same batch or in another.
    batches = [rows[b::3] + rng.sample(rows, 20) for b in range(3)]
    got = set().union(*run(spark, tmp_path, batches))
    assert got == {(k, *used) for k, pages in keywords.items() for used in simulate_keyword(pages)}


def test_pages_wait_for_the_gap_to_close(spark, tmp_path):
    got = run(spark, tmp_path, [[("a", 2, 1, 1, 0), ("a", 4, 1, 1, 1)], [("a", 1, 1, 1, 2)], [("a", 3, 3, 0, 3)]])
    assert got == [set(), {("a", 1, 1, 0), ("a", 2, 2, 0)}, {("a", 3, 3, 3), ("a", 4, 4, 0)}]


def test_a_gap_is_given_up_after_the_wait(spark, tmp_path):
    batches = [
        [("a", 1, 1, 1, 0), ("a", 3, 2, 0, 5), ("a", 5, 1, 1, 6)],
        [("b", 1, 1, 1, 66)],  # an hour past a's third page, not past its fifth
        [("a", 2, 9, 0, 60), ("a", 4, 2, 0, 61)],  # the second comes too late; the fourth closes its gap
        [("b", 3, 1, 1, 70), ("a", 7, 1, 1, 70), (None, None, 1, 1, 70), ("c", 1, 1, 1, None)],
        [("b", 9, 1, 1, 300)],  # gives up b's and a's gaps; b's ninth page waits itself
    ]
    got = run(spark, tmp_path, batches)
    assert got == [
        {("a", 1, 1, 0)},
        {("b", 1, 1, 0), ("a", 3, 2, 2)},
        {("a", 4, 3, 4), ("a", 5, 4, 0)},
        set(),
        {("b", 3, 2, 0), ("a", 7, 5, 0)},
    ]


def test_no_more_pages_are_held_than_can_be_used(spark, tmp_path):
    """Pages come from the last to the first; the cap lets nine be used."""
    rows = [("a", p, 1, 1, 0) for p in range(500, 0, -1)]
    got = run(spark, tmp_path, [rows[:480], rows[480:]])
    assert got == [set(), {("a", p, p, 0) for p in range(1, 10)}]


def test_limits_and_first_number(spark, tmp_path):
    got = run(spark, tmp_path, [[("a", p, 1, 0, 0) for p in (2, 0, 3, 1)]], first=0, max_dupes=3, max_pages=50)
    assert got == [{("a", 0, 1, 1), ("a", 1, 2, 2)}]
