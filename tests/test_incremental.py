"""The frontier after each batch of pages against a crawl of all pages so far."""

import random

import pytest
from pyspark.sql import functions as F

from postsieve.plans import crawl, incremental
from postsieve.session import new_dir
from postsieve.streaming.frontier import stream_frontier

from test_stop import listing_rows, simulate_run

SCHEMA = "run_id string, platform_pos int, keyword_idx int, page_no int, links array<string>"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def check(spark, path, rows, seen=(), max_dupes=3):
    """The stored frontier equals the simulation over ``rows``, in which later ones replace earlier ones."""
    pages = {r[:4]: r for r in rows}
    got = incremental.read_frontier(spark, path).collect()
    for run in {r[0] for r in rows}:
        mine = [((p, k), page, links or []) for r, p, k, page, links in pages.values() if r == run]
        want = simulate_run(mine, [u for r, u in seen if r == run], max_dupes=max_dupes)
        found = sorted((r for r in got if r.run_id == run), key=lambda r: r.seq)
        assert [(r.platform_pos, r.keyword_idx, r.page_no, r.url) for r in found] == want
        assert [r.seq for r in found] == list(range(1, len(want) + 1))
    assert {r.run_id for r in got} <= {r[0] for r in rows}


@pytest.mark.parametrize("seed", range(2))
def test_three_batches(spark, seed):
    rng = random.Random(seed)
    rows = [r for run in ("a", "b", "c", None) for r in listing_rows(rng, run)]
    rng.shuffle(rows)
    # The second batch brings runs b and null anew, the third pages that were there, with other links.
    first = [r for r in rows if r[0] in ("a", "c") and rng.random() < 0.8]
    second = [r for r in rows if r not in first and r[0] != "c"]
    third = [r for r in rows if r not in first and r not in second] + [(*r[:4], r[4][:1]) for r in first if r[0] == "a"][:3]
    seen = [("a", "0/u3"), ("a", "1/u20"), ("b", "0/u7")]
    visited, path = spark.createDataFrame(seen, "run_id string, url string"), new_dir(spark, "incremental")
    incremental.init_frontier(frame(spark, rows), path)
    so_far = []
    for batch_id, part in enumerate((first, second, third)):
        incremental.add_pages(frame(spark, part), path, batch_id, visited, max_dupes=3)
        so_far += part
        check(spark, path, so_far, seen)
    # The last batch done again, as after a failure, changes nothing.
    incremental.add_pages(frame(spark, third), path, 2, visited, max_dupes=3)
    check(spark, path, so_far, seen)


def test_a_batch_crawls_its_runs_from_the_first_changed_keyword(spark, monkeypatch):
    rng = random.Random(5)
    rows = [r for run in "abcd" for r in listing_rows(rng, run)]
    late = [("b", 1, 2, 40, ["1/new"]), ("b", 1, 4, 41, ["0/new"])]
    path, crawled = new_dir(spark, "incremental"), []

    def watched(listing, *args):
        crawled.append({(r.run_id, r.platform_pos, r.keyword_idx) for r in listing.collect()})
        return crawl_all(listing, *args)

    crawl_all = crawl.crawl_frontier
    monkeypatch.setattr(crawl, "crawl_frontier", watched)
    incremental.init_frontier(frame(spark, rows), path)
    incremental.add_pages(frame(spark, rows), path, 0, max_dupes=3)
    incremental.add_pages(frame(spark, late), path, 1, max_dupes=3)
    check(spark, path, rows + late)
    assert {k[0] for k in crawled[0]} == set("abcd")
    assert crawled[1] == {("b", 1, k) for k in range(2, 6)}


def test_no_more_pages_are_stored_than_can_be_used(spark):
    rows = [("a", 0, 0, p, [f"u{p}"]) for p in range(1, 60)]
    path = new_dir(spark, "incremental")
    incremental.init_frontier(frame(spark, rows), path)
    incremental.add_pages(frame(spark, rows[20:]), path, 0)
    check(spark, path, rows[20:], max_dupes=5)
    incremental.add_pages(frame(spark, rows[:20]), path, 1)
    check(spark, path, rows, max_dupes=5)
    assert spark.read.parquet(f"{path}/pages").groupBy("batch_id").agg(F.count("*").alias("n")).filter("n > 10").isEmpty()


def test_empty_batches_and_pages_without_links(spark):
    path = new_dir(spark, "incremental")
    incremental.init_frontier(frame(spark, []), path)
    assert incremental.read_frontier(spark, path).collect() == []
    incremental.add_pages(frame(spark, []), path, 0)
    rows = [("a", 0, 0, 1, None), ("a", 0, 0, 2, []), ("a", 0, 1, 1, ["u"])]
    incremental.add_pages(frame(spark, rows), path, 1)
    check(spark, path, rows, max_dupes=5)


@pytest.mark.parametrize("fails", ["pages", "frontier", "runs"])
def test_stream_killed_in_a_batch(spark, tmp_path, monkeypatch, fails):
    """A batch that fails before its last table is written is done again; pages arrive in any order."""
    rng = random.Random(5)
    rows = [r for run in ("a", "b", None) for r in listing_rows(rng, run)]
    rng.shuffle(rows)
    source, path, state = (str(tmp_path / n) for n in ("in", "frontier", "state"))
    for part in (rows[0::3], rows[1::3], rows[2::3]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)

    def stream():
        arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        return stream_frontier(arriving, path, state, max_dupes=3)

    write = incremental._write

    def broken(rows, path, name, batch_id):
        if batch_id == 1 and name == fails:
            raise OSError("lost")
        write(rows, path, name, batch_id)

    with monkeypatch.context() as patch:
        patch.setattr(incremental, "_write", broken)
        with pytest.raises(Exception, match="lost"):
            stream().awaitTermination()
    stream().awaitTermination()
    check(spark, path, rows)
    # Started again with nothing new, it changes nothing.
    stream().awaitTermination()
    check(spark, path, rows)
