"""The stop rule and the frontier against plain simulations."""

import random

import pytest
from pyspark.sql import functions as F

from postsieve.operators import keyed, stop
from postsieve.plans.crawl import crawl_frontier, keyword_frontier
from postsieve.streaming.pages import append_to
from postsieve.streaming.stop import stream_stop_rule


def simulate_keyword(pages, max_dupes=5, max_pages=10, consec=0, seen=0):
    """Pages used, and the counter after every page up to the stop."""
    used = []
    for ordinal, (page, n_links, n_new) in enumerate(sorted(pages), 1 + seen):
        consec = 0 if n_new else consec + max(n_links - n_new, 1)
        if consec >= max_dupes or ordinal >= max_pages:
            break
        used.append((page, ordinal, consec))
    return used


def simulate_run(listing, visited=(), max_dupes=5, max_pages=10):
    """One run page by page: keywords in order, links used are visited at once."""
    visited, frontier = set(visited), []
    for kw in sorted({row[0] for row in listing}):
        consec = 0
        for ordinal, (_, page, links) in enumerate(sorted(r for r in listing if r[0] == kw), 1):
            new = [u for u in links if u not in visited]
            consec = 0 if new else consec + max(len(links) - len(new), 1)
            if consec >= max_dupes or ordinal >= max_pages:
                break
            frontier += [(*kw, page, u) for u in new]
            visited.update(new)
    return frontier


def random_pages(rng, n):
    rows = []
    for page in rng.sample(range(1000), n):
        n_links = rng.choice([0, 0, 1, 1, 2, 3])
        rows.append((page, n_links, rng.choice([0, 0, 0, n_links])))
    return rows


@pytest.fixture(scope="module")
def keywords():
    rng = random.Random(7)
    return {k: random_pages(rng, rng.randint(1, 25)) for k in range(150)}


def frame(spark, keywords):
    rows = [("r", 0, k, *p) for k, pages in keywords.items() for p in pages]
    df = spark.createDataFrame(rows, "run_id string, platform_idx int, keyword_idx int, page_no int, n_links long, n_new long")
    return df.withColumn("n_dup", F.col("n_links") - F.col("n_new"))


def test_keyword_stop(spark, keywords):
    got = stop.keyword_stop(frame(spark, keywords)).collect()
    want = {(k, *row) for k, pages in keywords.items() for row in simulate_keyword(pages)}
    assert {(r.keyword_idx, r.page_no, r.ordinal, r.consec) for r in got} == want


def test_keyword_stop_goes_on_with_saved_counters(spark, keywords):
    saved = {k: (k % 6, k % 12) for k in keywords if k % 4}
    rows = [("r", 0, k, *c) for k, c in saved.items()]
    carried = spark.createDataFrame(rows, "run_id string, platform_idx int, keyword_idx int, consec int, pages int")
    got = stop.keyword_stop(frame(spark, keywords), carried=carried).collect()
    want = {
        (k, *row)
        for k, pages in keywords.items()
        for row in simulate_keyword(pages, consec=saved.get(k, (0, 0))[0], seen=saved.get(k, (0, 0))[1])
    }
    assert {(r.keyword_idx, r.page_no, r.ordinal, r.consec) for r in got} == want


@pytest.mark.parametrize("limits", [(1, 3), (3, 2000)])
def test_keyword_stop_limits(spark, keywords, limits):
    got = stop.keyword_stop(frame(spark, keywords), max_dupes=limits[0], max_pages=limits[1]).collect()
    want = {(k, *row) for k, pages in keywords.items() for row in simulate_keyword(pages, *limits)}
    assert {(r.keyword_idx, r.page_no, r.ordinal, r.consec) for r in got} == want


def test_consecutive_dupes_across_chunks(spark):
    """One keyword holds nearly all pages and spans several chunks."""
    rng = random.Random(3)
    pages = {0: [(p, n, rng.choice([0] * 9 + [n])) for p, n in enumerate(rng.choices([0, 1, 2], k=4000))], 1: [(5, 1, 0)]}
    df = frame(spark, pages)
    # Coalescing would put so few rows into one chunk.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        chunks = keyed.ordered_chunks(df, stop.KEYWORD, ["page_no"])
        assert chunks.filter("keyword_idx = 0").select("_chunk").distinct().count() > 1
        got = {(r.keyword_idx, r.page_no): r.consec for r in stop.consecutive_dupes(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k, rows in pages.items():
        consec = 0
        for page, n_links, n_new in sorted(rows):
            consec = 0 if n_new else consec + max(n_links - n_new, 1)
            assert got[k, page] == consec


def test_null_keywords_are_keywords(spark):
    rows = [("r", 0, None, p, 1, int(p == 1)) for p in (1, 2, 3)]
    df = spark.createDataFrame(rows, "run_id string, platform_idx int, keyword_idx int, page_no int, n_links long, n_new long")
    df = df.withColumn("n_dup", F.col("n_links") - F.col("n_new"))
    assert sorted((r.page_no, r.consec) for r in stop.consecutive_dupes(df).collect()) == [(1, 0), (2, 1), (3, 2)]
    assert stop.keyword_stop(df).count() == 3
    firsts = spark.createDataFrame([("r", 0, None, "u", 1)], "run_id string, platform_idx int, keyword_idx int, url string, page_no int")
    counted = stop.page_counts(df.select("run_id", "platform_idx", "keyword_idx", "page_no", "n_links"), firsts).collect()
    assert sorted((r.page_no, r.n_new) for r in counted) == [(1, 1), (2, 0), (3, 0)]


def test_number_rows_hot_key(spark):
    rows = [("hot", i) for i in range(3000)] + [(None, i) for i in range(40)] + [(f"k{i}", 0) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = keyed.number_rows(df, ["k"], ["v"], "n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    assert all(r.n == r.v + 1 for r in got)


def test_first_n_beyond_group_limit(spark):
    df = spark.createDataFrame([(i % 2, i) for i in range(5000)], "k int, v int")
    got = keyed.first_n_per_key(df, ["k"], ["v"], 1500, "n").collect()
    assert len(got) == 3000
    assert all(r.n == r.v // 2 + 1 for r in got)


def test_first_per_key_cuts_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS v")
    plan = keyed.first_per_key(df, ["k"], ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def listing_rows(rng, run):
    """Keywords that share links, so that where one stops matters to the next."""
    rows = []
    for platform in range(2):
        for kw in range(6):
            for page in range(1, rng.randint(2, 14)):
                pool = range(12 * (kw // 2), 12 * (kw // 2) + 30)
                links = rng.sample([f"{platform}/u{i}" for i in pool], rng.randint(0, 4))
                rows.append((run, platform, kw, page, links))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_crawl_frontier(spark, seed):
    rng = random.Random(seed)
    rows = [r for run in "abc" for r in listing_rows(rng, run)]
    seen = [("a", "0/u3"), ("a", "1/u20"), ("b", "0/u7")]
    listing = spark.createDataFrame(
        rows, "run_id string, platform_pos int, keyword_idx int, page_no int, links array<string>"
    )
    visited = spark.createDataFrame(seen, "run_id string, url string")
    got = crawl_frontier(listing, visited, max_dupes=3).orderBy("run_id", "seq").collect()
    for run in "abc":
        mine = [((p, k), page, links) for r, p, k, page, links in rows if r == run]
        want = simulate_run(mine, [u for r, u in seen if r == run], max_dupes=3)
        found = [r for r in got if r.run_id == run]
        assert [(r.platform_pos, r.keyword_idx, r.page_no, r.url) for r in found] == want
        assert [r.seq for r in found] == list(range(1, len(want) + 1))


def test_crawl_frontier_gives_up(spark):
    rows = listing_rows(random.Random(1), "a")
    listing = spark.createDataFrame(
        rows, "run_id string, platform_pos int, keyword_idx int, page_no int, links array<string>"
    )
    with pytest.raises(RuntimeError):
        crawl_frontier(listing, max_rounds=1)


def test_keyword_frontier_single_keyword(spark):
    rows = [("r", 0, 0, p, [f"u{p}", f"u{p - 1}"]) for p in range(1, 13)]
    listing = spark.createDataFrame(
        rows, "run_id string, platform_idx int, keyword_idx int, page_no int, links array<string>"
    )
    got = keyword_frontier(listing).orderBy("seq").collect()
    want = simulate_run([((0, k), page, links) for _, _, k, page, links in rows])
    assert [(r.platform_idx, r.keyword_idx, r.page_no, r.url) for r in got] == want
    assert max(r.page_no for r in got) == 9


def test_stream_stop_rule_over_batches(spark, keywords, tmp_path):
    source = tmp_path / "in"
    df = frame(spark, keywords).drop("n_dup")
    # Pages in order over three files, one micro-batch each.
    for i, (low, high) in enumerate([(0, 300), (300, 600), (600, 1000)]):
        part = df.filter((F.col("page_no") >= low) & (F.col("page_no") < high)).coalesce(1)
        part.write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = append_to(stream_stop_rule(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert sum(1 for p in query.recentProgress if p["numInputRows"]) == 3
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = {(k, *row) for k, pages in keywords.items() for row in simulate_keyword(pages)}
    assert {(r.keyword_idx, r.page_no, r.ordinal, r.consec) for r in got} == want
