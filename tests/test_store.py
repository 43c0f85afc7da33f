"""Postings store, CSV export, run state, dedup and visits."""

import glob

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from postsieve.operators import dedup, state, visits
from postsieve.plans import catalog
from postsieve.schemas import POSTING, RUN_DEFAULTS
from postsieve.sources import export, store, tables
from postsieve.streaming.pages import append_to, stream_dedup
from postsieve.streaming.store import stream_upsert
from postsieve.streaming.thin import thin

# A comma, doubled quotes, a line break, outer blanks, CJK, no tags.
ROWS = [
    ("Robotics trainee", "Nord & Söhne", "Kiel, Hafen", "1,900", ["ROS", "C++"], "Likes gears.", "A", "https://a.test/1"),
    ('The "quiet" job', 'Quote "" Ltd', "上海", "", ["a;b"], "One\nTwo", "乙", "https://b.test/2"),
    ("", " ", " somewhere ", "x", [], "", "C", "https://c.test/3"),
]
HEADER = "title,company,location,salary,tech_tags,requirements,source,job_url"


def as_csv(rows):
    def field(v):
        return '"' + ("; ".join(v) if isinstance(v, list) else v).replace('"', '""') + '"'

    return "\n".join([HEADER, *[",".join(map(field, r)) for r in sorted(rows, key=lambda r: r[-1])]])


def read_back(path):
    parts = sorted(glob.glob(f"{path}/part-*"))
    return b"".join(open(p, "rb").read() for p in parts).decode(), len(parts)


def test_csv_lines(spark):
    lines = export.csv_lines(spark.createDataFrame(ROWS, POSTING)).orderBy("job_url").collect()
    assert "\n".join([HEADER, *[r.line for r in lines]]) == as_csv(ROWS)
    assert '"The ""quiet"" job","Quote """" Ltd"' in lines[1].line
    assert '"ROS; C++"' in lines[0].line


@pytest.mark.parametrize("n", [0, 1, 3, 2000])
def test_export_bytes(spark, tmp_path, n):
    rows = ROWS[:n] if n <= 3 else [(*ROWS[i % 3][:-1], f"https://x/{i:05d}") for i in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = export.export_csv(spark.createDataFrame(rows, POSTING), str(tmp_path), at_ms=1772945319947)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert path.endswith("/ai_engineer_jobs_1772945319947.csv")
    got, parts = read_back(path)
    assert got == as_csv(rows)
    assert n < 2000 or parts > 1


def test_export_of_repeated_and_null_urls(spark, tmp_path):
    rows = [(*ROWS[0][:-1], None), (*ROWS[1][:-1], None), ROWS[2], ROWS[2], (*ROWS[0][:-1], ROWS[2][-1])]
    named = StructType([StructField(f.name, f.dataType) for f in POSTING])
    frame = spark.createDataFrame(rows, named)
    got, _ = read_back(export.export_csv(frame, str(tmp_path)))
    lines = [r.line for r in export.csv_lines(frame).collect()]
    assert got.startswith(HEADER + "\n")
    assert sorted(got[len(HEADER) + 1 :].replace("\n\"", "\x00\"").split("\x00")) == sorted(lines)
    only_null, _ = read_back(export.export_csv(frame.filter("job_url is null").limit(1), str(tmp_path / "n")))
    assert only_null.count("\n") == 1 + only_null.count("One\n")


def postings(spark, rows):
    """``(run, seq, title, company, url)`` as postings."""
    df = spark.createDataFrame(rows, "run_id string, seq long, title string, company string, job_url string")
    blank = {c: F.lit("") for c in ("location", "salary", "requirements", "source")}
    return df.withColumns({**blank, "tech_tags": F.array(F.lit("t"))})


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    store.init_store(spark, path)
    assert store.read_postings(spark, path).collect() == []
    first = dedup.with_job_key(postings(spark, [("a", 1, "x", "c", "u1"), ("a", 2, "y", "c", "u2")]))
    second = dedup.with_job_key(postings(spark, [("b", 1, "z", "c", "u1"), ("b", 2, "w", "c", "u3")]))
    store.append_batch(first, path, 0)
    for _ in range(2):  # repeating a batch changes nothing
        store.append_batch(second, path, 1)
    store.init_store(spark, path)
    got = [(r.job_url, r.title) for r in store.read_postings(spark, path).collect()]
    assert got == [("u1", "z"), ("u2", "y"), ("u3", "w")]
    assert store.count_postings(store.read_store(spark, path)).first().n_postings == 3
    keys = sorted((r.run_id, r.job_key) for r in store.read_keys(spark, path).collect())
    changed = dedup.with_job_key(postings(spark, [("a", 3, "renamed", "c", "u1")]))
    store.append_batch(changed, path, 2)
    compact = str(tmp_path / "compact")
    store.compact_store(spark, path, compact)
    # The replaced row is gone, its title and company are not.
    assert store.read_log(spark, compact).count() == 4
    known = sorted((r.run_id, r.job_key) for r in store.read_keys(spark, compact).collect())
    assert known == sorted([*keys, ("a", "renamed||c")])
    got = [("u1", "renamed"), *got[1:]]
    assert [(r.job_url, r.title) for r in store.read_postings(spark, str(tmp_path / "compact")).collect()] == got
    store.clear_postings(spark, path)
    assert store.read_postings(spark, path).collect() == []


def test_upsert(spark):
    target = postings(spark, [("a", 9, "old", "c", "u1"), ("a", 1, "kept", "c", "u2")])
    batch = postings(spark, [("a", 1, "new", "c", "u1"), ("a", 2, "newer", "c", "u1"), ("a", 3, "in", "c", "u3")])
    got = {r.job_url: r.title for r in store.upsert_postings(target, batch).collect()}
    assert got == {"u1": "newer", "u2": "kept", "u3": "in"}


def test_dedup_and_target(spark):
    rows = [("a", 5, " ML ", "X", "u5"), ("a", 2, "ml", "x　", "u2"), ("a", 3, "ml", "y", "u3"), ("b", 9, "ml", "x", "u9"), ("a", 7, "q", "q", "u7")]
    first = dedup.dedup_title_company(postings(spark, rows))
    assert {(r.run_id, r.seq) for r in first.collect()} == {("a", 2), ("a", 3), ("a", 7), ("b", 9)}
    assert {(r.run_id, r.seq) for r in dedup.cut_at_target(first, 2).collect()} == {("a", 2), ("a", 3), ("b", 9)}
    saved = first.filter("seq = 2")
    assert {r.seq for r in dedup.drop_saved_keys(first, saved).collect()} == {3, 7, 9}


def test_stream_upsert(spark, tmp_path):
    batches = [
        [("a", 1, "t1", "c", "u1"), ("a", 2, "T1 ", "c", "u2"), ("a", 3, "t2", "c", "u3"), ("b", 1, "t1", "c", "v1")],
        [("a", 4, "t2", "c", "u4"), ("a", 5, "t3", "c", "u5"), ("a", 6, "t4", "c", "u6"), ("b", 2, "t2", "c", "v2")],
        [("a", 7, "t5", "c", "u7"), ("b", 3, "t1", "C", "v3")],
    ]
    source, path, ckpt = (str(tmp_path / n) for n in ("in", "store", "ckpt"))
    schema = postings(spark, batches[0]).schema
    for rows in batches:
        postings(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        stream_upsert(stream, path, ckpt, target=3).awaitTermination()
    got = {(r.run_id, r.seq, r.batch_id) for r in store.read_log(spark, path).collect()}
    assert got == {("a", 1, 0), ("a", 3, 0), ("b", 1, 0), ("a", 5, 1), ("b", 2, 1)}


def test_writers_leave_each_other_alone(spark, tmp_path):
    source, path, ckpt = (str(tmp_path / n) for n in ("in", "store", "ckpt"))
    schema = postings(spark, [("a", 1, "t", "c", "u")]).schema

    def stream_on(rows):
        postings(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream_upsert(spark.readStream.schema(schema).parquet(source), path, ckpt, target=4).awaitTermination()

    stream_on([("a", 1, "t1", "c", "u1")])
    store.append_batch(dedup.with_job_key(postings(spark, [("a", 7, "t7", "c", "v1")])), path, 1)
    stream_on([("a", 2, "T7", "c", "u2"), ("a", 3, "t3", "c", "u3")])
    other = stream_upsert(spark.readStream.schema(schema).parquet(source), path, f"{ckpt}-2", target=4)
    other.awaitTermination()
    stream_on([("a", 4, "t4", "c", "u4"), ("a", 5, "t5", "c", "u5")])
    log = store.read_log(spark, path)
    assert {(r.run_id, r.seq) for r in log.collect()} == {("a", 1), ("a", 7), ("a", 3), ("a", 4)}
    assert log.select("writer").distinct().count() == 2
    # A batch run again replaces its own folder only.
    store.append_batch(dedup.with_job_key(postings(spark, [("a", 8, "t8", "c", "v2")])), path, 1)
    assert {r.seq for r in store.read_log(spark, path).collect()} == {1, 3, 4, 8}
    assert {r.job_key for r in store.read_keys(spark, path).collect()} == {"t1||c", "t3||c", "t4||c", "t8||c"}


def test_only_the_buckets_of_the_runs_are_read(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(f"run{k}", k, "t", "c", f"u{k}") for k in range(100)]
    store.append_batch(dedup.with_job_key(postings(spark, rows)), path, 0)
    runs = spark.createDataFrame([("run7",)], "run_id string")
    found = store.read_keys(spark, path, runs)
    assert [r.run_id for r in found.collect()] == ["run7"]
    assert len(found.inputFiles()) == 0 or "bucket" in found._jdf.queryExecution().executedPlan().toString()


def test_stream_dedup(spark, tmp_path):
    source, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    for rows in ([("a", "u"), ("a", "u"), ("b", "u")], [("a", "u"), ("a", "v")]):
        df = spark.createDataFrame(rows, "run_id string, url string")
        df.write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        append_to(stream_dedup(stream), out, ckpt).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == [("a", "u"), ("a", "v"), ("b", "u")]


def test_thin(spark):
    big = 2**60 + 1
    rows = [("hot", i, big + i) for i in range(500, 0, -1)] + [(None, 1, None), (None, 2, 7), ("x", 9, None)]
    df = spark.createDataFrame(rows, "k string, o int, v long").coalesce(1)
    got = {tuple(r) for r in thin(df, ["k"], 2, "o").collect()}
    assert got == {("hot", 1, big + 1), ("hot", 2, big + 2), (None, 1, None), (None, 2, 7), ("x", 9, None)}


def test_state_defaults(spark, tmp_path):
    spark.createDataFrame([("r", "searching", 10, "x")], "run_id string, status string, collected int, extra string").write.parquet(
        str(tmp_path / "s")
    )
    row = tables.read_run_state(spark, str(tmp_path / "s")).first().asDict()
    assert row == RUN_DEFAULTS | {"run_id": "r", "status": "searching", "collected": 10, "extra": "x"}


def test_state_files_of_two_versions(spark, tmp_path):
    path = str(tmp_path / "s")
    spark.createDataFrame([("old", "searching", 10)], "run_id string, status string, collected int").write.parquet(path)
    newer = spark.createDataFrame([("new", "idle", 1, None)], "run_id string, status string, collected int, target int")
    newer.write.mode("append").parquet(path)
    got = {r.run_id: r for r in tables.read_run_state(spark, path).collect()}
    assert (got["old"].target, got["new"].target) == (50, None)
    assert got["old"].max_pages_per_keyword == got["new"].max_pages_per_keyword == 10


def test_stored_null_stays_null(spark):
    df = spark.createDataFrame([("r", None)], "run_id string, target int")
    assert tables.with_run_defaults(df).first().target is None


def test_merge_and_reset(spark):
    current = spark.createDataFrame([("r", "idle", 1), ("s", "done", 2)], "run_id string, status string, collected int")
    partial = spark.createDataFrame([("r", 5, None), ("new", 6, "n")], "run_id string, collected int, note string")
    got = {r.run_id: r.asDict() for r in state.merge_run_state(current, partial, F.lit(77)).collect()}
    assert got["r"] == RUN_DEFAULTS | {"run_id": "r", "status": "idle", "collected": 5, "note": None, "last_updated": 77}
    assert got["s"] == RUN_DEFAULTS | {"run_id": "s", "status": "done", "collected": 2, "note": None}
    assert got["new"] == RUN_DEFAULTS | {"run_id": "new", "collected": 6, "note": "n", "last_updated": 77}
    reset = state.reset_run_state(current, F.lit(5)).collect()
    assert [r.asDict() for r in reset if r.run_id == "s"] == [RUN_DEFAULTS | {"run_id": "s", "last_updated": 5}]
    stamped = state.merge_run_state(current, partial).filter("run_id = 'r'").first().last_updated
    assert stamped > 1_700_000_000_000


def test_progress(spark):
    saved = spark.createDataFrame([("a",)] * 25 + [("b",)] * 3, "run_id string")
    rows = [("a", "searching", 50, 1), ("b", "searching", 2, 0), ("c", "done", 0, 0), ("d", "idle", 3, 2)]
    runs = spark.createDataFrame(rows, "run_id string, status string, target int, n_visited long")
    got = {r.run_id: tuple(r)[1:] for r in state.run_progress(saved, runs).collect()}
    assert got == {
        "a": (25, 50, 50, "25/50", False, True),
        "b": (3, 2, 100, "3/2", True, True),
        "c": (0, 0, None, "0/0", True, False),
        "d": (0, 3, 0, "0/3", False, True),
    }


def test_visits_and_resume(spark):
    pending = spark.createDataFrame([("r", 1, "u1"), ("r", 2, "u2"), ("s", 1, "u1")], "run_id string, seq long, url string")
    new = spark.createDataFrame([("r", 1, "u3"), ("t", 1, "u4")], "run_id string, seq long, url string")
    visited = spark.createDataFrame([("r", "u1")], "run_id string, url string")
    queue = visits.enqueue(pending, new)
    assert {tuple(r) for r in queue.filter("run_id IN ('r', 't')").collect()} == {
        ("r", 1, "u1"), ("r", 2, "u2"), ("r", 3, "u3"), ("t", 1, "u4")
    }
    from_zero = spark.createDataFrame([("r", 0, "u5"), ("r", 4, "u6")], "run_id string, seq long, url string")
    assert {tuple(r)[1:] for r in visits.enqueue(pending, from_zero).filter("run_id = 'r'").collect()} == {
        (1, "u1"), (2, "u2"), (3, "u5"), (7, "u6")
    }
    assert {r.url for r in visits.pop_processed(queue, visited).filter("run_id = 'r'").collect()} == {"u2", "u3"}
    assert visits.mark_visited(visited, pending).count() == 3
    rows = [("r", "idle", 0, 5), ("s", "idle", 9, 5), ("x", "idle", 0, 5), ("y", "done", 2, 5), ("z", "idle", 2, 5)]
    runs = spark.createDataFrame(rows, "run_id string, status string, collected int, target int")
    starts = visits.run_start(runs, visited, pending)
    got = {r.run_id: (r.resumed, r.status) for r in starts.collect()}
    assert got == {
        "r": (True, "visiting_detail"),
        "s": (False, "visiting_detail"),
        "x": (False, "searching"),
        "y": (False, "searching"),
        "z": (True, "searching"),
    }
    left = visits.resume_pending(starts, pending, visited)
    assert [(r.run_id, r.url) for r in left.collect()] == [("r", "u2")]


def test_active_runs(spark):
    events = spark.createDataFrame([("r", 1, 1), ("r", 2, 2), ("s", 1, 3)], "run_id string, active_tab_id long, e int")
    runs = spark.createDataFrame([("r", 1, "searching"), ("s", 1, "done")], "run_id string, active_tab_id long, status string")
    assert [r.e for r in visits.active_run_filter(events, runs).collect()] == [1]


def test_two_writers_deal_the_postings_to_more_than_one_task(spark, tmp_path, monkeypatch):
    """What goes into the stream is written by the tasks that read the documents, not by one."""
    docs = spark.range(4000, numPartitions=16).selectExpr(
        "id AS doc_id", "concat('title ', id % 900, '\n', id) AS text", "if(id % 2 = 0, 'en', 'de') AS lang", "'web' AS source", "id AS n_chars"
    )
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(catalog, "new_dir", lambda session, label: f"{tmp_path}/{label}")
    got = sorted(tuple(r) for r in catalog.two_writers(spark, str(tmp_path)).collect())
    saved, want = set(), []
    for part in range(3):
        for seq in range(part, 4000, 3):
            key = ("en" if seq % 2 == 0 else "de", seq % 900)
            if key not in saved:
                saved.add(key)
                want.append((key[0], seq))
    assert [r[:2] for r in got] == sorted(want)
    # Two of the three parts go through the stream.
    assert len(glob.glob(f"{tmp_path}/incoming/part-*.parquet")) > 2
