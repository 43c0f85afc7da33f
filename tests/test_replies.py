"""Strict reading of replies, rule labels and the scorer hook."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postsieve.operators import replies, scoring
from postsieve.plans import curate
from postsieve.sources import store, tables

GOOD = {
    "is_ai_engineer": True,
    "is_campus_or_intern": True,
    "title": "Vision trainee",
    "company": "Lighthouse",
    "location": "Porto",
    "salary": "12/h",
    "tech_tags": ["OpenCV", "Rust"],
    "requirements": "Knows cameras.",
}
NEITHER = GOOD | {"is_ai_engineer": False, "is_campus_or_intern": False, "tech_tags": [], "requirements": ""}
TEXT = json.dumps(GOOD)


def without(name):
    return json.dumps({k: v for k, v in GOOD.items() if k != name})


def changed(**fields):
    return json.dumps(GOOD | fields)


CASES = [
    (TEXT, "ok"),
    (json.dumps(NEITHER), "not_qualified"),
    (changed(tech_tags=[]), "ok"),
    (changed(salary=""), "ok"),
    (changed(is_ai_engineer=False), "not_qualified"),
    (changed(is_campus_or_intern=False), "not_qualified"),
    *[(without(f), "bad_schema") for f in GOOD],
    (changed(is_ai_engineer="true"), "bad_schema"),
    (changed(is_ai_engineer=1), "bad_schema"),
    (changed(tech_tags="LLM, PyTorch"), "bad_schema"),
    (changed(tech_tags=[1, 2, 3]), "bad_schema"),
    (changed(tech_tags=["a", None]), "bad_schema"),
    (changed(tech_tags=["a", 1]), "bad_schema"),
    (changed(tech_tags=[["a"]]), "bad_schema"),
    (changed(tech_tags={"a": "b"}), "bad_schema"),
    (changed(title=5), "bad_schema"),
    (changed(title=None), "bad_schema"),
    (changed(title=["x"]), "bad_schema"),
    (changed(salary=1.5), "bad_schema"),
    (changed(title="2024-01-01", company="true", location="5"), "ok"),
    (changed(extra={"a": 1}), "ok"),
    ("null", "bad_schema"),
    ("{}", "bad_schema"),
    ("[]", "bad_schema"),
    (f"[{TEXT}]", "bad_schema"),
    ("5", "bad_schema"),
    ('"text"', "bad_schema"),
    ("", "not_json"),
    ("  \n", "not_json"),
    ("sorry", "not_json"),
    (TEXT + " junk", "not_json"),
    (TEXT + "}", "not_json"),
    (TEXT + "]", "not_json"),
    (TEXT + TEXT, "not_json"),
    (TEXT + "," + TEXT, "not_json"),
    (TEXT[:-1], "not_json"),
    (f"```json\n{TEXT}\n```", "not_json"),
    (TEXT.replace('"', "'"), "not_json"),
    (TEXT.replace('"12/h"', "NaN"), "not_json"),
    (f"\n {TEXT}\t", "ok"),
    ('{"title": 5, ' + TEXT[1:], "ok"),
    (TEXT[:-1] + ', "title": 5}', "bad_schema"),
    (None, "call_failed"),
]


def test_status(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(CASES)], "i int, reply string")
    got = {r.i: r for r in replies.parse_reply_strict(df).collect()}
    assert [(CASES[i][0], got[i].status) for i in range(len(CASES))] == CASES
    assert got[0].extraction.asDict() == GOOD
    assert got[5].extraction.is_campus_or_intern is False
    assert got[16].extraction is None
    assert replies.rejects(replies.parse_reply_strict(df)).count() == sum(s != "ok" for _, s in CASES)
    assert replies.replayable(replies.parse_reply_strict(df)).count() == 1


def test_parsed_once(spark):
    """A filter on the status must not repeat the parse."""
    df = spark.range(3).selectExpr("cast(id AS string) AS reply")
    plan = replies.rejects(replies.parse_reply_strict(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json(concat([,") <= 1


def test_to_posting(spark):
    df = spark.createDataFrame([("LinkedIn", "u1", changed(job_url="x", source="y"))], "platform string, url string, reply string")
    row = replies.to_posting(replies.parse_reply_strict(df)).first()
    assert (row.source, row.job_url, row.title, row.tech_tags) == ("LinkedIn", "u1", GOOD["title"], GOOD["tech_tags"])


def test_reply_content(spark):
    body = json.dumps({"choices": [{"message": {"content": TEXT}}, {"message": {"content": "b"}}]})
    df = spark.createDataFrame([("a", body), ("b", "{}"), ("c", "oops"), ("d", None)], "url string, body string")
    got = {r.url: r.reply for r in tables.reply_content(df).collect()}
    assert got == {"a": TEXT, "b": None, "c": None, "d": None}


def test_quality(spark):
    rows = [("ML Engineer, junior", [], ""), ("AI Engineer", [], "r"), ("AI Engineer", ["x"], "r"), ("Other", [], "r")]
    df = spark.createDataFrame(rows, "title string, tech_tags array<string>, requirements string")
    got = [tuple(r)[3:] for r in replies.quality_checks(df).collect()]
    assert got == [
        (True, True, ["Machine Learning"]),
        (True, False, ["AI", "Machine Learning"]),
        (False, False, ["x"]),
        (True, False, []),
    ]


@pytest.mark.parametrize(
    "text, role, level",
    [
        ("AI Engineer intern", True, True),
        ("Senior ML Engineer, 5+ years", True, False),
        ("ML engineer 3-5 years or new grad", True, True),
        ("AI Engineer in QA: Test Engineer", False, True),
        ("international engineer, 10 years", False, False),
        ("算法工程师 校招 5 years", True, True),
        ("LLM Engineer / 运维工程师", False, True),
        ("Machine Learning Engineer, 2 years", True, True),
        ("", False, True),
        ("机器学习工程师, 5年以上经验", True, False),
        ("算法工程师 三年以上", True, False),
        ("AI engineers, at least five years", True, False),
        ("ML engineer, 4 or more years", True, False),
        ("LLM engineer, 3+ yrs, new grads welcome", True, True),
        ("NLP engineer, 2年经验", True, True),
        ("3 years", False, False),
        ("AI engineer\n103 years of history", True, False),
        ("CV engineer, 1.5 years or 2 yrs", True, False),
        ("applied scientists, 12-15+ yrs", True, False),
        ("data scientist, ten to twelve years", True, False),
        ("data scientist: many years, ten people", True, True),
        ("AI engineer, 2~3年", True, False),
    ],
)
def test_rules(spark, text, role, level):
    row = scoring.rule_labels(spark.createDataFrame([(text,)], "text string")).first()
    assert (row.rule_role, row.rule_level) == (role, level)


def test_prompt(spark):
    df = spark.createDataFrame([("u", "x" * 5001)], "url string, text string")
    row = scoring.build_prompt(df, system="be brief").first()
    assert row.prompt == "Job URL: u\n\nJob Description:\n" + "x" * 5000 + "..."
    assert row.system == "be brief"
    assert "system" not in scoring.build_prompt(df).columns


def test_scorer_may_fail_on_a_row(spark):
    big = 2**60 + 1
    df = spark.createDataFrame([(big, "p"), (None, "q")], "i long, prompt string").coalesce(1)
    scored = scoring.score_batch(df, lambda b: b["prompt"].map(lambda p: None if p == "q" else p))
    assert {r.i: r.reply for r in scored.collect()} == {big: "p", None: None}


def make_scorer(good=GOOD):
    """Even numbers qualify; two neighbours share a title."""

    def one(url):
        n = int(url[1:])
        if n % 10 == 3:
            return None
        return json.dumps(good | {"is_ai_engineer": n % 2 == 0, "title": f"t{n // 4}"})

    return lambda batch: batch["url"].map(one)


def test_score_in_waves(spark, tmp_path):
    rows = [("a", i, f"u{i}") for i in range(1, 61)] + [("b", 3 * i, f"u{i}") for i in range(1, 5)]
    df = spark.createDataFrame(rows, "run_id string, seq long, url string")
    df = df.withColumns({"platform": F.lit("Indeed"), "text": F.lit("t")})
    path, rejected = str(tmp_path / "store"), str(tmp_path / "rejected")
    waves = curate.score_in_waves(df, make_scorer(), path, rejected, target=7, wave=8)
    got = {}
    for r in store.read_log(spark, path).orderBy("seq").collect():
        got.setdefault(r.run_id, []).append(r.seq)
    # First of each title among the even numbers, seven at most.
    assert got == {"a": [2, 4, 8, 12, 16, 20, 24], "b": [6, 12]}
    assert waves == 2
    # Called again, it adds nothing and leaves what is there.
    curate.score_in_waves(df, make_scorer(), path, rejected, target=7, wave=8)
    again = store.read_log(spark, path).groupBy("run_id").count().collect()
    assert {r.run_id: r["count"] for r in again} == {"a": 7, "b": 2}
    scored = spark.read.parquet(rejected)
    assert scored.filter("run_id = 'a'").agg(F.max("seq")).first()[0] <= 24
    assert {r.status for r in scored.select("status").distinct().collect()} == {"not_qualified", "call_failed"}


def test_no_calls_for_runs_stopped_between_waves(spark, tmp_path):
    rows = [(run, i, f"u{2 * i}") for run in ("a", "b", "c", None) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "run_id string, seq long, url string")
    df = df.withColumns({"platform": F.lit("Indeed"), "text": F.lit("t")})
    states = [
        [("a", "analysing"), ("b", "analysing")],
        [("a", "idle"), ("b", "analysing"), (None, "idle")],
        [("a", "idle"), ("b", "error"), ("c", None)],
    ]
    asked = []

    def runs():
        asked.append(len(asked))
        return spark.createDataFrame(states[min(asked[-1], 2)], "run_id string, status string")

    path, rejected = str(tmp_path / "store"), str(tmp_path / "rejected")
    scorer = lambda batch: batch["url"].map(lambda u: json.dumps(GOOD | {"title": u}))
    waves = curate.score_in_waves(df, scorer, path, rejected, target=1000, wave=8, runs=runs)
    last = store.read_log(spark, path).groupBy("run_id").agg(F.max("seq").alias("last"), F.count("seq").alias("n")).collect()
    # Waves end at 8, 24 and 56; a run without an id or a state cannot be stopped.
    assert {r.run_id: (r.last, r.n) for r in last} == {"a": (8, 8), "b": (24, 24), "c": (40, 40), None: (40, 40)}
    assert waves == 3 and asked == [0, 1, 2, 3]


def test_waves_take_every_row_and_spread_it(spark, tmp_path):
    rows = [("a", n, f"u{2 * k}") for k, n in enumerate([0, -3, None, 1, 2, 900])] + [("b", k, f"u{4 * k}") for k in range(1, 300)]
    df = spark.createDataFrame(rows, "run_id string, seq long, url string").coalesce(1)
    df = df.withColumns({"platform": F.lit("Indeed"), "text": F.lit("t")})
    path, rejected = str(tmp_path / "store"), str(tmp_path / "rejected")

    def scorer(batch):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        return batch["url"].map(lambda u: json.dumps(GOOD | {"title": u, "location": str(part)}))

    curate.score_in_waves(df, scorer, path, rejected, target=1000, wave=400, calls=4)
    log = store.read_log(spark, path)
    assert log.filter("run_id = 'a'").count() == 6
    assert log.filter("run_id = 'b'").count() == 299
    assert log.filter("run_id = 'b'").select("location").distinct().count() == 4


def test_the_last_reply_counts(spark):
    details = spark.createDataFrame([("a", 1, "u2"), ("a", 2, "u4")], "run_id string, seq long, url string")
    good = json.dumps(GOOD)
    rows = [("u2", "busy", 1), ("u2", good, 2), ("u4", good, 1), ("u4", "busy", 2)]
    replies_ = spark.createDataFrame(rows, "url string, reply string, reply_seq int")
    postings, rejected = curate.curate(details.withColumn("platform", F.lit("Indeed")), replies_)
    assert [r.job_url for r in postings.collect()] == ["u2"]
    assert [(r.url, r.status) for r in rejected.collect()] == [("u4", "not_json")]


def test_curate_against_saved(spark):
    rows = [("a", 1, "u2"), ("a", 2, "u4"), ("a", 3, "u5"), ("a", 4, "u6"), ("a", 5, "u8"), ("a", 6, "u99")]
    details = spark.createDataFrame(rows, "run_id string, seq long, url string").withColumn("platform", F.lit("Indeed"))
    urls = pd.DataFrame({"url": [r[2] for r in rows[:-1]]})
    captured = spark.createDataFrame(urls.assign(reply=make_scorer()(urls)))
    saved = spark.createDataFrame([("a", "t1||lighthouse"), ("a", "other")], "run_id string, job_key string")
    postings, rejected = curate.curate(details, captured, saved, target=4)
    assert sorted(r.job_url for r in postings.collect()) == ["u2", "u8"]
    assert {(r.url, r.status) for r in rejected.collect()} == {("u5", "not_qualified"), ("u99", "call_failed")}
