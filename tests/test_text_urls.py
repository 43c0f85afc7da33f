"""Text and URL functions."""

from urllib.parse import quote

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postsieve.functions import text, urls
from postsieve.sources import search_plan as sp


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_trim_and_key(spark):
    blanks = "\t\n\x0b\x0c\r        　﻿"
    assert one(spark, text.js_trim(F.col("a")), a=f"{blanks}a　b{blanks}") == "a　b"
    assert one(spark, text.js_trim(F.col("a")), a="​a\x1c") == "​a\x1c"
    assert one(spark, text.job_key(F.col("a"), F.col("b")), a=" ML Intern ", b="ACME ") == "ml intern||acme"


@pytest.mark.parametrize("n", [4999, 5000, 5001, 9000])
def test_clip(spark, n):
    want = "ä" * n if n <= 5000 else "ä" * 5000 + "..."
    assert one(spark, text.clip(F.col("a")), a="ä" * n) == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\0")), min_size=30, max_size=60))
def test_encode_component(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", text.encode_component(F.col("t")).alias("e")).collect():
        assert row.e == quote(row.t, safe="-_.!~*'()")


@pytest.mark.parametrize(
    "href, base, want",
    [
        ("/a/b?x=1", "https://h.com/q/w?z", "https://h.com/a/b?x=1"),
        ("b", "https://h.com/q/w?z", "https://h.com/q/b"),
        ("../b/./c", "https://h.com/q/w/e?z", "https://h.com/q/b/c"),
        ("a/..", "https://h.com/q/", "https://h.com/q/"),
        ("../../..", "https://h.com/q/", "https://h.com/"),
        ("//o.com/x", "https://h.com", "https://o.com/x"),
        ("HTTPS://O.com", "http://h.com", "https://o.com/"),
        ("mailto:x", "https://h.com", None),
        ("javascript:void(0)", "https://h.com", None),
        ("?p=2", "https://h.com/q#f", "https://h.com/q?p=2"),
        ("#top", "https://h.com/q?a#f", "https://h.com/q?a#top"),
        ("", "https://h.com/q", "https://h.com/q"),
        ("/für x?ä=%20", "https://h.com", "https://h.com/f%C3%BCr%20x?%C3%A4=%20"),
        ("http://", "https://h.com", None),
        (" /t ", "https://h.com/", "https://h.com/t"),
    ],
)
def test_resolve(spark, href, base, want):
    assert one(spark, urls.resolve_url(F.col("h"), F.col("b")), h=href, b=base) == want


@pytest.mark.parametrize(
    "url, want",
    [
        ("http://x/?a=1&jk=%E4%BD%A0+b&jk=2", "你 b"),
        ("http://x/?jk=a&jk=2", "a"),
        ("http://x/?jk=&a=1", None),
        ("http://x/?ajk=3", None),
        ("http://x/#?jk=3", None),
        ("http://x/?jk=%zz", "%zz"),
    ],
)
def test_query_value(spark, url, want):
    assert one(spark, urls.query_value(F.col("u"), "jk"), u=url) == want


def test_host(spark):
    assert one(spark, urls.host_of(F.col("u")), u="https://me@WWW.Indeed.com:80/x@y") == "www.indeed.com"


@pytest.fixture(scope="module")
def planned(spark):
    rows = sp.search_urls(sp.select_platforms(sp.search_plan(spark))).collect()
    return {(r.platform_idx, r.keyword_idx, r.page_no): r.search_url for r in rows}


def test_plan_size(planned):
    assert [len(p["keywords"]) for p in sp.PLATFORMS] == [20, 20, 24]
    assert len(planned) == 64 * 10


def test_search_urls(planned):
    first = "https://www.linkedin.com/jobs/search/?keywords=AI%20Engineer%20intern&f_E=1%2C2&f_TPR=r7776000&start="
    assert [planned[0, 0, p] for p in (1, 2, 3)] == [first + s for s in ("0", "25", "50")]
    first = "https://www.indeed.com/jobs?q=AI%20Engineer%20intern&fromage=90&start="
    assert [planned[1, 0, p] for p in (1, 2, 4)] == [first + s for s in ("0", "10", "30")]
    url = planned[2, 0, 3]
    assert url.startswith("https://www.zhipin.com/web/geek/job?query=AI%E5%B7%A5%E7%A8%8B%E5%B8%88%20%E6%A0%A1%E6%8B%9B&")
    assert url.endswith("&city=100010000&publishTime=3&experience=101%2C102&page=3")
    assert "start=" not in url


def test_select_platforms(spark):
    chosen = sp.select_platforms(sp.search_plan(spark), [2, 0]).select("platform_idx", "platform_pos").distinct()
    assert {tuple(r) for r in chosen.collect()} == {(2, 0), (0, 1)}


def test_toggle(spark):
    df = spark.createDataFrame([([0, 1, 2], 1), ([0, 2], 1), ([], 2)], "c array<int>, i int")
    got = df.select(sp.toggle_platform(F.col("c"), F.col("i")).alias("x")).collect()
    assert [r.x for r in got] == [[0, 2], [0, 1, 2], [2]]
