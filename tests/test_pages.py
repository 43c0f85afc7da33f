"""Links and labelled text of captured pages, platform by platform."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from postsieve.functions import dom
from postsieve.operators import capture, links, platforms
from postsieve.operators.details import DETAIL_RULES
from postsieve.streaming.pages import append_to, stream_capture

LINKEDIN = """
<a class=x href="/jobs/view/11/?ref=a">A</a> <a href='https://www.linkedin.com/jobs/view/22'>B</a>
<a data-href="/jobs/view/98/" href="/jobs/view/engineer-33/">slug</a> <A HREF=/incareer/jobs/view/44/>C</A>
<!-- <a href="/jobs/view/99/">hidden</a> --><script>'<a href="/jobs/view/97/">'</script>
<a href="/jobs/view/11/?ref=b">A again</a> <a href="/feed/">no</a> <a>none</a>
"""
INDEED = """
<div class="job_seen_beacon"><table><tr><td><h2 class="jobTitle css"><a href="/rc/clk?jk=a1&amp;x=1">1</a></h2></td></tr></table>
<div><a href="/rc/clk?from=2">2</a></div></div>
<a href="/rc/clk?from=outside">not in a card</a>
<a class="jcs-JobTitle other" href="/viewjob?jk=&amp;t=%C3%A4">3</a>
<a data-jk="q" href="https://www.indeed.com/viewjob?jk=a1">1 again</a>
<a href="/pagead/clk?mo=r">advert without key</a> <a href="/pagead/clk?jk=b%2B2">4</a>
<a class="jcs-JobTitle">no target</a> <a class="xjcs-JobTitle" href="/viewjob?jk=zz">other class</a>
<a data-jk href="/company/x">elsewhere</a>
"""
BOSS = """
<a href="/job_detail/abc.html?lid=1#x">1</a><a href="https://www.zhipin.com/job_detail/def.html">2</a>
<a href="job_detail/ghi.html">relative without slash</a><a href="/job_detail/abc.html?lid=2">1</a><a href="/gongsi/1.html">no</a>
<a href="/job_detail/j k.html">blank</a>
"""


def found(spark, url, html):
    pages = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return links.extract_links(platforms.with_platform(pages)).first()


def test_linkedin_links(spark):
    row = found(spark, "https://www.linkedin.com/jobs/search/?x", LINKEDIN)
    assert row.links == [f"https://www.linkedin.com/jobs/view/{n}/" for n in (11, 22, 44)]
    row = found(spark, "https://www.linkedin.cn/incareer/jobs/search", LINKEDIN)
    assert row.links[0] == "https://www.linkedin.cn/incareer/jobs/view/11/"


def test_indeed_links(spark):
    row = found(spark, "https://www.indeed.com/jobs?q=a", INDEED)
    assert row.links == [
        "https://www.indeed.com/viewjob?jk=a1",
        "https://www.indeed.com/rc/clk?from=2",
        "https://www.indeed.com/viewjob?jk=&t=%C3%A4",
        "https://www.indeed.com/viewjob?jk=b+2",
    ]


def test_boss_links(spark):
    row = found(spark, "https://www.zhipin.com/web/geek/job?page=1", BOSS)
    assert row.platform == "Boss直聘"
    assert row.links == [
        "https://www.zhipin.com/job_detail/abc.html",
        "https://www.zhipin.com/job_detail/def.html",
        "https://www.zhipin.com/job_detail/j%20k.html",
    ]


def test_no_links(spark):
    assert found(spark, "https://www.indeed.com/jobs", "<p>nothing").links == []
    assert found(spark, "https://www.linkedin.com/jobs", None).links == []
    assert found(spark, "https://elsewhere.com/", LINKEDIN) is None


def test_references_and_unparsed_elements(spark):
    html = """<a href='/jobs&#47;view/2/'>a</a><a href="&#x2F;jobs/view/3/?a=1&amp;b=2">b</a><a href="/jobs/view/4&sol;">c</a>
      <noscript><a href="/jobs/view/5/">n</a></noscript><textarea><a href="/jobs/view/6/"></textarea>
      <a href="/jobs/view/7/?x=&amp;#47;">d</a>"""
    got = found(spark, "https://www.linkedin.com/jobs/search/", html).links
    assert got == [f"https://www.linkedin.com/jobs/view/{k}/" for k in (2, 3, 4, 7)]


def test_a_page_that_breaks_the_parser_is_marked(spark, monkeypatch):
    rows = [(1, "https://www.indeed.com/viewjob?jk=1", "<h1>T</h1><![bad"), (2, "https://www.indeed.com/jobs", "<![bad")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for row in capture.capture(pages).collect():
        assert row.parse_failed in (True, False)


def text_of(spark, url, html):
    pages = spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")
    return capture.capture(pages).first().text


def test_linkedin_detail(spark):
    html = """<h1> Plain </h1><div class="jobs-unified-top-card__job-title"> </div>
      <a href="/company/acme/"> Acme &amp; Co </a><span class="topcard__flavor--bullet">Berlin</span>
      <main>main <div id="job-details"><p>One</p>two<br>three<div hidden-not>four <b>five</b></div>
      <ul><li>x<li>y</ul><script>no()</script></div> rest</main>"""
    assert text_of(spark, "https://www.linkedin.com/jobs/view/1/", html) == (
        "Title: Plain\nCompany: Acme & Co\nLocation: Berlin\n\nJob Description:\nOne\ntwo\nthree\nfour five\nx\ny"
    )


def test_first_match_of_a_selector_counts(spark):
    html = """<span class="topcard__org-name-link"> </span><span class="topcard__org-name-link">Late</span>
      <a href="/company/1">By link</a>"""
    assert text_of(spark, "https://www.linkedin.com/jobs/view/1/", html) == "Company: By link"


def test_indeed_detail(spark):
    html = """<h1 class="jobsearch-JobInfoHeader-title">Dev <span>- job post</span></h1>
      <div class="jobsearch-InlineCompanyRating-companyHeader"><b><a>Corp</a></b></div>
      <div class="jobsearch-JobInfoHeader-subtitle"><div>Corp</div><p>x</p><div> Paris <i>10</i></div></div>
      <div id="salaryInfoAndJobType">30 &euro;</div><main>skip</main>
      <div class="jobsearch-jobDescriptionText">   </div><div id="jobDescriptionText">later</div>"""
    # The body is the first match in the document, even when it is empty.
    assert text_of(spark, "https://www.indeed.com/viewjob?jk=1", html) == (
        "Title: Dev - job post\nCompany: Corp\nLocation: Paris 10\nSalary: 30 €\n\nJob Description:\n"
    )


def test_last_child_must_be_last(spark):
    html = '<div class="jobsearch-JobInfoHeader-subtitle"><div>a</div><p>x</p></div><main>m</main>'
    assert text_of(spark, "https://www.indeed.com/viewjob?jk=1", html) == "\nPage Content:\nm"


def test_boss_detail(spark):
    html = """<div class="job-name">AI工程师</div><div class="company-info"><p class="name">公司</p></div>
      <span class="job-area">北京</span><em class="big-salary-x">20K</em>
      <div class="tag-list"><span>在校</span><span>本科</span></div>
      <div class="job-box"><div class="text">Outer<div>In <div>Deep</div></div>End</div></div>"""
    assert text_of(spark, "https://www.zhipin.com/job_detail/1.html", html) == (
        "Title: AI工程师\nCompany: 公司\nLocation: 北京\nSalary: 20K\nTags: 在校本科\n\nJob Description:\nOuter\nIn\nDeep\nEnd"
    )


def test_boss_fallback(spark):
    html = '<h1>T</h1><main><pre>a\n b</pre>c</main>'
    got = text_of(spark, "https://www.zhipin.com/job_detail/1.html", html)
    assert got == "Title: T\n\nPage Content:\na b\nc"


def test_empty_page(spark):
    assert text_of(spark, "https://www.zhipin.com/job_detail/1.html", "") == ""


CAPTURED = [
    (1, "https://www.linkedin.com/jobs/search/", LINKEDIN),
    (2, "https://www.linkedin.com/jobs/view/5/?trk=x", "<h1>T</h1>"),
    (3, "https://www.linkedin.com/checkpoint/jobs/view/6/", "<h1>T</h1>"),
    (4, "https://elsewhere.com/", "<h1>T</h1>"),
]


def check_captured(rows):
    got = {r.page_id: r for r in rows}
    assert sorted(got) == [1, 2, 3]
    assert (len(got[1].links), got[1].text, got[1].job_url) == (3, "", None)
    assert (got[2].links, got[2].text, got[2].job_url) == ([], "Title: T", "https://www.linkedin.com/jobs/view/5/")
    assert (got[3].links, got[3].text, got[3].walled) == ([], "", True)


def test_capture(spark):
    check_captured(capture.capture(spark.createDataFrame(CAPTURED, "page_id long, url string, html string")).collect())


def test_stream_capture(spark, tmp_path):
    df = spark.createDataFrame(CAPTURED, "page_id long, url string, html string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        append_to(stream_capture(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 3
    check_captured(rows)


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://a.com/login?x", True),
        ("https://a.com/user/login", True),
        ("https://a.com/x?next=/challenge", True),
        ("https://a.com/Login", False),
        ("https://a.com/jobs", False),
        (None, False),
    ],
)
def test_auth_wall(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(platforms.is_auth_wall(F.col("u")).alias("w")).first().w is want


def test_skip_walled(spark):
    rows = [("r", 0, 1, "/a"), ("r", 0, 2, "/login"), ("r", 0, 3, "/b"), ("r", 1, 4, "/c"), ("s", 0, 5, "/d")]
    df = spark.createDataFrame(rows, "run_id string, platform_idx int, seq long, url string")
    assert {r.seq for r in platforms.skip_walled_platform(df).collect()} == {1, 4, 5}


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_recency(spark, kind):
    rows = [("LinkedIn", 89), ("LinkedIn", 91), ("Indeed", 90), ("Boss直聘", 31), ("Boss直聘", 30), ("Other", 1)]
    as_of = dt.datetime(2024, 6, 1)
    rows = [(p, d, (as_of - dt.timedelta(days=d)).isoformat(" ")) for p, d in rows]
    df = spark.createDataFrame(rows, "platform string, days int, at string")
    df = df.withColumn("posted_at", F.col("at").cast(kind))
    got = {(r.platform, r.days) for r in platforms.recency_filter(df, as_of).collect()}
    assert got == {("LinkedIn", 89), ("Indeed", 90), ("Boss直聘", 30)}


def test_recency_reaches_the_scan(spark, tmp_path):
    spark.sql("SELECT 'Indeed' AS platform, timestamp_ntz '2024-01-01 00:00:00' AS posted_at").write.parquet(str(tmp_path / "p"))
    df = platforms.recency_filter(spark.read.parquet(str(tmp_path / "p")), dt.datetime(2024, 1, 31))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(posted_at" in plan.split("PushedFilters")[1]


def test_seniority(spark):
    rows = [("LinkedIn", "1"), ("LinkedIn", "3"), ("Indeed", "9"), ("Boss直聘", "102"), ("Boss直聘", "1")]
    df = spark.createDataFrame(rows, "platform string, level string")
    got = {tuple(r) for r in platforms.seniority_filter(df).collect()}
    assert got == {("LinkedIn", "1"), ("Indeed", "9"), ("Boss直聘", "102")}


def _random_page(rng, marks):
    """Markup put together at random, plain and not."""
    tags = ["div", "p", "span", "h1", "a", "b", "br", "main", "script", "style", "li", "IMG", "title", "template"]
    values = [*marks, "x", "a b", "", "/company/x?a=1&amp;b=2", "a&#98;c"]

    def attribute():
        name = rng.choice(["class", "id", "href", "data-testid", "CLASS", "x-y", "data-jk"])
        value = " ".join(rng.choices(values, k=rng.choice([1, 1, 2])))
        return rng.choice([f' {name}="{value}"', f" {name}='{value}'", f" {name}", f" {name} = {value.split(' ')[0] or 'v'}"])

    odd = ["<", "< b", "</>", "<!-", "<!-- a <div> -->", "<!-->", "<!doctype html>", "<?php x ?>", "<![CDATA[x]]>", "&", "&am", '<a b="', "<p/ >", '<i a="1"b>', "</p x>", "<script/>"]
    plain = ["text", " and\n more ", "&amp;", "&lt;b&gt;", "&nbsp;", "1 > 0", "é", "<!-- <p> -->", "</ul>"]
    out = []
    for _ in range(rng.randrange(1, 40)):
        tag = rng.choice(tags)
        kind = rng.random()
        if kind < 0.45:
            out.append(f"<{tag}{''.join(attribute() for _ in range(rng.randrange(3)))}{rng.choice(['', '', '', ' /'])}>")
        elif kind < 0.75:
            out.append(f"</{tag}{rng.choice(['', ' '])}>")
        else:
            out.append(rng.choice(plain if rng.random() < 0.97 else odd))
    return "".join(out)


def test_scanned_pages_give_what_the_parser_gives():
    rng = random.Random(6)
    plans = []
    for rules in DETAIL_RULES.values():
        marks = sorted(set().union(*(s.marks for p in rules.picks for s in p.any_of)))
        plans.append((dom.Plan(rules.picks), marks))
    anchors = (dom.Sel(tag="a", cls=("x",)), dom.Sel(tag="a", has="data-jk"), dom.Sel(tag="a", inside=dom.Sel(cls=("a",))))
    plans.append((dom.Plan(anchors=anchors), ["x", "a"]))
    scanned = 0
    for k in range(6000):
        plan, marks = plans[k % len(plans)]
        page = _random_page(rng, marks)
        got, want = dom._Finder(plan).run(page), dom._Finder(plan).parse(page)
        assert (got.texts, got.targets) == (want.texts, want.targets), page
        scanned += dom._Finder(plan)._scan(page)
    assert 2000 < scanned < 5900
