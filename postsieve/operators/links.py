"""Job links out of listing pages, one rule set per platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions.dom import Sel, anchor_targets
from postsieve.functions.html import hrefs
from postsieve.functions.text import let
from postsieve.functions.urls import host_of, path_of, query_value, resolve_url

# Which anchors of an Indeed result page lead to jobs.
INDEED_ANCHORS = (
    Sel(tag="a", cls=("jcs-JobTitle",)),
    Sel(tag="a", has="data-jk"),
    Sel(tag="a", inside=Sel(tag="h2", cls=("jobTitle",))),
    Sel(tag="a", part=("href", "/rc/clk"), inside=Sel(cls=("job_seen_beacon",))),
    Sel(tag="a", part=("href", "/pagead/clk")),
)


def _linkedin_form(full: Column, href: Column, page_url: Column) -> Column:
    """Canonical URL by job number, on the domain of the page."""
    in_china = F.contains(host_of(page_url), F.lit("linkedin.cn"))
    start = F.when(in_china, F.lit("https://www.linkedin.cn/incareer/jobs/view/")).otherwise(
        F.lit("https://www.linkedin.com/jobs/view/")
    )
    number = F.regexp_extract(path_of(full), r"/(?:incareer/)?jobs/view/([0-9]+)", 1)
    url = let(number, lambda n: F.when(n != "", F.concat(start, n, F.lit("/"))))
    return F.when(F.contains(href, F.lit("/jobs/view/")), url)


def _indeed_form(full: Column, href: Column) -> Column:
    """Canonical URL by job key, else the link itself if it is a job or click link."""
    key = query_value(full, "jk")
    plain = F.contains(href, F.lit("/viewjob")) | F.contains(href, F.lit("/rc/clk"))
    return F.coalesce(F.concat(F.lit("https://www.indeed.com/viewjob?jk="), key), F.when(plain, full))


def _boss_form(full: Column, href: Column) -> Column:
    """Canonical URL by path."""
    url = F.concat(F.lit("https://www.zhipin.com"), path_of(full))
    return F.when(F.contains(href, F.lit("/job_detail/")), url)


def job_link(href: Column, page_url: Column, platform: Column) -> Column:
    """Canonical job URL of a link on a page of ``platform``; null for any other link."""
    base = (
        F.when(platform == "LinkedIn", page_url)
        .when(platform == "Indeed", F.lit("https://www.indeed.com"))
        .when(platform == "Boss直聘", F.lit("https://www.zhipin.com"))
    )

    def form(full: Column) -> Column:
        return (
            F.when(platform == "LinkedIn", _linkedin_form(full, href, page_url))
            .when(platform == "Indeed", _indeed_form(full, href))
            .when(platform == "Boss直聘", _boss_form(full, href))
        )

    return let(resolve_url(href, base), form)


def distinct_links(links: Column) -> Column:
    """Links in order of first occurrence, nulls dropped."""
    return F.array_distinct(F.filter(links, lambda u: u.isNotNull()))


def page_links(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Every page with ``links``: all its link targets as written, distinct, in order."""
    return pages.withColumn("links", distinct_links(hrefs(F.col(html)))).drop(html)


def extract_links(pages: DataFrame, html: str = "html", url: str = "url", platform: str = "platform") -> DataFrame:
    """Listing pages with ``links``: canonical job URLs, distinct, in document order; ``parse_failed`` as in details.

    One pass over the pages. Only the anchors of Indeed depend on the elements around
    them; only its pages are handed to Python.
    """
    name = F.col(platform)
    in_python = F.when(name == "Indeed", F.col(html))
    found = pages.withColumn("_anchors", anchor_targets(in_python, INDEED_ANCHORS))
    found = found.withColumn("_hrefs", F.when(name == "Indeed", F.col("_anchors.targets")).otherwise(hrefs(F.col(html))))
    jobs = distinct_links(F.transform("_hrefs", lambda h: job_link(h, F.col(url), name)))
    links = F.coalesce(jobs, F.array().cast("array<string>"))
    failed = F.col("_anchors.failed")
    return found.withColumns({"links": links, "parse_failed": failed}).drop("_anchors", "_hrefs", html)


def link_rows(pages: DataFrame, keys: list[str], links: str = "links") -> DataFrame:
    """One row per link with its place on the page, from 0.

    Exploded as outer and filtered after: for an inner explode the optimizer infers a
    filter on the size of the array and pushes it to the scan, so that every link
    would be extracted twice.
    """
    rows = pages.select(*keys, F.posexplode_outer(links).alias("pos", "url"))
    return rows.filter(F.col("url").isNotNull())
