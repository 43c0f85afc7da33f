"""Links and texts of captured pages in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.operators.details import extract_detail_text
from postsieve.operators.links import extract_links, job_link
from postsieve.operators.platforms import is_auth_wall, with_platform


def canonical_job_url(url: Column, platform: Column) -> Column:
    """The job URL a page stands for, null for pages that are not job pages.

    Redirects and tracking parameters make the address of a visited page differ from
    the link that led there; visits are compared in this form.
    """
    return job_link(url, url, platform)


def capture(pages: DataFrame) -> DataFrame:
    """Pages of known platforms with ``platform, job_url, walled, links, text, parse_failed``.

    A page with a ``job_url`` is a detail page and gives ``text``; any other is a
    listing page and gives ``links``. Walled pages give neither.
    """
    named = with_platform(pages)
    named = named.withColumns(
        {"job_url": canonical_job_url(F.col("url"), F.col("platform")), "walled": is_auth_wall(F.col("url"))}
    )
    detail = F.col("job_url").isNotNull()
    split = named.withColumns(
        {
            "_listing": F.when(~F.col("walled") & ~detail, F.col("html")),
            "_detail": F.when(~F.col("walled") & detail, F.col("html")),
        }
    ).drop("html")
    listed = extract_links(split, html="_listing").withColumnRenamed("parse_failed", "_failed")
    found = extract_detail_text(listed, html="_detail")
    return found.withColumn("parse_failed", F.col("parse_failed") | F.col("_failed")).drop("_failed")
