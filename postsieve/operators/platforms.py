"""Which platform a page belongs to, login walls, and board-side filters."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions.text import contains_any
from postsieve.functions.urls import host_of
from postsieve.sources.search_plan import PLATFORMS

# Parts of a URL that mark a login or captcha page.
AUTH_WALL_PATTERNS = [
    "/login",
    "/signin",
    "/checkpoint",
    "/authwall",
    "/uas/login",
    "/challenge",
    "/regwall",
    "/passport/login",
    "/user/login",
]

HOST_MARKS = [(p["host_mark"], p["name"]) for p in PLATFORMS]


def platform_of(host: Column, marks: list[tuple[str, str]] = HOST_MARKS) -> Column:
    """Name of the first platform whose mark the host contains, else null."""
    name = F.lit(None).cast("string")
    for mark, platform in reversed(marks):
        name = F.when(F.contains(host, F.lit(mark)), F.lit(platform)).otherwise(name)
    return name


def with_platform(pages: DataFrame, marks: list[tuple[str, str]] = HOST_MARKS) -> DataFrame:
    """Pages of a known platform; others are ignored."""
    named = pages.withColumn("platform", platform_of(host_of(F.col("url")), marks))
    return named.filter(F.col("platform").isNotNull())


def is_auth_wall(url: Column, patterns: list[str] = AUTH_WALL_PATTERNS) -> Column:
    """Whether the URL, query string included, holds a wall pattern (case sensitive)."""
    return F.coalesce(contains_any(url, patterns), F.lit(False))


def first_walls(
    visits: DataFrame, keys: list[str], order: str = "seq", url: str = "url", patterns: list[str] = AUTH_WALL_PATTERNS
) -> DataFrame:
    """Place ``_wall`` of the first walled page per key: one minimum, aggregated before the shuffle."""
    return visits.filter(is_auth_wall(F.col(url), patterns)).groupBy(*keys).agg(F.min(order).alias("_wall"))


def before_walls(visits: DataFrame, walls: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Visits before their key's ``_wall``; keys without a wall are kept."""
    after = reduce(lambda a, b: a & b, [F.col(f"v.{k}") == F.col(f"w.{k}") for k in keys])
    after = after & (F.col(f"v.{order}") >= F.col("w._wall"))
    return visits.alias("v").join(walls.alias("w"), after, "left_anti")


def skip_walled_platform(
    visits: DataFrame,
    keys: list[str] = ["run_id", "platform_idx"],
    order: str = "seq",
    url: str = "url",
    patterns: list[str] = AUTH_WALL_PATTERNS,
) -> DataFrame:
    """Visits before the first walled page of their platform in the run.

    The visits are never sorted within a platform. Platforms without a wall are kept.
    """
    return before_walls(visits, first_walls(visits, keys, order, url, patterns), keys, order)


def _any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def recency_filter(
    df: DataFrame,
    as_of: dt.datetime,
    platform: str = "platform",
    posted_at: str = "posted_at",
    windows: dict[str, int] | None = None,
) -> DataFrame:
    """Postings no older than their platform's window in days.

    Written as literal comparisons, so that the Parquet scan can skip row groups.
    """
    windows = windows or {p["name"]: p["window_days"] for p in PLATFORMS}
    kind = df.schema[posted_at].dataType

    def since(days: int) -> Column:
        # Of the column's own type: a cast on the column would keep the filter from the scan.
        return F.lit((as_of - dt.timedelta(days=days)).isoformat(sep=" ")).cast(kind)

    return df.filter(
        _any_of(
            [
                (F.col(platform) == name) & (F.col(posted_at) >= since(days))
                for name, days in windows.items()
            ]
        )
    )


def seniority_filter(
    df: DataFrame,
    platform: str = "platform",
    level: str = "level",
    levels: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Postings at an accepted level; platforms without level codes pass through."""
    levels = levels if levels is not None else {p["name"]: p["levels"] for p in PLATFORMS}
    return df.filter(
        _any_of(
            [
                (F.col(platform) == name) & (F.col(level).isin(codes) if codes else F.lit(True))
                for name, codes in levels.items()
            ]
        )
    )


def attach_source(details: DataFrame, platforms: DataFrame, key: str = "platform_idx") -> DataFrame:
    """Look up the platform of each row.

    No broadcast hint: Spark broadcasts the lookup side when its measured size is
    below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides otherwise.
    """
    return details.join(platforms, key)
