"""URL resolution and canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsieve.functions.text import encode_path, encode_query, js_trim, let

_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*:"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, rf"^{_SCHEME}//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def origin_of(url: Column) -> Column:
    return F.regexp_extract(url, rf"^({_SCHEME}//[^/?#]*)", 1)


def path_of(url: Column) -> Column:
    """Path of an absolute URL, ``/`` where there is none."""
    return F.concat(F.lit("/"), F.regexp_extract(url, rf"^{_SCHEME}//[^/?#]*/?([^?#]*)", 1))


def query_value(url: Column, name: str) -> Column:
    """First value of a query parameter, decoded; null if absent or empty."""
    raw = F.regexp_extract(url, rf"^[^?#]*\?(?:[^#]*?&)??{name}=([^&#]*)", 1)
    return let(raw, lambda r: F.when(r != "", F.coalesce(F.try_url_decode(r), r)))


def _kept_segments(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.aggregate(
        F.slice(parts, 2, F.size(parts)),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments."""
    slash = F.when(path.rlike(r"[^/]/.*/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.regexp_replace(F.concat(F.lit("/"), F.array_join(_kept_segments(path), "/"), slash), "^//$", "/")
    return F.when(path.rlike(r"/\.{1,2}(?:/|$)"), joined).otherwise(path)


def _absolute(h: Column, base: Column) -> Column:
    origin = origin_of(base)
    return (
        F.when(h.rlike("^(?i:https?):"), F.regexp_replace(h, "^(?i:(https?)):/*", "$1://"))
        .when(h.rlike(f"^{_SCHEME}"), F.lit(None).cast("string"))
        .when(h.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), h))
        .when(h.startswith("/"), F.concat(origin, h))
        .when(h.startswith("?"), F.concat(origin, path_of(base), h))
        .when(h.startswith("#") | (h == ""), F.concat(F.regexp_extract(base, "^([^#]*)", 1), h))
        .otherwise(F.concat(origin, F.regexp_extract(path_of(base), "^(.*/)", 1), h))
    )


def _normal(url: Column) -> Column:
    tail = F.regexp_extract(url, r"^[^?#]*([?#].*)?$", 1)
    path = let(path_of(url), _without_dots)
    # The host has to be non-empty and free of blanks, or the link is malformed.
    return F.when(
        url.rlike(r"^(?i:https?)://[^/?#\s]+(?:[/?#]|$)"),
        F.concat(F.lower(origin_of(url)), encode_path(path), encode_query(tail)),
    )


def resolve_url(href: Column, base: Column) -> Column:
    """Absolute form of a link found on page ``base``; null if it is not a web link."""
    return let(js_trim(href), lambda h: let(_absolute(h, base), _normal))
