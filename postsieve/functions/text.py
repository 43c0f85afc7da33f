"""Text functions with the semantics of ECMAScript strings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code points ECMAScript trims (white space and line terminators).
BLANKS = "".join(
    map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)

# Characters encodeURIComponent leaves alone but url_encode does not,
# and the blank, which it writes as %20.
_COMPONENT = (
    ("+", "%20"),
    ("%21", "!"),
    ("%27", "'"),
    ("%28", "("),
    ("%29", ")"),
    ("%7E", "~"),
)

# Further characters that stand as they are in the path of a URL.
_PATH = (
    ("%24", "$"),
    ("%26", "&"),
    ("%2B", "+"),
    ("%2C", ","),
    ("%2F", "/"),
    ("%3A", ":"),
    ("%3B", ";"),
    ("%3D", "="),
    ("%40", "@"),
    ("%5B", "["),
    ("%5D", "]"),
    ("%7C", "|"),
    ("%25", "%"),
)

# What else stands as it is in a query or fragment.
_QUERY = (("%23", "#"), ("%3F", "?"), ("%5C", "\\"), ("%5E", "^"), ("%60", "`"), ("%7B", "{"), ("%7D", "}"))


def _swap(text: Column, pairs) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it.

    Columns nest by copying; without this, chains of conditionals over one text grow
    exponentially, inside lambda functions above all.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def with_computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns whose values are computed once, also where they are filtered on.

    The optimizer pushes a filter on a plain column below it and repeats the whole
    expression there; it cannot push one below a generated column.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def js_trim(text: Column) -> Column:
    """Trim all Unicode white space, where a plain ``trim`` strips U+0020 only."""
    return F.trim(text, F.lit(BLANKS))


def job_key(title: Column, company: Column) -> Column:
    """Identity of a posting: lower-cased, trimmed title and company."""
    return F.concat(js_trim(F.lower(title)), F.lit("||"), js_trim(F.lower(company)))


def encode_component(text: Column) -> Column:
    return _swap(F.url_encode(text), _COMPONENT)


def _encode_rest(text: Column, pairs) -> Column:
    coded = lambda t: F.when(t.rlike(r"[^\x21-\x7e]"), _swap(F.url_encode(t), pairs)).otherwise(t)
    return let(text, coded)


def encode_path(path: Column) -> Column:
    """Percent-encode what a URL path may not hold, leaving existing escapes alone."""
    return _encode_rest(path, _COMPONENT + _PATH)


def encode_query(tail: Column) -> Column:
    """The same for a query or fragment, its leading mark included."""
    return _encode_rest(tail, _COMPONENT + _QUERY + _PATH)


def clip(text: Column, limit: int = 5000) -> Column:
    """At most ``limit`` characters, marked with an ellipsis where text was cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def filled(text: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(text, F.lit(""))


def contains_any(text: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])
