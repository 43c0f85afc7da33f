"""Links out of HTML by built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postsieve.functions.text import let

# What a page does not hold as elements: comments, and the insides of elements whose content is not parsed.
_HIDDEN = r"(?is)<!--.*?-->|<(script|style|noscript|textarea|template)\b.*?</\1\s*>"
_ANCHOR = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
# Named character references met in addresses. The ampersand comes last, as what it makes is plain text.
_NAMED = [
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&sol;", "/"),
    ("&quest;", "?"),
    ("&equals;", "="),
    ("&num;", "#"),
    ("&colon;", ":"),
    ("&period;", "."),
    ("&percnt;", "%"),
    ("&plus;", "+"),
    ("&lowbar;", "_"),
    ("&nbsp;", "\u00a0"),
]
_NUMERIC = r"(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});?"


def _character(reference: Column) -> Column:
    """The character of a numeric reference, from its UTF-32 code."""
    digits = F.regexp_replace(reference, "(?i)[&#x;]", "")
    code = F.when(reference.rlike("(?i)x"), digits).otherwise(F.conv(digits, 10, 16))
    return F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32")


def decode_entities(text: Column) -> Column:
    """Numeric references and common named ones replaced by their characters, in one pass."""

    def numeric(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(_NUMERIC), 0)
        parts = F.split(t, _NUMERIC, -1)
        joined = lambda p: F.array_join(F.transform(p, lambda x, i: F.concat(named(x), F.coalesce(_character(F.get(found, i)), F.lit("")))), "")
        return let(parts, joined)

    def named(t: Column) -> Column:
        for reference, character in _NAMED:
            t = F.replace(t, F.lit(reference), F.lit(character))
        return F.replace(t, F.lit("&amp;"), F.lit("&"))

    return F.when(F.contains(text, F.lit("&")), numeric(text)).otherwise(text)


def hrefs(html: Column) -> Column:
    """Targets of all anchors in document order, decoded; comments and what a page does not show as elements aside."""
    quoted = F.regexp_extract_all(F.regexp_replace(html, _HIDDEN, ""), F.lit(_ANCHOR), 1)
    return F.transform(quoted, lambda q: decode_entities(F.regexp_replace(q, "^[\"']|[\"']$", "")))
