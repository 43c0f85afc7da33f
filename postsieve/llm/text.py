"""Column expressions over whole texts, shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what separates words.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key(text: Column) -> Column:
    """A hash of a text, null like empty, to find rows again beside their doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"{BLANK}+"), lambda w: w != "")


def window_hashes(hashes: Column, width_log2: int) -> Column:
    """Hash of the ``2 ** width_log2`` words from each position on, by doubling; one entry per whole window."""

    def doubled(step: int) -> Callable[[Column], Column]:
        return lambda h: F.zip_with(h, F.slice(h, step + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))

    out = hashes
    for k in range(width_log2):
        out = let(out, doubled(1 << k))
    return let(out, lambda h: F.slice(h, 1, F.greatest(F.size(h) - (1 << width_log2) + 1, F.lit(0))))


def repeated_cover(windows: Column, width: int) -> Column:
    """How many positions lie in windows whose hash occurs twice or more. Sorting keeps it near linear."""

    def entries(w: Column) -> Column:
        return F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p")))

    def flagged(s: Column) -> Column:
        twin = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
        marked = F.transform(s, lambda x, i: F.when(twin(x, i), x["p"]))
        return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

    def cover(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    none = F.lit(0).cast("bigint")
    distinct = lambda w: F.size(F.array_distinct(w)) == F.size(w)
    return let(
        windows, lambda w: F.when(distinct(w), none).otherwise(let(let(F.sort_array(entries(w)), flagged), cover))
    )


def count_chars(text: Column, keep: str) -> Column:
    """How many characters of the class ``keep`` (as in a regular expression) a text has."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("bigint")
