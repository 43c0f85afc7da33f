"""Strict reading of scorer replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.functions.text import with_computed
from postsieve.schemas import POSTING_COLUMNS, REPLY_FLAGS, REPLY_TEXTS


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def parse_reply_strict(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Add ``status`` and the eight fields of a valid reply as ``extraction``.

    A reply is valid if it is one JSON object with every field of the exact type:
    no coercion, no nulls; unknown keys are ignored and the last of a repeated key
    counts (needs ``spark.sql.variant.allowDuplicateKeys``). ``status`` is

    - ``call_failed``: there is no reply,
    - ``not_json``: the reply is not one JSON value,
    - ``bad_schema``: a field is missing or of another type,
    - ``not_qualified``: a flag is false,
    - ``ok``.
    """
    text = F.col(reply)
    # The JSON reader stops after the first value. Closing the text with two kinds of
    # bracket shows whether something other than blanks follows it.
    in_list = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    items = F.try_variant_get(F.col("_list"), "$", "array<variant>")
    parsed = df.withColumns({"_list": in_list, "_object": in_object}).withColumn(
        "_json", F.when(F.col("_object").isNotNull() & (F.size(items) == 1), F.element_at(items, 1))
    )

    def field(name: str) -> Column:
        return F.try_variant_get("_json", f"$.{name}", "variant")

    def typed(name: str, kind: str) -> Column:
        return F.try_variant_get("_json", f"$.{name}", kind)

    tags = typed("tech_tags", "array<string>")
    tags_ok = F.schema_of_variant(field("tech_tags")).isin("ARRAY<STRING>", "ARRAY<VOID>") & F.forall(
        tags, lambda t: t.isNotNull()
    )
    exact = _all(
        [F.schema_of_variant(field(f)) == "BOOLEAN" for f in REPLY_FLAGS]
        + [F.schema_of_variant(field(f)) == "STRING" for f in REPLY_TEXTS]
        + [tags_ok]
    )
    extraction = F.struct(
        *[typed(f, "boolean").alias(f) for f in REPLY_FLAGS],
        *[typed(f, "string").alias(f) for f in REPLY_TEXTS],
        tags.alias("tech_tags"),
    )
    valid = parsed.withColumn("_extraction", F.when(F.coalesce(exact, F.lit(False)), extraction))
    made = F.col("_extraction")
    status = (
        F.when(text.isNull(), "call_failed")
        .when(F.col("_json").isNull(), "not_json")
        .when(made.isNull(), "bad_schema")
        .when(~_all([made[f] for f in REPLY_FLAGS]), "not_qualified")
        .otherwise("ok")
    )
    read = with_computed(valid, status=status, extraction=made)
    return read.drop("_list", "_object", "_json", "_extraction")


def qualify(df: DataFrame) -> DataFrame:
    """Postings for AI engineers at entry level."""
    return df.filter(_all([F.col(f) for f in REPLY_FLAGS]))


def to_posting(df: DataFrame, *extra: str, platform: str = "platform", url: str = "url") -> DataFrame:
    """Qualified replies as postings; source and URL are those of the page, never the scorer's."""
    fields = {f: F.col(f"extraction.{f}") for f in (*REPLY_TEXTS, "tech_tags")}
    fields |= {"source": F.col(platform), "job_url": F.col(url)}
    return df.filter(F.col("status") == "ok").select(*extra, *[fields[c].alias(c) for c in POSTING_COLUMNS])


def rejects(df: DataFrame) -> DataFrame:
    """Replies that gave no posting, with their ``status``; kept for review and replay."""
    return df.filter(F.col("status") != "ok").drop("extraction")


def replayable(rejected: DataFrame) -> DataFrame:
    """Rejects worth another call: those the scorer never answered."""
    return rejected.filter(F.col("status") == "call_failed")


# Tags a title stands for where a reply names none.
TITLE_TAGS = [("ml engineer", ["Machine Learning"]), ("ai engineer", ["AI", "Machine Learning"])]


def quality_checks(postings: DataFrame) -> DataFrame:
    """Flag what the prompt demands but a valid reply may lack, and fill tags from the title."""
    filled = F.col("tech_tags")
    for title, tags in reversed(TITLE_TAGS):
        hit = (F.size("tech_tags") == 0) & F.contains(F.lower("title"), F.lit(title))
        filled = F.when(hit, F.array(*[F.lit(t) for t in tags])).otherwise(filled)
    return postings.withColumns(
        {
            "no_tags": F.size("tech_tags") == 0,
            "no_requirements": F.col("requirements") == "",
            "filled_tags": filled,
        }
    )
