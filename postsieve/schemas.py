"""Record types and their defaults."""

from __future__ import annotations

from pyspark.sql import types as T

_TAGS = T.ArrayType(T.StringType(), containsNull=False)

POSTING = T.StructType(
    [
        T.StructField("title", T.StringType(), False),
        T.StructField("company", T.StringType(), False),
        T.StructField("location", T.StringType(), False),
        T.StructField("salary", T.StringType(), False),
        T.StructField("tech_tags", _TAGS, False),
        T.StructField("requirements", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("job_url", T.StringType(), False),
    ]
)
POSTING_COLUMNS = POSTING.fieldNames()

REPLY_FLAGS = ("is_ai_engineer", "is_campus_or_intern")
REPLY_TEXTS = ("title", "company", "location", "salary", "requirements")

PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

# One row per run. Collections that grow with a run (visited URLs, saved keys, the
# frontier) are tables of their own, keyed by run_id.
RUN_STATE = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("target", T.IntegerType()),
        T.StructField("collected", T.IntegerType()),
        T.StructField("current_keyword_index", T.IntegerType()),
        T.StructField("current_page", T.IntegerType()),
        T.StructField("pages_per_keyword", T.IntegerType()),
        T.StructField("max_pages_per_keyword", T.IntegerType()),
        T.StructField("consecutive_dupes", T.IntegerType()),
        T.StructField("current_platform_index", T.IntegerType()),
        T.StructField("active_tab_id", T.LongType()),
        T.StructField("selected_platform_indices", T.ArrayType(T.IntegerType())),
        T.StructField("last_updated", T.LongType()),
    ]
)

# Defaults of a run.
RUN_DEFAULTS = {
    "status": "idle",
    "target": 50,
    "collected": 0,
    "current_keyword_index": 0,
    "current_page": 1,
    "pages_per_keyword": 0,
    "max_pages_per_keyword": 10,
    "consecutive_dupes": 0,
    "current_platform_index": 0,
    "active_tab_id": None,
    "selected_platform_indices": [0, 1, 2],
    "last_updated": 0,
}

STOPPED = ("idle", "done", "error")
