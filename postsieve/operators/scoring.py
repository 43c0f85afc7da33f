"""Prompts, the scorer hook, and rule labels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsieve.functions.text import clip, contains_any
from postsieve.operators.keyed import last_per_key

def build_prompt(
    details: DataFrame, text: str = "text", url: str = "url", limit: int = 5000, system: str | None = None
) -> DataFrame:
    """Add ``prompt`` and, unless ``system`` is None, ``system``.

    The text is clipped here, before it travels to Python.
    """
    prompt = F.concat(
        F.lit("Job URL: "), F.col(url), F.lit("\n\nJob Description:\n"), clip(F.col(text), limit)
    )
    out = details.withColumn("prompt", prompt)
    return out if system is None else out.withColumn("system", F.lit(system))


Scorer = Callable[[pd.DataFrame], pd.Series]


def score_batch(prompts: DataFrame, scorer: Scorer) -> DataFrame:
    """Add ``reply``: what ``scorer`` returns for a batch of rows, null where it failed.

    The scorer sees a pandas frame and returns one reply per row. It should set up its
    model or client once per process and retry by itself; a lost task is run again, so
    equal prompts should get equal replies.
    """
    schema = T.StructType([*prompts.schema.fields, T.StructField("reply", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = scorer(batch.to_pandas())
            # Only the reply comes from pandas, which would turn whole numbers with gaps into floats.
            reply = pa.array(replies, pa.string(), from_pandas=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, reply], names=[*batch.schema.names, "reply"])

    return prompts.mapInArrow(run, schema)


def try_batch(prompts: DataFrame, scorer: Scorer) -> DataFrame:
    """Add ``reply`` and ``error``, as :func:`score_batch` does, but for scorers that may fail.

    A scorer that raises fails for all rows of its batch; one that returns an exception or nothing in place of a reply
    fails for that row. Nothing is tried again here; see :func:`plans.curate.score_with_retries`.
    """
    schema = T.StructType([*prompts.schema.fields, T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())])

    def one(reply: object) -> tuple[str | None, str | None]:
        if isinstance(reply, BaseException):
            return None, f"{type(reply).__name__}: {reply}"
        return (reply, None) if isinstance(reply, str) else (None, "no reply")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            try:
                found = list(scorer(batch.to_pandas()))
            except Exception as failure:
                found = [failure] * batch.num_rows
            if len(found) != batch.num_rows:
                raise ValueError(f"the scorer gave {len(found)} replies to {batch.num_rows} rows")
            answers = [one(reply) for reply in found]
            columns = [pa.array([a[k] for a in answers], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "reply", "error"])

    return prompts.mapInArrow(run, schema)


def score_from_table(
    details: DataFrame, replies: DataFrame, keys: list[str] = ["url"], order: str = "reply_seq"
) -> DataFrame:
    """Add ``reply`` from a table of captured replies, null where there is none.

    Of several replies to a key the last by ``order`` counts; without that column, a reply
    that arrived before one that failed.
    """
    by = [c for c in (order, "reply") if c in replies.columns]
    return details.join(last_per_key(replies, keys, by).select(*keys, "reply"), keys, "left")


# Terms of the written criteria, lower case.
ROLE_TERMS = [
    "ai engineer",
    "ml engineer",
    "llm engineer",
    "machine learning engineer",
    "algorithm engineer",
    "applied scientist",
    "ai research engineer",
    "nlp engineer",
    "cv engineer",
    "data scientist",
    "mlops engineer",
    "ai platform engineer",
    "ai agent engineer",
    "机器学习工程师",
    "算法工程师",
    "人工智能工程师",
    "大模型工程师",
    "深度学习工程师",
]
NOT_ROLE_TERMS = [
    "generic software engineer",
    "backend engineer",
    "frontend engineer",
    "data engineer",
    "big data engineer",
    "test engineer",
    "qa engineer",
    "sdet",
    "ai artist",
    "aigc designer",
    "image generator",
    "生图师",
    "devops",
    "sre",
    "operations engineer",
    "运维工程师",
    "product manager",
    "business analyst",
    "sales",
    "marketing",
]
LEVEL_TERMS = [
    "intern",
    "internship",
    "co-op",
    "campus recruit",
    "new graduate",
    "new grad",
    "university graduate",
    "university grad",
    "college graduate",
    "new college grad",
    "recent graduate",
    "early career",
    "entry level",
    "entry-level",
    "0-2 years",
    "校招",
    "应届",
    "实习",
    "2025 graduate",
    "2026 graduate",
]
# Three or more years, in digits or words, English or Chinese. What a match may begin with comes first, so that the
# other places of a text are passed over at one look.
_UP_TO = r"(?: or more|\+)? ?(?:to [a-z]+ )?(?:years|yrs)"
YEARS_IN_DIGITS = (
    r"(?=[1-9])(?<![0-9])(?:[3-9]|[1-9][0-9])(?: or more)?\+? ?(?:-|to|~|至)? ?[0-9]* ?(?:\+ ?)?(?:years|yrs|年)"
)
YEARS_IN_WORDS = rf"(?=[efnst])(?:three|four|five|six|seven|eight|nine|ten){_UP_TO}"
YEARS_IN_CHINESE = r"[三四五六七八九十]年"


def terms_pattern(terms: list[str]) -> str:
    """One pattern for all terms; Latin ones have to stand as words of their own, also in the plural."""
    latin = "|".join(t for t in terms if t.isascii())
    other = "|".join(t for t in terms if not t.isascii())
    bounded = f"(?<![a-z0-9])(?:{latin})s?(?![a-z0-9])"
    return f"{bounded}|{other}" if other else bounded


def names_any(low: Column, terms: list[str]) -> Column:
    """Whether a lower-case text names one of the terms.

    The plain substring search rules most texts out before the pattern is tried.
    """
    return contains_any(low, terms) & low.rlike(terms_pattern(terms))


def role_rules(low: Column) -> Column:
    """Whether a lower-case text names a role wanted and none that is ruled out."""
    return names_any(low, ROLE_TERMS) & ~names_any(low, NOT_ROLE_TERMS)


def asks_years(low: Column) -> Column:
    """Whether a lower-case text asks for three or more years; each pattern is tried only where its unit occurs."""
    english, chinese = contains_any(low, ["years", "yrs"]), F.contains(low, F.lit("年"))
    digits = (english | chinese) & low.rlike(YEARS_IN_DIGITS)
    return digits | (english & low.rlike(YEARS_IN_WORDS)) | (chinese & low.rlike(YEARS_IN_CHINESE))


def level_rules(low: Column) -> Column:
    """False only for texts that ask for three or more years and name no entry track."""
    return ~asks_years(low) | names_any(low, LEVEL_TERMS)


def rule_labels(df: DataFrame, text: str = "text") -> DataFrame:
    """Rule approximations of the scorer's two flags; kept apart from :func:`replies.qualify`."""
    low = df.withColumn("_low", F.lower(text))
    labels = {"rule_role": role_rules(F.col("_low")), "rule_level": level_rules(F.col("_low"))}
    return low.withColumns(labels).drop("_low")
