import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, rows):
    """Rows ``(doc_id, text[, lang[, source]])`` as a table of documents, with columns whose names the operators use."""
    full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    clash = ["row", "k", "n", "key", "digest", "uid", "_id", "_key", "_spans", "_n", "group", "spans", "score", "line"]
    return df.withColumns({c: F.lit(7) for c in clash})


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, tiny and long texts, ties and repeated rows."""
    rng = random.Random(5)
    long = "\n".join(sentence(rng, 40) for _ in range(400))
    near = sentence(rng, 60)
    return [
        (1, None, "en", "a"),
        (2, "", "en", None),
        (3, " \t\n\x0b\x0c\r ", None, "a"),
        (4, "one", "en", "b"),
        (5, "\x00 é ퟿ \U0001f600 x\x00y", "fr", "b"),
        (6, long, "en", "c"),
        (7, near, "en", "a"),
        (8, near.upper(), "en", "a"),
        (9, near + " extra", "de", "a"),
        (9, near + " extra", "de", "a"),
        (None, near, "en", None),
        (None, None, None, None),
        (None, "nobody's text stands here alone", None, "z"),
        (10, "same doc id, first text of two", "en", "a"),
        (10, "same doc id, second text of both", "en", "a"),
        (11, "a " * 300, "en", "a"),
        (12, "The same line of ten words stands here twice again, yes.\n" * 3, "en", "a"),
        (13, "the SAME line of ten words  stands here twice again, yes.", "en", "a"),
        (14, "x" * 5000, "en", "a"),
        (15, "<|endoftext|> is  ordinary   text   here", "en", "a"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return docs_of(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def none(spark):
    return docs_of(spark, []).cache()
