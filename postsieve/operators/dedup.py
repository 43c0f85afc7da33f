"""One posting per title and company, up to the target of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.functions.text import job_key
from postsieve.operators.keyed import first_n_per_key, first_per_key


def with_job_key(df: DataFrame, title: str = "title", company: str = "company") -> DataFrame:
    return df.withColumn("job_key", job_key(F.col(title), F.col(company)))


def dedup_title_company(
    postings: DataFrame, keys: list[str] = ["run_id"], order: str = "seq", title: str = "title", company: str = "company"
) -> DataFrame:
    """The first posting in arrival order of each title and company within a run; adds ``job_key``."""
    return first_per_key(with_job_key(postings, title, company), [*keys, "job_key"], [order])


def drop_saved_keys(postings: DataFrame, saved: DataFrame, keys: list[str] = ["run_id"]) -> DataFrame:
    """Postings whose title and company an earlier batch of the run has not saved."""
    return postings.join(saved.select(*keys, "job_key"), [*keys, "job_key"], "left_anti")


def cut_at_target(postings: DataFrame, n: int = 50, keys: list[str] = ["run_id"], order: str = "seq") -> DataFrame:
    """The first ``n`` saved postings of each run."""
    return first_n_per_key(postings, keys, [order], n, "_saved").drop("_saved")
