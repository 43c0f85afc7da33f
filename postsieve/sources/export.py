"""CSV export."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the export, in order.
CSV_COLUMNS = ["title", "company", "location", "salary", "tech_tags", "requirements", "source", "job_url"]
HEADER = ",".join(CSV_COLUMNS)


def _field(name: str) -> Column:
    value = F.array_join(name, "; ", "") if name == "tech_tags" else F.coalesce(name, F.lit(""))
    return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))


def _line() -> Column:
    return F.concat_ws(",", *[_field(c) for c in CSV_COLUMNS])


def csv_lines(postings: DataFrame) -> DataFrame:
    """``(job_url, line)``: every field quoted, quotes doubled, tags joined by ``"; "``."""
    return postings.select("job_url", _line().alias("line"))


def export_name(at_ms: int | None = None) -> str:
    return f"ai_engineer_jobs_{int(time.time() * 1000) if at_ms is None else at_ms}.csv"


def export_csv(postings: DataFrame, folder: str, at_ms: int | None = None) -> str:
    """Write all postings by ``job_url`` and return the path.

    The path is a folder of part files: read in name order they are the bytes of one
    CSV file with a bare header, ``\\n`` between lines and none at the end. Rows are
    range partitioned and written in parallel.
    """
    path = f"{folder.rstrip('/')}/{export_name(at_ms)}"
    spark = postings.sparkSession
    # Sorted before the lines are made, so that drawing the bounds makes none. The first row of the first part is the
    # first of the file; the id is taken after the sort.
    placed = postings.select(*CSV_COLUMNS).orderBy("job_url").withColumn("_place", F.monotonically_increasing_id())
    # A line is written with its line break in front and closed by the quote that ends
    # every line, so no break follows the last one.
    header = F.when(F.col("_place") == 0, F.lit(HEADER)).otherwise(F.lit(""))
    line = _line()
    body = F.concat(header, F.lit("\n"), F.substring(line, 1, F.length(line) - 1))
    placed.select(body.alias("value")).write.option("lineSep", '"').text(path)
    if spark.read.text(path).isEmpty():
        # The writer needs some separator; splitting the header at its last letter gives one.
        only = spark.createDataFrame([(HEADER[:-1],)], "value string")
        only.coalesce(1).write.mode("append").option("lineSep", HEADER[-1]).text(path)
    return path
