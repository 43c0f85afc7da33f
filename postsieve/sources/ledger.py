"""The ledger of attempts at scorer calls: an append-only log, one folder per round of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTEMPT = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("reply", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
LEDGER = T.StructType([*ATTEMPT.fields, T.StructField("round", T.LongType())])


def init_ledger(spark: SparkSession, path: str) -> None:
    """Create the ledger unless it exists."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").partitionBy("round").parquet(path)


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    """``url, at, reply, error`` of every attempt, with its ``round``."""
    return spark.read.schema(LEDGER).parquet(path)


def append_attempts(attempts: DataFrame, path: str, round_: int) -> None:
    """Write the attempts of a round; writing a round again replaces it."""
    attempts.select(*[F.col(f.name).cast(f.dataType) for f in ATTEMPT]).write.mode("overwrite").parquet(f"{path}/round={round_}")
