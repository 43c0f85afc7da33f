"""Shards along a Hilbert curve over metadata, for files that several columns can prune.

Columns are quantised to cells of about equal row counts, rows are ordered by the curve index of their cell, and the
order is cut into runs of equal length. Rows near each other in the order are near in every column, so a file covers
a small box and its minimum and maximum prune for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsieve.operators.keyed import number_rows
from postsieve.session import materialise

SHARDS = 8
BITS = 5


def _number(df: DataFrame, column: str) -> Column:
    """An order-preserving number: the value, or the first seven bytes of a string. Null comes first."""
    if isinstance(df.schema[column].dataType, T.StringType):
        head = F.rpad(F.hex(F.substring(F.encode(column, "utf-8"), 1, 7)), 14, "0")
        value = F.conv(head, 16, 10).cast("bigint").cast("double")
    else:
        value = F.col(column).cast("double")
    return F.coalesce(value, F.lit(-1.0))


def curve_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer cells, one row per point and one column per dimension.

    Bits are taken from the top; each step undoes the rotation and reflection of the sub-cube it enters.
    """
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        top, rest = 1 << level, (1 << level) - 1
        for k in range(len(x)):
            set_ = (x[k] & top) != 0
            swap = np.where(set_, 0, (x[0] ^ x[k]) & rest)
            x[0] = np.where(set_, x[0] ^ rest, x[0]) ^ swap
            x[k] = x[k] ^ swap if k else x[0]
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x = [v ^ turn for v in x]
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for v in x:
            out = (out << 1) | ((v >> level) & 1)
    return out


def with_curve(df: DataFrame, columns: list[str], bits: int = BITS, name: str = "curve") -> DataFrame:
    """Add the curve index over ``columns``. Cell bounds are quantiles over all rows, ``2 ** bits - 1`` a column."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    numbers = df.select(*[_number(df, c).alias(f"n{k}") for k, c in enumerate(columns)])
    row = numbers.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in numbers.columns]).first()
    bounds = [np.array(v if v is not None else [0.0] * len(shares)) for v in row]

    @F.pandas_udf("bigint")
    def index(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for values in parts:
            cells = [np.searchsorted(b, v.to_numpy(float), side="right") for b, v in zip(bounds, values, strict=True)]
            yield pd.Series(curve_index(np.stack(cells, axis=1), bits))

    return df.withColumn(name, index(*[_number(df, c) for c in columns]))


def cut_runs(df: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Cut the order into ``shards`` runs whose row counts differ by one at most; add ``shard`` and ``slot``."""
    ranked = number_rows(df, [], order, "_rank")
    total = df.count()
    place = F.col("_rank") - 1
    shard = F.floor(place * shards / F.lit(max(total, 1)))
    exact = F.expr(f"((_rank - 1) * {shards}) div {max(total, 1)}") if total * shards < 1 << 62 else shard
    first = F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")
    return (
        ranked.withColumn("_shard", exact)
        .withColumn("slot", (place - first).cast("bigint"))
        .withColumn("shard", F.col("_shard").cast("int"))
        .drop("_rank", "_shard")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Put every row of ``(doc_id, text, lang, source)`` into a shard.

    Dimensions are source, language and size. Rows of equal text take the metadata of the least of them, so they are
    neighbours on the curve and only a cut can part them; a group larger than a shard spans several. Null text has
    size 1 and the checksum of no bytes; nulls in other columns form a cell of their own. Repeated rows are all kept.
    Ties are ordered by text, then doc_id. An empty table gives no rows. Further columns are dropped.
    """
    text = F.coalesce("text", F.lit(""))
    base = materialise(
        docs.select(
            F.col("doc_id"),
            F.col("source"),
            F.col("lang"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
            F.xxhash64(text).alias("_text"),
        ),
        "sizes",
    )
    keys = ["_text", "size", "text_crc32"]
    groups = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("doc_id", "source", "lang")).alias("_least")
    )
    groups = materialise(groups.filter("_n > 1").select(*keys, "_least"), "groups")
    led = base.join(groups, keys, "left").select(
        "doc_id",
        *keys,
        *[F.when(F.col("_least").isNull(), F.col(c)).otherwise(F.col(f"_least.{c}")).alias(c) for c in ("source", "lang")],
    )
    curved = with_curve(led, ["source", "lang", "size"], bits)
    return cut_runs(curved, ["curve", "_text", "doc_id"], shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write documents into one folder per shard, each file a sorted run. ``doc_id`` must be unique."""
    rows = docs.join(placed.select("doc_id", "shard", "slot"), "doc_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
