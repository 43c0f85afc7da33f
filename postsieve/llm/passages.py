"""Removal of passages that repeat anywhere in the corpus, wherever their lines break.

A unit is every window of ``WINDOW`` consecutive words. Of the hashes of ``GRAM`` words inside a window the smallest is
its mark: equal windows have equal marks, and few places of a text are the mark of any window. Marks that occur once
in the corpus rule out their windows, the others' windows are compared one by one. Nothing is sampled.

Texts that are equal as a whole are told first: of these only the first goes on, the others lose all from their first
word to their last. The texts are dealt out once, to a table in buckets by row, and every later join reads them there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm import arrays
from postsieve.session import materialise, new_dir

# Words of the shortest passage that is looked for.
WINDOW = 50
# Words a mark is made of.
GRAM = 25


def _rolling(values: np.ndarray, size: int, of: np.ufunc) -> np.ndarray:
    """``of`` over the ``size`` values from each position on, by doubling; the last positions have none."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    step = 1
    while 2 * step <= size:
        values = of(values[:-step], values[step:])
        step *= 2
    return of(values[:n], values[size - step : size - step + n])


def _marks(found: arrays.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the words from each position on, and the mark of each window, 0 where a text ends within."""
    hashes = arrays.windows(found.hashes, gram)
    marks = _rolling(hashes, window - gram + 1, np.minimum)
    doc = np.searchsorted(found.bounds, np.arange(len(marks)), side="right") - 1
    return hashes, np.where(np.arange(len(marks)) + window <= found.bounds[doc + 1], marks, np.uint64(0))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _printed(window: int, gram: int):
    """For each row and mark: at how many of its places it is one."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrays.pieces(batch, "text"):
                found = arrays.words(data, offsets, arrays.BLANK_SEPARATED)
                hashes, marks = _marks(found, window, gram)
                reach = window - gram
                edge = np.zeros(reach, np.uint64)
                # A place is a mark if a window that holds it has no smaller hash.
                at = np.flatnonzero(_rolling(np.concatenate((edge, marks, edge)), reach + 1, np.maximum) == hashes) if len(marks) else marks[:0].astype(np.int64)
                doc = np.searchsorted(found.bounds, at, side="right") - 1
                by = np.lexsort((hashes[at], doc))
                key, doc = hashes[at][by], doc[by]
                new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])))[: len(key)])
                n = np.diff(np.append(new, len(key)))
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(doc[new])), _signed(key[new]), pa.array(n)], ["row", "key", "n"])

    return marked


def _windows(window: int, gram: int):
    """The windows of each row whose mark is one of its ``keys``."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in arrays.pieces(batch, "text"):
                found = arrays.words(data, offsets, arrays.BLANK_SEPARATED)
                _, marks = _marks(found, window, gram)
                keys = rows.column(3).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                at = np.flatnonzero(np.isin(marks, keys) & (marks != 0))
                doc = np.searchsorted(found.bounds, at, side="right") - 1
                whole = arrays.windows(found.hashes, window)[at]
                place = (at - found.bounds[doc]).astype(np.int32)
                doc = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(doc), rows.column(1).take(doc), pa.array(place), _signed(whole)], ["row", "doc_id", "at", "key"]
                )

    return listed


def _cut(window: int):
    """Take out, of each row, the words ``[since, at + window)`` of its later windows."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for text, later, copy in zip(batch.column(1), batch.column(2), batch.column(3).to_pylist(), strict=True):
                text, found = text.as_py(), []
                if later.is_valid or copy:
                    data = np.frombuffer(text.encode(), np.uint8)
                    words = arrays.words(data, np.array([0, len(data)]), arrays.BLANK_SEPARATED)
                    places = np.zeros(len(words.hashes) + 1, np.int64)
                    if copy and len(words.hashes) >= window:
                        places[0], places[-1] = 1, -1
                    if later.is_valid:
                        np.add.at(places, later.values.field("since").to_numpy(), 1)
                        np.add.at(places, later.values.field("at").to_numpy() + window, -1)
                    gone = np.cumsum(places) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8)))))
                    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                    starts, ends = chars[words.starts[edges[::2]]], chars[words.ends[edges[1::2] - 1]]
                    found = [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                    bounds = [0, *[p for s in found for p in (s["start"], s["end"])], len(text)]
                    text = "".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
                texts.append(text)
                spans.append(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(spans, span)], ["doc_id", "text", "removed"]
            )

    return cut


def _in_buckets(rows: DataFrame) -> DataFrame:
    """Rows written once, in buckets by ``row``, so that joins on it move only what is joined to them.

    The number of a row is the same in every pass from then on.
    """
    spark = rows.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"rows_{uuid.uuid4().hex}"
    writer = rows.repartition(n, "row").write.bucketBy(n, "row").option("compression", "zstd")
    writer.option("path", new_dir(spark, "rows")).saveAsTable(name)
    return spark.table(name)


def dedup_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Keep the first occurrence of each window of ``window`` words in the corpus, by doc_id and place; take the
    words of the others out.

    Words are separated by blanks and line breaks, and A-Z count as a-z. For each row of ``(doc_id, text)``: the text
    that stays, and ``removed``, the spans taken out as ``(start, end)`` in code points of the original, from the first
    word of a passage to the end of its last. Blanks around a passage stay. A window that overlaps its own first
    occurrence loses only the words beyond it. Windows are told apart by 64 bits. Null text stays null and loses
    nothing. Rows of one doc_id rank by their place in the table; rows without doc_id rank last. An empty table gives
    no rows; further columns are ignored.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = _in_buckets(numbered)
    rank = [F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("row")]
    # Two hashes stand for a text.
    keyed = rows.filter("text is not null").select("row", F.struct(*rank).alias("rank"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    first = keyed.groupBy("k1", "k2").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Written, so that the join is one of two plain tables, whose hot keys Spark splits.
    first = materialise(first.select("k1", "k2", F.col("first.row").alias("row0")), "equal")
    copies = keyed.join(first, ["k1", "k2"]).filter("row <> row0")
    copies = materialise(copies.select("row"), "copies")

    marks = rows.mapInArrow(_printed(window, gram), "row bigint, key bigint, n bigint")
    marks = materialise(marks.join(copies, "row", "left_anti"), "marks")
    repeated = marks.groupBy("key").agg(F.sum("n").alias("times")).filter("times > 1").select("key")
    kept = marks.join(materialise(repeated, "repeated"), "key").groupBy("row").agg(F.collect_list("key").alias("keys"))
    held = rows.join(kept, "row").select("row", "doc_id", "text", "keys")
    found = materialise(held.mapInArrow(_windows(window, gram), "row bigint, doc_id bigint, at int, key bigint"), "windows")
    place = F.struct(*rank, "at")
    # One row per window and task goes through the shuffle, however common the passage.
    first = found.groupBy("key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    first = materialise(first.filter("n > 1").select("key", F.col("first.row").alias("row0"), F.col("first.at").alias("at0")), "first")
    later = found.select("row", "at", "key").join(first, "key").filter((F.col("row") != F.col("row0")) | (F.col("at") != F.col("at0")))
    since = F.when(F.col("row") == F.col("row0"), F.greatest("at", F.col("at0") + window)).otherwise(F.col("at"))
    cut = later.groupBy("row").agg(F.collect_list(F.struct("at", since.alias("since"))).alias("later"))
    cut = cut.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True)), allowMissingColumns=True)
    joined = rows.join(cut, "row", "left").select("doc_id", "text", "later", F.coalesce("copy", F.lit(False)).alias("copy"))
    return joined.mapInArrow(_cut(window), "doc_id bigint, text string, removed array<struct<start:bigint,end:bigint>>")
