"""Removal of lines that repeat anywhere in the corpus, by digest of their normalised text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.session import materialise

# Shorter lines are too common to tell a copy by.
MIN_WORDS = 8
# Fixed value: what separates words.
BLANKS = " \t\n\x0b\x0c\r"
_SPACES = str.maketrans(dict.fromkeys(BLANKS, " "))


def unit_key(line: str, min_words: int = MIN_WORDS) -> bytes | None:
    """Digest of a line in lower case with single blanks; none for a line of fewer words."""
    found = [w for w in line.translate(_SPACES).split(" ") if w]
    if len(found) < min_words:
        return None
    return hashlib.md5(" ".join(found).lower().encode()).digest()


def units(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per line of at least ``min_words`` words of ``(row, doc_id, text)``: its number and digest."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number, keys = [], [], []
            for k, text in enumerate(batch.column(2)):
                for i, line in enumerate((text.as_py() or "").split("\n")):
                    key = unit_key(line, min_words)
                    if key is not None:
                        at.append(k)
                        number.append(i)
                        keys.append(key)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(number, pa.int32()), pa.array(keys, pa.binary())],
                ["row", "doc_id", "line", "digest"],
            )

    return rows.select("row", "doc_id", "text").mapInArrow(split, "row bigint, doc_id bigint, line int, digest binary")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts, spans = [], []
        for text, cut in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found, kept, start, gone = [], [], 0, set(cut or ())
            for i, line in enumerate((text or "").split("\n")):
                if i in gone:
                    found.append({"start": start, "end": start + len(line)})
                else:
                    kept.append(line)
                start += len(line) + 1
            texts.append(text if not gone else "\n".join(kept))
            spans.append(found)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array(spans, span)], ["doc_id", "text", "removed"]
        )


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Keep the first occurrence of each line in the corpus, by doc_id and place; take the others out.

    For each row of ``(doc_id, text)``: the text that stays, and ``removed``, the spans of the lines taken out as
    ``(start, end)`` in code points of the original, without the line break. Null text stays null and loses nothing.
    Rows of one doc_id rank by their place in the table; rows without doc_id rank last. An empty table gives no rows;
    further columns are ignored.
    """
    numbered = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    # Written, since the number of a row must be the same in both passes.
    rows = materialise(numbered.withColumn("row", F.monotonically_increasing_id()), "rows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "line")
    found = materialise(units(rows, min_words).select("digest", place.alias("place")), "lines")
    # One row per digest and task goes through the shuffle, however common the line.
    first = found.groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    first = materialise(first.filter("n > 1").select("digest", "first"), "repeated")
    later = found.join(first, "digest").filter(F.col("place") != F.col("first"))
    cut = later.groupBy(F.col("place.row").alias("row")).agg(F.collect_list("place.line").alias("cut"))
    held = rows.join(cut, "row", "left").select("doc_id", "text", "cut")
    return held.mapInArrow(_cut, "doc_id bigint, text string, removed array<struct<start:bigint,end:bigint>>")
