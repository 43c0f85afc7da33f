"""Fewer rows of hot keys before a stateful step."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def thin(rows: DataFrame, keys: list[str], n: int, order: str | None = None) -> DataFrame:
    """At most ``n`` rows per key of every Arrow batch, the first by ``order`` if given.

    Streams combine nothing before the shuffle of a stateful step, so a key with most
    of the rows would send them all to one task. Fit for steps that need no more than
    the first ``n`` rows of a key.
    """
    needed = [*keys] if order is None else [*keys, order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.select(needed).to_pandas()
            if order is not None:
                frame = frame.sort_values(order, kind="stable")
            kept = frame.groupby(keys, sort=False, dropna=False).head(n).index
            yield batch.take(pa.array(kept.to_numpy()))

    return rows.mapInArrow(run, rows.schema)
