"""Benchmark passages in documents, by a prefix-filtered join of item windows.

Every window of an item is a sequence that a document holds whole or not at all, so its necessary prefix in an order
by rarity is one shingle: the one that all documents together hold least often. Documents are joined with the items
on those shingles alone; a candidate must fit between the document's ends at the window's place, and is then compared
word by word. Items are the query set: they are taken in blocks of bounded size, each sent to every task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsieve.llm import arrays
from postsieve.llm.text import text_key

WINDOW = 10
# Words in a shingle; a shorter window is one shingle.
SHINGLE = 3
# Bytes of item text in a block.
BLOCK = 1 << 20
_FOUND = "doc_id bigint, text_key bigint, text string, items array<string>, starts array<int>, ends array<int>"
_RESULT = "doc_id bigint, text_key bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


class Index:
    """Windows of one block of items: the items' words, and where each window begins and how long it is."""

    def __init__(self, block: pa.Table, window: int):
        data, offsets = arrays.utf8(block.column("text"))
        found = arrays.words(data, offsets, arrays.ALPHANUMERIC)
        self.words = found.hashes
        self.ids = ["null" if i is None else str(i) for i in block.column("item_id").to_pylist()]
        starts, lengths, owners = [], [], []
        for k, (a, b) in enumerate(zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True)):
            n = min(window, b - a)
            if n:
                starts.extend(range(a, b - n + 1))
                count = b - a - n + 1
                lengths.extend([n] * count)
                owners.extend([k] * count)
        self.start = np.array(starts, np.int64)
        self.length = np.array(lengths, np.int64)
        self.owner = np.array(owners, np.int64)
        self.widest = window
        self.sizes = sorted({min(SHINGLE, n) for n in lengths})
        self.shingles = {}
        for size in self.sizes:
            self.shingles[size] = np.unique(arrays.windows(self.words, size)[self._places(size)[1]])

    def _places(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For windows with shingles of this size: the window, the shingle's place in the words, and in the window."""
        own = np.flatnonzero(np.minimum(self.length, SHINGLE) == size)
        counts = self.length[own] - size + 1
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        window = np.repeat(own, counts)
        return window, self.start[window] + inside, inside

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Give each window its rarest shingle; of equals the first."""
        self.keys = {}
        for size in self.sizes:
            window, place, inside = self._places(size)
            values = arrays.windows(self.words, size)[place]
            at = np.searchsorted(self.shingles[size], values)
            often = np.array([counts.get((size, k), 0) for k in range(len(self.shingles[size]))], np.int64)[at]
            by = np.lexsort((inside, often, window))
            first = by[np.concatenate(([True], window[by][1:] != window[by][:-1]))]
            by = first[np.argsort(values[first], kind="stable")]
            self.keys[size] = (values[by], window[by], inside[by], _sieve(values[by]))


def _sieve(values: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 20, bool)
    out[(values >> np.uint64(44)).astype(np.int64)] = True
    return out


def _positions(hashes: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Positions whose hash may be among those of the sieve."""
    return np.flatnonzero(sieve[(hashes >> np.uint64(44)).astype(np.int64)])


def _inside(found: arrays.Words, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose ``size`` words lie in one document, and that document."""
    doc = np.searchsorted(found.bounds, at, side="right") - 1
    fits = at + size <= found.bounds[doc + 1]
    return at[fits], doc[fits]


def shingle_counts(docs: DataFrame, shingles: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """How often all documents together hold each shingle of the items. Counts per task, then added up."""
    sent = docs.sparkSession.sparkContext.broadcast({s: (v, _sieve(v)) for s, v in shingles.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {s: np.zeros(len(v[0]), np.int64) for s, v in sent.value.items()}
        for batch in batches:
            for _, data, offsets in arrays.pieces(batch, "text"):
                found = arrays.words(data, offsets, arrays.ALPHANUMERIC)
                for size, (values, sieve) in sent.value.items():
                    hashes = arrays.windows(found.hashes, size)
                    at, _ = _inside(found, _positions(hashes, sieve), size)
                    place = np.minimum(np.searchsorted(values, hashes[at]), len(values) - 1)
                    place = place[values[place] == hashes[at]]
                    totals[size] += np.bincount(place, minlength=len(values))
        for size, total in totals.items():
            k = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(k), size, np.int32)), pa.array(k.astype(np.int32)), pa.array(total[k])], ["size", "k", "n"]
            )

    counts = docs.select("text").mapInArrow(count, "size int, k int, n bigint").groupBy("size", "k").agg(F.sum("n").alias("n"))
    return {(r["size"], r["k"]): r["n"] for r in counts.collect()}


def _hits(found: arrays.Words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, item, first word and end of every occurrence of a window."""
    out = [[], [], [], []]
    for size, (values, window, inside, sieve) in index.keys.items():
        hashes = arrays.windows(found.hashes, size)
        at, doc = _inside(found, _positions(hashes, sieve), size)
        low = np.searchsorted(values, hashes[at], side="left")
        counts = np.searchsorted(values, hashes[at], side="right") - low
        entry = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - low, counts)
        at, doc, window_ = np.repeat(at, counts), np.repeat(doc, counts), window[entry]
        start, length = at - inside[entry], index.length[window_]
        fits = (start >= found.bounds[doc]) & (start + length <= found.bounds[doc + 1])
        doc, window_, start, length = doc[fits], window_[fits], start[fits], length[fits]
        same = np.ones(len(start), bool)
        for k in range(index.widest):
            there = np.minimum(k, length - 1)
            same &= found.hashes[start + there] == index.words[index.start[window_] + there]
        for values_, v in zip(out, (doc, index.owner[window_], start, start + length), strict=True):
            values_.append(v[same])
    return tuple(np.concatenate(v) if v else np.empty(0, np.int64) for v in out)


def _mark(docs: DataFrame, index: Index, last: bool) -> DataFrame:
    """Add the hits of one block of items to those found so far; after the last block, count them."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for rows, data, offsets in arrays.pieces(batch, "text"):
                found = arrays.words(data, offsets, arrays.ALPHANUMERIC)
                doc, item, start, end = _hits(found, index)
                items: list[set] = [set(x or ()) for x in rows.column(3).to_pylist()]
                spans: list[set] = [
                    set(zip(a or (), b or (), strict=True))
                    for a, b in zip(rows.column(4).to_pylist(), rows.column(5).to_pylist(), strict=True)
                ]
                for d, i, a, b in zip(doc.tolist(), item.tolist(), start.tolist(), end.tolist(), strict=True):
                    base = int(found.bounds[d])
                    items[d].add(index.ids[i])
                    spans[d].add((a - base, b - base))
                if last:
                    n_words = np.diff(found.bounds)
                    hit = [_covered(s) for s in spans]
                    digest = [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items]
                    columns = [*rows.columns[:2], pa.array(n_words, pa.int64()), pa.array(hit, pa.int64())]
                    columns += [pa.array([len(i) for i in items], pa.int64()), pa.array(digest), pa.array([h > 0 for h in hit])]
                    names = ["doc_id", "text_key", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
                else:
                    kind = pa.list_(pa.int32())
                    columns = [*rows.columns[:3], pa.array([sorted(i) for i in items], pa.list_(pa.string()))]
                    columns += [pa.array([[x[k] for x in sorted(s)] for s in spans], kind) for k in (0, 1)]
                    names = ["doc_id", "text_key", "text", "items", "starts", "ends"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(mark, _RESULT if last else _FOUND)


def _covered(spans: set[tuple[int, int]]) -> int:
    total = until = 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, until))
        until = max(until, end)
    return total


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Words of each row of ``(doc_id, text)`` that lie in an occurrence of a window of ``(item_id, text)``.

    Null texts have no words; documents without words and items without words never meet. Items that share an id count
    once, items without id as "null". Repeated documents are answered one by one; an empty table gives no rows, and
    without items nothing is hit. Further columns are ignored. ``text_key`` is a hash of the row's text.
    """
    sized = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block + 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text_key(F.col("text")).alias("text_key"),
        F.col("text"),
        F.lit(None).cast("array<string>").alias("items"),
        *[F.lit(None).cast("array<int>").alias(c) for c in ("starts", "ends")],
    )
    for k in range(blocks):
        index = Index(sized.filter(part == k).toArrow(), window)
        index.order(shingle_counts(docs, index.shingles) if index.sizes else {})
        out = _mark(out, index, last=k == blocks - 1)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows that hold no window of an item, with all columns."""
    hit = decontaminate(docs, items).filter("contaminated")
    hit = hit.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    same = hit["_id"].eqNullSafe(docs["doc_id"]) & (hit["_key"] == text_key(docs["text"]))
    return docs.join(hit, same, "left_anti")
