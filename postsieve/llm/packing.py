"""Packing of token sequences by harmonic classes.

A bin holds ``capacity`` tokens. A piece whose length lies in ``(capacity / (k + 1), capacity / k]`` is of class k,
and a bin of class k takes exactly k pieces, whatever their lengths: no piece has to know of another, so every worker
fills its own stretch of bins. Documents are cut so that pieces fill their class: first into whole bins, then, while
the rest would fill less than ``fill`` of its share of a bin, the largest whole share ``capacity // k`` is cut off.
Only the last bin of each class is short; these few are put together by first fit.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postsieve.operators.keyed import number_rows
from postsieve.session import materialise

CAPACITY = 1024
FILL = 0.97
# Distinct words whose ids a worker remembers; beyond it the memory starts anew.
REMEMBERED = 1_000_000
# What the vocabulary's pattern takes as white space, besides the space itself.
_BLANK = r"[ \t\n\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, k int, uid bigint"


def cut(n: int, capacity: int = CAPACITY, fill: float = FILL) -> list[int]:
    """Lengths of the pieces of a document of ``n`` tokens."""
    out = [capacity] * (n // capacity)
    return out + list(_cut_rest(n % capacity, capacity, fill))


@functools.lru_cache(4096)
def _cut_rest(rest: int, capacity: int, fill: float) -> tuple[int, ...]:
    out = []
    while rest:
        k = capacity // rest
        share = capacity // (k + 1)
        if rest * k >= fill * capacity or not share or rest <= share:
            out.append(rest)
            break
        out.append(share)
        rest -= share
    return tuple(out)


class Encoder:
    """Token ids of texts by a public byte-pair vocabulary, as ``tokenizers`` gives them.

    Text is taken apart before each space between two characters that are not both blank, where no piece of the
    vocabulary's pattern can reach across; every distinct part is encoded once and remembered. Texts with longer runs
    of blanks, and those that hold a special token's string, are encoded whole.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values() if t.special]
        self.part = _fast_encoder(vocabulary) or (lambda t: self.whole.encode(t, add_special_tokens=False).ids)
        self.known: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.known.clear()
        self.ids = np.empty(1 << 16, np.int32)
        self.ends = [0]

    def _numbers(self, parts: list[str]) -> np.ndarray:
        known, ends = self.known, self.ends
        out = np.empty(len(parts), np.int64)
        for k, part in enumerate(parts):
            number = known.get(part)
            if number is None:
                ids = self.part(part)
                end = ends[-1] + len(ids)
                if end > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), end), np.int32)])
                self.ids[ends[-1] : end] = ids
                number = known[part] = len(ends) - 1
                ends.append(end)
            out[k] = number
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, f"{_BLANK} ({_BLANK}|$)")
        for token in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        odd = odd.to_numpy(zero_copy_only=False).astype(bool)
        plain = pc.if_else(pa.array(odd), "", texts)
        lists = pc.split_pattern(plain, " ")
        bounds = np.asarray(lists.offsets, np.int64)
        parts = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        coded = parts.dictionary_encode()
        if len(self.known) > REMEMBERED:
            self._reset()
        values = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy(zero_copy_only=False)
        # The first part of a text has no space before it.
        head = np.zeros(len(parts), bool)
        head[bounds[:-1]] = True
        first = np.full(len(values), -1, np.int64)
        heads = np.unique(code[head])
        first[heads] = self._numbers([values[k] for k in heads.tolist()])
        later = np.full(len(values), -1, np.int64)
        tails = np.flatnonzero(np.bincount(code[~head], minlength=len(values)))
        later[tails] = self._numbers([" " + values[k] for k in tails.tolist()])
        number = np.where(head, first[code], later[code])
        ends = np.asarray(self.ends, np.int64)
        lengths = ends[number + 1] - ends[number]
        until = np.concatenate(([0], np.cumsum(lengths)))
        at = np.repeat(ends[number] - until[:-1], lengths) + np.arange(until[-1])
        ids = self.ids[at]
        spans = until[bounds]
        out = [ids[a:b] for a, b in zip(spans[:-1].tolist(), spans[1:].tolist(), strict=True)]
        for k in np.flatnonzero(odd).tolist():
            out[k] = np.array(self.whole.encode(texts[k].as_py(), add_special_tokens=False).ids, np.int32)
        return out


def _fast_encoder(vocabulary: str):
    """The same vocabulary as ranks for ``tiktoken``, where such a file lies beside it."""
    import base64
    import os

    ranks_file = os.path.splitext(vocabulary)[0] + ".tiktoken"
    if not os.path.exists(ranks_file):
        return None
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary


@functools.lru_cache(2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, fill: float = FILL, end: int = 0) -> DataFrame:
    """One row per piece of every document: where it starts, its length, checksum and class ``k``."""

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from postsieve.llm import arrays

        encode = encoder(vocabulary).encode
        for batch in batches:
            for rows, _, _ in arrays.pieces(batch, "text"):
                out: list[tuple] = []
                ids_of = encode(rows.column(1))
                for row, ids in enumerate(ids_of):
                    ids = np.append(ids, end).astype("<u4")
                    start = 0
                    for length in cut(len(ids), capacity, fill):
                        crc = zlib.crc32(ids[start : start + length].tobytes())
                        out.append((row, start, length, crc, len(ids), capacity // length))
                        start += length
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(columns[0], pa.int64())).cast(pa.int64()),
                        *[pa.array(c, pa.int64()) for c in columns[1:5]],
                        pa.array(columns[5], pa.int32()),
                        pa.nulls(len(out), pa.int64()),
                    ],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", "uid"],
                )

    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(pieces_of, _PIECE)
    return found.withColumn("uid", F.monotonically_increasing_id())


def _first_fit(lengths: dict[int, int], capacity: int) -> dict[int, tuple[int, int]]:
    """For each short bin, the bin that takes it and the offset there; longest first."""
    room: list[int] = []
    out = {}
    for key in sorted(lengths, key=lambda k: (-lengths[k], k)):
        at = next((b for b, free in enumerate(room) if free >= lengths[key]), len(room))
        if at == len(room):
            room.append(capacity)
        out[key] = (at, capacity - room[at])
        room[at] -= lengths[key]
    return out


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, fill: float = FILL) -> DataFrame:
    """Pack all documents of ``(doc_id, text)``; one row per piece with its sequence and offset there.

    Null text is empty and has the end token alone. Repeated rows and rows without doc_id are packed as rows of their
    own. An empty table gives no rows; further columns are ignored.
    """
    pieces = materialise(token_pieces(docs, vocabulary, capacity, fill), "pieces")
    # Whole bins need no partner; they are numbered by their row, below zero.
    whole = pieces.filter("k = 1").select("*", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    shared = pieces.filter("k > 1")
    ranked = number_rows(shared, ["k"], ["uid"], "rank")
    # Class and bin number in one id; a class has fewer than 2 ** 48 bins.
    bin_id = F.shiftleft(F.col("k").cast("bigint"), 48) + F.expr("(rank - 1) div k")
    ordered = Window.partitionBy("bin").orderBy("uid")
    filled = ranked.withColumn("bin", bin_id).withColumn(
        "at", F.sum("length").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    )
    filled = materialise(filled.withColumn("at", F.coalesce("at", F.lit(0)).cast("bigint")), "bins")
    # At most one short bin a class, so at most `capacity` rows reach the driver.
    totals = filled.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    last = filled.join(F.broadcast(totals.filter("n % k > 0")), "k").filter("rank > n - n % k")
    short = {r["bin"]: r["total"] for r in last.groupBy("bin").agg(F.sum("length").alias("total")).collect()}
    moves = [(key, at, offset) for key, (at, offset) in _first_fit(short, capacity).items()]
    moved = docs.sparkSession.createDataFrame(moves, "bin bigint, to_bin bigint, shift bigint")
    packed = filled.join(F.broadcast(moved), "bin", "left").select(
        *pieces.columns,
        F.coalesce("to_bin", "bin").alias("sequence_id"),
        (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
    return whole.unionByName(packed).drop("uid", "k")
