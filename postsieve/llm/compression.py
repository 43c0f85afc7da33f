"""Code length of texts by prediction by partial matching over bytes.

The trie of byte contexts is learned from all training texts: their runs of ``ORDER + 1`` bytes are counted in every
task and added up, and shorter contexts follow from longer ones. A byte is coded in the longest context seen before;
where it never followed, an escape is coded (half a count for each distinct successor, taken from the successors) and
the next shorter context tried, without the symbols already ruled out. A-Z count as a-z. What the counts say of a symbol and of an escape in a context
is the same at every place, so both are computed once per node and texts only look them up.

The trie goes to the tasks in blocks of bounded size, one after another, split by the last two bytes of a context, so
that all longer contexts of a place lie in one block. Word counts for the base score go another way, since a vocabulary has no bound:
each task sends its distinct words to the bucket that holds their counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.llm import arrays
from postsieve.session import materialise

ORDER = 5
# Bytes that no UTF-8 text holds: what stands before a text, and its end.
PAD, END = 0xFE, 0xFF
SYMBOLS = 256
# Entries of the trie that are sent to the tasks at once.
BLOCK = 4_000_000
# Buckets of the vocabulary; more where one would pass so many words.
BUCKETS = 32
BUCKET_WORDS = 1_000_000
# Distinct values a task gathers before it merges them.
GATHERED = 500_000
NGRAM, WORD = 0, 1


def symbols(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Keys of ``order`` context bytes and a symbol for every byte and end of every text, and bounds per text."""
    lengths = np.diff(offsets)
    step = order + 1
    flat = np.full(len(data) + step * len(lengths), PAD, np.uint64)
    shift = np.repeat(np.arange(len(lengths)) * step + order, lengths)
    flat[np.arange(len(data)) + shift] = arrays.BLANK_SEPARATED.lower[data]
    ends = offsets[1:] + (np.arange(len(lengths)) + 1) * step - 1
    flat[ends] = END
    keys = np.zeros(max(0, len(flat) - order), np.uint64)
    for k in range(step):
        keys = (keys << np.uint64(8)) | flat[k : k + len(keys)]
    valid = np.ones(len(keys), bool)
    if order:
        for k in range(order):
            valid[ends[:-1] - k] = False
    return keys[valid], np.concatenate(([0], np.cumsum(lengths + 1)))


class _Tally:
    """Distinct values with counts, merged now and then so that memory follows the distinct ones."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        self.limit = GATHERED

    def add(self, values: np.ndarray) -> None:
        self.parts.append(arrays.counted(values))
        self.size += len(self.parts[-1][0])
        if self.size > self.limit:
            merged = self.merged()
            self.parts, self.size = [merged], len(merged[0])
            self.limit = max(GATHERED, 2 * self.size)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        return _summed(np.concatenate([p[0] for p in self.parts]), np.concatenate([p[1] for p in self.parts]))


def _summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(values):
        return values, counts
    by = np.argsort(values, kind="stable")
    values, counts = values[by], counts[by]
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[at], np.add.reduceat(counts, at)


def corpus_counts(docs: DataFrame) -> DataFrame:
    """``(kind, key, n)`` over all texts: byte runs of the longest order, and hashes of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies = {NGRAM: _Tally(), WORD: _Tally()}
        for batch in batches:
            for _, data, offsets in arrays.pieces(batch, "text", 1 << 20):
                tallies[NGRAM].add(symbols(data, offsets)[0])
                tallies[WORD].add(arrays.words(data, offsets, arrays.BLANK_SEPARATED).hashes)
        for kind, tally in tallies.items():
            values, counts = tally.merged()
            for k in range(0, len(values), 200_000):
                part = values[k : k + 200_000].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), kind, np.int8)), pa.array(part), pa.array(counts[k : k + 200_000])],
                    ["kind", "key", "n"],
                )

    lowered = docs.select("text").mapInArrow(count, "kind tinyint, key bigint, n bigint")
    return lowered.groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Table:
    """Open addressing over arrays: a value for each of many distinct 64-bit keys."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, self.EMPTY)
        self.values = np.zeros(1 << bits, values.dtype)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot] == self.EMPTY
            self.keys[slot[free]] = keys[left[free]]
            placed = self.keys[slot] == keys[left]
            self.values[slot[placed]] = values[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and which keys there are."""
        slot = self._slot(keys)
        there = self.keys[slot]
        out, found = self.values[slot], there == keys
        left = np.flatnonzero(~found & (there != self.EMPTY))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.values[slot[hit]]
            found[left[hit]] = True
            on = ~hit & (there != self.EMPTY)
            left, slot = left[on], slot[on]
        return out, found


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key, -1 where there is none."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


def _low(order: int) -> np.uint64:
    return np.uint64((1 << (8 * order)) - 1)


class Level:
    """Contexts of one order: their successors with log10 of counts and probabilities, and what an escape costs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, shorter: Level | None, order: int):
        self.keys = keys
        context = keys >> np.uint64(8)
        at = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(keys) else np.empty(0, np.int64)
        self.contexts = context[at]
        self.counts = counts
        self.total = np.add.reduceat(counts, at) if len(at) else counts
        self.distinct = np.diff(np.append(at, len(keys)))
        self.log_count = np.log10(counts - 0.5)
        self.plain = self.log_count - np.log10(np.repeat(self.total, self.distinct))
        self.escape = np.log10(0.5 * self.distinct / self.total)
        if shorter is None:
            return
        # In the shorter context, the symbols seen here are ruled out.
        parent = _find(shorter.contexts, self.contexts & _low(order - 1))
        there = shorter.counts[_find(shorter.keys, keys & _low(order))]
        gone = np.add.reduceat(there, at) if len(at) else there
        new = shorter.distinct[parent] - self.distinct
        rest = shorter.total[parent] - gone
        self.down_whole = np.log10(np.maximum(rest, 1))
        self.down_escape = np.where(new > 0, np.log10(np.maximum(0.5 * new, 0.5)) - self.down_whole, 0.0)

    def trim(self) -> None:
        """Drop what only longer contexts needed while they were built."""
        del self.counts, self.total
        self.plain, self.log_count = self.plain.astype(np.float32), self.log_count.astype(np.float32)


class Trie:
    """The levels of one block of contexts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, pair_keys: np.ndarray, pair_counts: np.ndarray, order: int = ORDER):
        tables = [_summed(pair_keys & np.uint64(0xFF), pair_counts), (pair_keys, pair_counts)]
        longer = [(keys, counts)]
        for k in range(order - 1, 1, -1):
            longer.append(_summed(longer[-1][0] & _low(k + 1), longer[-1][1]))
        self.order = order
        self.levels: list[Level] = []
        for k, (own, n) in enumerate([*tables, *reversed(longer)][: order + 1]):
            self.levels.append(Level(own, n, self.levels[-1] if k else None, k))
        self.seen = int(self.levels[0].distinct[0]) if len(keys) else 0
        for level in self.levels:
            level.trim()
            del level.distinct
        del self.levels[-1].log_count

    def open(self) -> None:
        """Turn the longest contexts into a table, once in every worker."""
        top = self.levels[self.order]
        if hasattr(top, "plain"):
            self.table = Table(top.keys, top.plain)
            del top.keys, top.plain

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol in its context."""
        out, found = self.table.get(keys)
        out = out.astype(np.float64)
        left = np.flatnonzero(~found)
        if not len(left):
            return out
        keys = keys[left]
        total = np.zeros(len(left))
        node = _find(self.levels[-1].contexts, keys >> np.uint64(8))
        total[node >= 0] = self.levels[-1].escape[node[node >= 0]]
        open_ = np.ones(len(left), bool)
        for k in range(self.order - 1, -1, -1):
            level, above = self.levels[k], self.levels[k + 1]
            entry = _find(level.keys, keys & _low(k + 1))
            context = _find(level.contexts, (keys & _low(k + 1)) >> np.uint64(8))
            ruled, hit = node >= 0, entry >= 0
            for mask, add in (
                (open_ & ruled & hit, lambda m: level.log_count[entry[m]] - above.down_whole[node[m]]),
                (open_ & ruled & ~hit, lambda m: above.down_escape[node[m]]),
                (open_ & ~ruled & hit, lambda m: level.plain[entry[m]]),
                (open_ & ~ruled & ~hit & (context >= 0), lambda m: level.escape[context[m]]),
            ):
                total[mask] += add(mask)
            open_ &= ~hit
            node = context
        total[open_] -= np.log10(max(1, SYMBOLS - self.seen))
        out[left] = total
        return out


def _block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
    return ((keys >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(blocks)


def _scorer(sent: Broadcast):
    """Adds to ``score`` what the contexts say of each text of ``(doc_id, text, held_out, score)``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = sent.value
        trie.open()
        for batch in batches:
            for rows, data, offsets in arrays.pieces(batch, "text", 1 << 20):
                keys, bounds = symbols(data, offsets)
                score = rows.column(3).to_numpy(zero_copy_only=False) + np.add.reduceat(trie.log10(keys), bounds[:-1])
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], pa.array(score)], rows.schema.names)

    return add


def _block_scorer(sent: Broadcast, block: int, blocks: int):
    """What the contexts of one block say of each text of ``(row, text)``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = sent.value
        trie.open()
        for batch in batches:
            for rows, data, offsets in arrays.pieces(batch, "text", 1 << 20):
                keys, bounds = symbols(data, offsets)
                own = _block_of(keys, blocks) == block
                logs = np.zeros(len(keys))
                logs[own] = trie.log10(keys[own])
                number = pa.array(np.full(rows.num_rows, block, np.int32))
                yield pa.RecordBatch.from_arrays([rows.column(0), number, pa.array(np.add.reduceat(logs, bounds[:-1]))], ["row", "block", "score"])

    return score


def trie_scores(docs: DataFrame, counts: DataFrame, after, schema: str, block: int = BLOCK) -> DataFrame:
    """``score`` of every row of ``(doc_id, text, held_out)`` under the counts of :func:`corpus_counts`.

    ``after`` goes on with the scored batches, with one block in the same Python worker, into rows of ``schema``, which
    are written; then the workers drop the trie. Of several blocks one is held at a time: its scores are written and its
    trie is dropped before the next is built.
    """
    runs = counts.filter(F.col("kind") == NGRAM).select("key", "n")
    blocks = -(-max(1, runs.count()) // block)
    # At most 65,536 pairs of bytes.
    pairs = runs.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    pair_keys, pair_counts = _summed(pairs["key"].to_numpy().view(np.uint64), pairs["n"].to_numpy())
    part = F.shiftright("key", 8).bitwiseAND(0xFFFF) % blocks

    def sent_block(k: int) -> Broadcast:
        own = runs.filter(part == k).toArrow()
        keys, n = _summed(own["key"].to_numpy().view(np.uint64), own["n"].to_numpy())
        return docs.sparkSession.sparkContext.broadcast(Trie(keys, n, pair_keys, pair_counts))

    if blocks == 1:
        sent = sent_block(0)
        out = docs.withColumn("score", F.lit(0.0)).mapInArrow(_chained(_scorer(sent), after), schema)
        out = materialise(out, "scored")
        sent.unpersist()
        return out
    # Written, since the number of a row must be the same for every block.
    rows = materialise(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    scores = None
    for k in range(blocks):
        sent = sent_block(k)
        one = rows.select("row", "text").mapInArrow(_block_scorer(sent, k, blocks), "row bigint, block int, score double")
        one = materialise(one, "block")
        sent.destroy()
        scores = one if scores is None else scores.unionByName(one)
    # Added up in the order of blocks, as sums depend on it.
    listed = F.array_sort(F.collect_list(F.struct("block", "score")))
    total = scores.groupBy("row").agg(F.aggregate(listed, F.lit(0.0), lambda a, s: a + s["score"]).alias("score"))
    scored = rows.join(total, "row").select("doc_id", "text", "held_out", "score")
    return materialise(scored.mapInArrow(after, schema), "scored")


def _chained(first, second):
    return lambda batches: second(first(batches))


_CHUNK = (
    "chunk bigint, bucket int, hashes binary, docs binary, counts binary,"
    " ids array<bigint>, held array<boolean>, tokens array<bigint>, scores array<double>"
)


def _word_rows(buckets: int):
    """Per piece of documents: one row with what is known of them, and per bucket its words with documents and counts."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, data, offsets in arrays.pieces(batch, "text"):
                found = arrays.words(data, offsets, arrays.BLANK_SEPARATED)
                per_doc = np.diff(found.bounds)
                by = np.argsort(found.hashes, kind="stable")
                hashes, doc = found.hashes[by], np.repeat(np.arange(rows.num_rows, dtype=np.uint32), per_doc)[by]
                at = np.flatnonzero(np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])))[: len(hashes)])
                count = np.diff(np.append(at, len(hashes))).astype(np.uint32)
                hashes, doc = hashes[at], doc[at]
                # Sorted by hash, a bucket is a range.
                cuts = np.searchsorted(((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(1, buckets))
                cuts = np.concatenate(([0], cuts, [len(hashes)]))
                own = [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                some = [k for k, (a, b) in enumerate(own) if b > a]
                packed = [[x[own[k][0] : own[k][1]].tobytes() for k in some] for x in (hashes, doc, count)]
                n = len(some) + 1
                none = [None] * len(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, number, np.int64)),
                        pa.array([-1, *some], pa.int32()),
                        *[pa.array([None, *p], pa.binary()) for p in packed],
                        pa.array([rows.column(0).to_pylist(), *none], pa.list_(pa.int64())),
                        pa.array([rows.column(2).to_pylist(), *none], pa.list_(pa.bool_())),
                        pa.array([per_doc + 1, *none], pa.list_(pa.int64())),
                        pa.array([rows.column(3).to_pylist(), *none], pa.list_(pa.float64())),
                    ],
                    ["chunk", "bucket", "hashes", "docs", "counts", "ids", "held", "tokens", "scores"],
                )
                number += 1

    return chunks


def _bucket(key: Column, buckets: int) -> Column:
    """The same bucket from the signed hash: its top 32 bits, times the number of buckets, shifted down."""
    return F.shiftright(F.shiftrightunsigned(key, 32) * buckets, 32).cast("int")


def _base(train_tokens: int, train_words: int):
    """Adds up the base score of each document: per bucket first its counts, then the documents' words."""

    def log10(c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.5) / (train_tokens + 0.5 * (train_words + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, keys, counts = None, [], []
        table = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != current:
                    current, keys, counts, table = row["bucket"], [], [], None
                if row["chunk"] is None:
                    keys.append(np.frombuffer(row["hashes"], np.uint64))
                    counts.append(np.frombuffer(row["counts"], np.int64))
                    continue
                if table is None:
                    known = np.concatenate(keys) if keys else np.empty(0, np.uint64)
                    table = Table(known, np.concatenate(counts) if counts else np.empty(0, np.int64))
                doc = np.frombuffer(row["docs"], np.uint32)
                times = np.frombuffer(row["counts"], np.uint32)
                count, found = table.get(np.frombuffer(row["hashes"], np.uint64))
                count = np.where(found, count, 0)
                base = np.bincount(doc, log10(count) * times)
                known = np.bincount(doc, found * times)
                there = np.flatnonzero(np.bincount(doc))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(there), row["chunk"], np.int64)),
                        pa.array(there.astype(np.int32)),
                        pa.array(base[there]),
                        pa.array(known[there].astype(np.int64)),
                    ],
                    ["chunk", "i", "base", "known"],
                )

    return score


def _packed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(bucket, key, n)`` of a task as few rows of packed arrays."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        bucket, key, n = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(3))
        by = np.argsort(bucket, kind="stable")
        groups = np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(bucket[g[0]]) for g in groups], pa.int32()),
                pa.array([key[g].astype(np.int64).tobytes() for g in groups], pa.binary()),
                pa.array([n[g].astype(np.int64).tobytes() for g in groups], pa.binary()),
            ],
            ["bucket", "hashes", "counts"],
        )

    held: list[pa.RecordBatch] = []
    for batch in parts:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= 200_000:
            yield pack(held)
            held = []
    if held:
        yield pack(held)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def score_documents(docs: DataFrame) -> DataFrame:
    """Base score and code length of every row of ``(doc_id, text)``, learned from the rows not held out.

    Null text is empty and has the end alone. Rows without doc_id are training rows; repeated rows count and are
    scored each for itself. An empty table gives no rows; without training rows every symbol is equally likely.
    Further columns are ignored.
    """
    marked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("held_out", held_out(F.col("doc_id")))
    training = marked.filter(~F.col("held_out"))
    counts = materialise(corpus_counts(training), "counts")
    words = counts.filter(F.col("kind") == WORD).select("key", "n")
    ends = training.count()
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    train_tokens, train_words = (total["n"] or 0) + ends, total["v"] + (ends > 0)
    buckets = max(BUCKETS, -(-train_words // BUCKET_WORDS))
    chunks = trie_scores(marked, counts, _word_rows(buckets), _CHUNK)
    vocabulary = words.select(_bucket(F.col("key"), buckets).alias("bucket"), "key", "n").mapInArrow(
        _packed, "bucket int, hashes binary, counts binary"
    )
    columns = ["bucket", "chunk", "hashes", "docs", "counts"]
    vocabulary = vocabulary.select("bucket", F.lit(None).cast("bigint").alias("chunk"), "hashes", F.lit(None).cast("binary").alias("docs"), "counts")
    sent = chunks.filter("bucket >= 0").select(*columns).unionByName(vocabulary)
    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", F.col("chunk").asc_nulls_first())
    base = dealt.mapInArrow(_base(train_tokens, train_words), "chunk bigint, i int, base double, known bigint")
    base = base.groupBy("chunk", "i").agg(F.sum("base").alias("base"), F.sum("known").alias("known"))
    listed = chunks.filter("bucket < 0").select("chunk", F.posexplode(F.arrays_zip("ids", "held", "tokens", "scores")).alias("i", "d"))
    end = float(np.log10((ends + 0.5) / (train_tokens + 0.5 * (train_words + 1))))
    return listed.join(base, ["chunk", "i"], "left").select(
        F.col("d.ids").alias("doc_id"),
        F.col("d.held").alias("held_out"),
        F.col("d.tokens").alias("n_tokens"),
        (F.coalesce("known", F.lit(0)) + int(ends > 0)).cast("bigint").alias("n_known"),
        F.lit(train_tokens).cast("bigint").alias("train_tokens"),
        (F.coalesce("base", F.lit(0.0)) + end).alias("base_score"),
        F.col("d.scores").alias("score"),
    )
