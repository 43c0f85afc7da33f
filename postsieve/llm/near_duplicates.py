"""Near duplicates by MinHash with tensored banding, links confirmed on full shingle sets.

Two small collections of sub-signatures, each of two minhashes, are computed per document. The tables are all pairs
of one entry of either collection, so 22 sub-signatures give 121 tables of four minhashes each. A pair of documents
with similarity 0.75 meets in no table with a chance of about 2 in 10,000, one of 0.8 with 3 in 100,000.

1. Documents of equal sets are one node. Sub-signatures that only one node has cannot meet another and are dropped;
   table keys are formed from the rest, so most documents bring no key at all.
2. In each bucket all nodes are compared with the least one. Confirmed links give components.
3. Rounds of hubs: where a bucket still holds several components, the nodes outside the largest are compared with one node
   of it, drawn anew for each bucket and round. A node's first link puts it into the component. Rounds go on while each
   settles a tenth of what it found, so that their pairs stay in proportion to the rows of the buckets.
4. What is left outside is joined with all nodes of such buckets by the rarest shingles of their full sets: a pair that is
   similar enough shares one of its first, and from there on has enough left on both sides. Passages that many texts share
   come last in this order, and texts that have little more in common form no pair at all.

Before full sets are compared, sketches of one bit from each of 2,048 further minhashes rule most pairs out. A pair at
the threshold agrees in 7/8 of the bits; one in 100,000 such pairs agrees in fewer than the number asked for.

No step emits all pairs of a group: inside a component nothing is compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.llm import arrays
from postsieve.llm.graph import components
from postsieve.llm.text import fresh, text_key
from postsieve.session import materialise

SHINGLE = 5
# Percent of the union that the intersection must reach.
SIMILAR = 75
SIDES = 11
# Bits of a sketch in 64-bit words, and how many must agree: 4.2 standard deviations below what the threshold gives.
SKETCH = 32
AGREE = 1729
# Another round of hubs follows one that settled at least so many percent of the rows outside the largest components.
SETTLED = 10
_FEATURES = "doc_id bigint, text_key bigint, n_shingles bigint, digest binary, sig array<bigint>"
_SKETCHED = "node bigint, n bigint, sketch array<bigint>, shingles array<bigint>"


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two collections of ``SIDES`` sub-signatures for each non-empty set of hashes."""
    rng = np.random.default_rng(3)
    factors = rng.integers(0, 2**63, 4 * SIDES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    starts = bounds[:-1]
    out = np.empty((len(starts), 2 * SIDES), np.uint64)
    for k in range(2 * SIDES):
        first, second = (np.minimum.reduceat(values * f, starts) for f in factors[2 * k : 2 * k + 2])
        out[:, k] = arrays.mix(first * np.uint64(31) + arrays.mix(second))
    return out.view(np.int64)


def sketches(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``SKETCH`` words per non-empty set: one bit of the least value under each of 64 permutations a word."""
    rng = np.random.default_rng(4)
    low = (values >> np.uint64(32)).astype(np.uint32)
    starts = bounds[:-1]
    out = np.zeros((len(starts), SKETCH), np.uint64)
    for word in range(SKETCH):
        for bit in range(64):
            factor = np.uint32(rng.integers(0, 2**31)) * np.uint32(2) + np.uint32(1)
            least = np.minimum.reduceat((low ^ (low >> np.uint32(15))) * factor, starts)
            least = (least ^ (least >> np.uint32(16))) * np.uint32(0x85EBCA6B)
            out[:, word] |= (least >> np.uint32(31)).astype(np.uint64) << np.uint64(bit)
    return out.view(np.int64)


def _digests(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """128 bits for each non-empty set of hashes, whatever its order."""
    both = [np.add.reduceat(arrays.mix(values + np.uint64(salt)), bounds[:-1]) for salt in (0x9E37, 0x79B97F4A)]
    return np.stack([arrays.mix(b) for b in both], axis=1)


def _sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """Shingles and bounds of all texts, which texts have any, and the digest of each."""
    found = arrays.words(data, offsets, arrays.BLANK_SEPARATED)
    values, bounds = arrays.shingles(found, SHINGLE)
    some = np.flatnonzero(np.diff(bounds))
    digest: list[bytes | None] = [None] * (len(offsets) - 1)
    if len(some):
        for k, d in zip(some.tolist(), _digests(values, np.append(bounds[some], bounds[-1])), strict=True):
            digest[k] = d.tobytes()
    return values, bounds, some, digest


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in arrays.pieces(batch, "text"):
            values, bounds, some, digest = _sets(data, offsets)
            sig: list[np.ndarray | None] = [None] * rows.num_rows
            if len(some):
                for k, s in zip(some.tolist(), signatures(values, np.append(bounds[some], bounds[-1])), strict=True):
                    sig[k] = s
            yield pa.RecordBatch.from_arrays(
                [*rows.columns[:2], pa.array(np.diff(bounds)), pa.array(digest, pa.binary()), pa.array(sig, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n_shingles", "digest", "sig"],
            )


def _sketched_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offsets in arrays.pieces(batch, "text"):
            values, bounds, some, _ = _sets(data, offsets)
            if len(some):
                found = list(sketches(values, np.append(bounds[some], bounds[-1])))
                sets = [values[bounds[k] : bounds[k + 1]].view(np.int64) for k in some.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(some)) for c in rows.columns[:2]), pa.array(found, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int64()))],
                    ["node", "n", "sketch", "shingles"],
                )


def _agree(a: str, b: str) -> Column:
    """Whether enough bits of the sketches in the columns ``<side><word>`` agree."""
    differ = sum(F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(SKETCH))
    return differ <= 64 * SKETCH - AGREE


def _near_sizes(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= SIMILAR * F.greatest(a, b)


class _Corpus:
    """The nodes of one table of documents, and what links them."""

    def __init__(self, docs: DataFrame):
        docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
        self.docs = docs
        self.rows = materialise(docs.mapInArrow(_features, _FEATURES), "features")
        # The least document that has a set stands for the node.
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
        nodes = self.rows.filter("digest is not null").groupBy("digest").agg(
            F.min("doc_id").alias("first_id"),
            F.min_by("text_key", order).alias("first_key"),
            F.first("n_shingles").alias("n"),
            F.first("sig").alias("sig"),
        )
        self.nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def keys(self) -> DataFrame:
        """The table keys of the sub-signatures that a node shares with another, as rows of :meth:`open_buckets`.

        Each node is a component of its own as yet, and the greatest of a bucket is its lead.
        """
        parts = self.nodes.select("node", F.posexplode("sig").alias("k", "v"))
        shared = parts.groupBy("k", "v").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
        shared = materialise(shared.select("k", "v"), "shared")
        held = parts.join(shared, ["k", "v"]).groupBy("node").agg(F.collect_list(F.struct("k", "v")).alias("s"))
        side = lambda low: F.filter("s", lambda x: (x["k"] < SIDES) if low else (x["k"] >= SIDES))
        pairs = lambda a: F.transform(side(False), lambda b: F.xxhash64(a["k"], b["k"], a["v"], b["v"]))
        keys = held.select("node", F.explode(F.flatten(F.transform(side(True), pairs))).alias("key"))
        keys = materialise(keys, "keys")
        met = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
        return materialise(keys.join(met.select("key", F.col("hi").alias("lead")), "key").withColumn("component", F.col("node")), "met")

    def sketch(self, keys: DataFrame) -> None:
        """Sketches and full sets of the nodes that meet others, each from the whole text that stands for the node."""
        held = self.nodes.join(keys.select("node").distinct(), "node", "left_semi")
        held = held.select("node", "n", F.xxhash64("first_id", "first_key").alias("place"))
        texts = self.docs.select(F.xxhash64("doc_id", "text_key").alias("place"), "text").join(held, "place")
        found = texts.dropDuplicates(["place", "node"]).select("node", "n", "text").mapInArrow(_sketched_sets, _SKETCHED)
        words = [F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH)]
        self.sketched = materialise(found.select("node", "n", *words, "shingles"), "sketches")

    def agreeing(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and sketches do not rule them out."""
        words = lambda c: [F.col(f"s{k}").alias(f"s{c}{k}") for k in range(SKETCH)]
        side = lambda c: self.sketched.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), *words(c))
        held = pairs.join(side("u"), "u").join(side("v"), "v")
        return held.filter(_near_sizes(F.col("nu"), F.col("nv")) & _agree("su", "sv")).select("u", "v", "nu", "nv")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The agreeing pairs whose full sets are similar enough."""
        pairs = materialise(pairs, "candidates")
        side = lambda c: self.sketched.select(F.col("node").alias(c), F.col("shingles").alias(f"s{c}"))
        both = F.size(F.array_intersect("su", "sv"))
        held = pairs.join(side("u"), "u").join(side("v"), "v").withColumn("both", both)
        held = held.filter(F.col("both") * 100 >= SIMILAR * (F.col("nu") + F.col("nv") - F.col("both")))
        return materialise(held.select("u", "v"), "links")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """The links among some pairs of nodes."""
        return self.confirmed(self.agreeing(pairs))

    def merged(self, rows: DataFrame, links: DataFrame, turn: int) -> DataFrame:
        """``(part, whole)``: the components that some links between nodes of the rows bring together, by their least."""
        if turn:
            place = rows.select("node", "component").distinct()
            links = links.join(place.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u")
            links = links.join(place.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v")
            links = links.select(F.col("cu").alias("u"), F.col("cv").alias("v"))
        return materialise(components(links).select(F.col("node").alias("part"), F.col("component").alias("whole")), "merged")

    def open_buckets(self, rows: DataFrame, merged: DataFrame) -> DataFrame:
        """Rows ``(key, node, component, lead)`` of the buckets that still hold several components after a merge.

        ``lead`` is the component that most nodes of a bucket have.
        """
        rows = materialise(_in_whole(rows.select("key", "node", "component"), merged), "placed")
        sizes = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        lead = sizes.groupBy("key").agg(
            F.max_by("component", F.struct("n", "component")).alias("lead"), F.count(F.lit(1)).alias("parts")
        )
        return materialise(rows.join(materialise(lead.filter("parts > 1").drop("parts"), "lead"), "key"), "open")

    def hub_pairs(self, rows: DataFrame, turn: int) -> DataFrame:
        """The nodes outside the lead of each bucket with one node of the lead, drawn by hash for this turn and bucket.

        In the first turn the lead is a single node.
        """
        if not turn:
            return rows.filter("component <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v")).distinct()
        hubs = rows.filter("component = lead").groupBy("key").agg(F.min_by("node", F.xxhash64(F.lit(turn), "key", "node")).alias("hub"))
        pairs = rows.filter("component <> lead").join(materialise(hubs, "hubs"), "key")
        return pairs.select(F.least("hub", "node").alias("u"), F.greatest("hub", "node").alias("v")).distinct()

    def rest_pairs(self, rows: DataFrame) -> DataFrame:
        """Pairs of nodes of the open buckets, at least one outside a lead, that may be similar enough, by a prefix join.

        With shingles in order of rarity among these nodes, a set of n can only share 75 % of the union with another if they
        share one of its first n - ceil(0.75 n) + 1. From the places of a shared one on, enough must be left on both sides.
        """
        place = rows.groupBy("node").agg(F.first("component").alias("component"), F.max(F.col("component") != F.col("lead")).alias("outside"))
        place = materialise(place, "crowd")
        sets = self.sketched.join(place.select("node"), "node", "left_semi")
        tokens = materialise(sets.select("node", F.explode("shingles").alias("t")), "tokens")
        often = materialise(tokens.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "often")
        counted = tokens.join(often, "t", "left").select("node", F.struct(F.coalesce("df", F.lit(1)).alias("df"), "t").alias("x"))
        ranked = counted.groupBy("node").agg(F.sort_array(F.collect_list("x")).alias("s"))
        n = F.size("s")
        prefix = F.slice("s", 1, (n - F.ceil(n * SIMILAR / 100) + 1).cast("int"))
        held = F.filter(F.transform(prefix, lambda x, i: F.struct(x["df"].alias("df"), x["t"].alias("t"), i.alias("i"))), lambda x: x["df"] > 1)
        first = ranked.select("node", n.alias("n"), F.explode(held).alias("x")).select("node", "n", "x.t", "x.i")
        first = materialise(first.join(place, "node"), "prefixes")
        a, b = first.filter("outside").alias("a"), first.alias("b")
        once = ~F.col("b.outside") | (F.col("a.node") < F.col("b.node"))
        left = F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i"))
        enough = (100 + SIMILAR) * left >= SIMILAR * (F.col("a.n") + F.col("b.n"))
        across = (F.col("a.t") == F.col("b.t")) & (F.col("a.component") != F.col("b.component"))
        pairs = a.join(b, across & once & _near_sizes(F.col("a.n"), F.col("b.n")) & enough)
        return pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()

    def merges(self) -> list[DataFrame]:
        """What :meth:`merged` found turn by turn; one after another they take each node to its component."""
        rows = self.keys()
        self.sketch(rows)
        merges, tried, turn, settled = [], None, 0, True
        outside = rows.filter("component <> lead").count()
        while outside and settled:
            pairs = self.hub_pairs(rows, turn)
            pairs = materialise(pairs.join(tried, ["u", "v"], "left_anti") if turn else pairs, "pairs")
            merges.append(self.merged(rows, self.compared(pairs), turn))
            tried = tried.unionByName(pairs) if turn else pairs
            rows, turn, before = self.open_buckets(rows, merges[-1]), turn + 1, outside
            outside = rows.filter("component <> lead").count()
            settled = 100 * (before - outside) >= SETTLED * before
        if outside:
            pairs = materialise(self.rest_pairs(rows).join(tried, ["u", "v"], "left_anti"), "pairs")
            merges.append(self.merged(rows, self.compared(pairs), turn))
        return merges


def _in_whole(rows: DataFrame, merged: DataFrame) -> DataFrame:
    """``rows`` with the component that theirs is part of after a merge."""
    held = rows.join(merged, F.col("component") == F.col("part"), "left")
    return held.withColumn("component", F.coalesce("whole", "component")).drop("part", "whole")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept, text_key, group)`` for each row of ``(doc_id, text)``.

    ``text_key`` is a hash of the text, ``group`` a number of the component, null for a row without words.

    A document without words has no shingles and stands alone; one of fewer than five words has one. Rows of equal
    sets always belong together, repeated rows too. A component is named by its least doc_id, ``kept`` marks the rows
    that have it; rows without doc_id are linked like others and never kept, and a component of such rows alone has a
    null name. Two rows of one doc_id with different texts are two documents, each named by its own component. An
    empty table gives no rows; further columns are ignored.
    """
    corpus = _Corpus(docs)
    named = corpus.nodes.select("digest", "first_id", F.col("node").alias("component"))
    for merged in corpus.merges():
        named = _in_whole(named, merged)
    named = materialise(named, "named")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    held = named.join(materialise(least, "names"), "component")
    names = held.select("digest", "component_id", F.col("component").alias("group"))
    found = corpus.rows.join(names, "digest", "left")
    name = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id",
        "n_shingles",
        name.alias("component_id"),
        F.coalesce(F.col("doc_id") == name, F.lit(False)).alias("kept"),
        "text_key",
        "group",
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates: that of the least doc_id, rows without doc_id last.

    Rows without words are near duplicates of nothing and all stay. All columns are kept.
    """
    found = near_duplicates(docs).filter("group is not null")
    first = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("f"))
    first = materialise(first.select(F.col("f.doc_id").alias("_id"), F.col("f.text_key").alias("_key")), "first")
    same = first["_id"].eqNullSafe(docs["doc_id"]) & (first["_key"] == text_key(docs["text"]))
    with_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = docs.filter(with_words).join(first, same, "left_semi")
    # Of rows repeated with all they hold in common, the first stays.
    one = Window.partitionBy("doc_id", text_key(F.col("text"))).orderBy(F.lit(0))
    n = fresh(docs, "n")
    kept = kept.withColumn(n, F.row_number().over(one)).filter(F.col(n) == 1).drop(n)
    return kept.unionByName(docs.filter(~with_words))
