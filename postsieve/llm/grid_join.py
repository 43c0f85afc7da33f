"""Near duplicates among embeddings of one label by an epsilon grid order join.

Vectors of length one with a cosine of 0.93 or more lie within a distance ``EPS``, and so do their shadows on any
orthonormal directions.

1. Equal vectors of a label are one node, counted. Principal directions come from the covariance of all nodes, of which
   only sums per pair of coordinates reach the driver.
2. Nodes of a label are put in the order of their grid cells of width ``EPS`` on the leading directions, and the sequence
   is cut into blocks, each with its bounding box.
3. Intervals of the sequence are joined recursively, all pairs of a level at once: starting from the whole sequence with
   itself, each pair is replaced by the pairs of its parts, and those whose boxes lie over ``EPS`` apart are dropped. What
   is left are pairs of blocks that may hold links.
4. Each pair of blocks goes to one task, which carries the recursion on down to leaves of the sequence. Leaves whose balls
   are over ``EPS`` apart are skipped, and leaves within ``EPS`` of each other throughout are linked whole; only what lies
   between is compared, in single precision first, and again in double precision where that is too close to the threshold.

A task returns for each node the number of its links and a root of the nodes that it saw linked, never the links
themselves, so that a dense group gives rows in proportion to its nodes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.llm.graph import components
from postsieve.operators.keyed import number_rows, same_keys
from postsieve.session import materialise

SIMILAR = 0.93
# Boxes and balls are computed in double precision; what is near their bounds is compared.
SLACK = 1e-6
DIRECTIONS = 8
# Coordinates from which directions are formed; longer vectors are projected by these alone, which any bound allows.
COORDINATES = 512
# Blocks are a quarter of a label, within these bounds; leaves are runs of a block; intervals have so many parts.
BLOCK, LARGEST_BLOCK, LEAF, FAN = 256, 16_384, 256, 8
# Bytes of vectors in a block, unless they are so long that not even the least block keeps to it.
BLOCK_BYTES = 32 << 20
_CELLS = [f"c{k}" for k in range(DIRECTIONS)]


def _eps(similar: float) -> float:
    return math.sqrt(2 - 2 * similar) + SLACK


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of equal length as rows, each scaled by a power of two to at most one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    rows = np.array(column.flatten(), np.float64).reshape(n, -1)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None]) if n else rows


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of each length, with their vectors of length one."""
    lengths = np.array(batch.column("dim"))
    for d in np.unique(lengths):
        rows = batch.filter(pa.array(lengths == d))
        yield rows, _unit(matrix(rows.column("e")))


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of coordinates, of coordinates (j = -1) and the count (i = j = -1), once per task."""
    outer, total, n = np.zeros((0, 0)), np.zeros(0), 0
    for batch in batches:
        for _, unit in _by_length(batch):
            unit = unit[:, :COORDINATES]
            d = unit.shape[1]
            if d > len(total):
                outer = np.pad(outer, (0, d - len(total)))
                total = np.pad(total, (0, d - len(total)))
            outer[:d, :d] += unit.T @ unit
            total[:d] += unit.sum(axis=0)
            n += len(unit)
    i, j = np.triu_indices(len(total))
    none = np.full(len(total) + 1, -1)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate((i, np.arange(-1, len(total)))), pa.int32()),
            pa.array(np.concatenate((j, none)), pa.int32()),
            pa.array(np.concatenate((outer[i, j], [n], total))),
        ],
        ["i", "j", "s"],
    )


def principal_directions(nodes: DataFrame) -> np.ndarray:
    """The leading directions of all nodes as columns; at most ``COORDINATES`` squared halves reach the driver."""
    sums = nodes.select("dim", "e").mapInArrow(_moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    found = sums.toPandas()
    d = int(found.i.max()) + 1 if len(found) else 0
    if d <= 0:
        return np.eye(1, 1)
    square, total = np.zeros((d, d)), np.zeros(d)
    pairs, single = found[found.j >= 0], found[(found.j < 0) & (found.i >= 0)]
    square[pairs.i, pairs.j] = square[pairs.j, pairs.i] = pairs.s
    total[single.i] = single.s
    n = float(found[found.i < 0].s.iloc[0])
    values, vectors = np.linalg.eigh(square / n - np.outer(total, total) / n**2)
    return np.ascontiguousarray(vectors[:, np.argsort(-values)[:DIRECTIONS]])


def _shadows(directions: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, unit in _by_length(batch):
                d = min(unit.shape[1], len(directions))
                at = np.zeros((DIRECTIONS, len(unit)))
                at[: directions.shape[1]] = (unit[:, :d] @ directions[:d]).T
                yield pa.RecordBatch.from_arrays([rows.column("node"), *[pa.array(x) for x in at]], ["node", *_CELLS])

    return run


def _apart(a: str, b: str) -> Column:
    """The squared distance of two boxes."""
    gap = [F.greatest(F.col(f"{a}.lo{k}") - F.col(f"{b}.hi{k}"), F.col(f"{b}.lo{k}") - F.col(f"{a}.hi{k}"), F.lit(0.0)) for k in range(DIRECTIONS)]
    return sum((g * g for g in gap[1:]), gap[0] * gap[0])


def block_pairs(boxes: DataFrame, eps: float) -> DataFrame:
    """``(pair, label, dim, a, b)``: the pairs of blocks that may hold links, by joining intervals level by level."""
    levels, last = 0, boxes.agg(F.max("block").alias("b")).first()["b"] or 0
    while FAN**levels <= last:
        levels += 1
    bounds = lambda: [f(f"{s}{k}").alias(f"{s}{k}") for s, f in (("lo", F.min), ("hi", F.max)) for k in range(DIRECTIONS)]
    pairs = boxes.select("label", "dim").distinct().withColumns({"a": F.lit(0).cast("bigint"), "b": F.lit(0).cast("bigint")})
    for level in range(levels - 1, -1, -1):
        parts = boxes.withColumn("part", F.expr(f"block div {FAN**level}")).groupBy("label", "dim", "part").agg(*bounds())
        parts = materialise(parts.withColumn("whole", F.expr(f"part div {FAN}")), "intervals")
        x, y, p = parts.alias("x"), parts.alias("y"), pairs.alias("p")
        in_x = (F.col("p.label") == F.col("x.label")) & (F.col("p.dim") == F.col("x.dim")) & (F.col("p.a") == F.col("x.whole"))
        in_y = (F.col("p.label") == F.col("y.label")) & (F.col("p.dim") == F.col("y.dim")) & (F.col("p.b") == F.col("y.whole"))
        near = (F.col("x.part") <= F.col("y.part")) & (_apart("x", "y") <= eps * eps)
        pairs = p.join(x, in_x).join(y, in_y & near).select("p.label", "p.dim", F.col("x.part").alias("a"), F.col("y.part").alias("b"))
        pairs = materialise(pairs, "interval-pairs")
    return materialise(pairs.withColumn("pair", F.monotonically_increasing_id()), "block-pairs")


class Block:
    """Vectors of a block in grid order, with the boxes and balls of its leaves."""

    def __init__(self, rows: np.ndarray, shadows: np.ndarray, first: int, weights: np.ndarray):
        self.rows, self.norms = rows, np.linalg.norm(rows, axis=1)
        self.unit = rows / self.norms[:, None]
        self.single = self.unit.astype(np.float32)
        self.first, self.weights = first, weights
        starts = np.arange(0, len(rows), LEAF)
        self.leaves = [slice(s, min(s + LEAF, len(rows))) for s in starts.tolist()]
        self.lo, self.hi = np.minimum.reduceat(shadows, starts), np.maximum.reduceat(shadows, starts)
        self.centres = np.stack([self.unit[s].mean(axis=0) for s in self.leaves])
        self.radii = np.array([np.linalg.norm(self.unit[s] - c, axis=1).max() for s, c in zip(self.leaves, self.centres, strict=True)])


class Links:
    """Counts of links and linked sets over the vectors of one or two blocks."""

    def __init__(self, n: int, similar: float):
        self.counts, self.parent = np.zeros(n, np.int64), np.arange(n)
        self.similar, self.eps = similar, _eps(similar)

    def roots(self, part: slice) -> np.ndarray:
        """The least of each one's set, with paths shortened."""
        at = self.parent[part]
        while True:
            up = self.parent[at]
            if (up == at).all():
                self.parent[part] = at
                return at
            at = up

    def union(self, a: slice, b: slice, linked: np.ndarray) -> None:
        left, right = self.roots(a), self.roots(b)
        across = linked & (left[:, None] != right[None, :])
        if not across.any():
            return
        i, j = np.nonzero(across)
        n = len(self.parent)
        for code in np.unique(left[i] * n + right[j]).tolist():
            x, y = divmod(code, n)
            while self.parent[x] != x:
                x = self.parent[x]
            while self.parent[y] != y:
                y = self.parent[y]
            self.parent[max(x, y)] = min(x, y)

    def leaf(self, a: Block, b: Block, s: int, t: int) -> None:
        x, y = a.leaves[s], b.leaves[t]
        apart = float(np.linalg.norm(a.centres[s] - b.centres[t]))
        reach = a.radii[s] + b.radii[t]
        if apart - reach > self.eps:
            return
        if apart + reach < self.eps - 2 * SLACK:
            linked = np.ones((x.stop - x.start, y.stop - y.start), bool)
        else:
            product = a.single[x] @ b.single[y].T
            margin = np.float32((a.unit.shape[1] + 8) * 2.4e-7)
            linked = product >= np.float32(self.similar)
            i, j = np.nonzero(np.abs(product - np.float32(self.similar)) <= margin)
            for k in range(0, len(i), 1 << 16):
                p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                u, v = p + x.start, q + y.start
                linked[p, q] = np.einsum("ij,ij->i", a.rows[u], b.rows[v]) / (a.norms[u] * b.norms[v]) >= self.similar
        own = a is b and s == t
        if own:
            np.fill_diagonal(linked, False)
        if not linked.any():
            return
        at_x, at_y = slice(a.first + x.start, a.first + x.stop), slice(b.first + y.start, b.first + y.stop)
        self.counts[at_x] += linked @ b.weights[y]
        if not own:
            self.counts[at_y] += a.weights[x] @ linked
        self.union(at_x, at_y, linked)

    def join(self, a: Block, b: Block, i: int, k: int, j: int, m: int) -> None:
        """Join the leaves from ``i`` to ``k`` of one block with those from ``j`` to ``m`` of the other."""
        gap = np.maximum(a.lo[i:k].min(axis=0) - b.hi[j:m].max(axis=0), b.lo[j:m].min(axis=0) - a.hi[i:k].max(axis=0))
        if np.square(np.maximum(gap, 0)).sum() > self.eps**2:
            return
        if k - i == 1 and m - j == 1:
            self.leaf(a, b, i, j)
        elif a is b and i == j and k == m:
            half = (i + k) // 2
            self.join(a, b, i, half, i, half)
            self.join(a, b, i, half, half, k)
            self.join(a, b, half, k, half, k)
        elif k - i >= m - j:
            self.join(a, b, i, (i + k) // 2, j, m)
            self.join(a, b, (i + k) // 2, k, j, m)
        else:
            self.join(a, b, i, k, j, (j + m) // 2)
            self.join(a, b, i, k, (j + m) // 2, m)


def _join_blocks(similar: float) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("block", "ascending"), ("pos", "ascending")])
        block = np.array(rows.column("block"))
        shadows = np.stack([np.array(rows.column(c)) for c in _CELLS], axis=1)
        vectors, weights = matrix(rows.column("e")), np.array(rows.column("n"))
        cut = int(np.searchsorted(block, block[0], side="right"))
        a = Block(vectors[:cut], shadows[:cut], 0, weights[:cut])
        b = Block(vectors[cut:], shadows[cut:], cut, weights[cut:]) if cut < len(block) else a
        found = Links(len(block), similar)
        found.join(a, b, 0, len(a.leaves), 0, len(b.leaves))
        some = np.flatnonzero(found.counts)
        nodes, roots = np.array(rows.column("node")), found.roots(slice(0, len(block)))
        return pa.table({"node": nodes[some], "root": nodes[roots[some]], "links": found.counts[some]})

    return run


def near_vectors(vectors: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for each row of ``vectors(vec_id, embedding, label)``.

    Two rows are linked if their labels are equal and not null, their vectors have the same length, and their cosine in
    double precision is ``similar`` or more (which must lie above zero). Null, empty and zero vectors and those that hold
    a null or a component that is not finite are linked with nothing, like rows without label; each is a component of
    its own. Repeated rows are rows of their own and linked like any others. A component is named by its least vec_id;
    ``kept`` marks the rows that have it. Rows without vec_id are linked like others and never kept; a component of such
    rows alone has a null name. An empty table gives no rows; further columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("e"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("label").isNotNull() & F.forall("e", finite) & F.exists("e", lambda x: x != 0)
    # Two hashes of all components stand for a vector.
    keys = {f"key{k}": F.when(usable, F.xxhash64(F.lit(k), "e")) for k in (1, 2)}
    rows = rows.withColumns(keys)
    nodes = rows.filter("key1 is not null").groupBy("label", "key1", "key2").agg(
        F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"), F.first("e").alias("e")
    )
    nodes = nodes.withColumn("dim", F.size("e"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")

    eps = _eps(similar)
    directions = principal_directions(nodes)
    shadows = nodes.select("node", "dim", "e").mapInArrow(_shadows(directions), "node bigint, " + ", ".join(f"{c} double" for c in _CELLS))
    placed = materialise(nodes.select("node", "label", "dim").join(shadows, "node"), "shadows")
    cells = [F.floor(F.col(c) / eps).alias(f"_{c}") for c in _CELLS]
    order = number_rows(placed.select("*", *cells), ["label", "dim"], [*[f"_{c}" for c in _CELLS], *_CELLS, "node"], "rank")
    sizes = placed.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("of"))
    fit = F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dim")))
    width = F.greatest(F.lit(BLOCK), F.least(F.lit(LARGEST_BLOCK), F.ceil(F.col("of") / 4), fit))
    order = same_keys(order, sizes.withColumn("width", width.cast("bigint")), ["label", "dim"])
    order = order.select("node", "label", "dim", *_CELLS, F.col("rank").alias("pos"), F.expr("(rank - 1) div width").alias("block"))
    order = materialise(order, "order")
    boxes = order.groupBy("label", "dim", "block").agg(
        *[f(F.col(c)).alias(f"{s}{k}") for s, f in (("lo", F.min), ("hi", F.max)) for k, c in enumerate(_CELLS)]
    )
    pairs = block_pairs(materialise(boxes, "boxes"), eps)

    sides = pairs.select("pair", "label", "dim", F.explode(F.array_distinct(F.array("a", "b"))).alias("block"))
    held = order.join(nodes.select("node", "n", "e"), "node").join(sides, ["label", "dim", "block"])
    found = held.select("pair", "block", "pos", "node", "n", "e", *_CELLS).groupBy("pair").applyInArrow(
        _join_blocks(similar), "node bigint, root bigint, links bigint"
    )
    found = materialise(found, "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = nodes.select("label", "key1", "key2", "n", "first_id", "node").join(counts, "node", "left").join(parts, "node", "left")
    named = materialise(named.withColumn("component", F.coalesce("component", "node")), "named")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "component").select(
        "label", "key1", "key2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.col("component_id")
    )
    named = materialise(named, "names").withColumn("known", F.lit(True))
    out = rows.drop("e").join(named, ["label", "key1", "key2"], "left")
    name = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        name.alias("component_id"),
        F.coalesce(F.col("vec_id") == name, F.lit(False)).alias("kept"),
    )
