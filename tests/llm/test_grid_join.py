import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsieve.llm import grid_join

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows):
    def good(r):
        return r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    vectors = [np.array(r[1], np.float32).astype(float) if good(r) else None for r in rows]
    links = [[] for _ in rows]
    for i, a in enumerate(vectors):
        for j, b in enumerate(vectors):
            if i != j and a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b):
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.93:
                    links[i].append(j)
    out = collections.Counter()
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        name = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out[(r[0], len(links[i]), name, r[0] is not None and r[0] == name)] += 1
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(3) for c in ["node", "n", "e", "key1", "dim", "block", "rank", "of"]})
    got = collections.Counter(map(tuple, grid_join.near_vectors(df).collect()))
    assert got == plain(rows)
    return got


def clusters(rng, groups, size, noise, d=24, label=0, first=0):
    rows = []
    for _ in range(groups):
        centre = rng.normal(size=d)
        for _ in range(size):
            rows.append((first + len(rows), (centre + rng.normal(size=d) * noise).astype(np.float32).tolist(), label))
    return rows


def test_odd_vectors(spark):
    a = [1.0, 2.0, 3.0]
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0, 0.0], 0), (4, [1.0, None, 2.0], 0), (5, [1.0, float("nan"), 0.0], 0),
        (6, [float("inf"), 0.0, 0.0], 0), (7, a, 0), (8, a, 0), (8, a, 0), (9, a, 1), (10, a, None), (11, a, None), (None, a, 0),
        (None, [-1.0, 0.0, 0.0], 2), (None, [-1.0, 0.0, 0.0], 2), (12, [1.0, 2.0], 0), (13, [2.0, 4.0], 0), (14, [5.0], 0), (15, [-5.0], 0),
        (16, [3e38, 3e38, -3e38], 0), (17, [1e-45, 0.0, 0.0], 0), (18, [1.0, 0.0, 0.0], 0), (19, [-0.0, 1.0], 0), (20, [0.0, 1.0], 0),
        (21, [2.0, 4.0, 6.0], 0), (22, [0.5] * 600, 0), (23, [0.5] * 599 + [0.6], 0), (24, [-0.5] * 600, 0),
    ]
    check(spark, rows)


def test_empty(spark):
    assert grid_join.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
    check(spark, [(1, None, 1), (2, [0.0], 1)])


def test_blocks_of_long_vectors_are_small(spark, monkeypatch):
    monkeypatch.setattr(grid_join, "BLOCK", 4)
    monkeypatch.setattr(grid_join, "BLOCK_BYTES", 8 * 700 * 10)
    sizes, old = [], grid_join.block_pairs

    def watched(boxes, eps):
        sizes.append(boxes.count())
        return old(boxes, eps)

    monkeypatch.setattr(grid_join, "block_pairs", watched)
    check(spark, clusters(np.random.default_rng(2), 10, 10, 0.2, d=700))
    assert sizes == [10]


@pytest.mark.parametrize("leaf", [2, 7, 256])
def test_clusters_against_all_pairs(spark, monkeypatch, leaf):
    """Near copies, chains around the threshold, a dense group and single vectors, over many blocks and leaves."""
    monkeypatch.setattr(grid_join, "BLOCK", 20)
    monkeypatch.setattr(grid_join, "LARGEST_BLOCK", 40)
    monkeypatch.setattr(grid_join, "FAN", 2)
    monkeypatch.setattr(grid_join, "LEAF", leaf)
    rng = np.random.default_rng(7)
    rows = clusters(rng, 20, 8, 0.25) + clusters(rng, 1, 120, 0.1, first=1000) + clusters(rng, 60, 1, 0, first=2000)
    rows += clusters(rng, 3, 30, 0.3, label=1, first=3000) + clusters(rng, 2, 20, 0.05, d=5, first=4000)
    rows += [(5000 + k, rows[200][1], 0) for k in range(150)]
    got = check(spark, rows)
    assert 100 < sum(n for r, n in got.items() if r[1] == 0) + 60 and max(r[1] for r in got) > 200


def test_both_sides_of_the_threshold(spark):
    rows = []
    for k, c in enumerate([0.93 - 1e-5, 0.93 - 1e-6, 0.93 + 1e-6, 0.93 + 1e-5]):
        rows += [(10 * k, [1.0, 0.0], k), (10 * k + 1, [c, float(np.sqrt(1 - c * c))], k)]
    assert sorted(r[1] for r in check(spark, rows).elements()) == [0] * 4 + [1] * 4


def test_links_are_found_without_comparing_far_or_dense_blocks(spark):
    """Groups far from one another: pairs of blocks grow with the blocks and not with their square."""
    rng = np.random.default_rng(1)
    boxes = []
    for n in (64, 256):
        step = [(0, 3, b, *[float(b) if s == "lo" and k == 0 else float(b) + 0.1 if k == 0 else 0.0 for s in ("lo", "hi") for k in range(8)]) for b in range(n)]
        names = [f"{s}{k}" for s in ("lo", "hi") for k in range(8)]
        boxes.append(spark.createDataFrame(step, "label int, dim int, block bigint, " + ", ".join(f"{x} double" for x in names)))
    small, large = (grid_join.block_pairs(b, 0.95).count() for b in boxes)
    assert (small, large) == (64 + 63, 256 + 255)
    whole = grid_join.Links(400, 0.93)
    unit = rng.normal(size=8) + rng.normal(size=(400, 8)) * 0.01
    block = grid_join.Block(unit, np.zeros((400, 8)), 0, np.ones(400, np.int64))
    block.single = None  # a dense group is linked without any product
    whole.join(block, block, 0, 2, 0, 2)
    assert (whole.counts == 399).all() and (whole.roots(slice(0, 400)) == 0).all()
