import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from postsieve.llm import manifest

from .conftest import docs_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[3], row[2], row[4], text]
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(hashes):
    """The top over some leaves, and for each leaf its siblings (left, right) per level."""
    proofs, places = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for k, p in enumerate(places):
            first = p // 16 * 16
            proofs[k].append((hashes[first:p], hashes[p + 1 : first + 16]))
            places[k] = p // 16
        hashes = [digest(hashes[i : i + 16]) for i in range(0, len(hashes), 16)]
    return hashes[0], proofs


def plain(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[3]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        trees[s] = tree([leaf(r, r[1]) for r in groups[s]])
    if not names:
        return collections.Counter()
    root, over = tree([trees[s][0] for s in names])
    out = collections.Counter()
    for k, s in enumerate(names):
        for r, proof in zip(groups[s], trees[s][1], strict=True):
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = text.translate(LOWER)
            h = leaf(r, text)
            steps = proof + over[k]
            for left, right in steps:
                h = digest([*left, h, *right])
            flat = digest(x for left, right in steps for x in left + right)
            out[(r[0], leaf(r, r[1]), trees[s][0], root, flat, h, h == root)] += 1
    return out


def full(rows):
    return [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]


def check(spark, rows):
    got = collections.Counter(map(tuple, manifest.tampered_manifest(docs_of(spark, rows)).collect()))
    assert got == plain(full(rows))
    return got


def test_odd_rows(odd, odd_rows):
    assert collections.Counter(map(tuple, manifest.tampered_manifest(odd).collect())) == plain(full(odd_rows))


def test_empty(none):
    assert manifest.tampered_manifest(none).collect() == []


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [257, 1, 16, 17, 300]])
def test_runs_of_all_sizes(spark, sizes):
    rows = [(100 * k + i, f"Text {i} of {k}", "en", f"s{k}") for k, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    check(spark, rows)


def test_many_sources_and_a_hot_one(spark):
    """Over sixteen sources twice, bytewise order of names, a source with a third of all rows."""
    names = [None, "", "-", "=", "a", "B", "é", "\U0001f600", *[f"s{k}" for k in range(300)]]
    rows = [(k, f"Row {k}", None, s) for k, s in enumerate(names)] + [(1000 + k, "Same", "en", "s7") for k in range(280)]
    got = check(spark, rows)
    assert 0 < sum(n for r, n in got.items() if not r[-1]) < len(rows)


def test_proofs_fold_to_the_root_and_name_changed_rows(spark):
    rows = [(k, f"Row {k}", "en", f"s{k % 3}") for k in range(200)]
    df = docs_of(spark, rows)
    changed = F.when(F.col("doc_id") == 42, F.lit("something else")).otherwise(F.col("text"))
    later = manifest.leaf([changed if c == "text" else F.col(c) for c in manifest.FIELDS])
    found = manifest.manifest(df, later).withColumn("back", manifest.folded(F.col("checked"), F.col("proof")))
    assert [r.doc_id for r in found.filter("back <> root").collect()] == [42]
    assert found.filter(manifest.folded(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 200


def test_a_very_long_text(spark):
    check(spark, [(1, "Words " * 400_000, "en", "a"), (2, "b", "en", "a")])
