import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from postsieve.llm import arrays, compression

from .brute import lower, words
from .conftest import docs_of, sentence


def ppm(train, text, order):
    """log10 probability of a text, byte by byte, with exclusion over plain dictionaries."""
    table = collections.defaultdict(collections.Counter)
    coded = lambda t: [compression.PAD] * order + list(lower(t).encode()) + [compression.END]
    for t in train:
        s = coded(t)
        for k in range(order, len(s)):
            for n in range(order + 1):
                table[tuple(s[k - n : k])][s[k]] += 1
    s, total = coded(text), 0.0
    for k in range(order, len(s)):
        excluded = set()
        for n in range(order, -1, -1):
            seen = table.get(tuple(s[k - n : k]))
            if not seen:
                continue
            left = {c: v for c, v in seen.items() if c not in excluded}
            if not left:
                continue
            whole = sum(left.values())
            if s[k] in left:
                total += math.log10((left[s[k]] - 0.5) / whole)
                break
            total += math.log10(0.5 * len(left) / whole)
            excluded |= set(left)
        else:
            total -= math.log10(256 - len(excluded))
    return total


@pytest.mark.parametrize("block", [compression.BLOCK, 200])
def test_against_brute_force(spark, odd_rows, block, monkeypatch):
    monkeypatch.setattr(compression, "BUCKETS", 3)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    rows = [(r[0], r[1] if r[1] is None or len(r[1]) < 1000 else r[1][:700]) for r in odd_rows]
    monkeypatch.setattr(compression.trie_scores, "__defaults__", (block,))
    got = compression.score_documents(docs_of(spark, rows)).collect()
    train = [t for i, t in rows if not held(i)]
    tokens = lambda t: [*words(lower(t)), None]
    counts = collections.Counter(w for t in train for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        want.append((i, held(i), len(own), sum(counts[w] > 0 for w in own), total, base, ppm(train, t or "", compression.ORDER)))
    key = lambda r: (r[0] is None, r[0] or 0, round(r[5], 4), round(r[6], 3))
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-5)


def test_probabilities_sum_to_one():
    import random

    data, offsets = arrays.utf8(pa.array([sentence(random.Random(1), 200), "é"]))
    keys, counts = arrays.counted(compression.symbols(data, offsets)[0])
    trie = compression.Trie(keys, counts, *compression._summed(keys & np.uint64(0xFFFF), counts))
    trie.open()
    for context in (int(keys[3]) >> 8, 0x6162636465, 0x7A7A7A6161, 0x7A7A7A7A7A):
        logs = trie.log10((np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64))
        assert (10**logs).sum() == pytest.approx(1, abs=1e-5)


def test_empty(none):
    assert compression.score_documents(none).collect() == []


def test_one_block_is_held_at_a_time(spark, monkeypatch):
    import random

    held, most, plans = set(), [], []
    made, write = spark.sparkContext.broadcast, compression.materialise

    def broadcast(value):
        sent = made(value)
        if isinstance(value, compression.Trie):
            held.add(id(sent))
            most.append(len(held))
            drop = sent.destroy
            sent.destroy = lambda *a: (held.discard(id(sent)), drop(*a))
        return sent

    def materialise(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        return write(df, label)

    monkeypatch.setattr(spark.sparkContext, "broadcast", broadcast)
    monkeypatch.setattr(compression, "materialise", materialise)
    monkeypatch.setattr(compression.trie_scores, "__defaults__", (300,))
    rng = random.Random(2)
    assert compression.score_documents(docs_of(spark, [(k, sentence(rng, 30)) for k in range(12)])).count() == 12
    # One Python step in a plan, however many blocks.
    assert len(most) > 3 and max(most) == 1 and max(plans) == 1
