import collections
import zlib

import numpy as np

from postsieve.llm import sharding


def test_curve_visits_every_cell_once_by_single_steps():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), axis=-1).reshape(-1, dims)
        index = sharding.curve_index(cells, bits)
        assert sorted(index.tolist()) == list(range(1 << (bits * dims)))
        walk = cells[np.argsort(index)]
        assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_odd_texts(odd, odd_rows):
    rows = sharding.shard_documents(odd).collect()
    sizes = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == collections.Counter(
        (r[0], *sizes(r[1])) for r in odd_rows
    )
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    assert sorted(shards) == list(range(8))
    counts = [len(s) for s in shards.values()]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in shards.values())


def test_equal_texts_are_neighbours(spark):
    from .conftest import docs_of

    rows = [(k, "copy", ["en", "de"][k % 2], f"s{k}") for k in range(40)] + [(100 + k, f"text {k}", "en", f"s{k}") for k in range(360)]
    found = sharding.shard_documents(docs_of(spark, rows)).collect()
    places = sorted((r.shard, r.slot, r.doc_id < 100) for r in found)
    own = [k for k, p in enumerate(places) if p[2]]
    assert own == list(range(own[0], own[0] + 40))


def test_empty(none):
    assert sharding.shard_documents(none).collect() == []
