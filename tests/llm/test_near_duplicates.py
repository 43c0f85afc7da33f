import collections
import random

from pyspark.sql import functions as F

from postsieve.llm import near_duplicates
from postsieve.llm.graph import components

from .brute import near_components
from .conftest import docs_of, sentence


def check(df, rows):
    want = near_components([(r[0], r[1]) for r in rows])
    want = collections.Counter((r[0], *w, r[0] is not None and r[0] == w[1]) for r, w in zip(rows, want, strict=True))
    got = near_duplicates.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert collections.Counter(map(tuple, got)) == want


def test_odd_texts(odd, odd_rows):
    check(odd, odd_rows)


def test_empty(none):
    assert near_duplicates.near_duplicates(none).collect() == []
    assert near_duplicates.drop_near_duplicates(none).collect() == []


def _chains_and_passages():
    """Chains of near copies, pairs at the threshold and a passage shared by many; more than a bucket compares at once."""
    rng = random.Random(11)
    rows = []
    for _ in range(6):
        words = sentence(rng, 120).split(" ")
        for _ in range(6):
            rows.append((len(rows), " ".join(words)))
            for _ in range(2):
                words[rng.randrange(len(words))] = sentence(rng, 1)
    for length in (20, 40, 80):
        # Cutting words from the end leaves a share of 0.75 exactly, then just below.
        text = sentence(rng, length + 4).split(" ")
        for n in (length, length * 3 // 4, length * 3 // 4 - 1):
            rows.append((len(rows), " ".join(text[: n + 4])))
    passage = sentence(rng, 60)
    for _ in range(150):
        rows.append((len(rows), f"{sentence(rng, 6)} {passage} {sentence(rng, 18)}"))
    return rows


def test_chains_and_passages(spark):
    rows = _chains_and_passages()
    check(docs_of(spark, rows), rows)


def test_what_no_hub_settles_goes_through_the_exact_join(spark, monkeypatch):
    """No link by hubs at all: the prefix join finds every one."""
    rows = _chains_and_passages()[:60]
    nothing = lambda self, rows, turn: rows.select(F.col("node").alias("u"), F.col("node").alias("v")).filter(F.lit(False))
    monkeypatch.setattr(near_duplicates._Corpus, "hub_pairs", nothing)
    check(docs_of(spark, rows), rows)


def _near_copies(rng, n):
    """One text of 120 words with two words exchanged in each copy; most pairs of copies are links, many are just not."""
    text, rows = sentence(rng, 120).split(" "), []
    for k in range(n):
        words = list(text)
        for _ in range(2):
            words[rng.randrange(len(words))] = sentence(rng, 1)
        rows.append((k, " ".join(words)))
    return rows


def test_a_group_of_near_copies(spark):
    rows = _near_copies(random.Random(9), 150)
    check(docs_of(spark, rows), rows)


def test_pairs_grow_with_a_group_and_not_with_its_square(spark, monkeypatch):
    compared, counts = near_duplicates._Corpus.compared, []

    def counting(self, pairs):
        counts[-1] += pairs.count()
        return compared(self, pairs)

    monkeypatch.setattr(near_duplicates._Corpus, "compared", counting)
    for n in (400, 1600):
        counts.append(0)
        near_duplicates.near_duplicates(docs_of(spark, _near_copies(random.Random(9), n))).count()
    assert 0 < counts[1] <= 5 * counts[0], counts


def test_texts_are_read_twice_whatever_the_rounds(spark, monkeypatch):
    """Once for signatures, once for sketches and sets of what meets; rounds take the sets from there."""
    df = docs_of(spark, _chains_and_passages())
    reads, rounds, read, compared = [], [], type(df).mapInArrow, near_duplicates._Corpus.compared
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, *a, **k: reads.append(1) or read(self, *a, **k))
    monkeypatch.setattr(near_duplicates._Corpus, "compared", lambda self, pairs: rounds.append(1) or compared(self, pairs))
    near_duplicates.near_duplicates(df).count()
    assert rounds
    assert len(reads) == 2


def test_one_row_of_each_group_stays(odd, odd_rows):
    kept = near_duplicates.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept.collect())
    names = near_components([(r[0], r[1]) for r in odd_rows])
    want, seen = [], set()
    for r, (size, name) in sorted(zip(odd_rows, names, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0, x[0][1] or "")):
        group = (name, r[1] if name is None or r[0] == 10 else None) if size else object()
        if group not in seen:
            seen.add(group)
            want.append((r[0] is None, r[0] or 0, r[1] or ""))
    assert got == sorted(want)


def test_components_of_paths(spark):
    rng = random.Random(3)
    edges, names = [], {}
    for path in range(5):
        nodes = [path * 100 + k for k in range(40)]
        names.update(dict.fromkeys(nodes, path * 100))
        rng.shuffle(nodes)
        edges += list(zip(nodes, nodes[1:], strict=False))
    df = spark.createDataFrame([*edges, edges[0], (5, 5)], "u bigint, v bigint")
    assert {r.node: r.component for r in components(df).collect()} == names
    assert components(df.filter(F.lit(False))).collect() == []
