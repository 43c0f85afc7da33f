import collections
import hashlib
import random

import pytest

from postsieve.llm import decontamination

from .brute import contamination
from .conftest import docs_of, sentence


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(2)
    items = [(str(k), sentence(rng, rng.choice([1, 2, 3, 9, 10, 11, 30]))) for k in range(30)]
    items += [(None, sentence(rng, 12)), ("0", sentence(rng, 14)), ("empty", ""), ("blank", " . "), ("void", None)]
    rows = [(1, None), (2, ""), (3, "..."), (None, items[30][1])]
    for k in range(60):
        parts = [sentence(rng, rng.randint(0, 30))]
        for _, text in rng.sample(items[:32], 3):
            words = text.split(" ")
            start = rng.randint(0, max(0, len(words) - 10))
            parts += [", ".join(words[start : start + rng.choice([9, 10, 25])]).upper(), sentence(rng, rng.randint(0, 4))]
        rows.append((10 + k // 2, " ".join(parts)))
    rows.append((99, "é".join(["aa"] * 40)))
    df = docs_of(spark, rows)
    return rows, items, df, spark.createDataFrame(items, "item_id string, text string")


@pytest.mark.parametrize("block", [decontamination.BLOCK, 400])
def test_against_brute_force(case, block):
    rows, items, docs, table = case
    want = collections.Counter()
    for doc_id, text in rows:
        n, hit, found = contamination(text, items)
        want[doc_id, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0] += 1
    got = decontamination.decontaminate(docs, table, block=block).drop("text_key").collect()
    assert collections.Counter(map(tuple, got)) == want
    assert sum(n for k, n in want.items() if k[-1]) > 20


def test_clean_rows_stay(case):
    rows, items, docs, table = case
    kept = decontamination.drop_contaminated(docs, table)
    assert kept.columns == docs.columns
    want = collections.Counter(r for r in rows if not contamination(r[1], items)[1])
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == want


def test_empty_tables(case, none):
    _, _, docs, table = case
    assert decontamination.decontaminate(none, table).collect() == []
    got = decontamination.decontaminate(docs, table.limit(0)).collect()
    assert len(got) == docs.count() and not any(r.contaminated for r in got)
