import collections
import random

from postsieve.llm import lines

from .brute import line_dedup
from .conftest import docs_of, sentence


def check(df, rows):
    ranked = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    want = collections.Counter()
    for (doc_id, *_), (text, removed) in zip(ranked, line_dedup([(r[0], r[1]) for r in ranked]), strict=True):
        want[doc_id, text, tuple(removed)] += 1
    got = lines.dedup_lines(df).collect()
    assert collections.Counter((r.doc_id, r.text, tuple(map(tuple, r.removed))) for r in got) == want


def test_odd_texts(odd, odd_rows, none):
    check(odd.coalesce(1), odd_rows)
    assert lines.dedup_lines(none).collect() == []


def test_common_lines(spark):
    rng = random.Random(9)
    common = [sentence(rng, n) for n in (3, 8, 60)]
    rows = [(k, "\n".join(rng.sample([*common, sentence(rng, 12), sentence(rng, 2)], 4))) for k in range(80)]
    check(docs_of(spark, rows), rows)
