import collections
import random

from postsieve.llm import quality

from .brute import quality_base
from .conftest import docs_of, sentence


def test_odd_texts(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(6, 1), (7, None), (None, 0)], "doc_id bigint, quality int")
    got = quality.judge(odd, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    want = collections.Counter()
    for doc_id, text, *_ in odd_rows:
        base = quality_base(text)
        want[doc_id, *base, base[0] < 20 or 100 * base[4] > 30 * base[0]] += 1
    assert collections.Counter(map(tuple, got.collect())) == want
    assert quality.judge(none, labels).collect() == []


def test_rules_are_learned_and_spare_clean_rows(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(300):
        text = sentence(rng, 40)
        bad = k % 5 == 0
        if bad:
            text = text.replace(" ", " ## ") if k % 2 else text.upper()
        rows.append((k, text))
        if k < 240:
            labels.append((k, int(not bad)))
    table = spark.createDataFrame(labels, "doc_id bigint, quality int")
    found = quality.judge(docs_of(spark, rows), table).collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in found)
    assert {r.rule for r in found} == {0, 1, 2}


def test_without_labels_only_the_base_decides(spark):
    rows = [(1, sentence(random.Random(1), 30)), (2, "short")]
    table = spark.createDataFrame([], "doc_id bigint, quality int")
    assert {r.doc_id: r.kept for r in quality.judge(docs_of(spark, rows), table).collect()} == {1: True, 2: False}
