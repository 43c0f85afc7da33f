import collections
import zlib

from postsieve.llm import language, queries

from .conftest import docs_of


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op9_language(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)


def test_odd_texts(spark, odd, odd_rows, none):
    found = language.identify(odd).collect()
    assert collections.Counter(r.doc_id for r in found) == collections.Counter(r[0] for r in odd_rows)
    for r in found:
        if r.doc_id in (1, 2, 3):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        if r.doc_id == 6:
            assert r.lang_pred in ("en", "fr", "de")
    assert language.identify(none).collect() == []


def test_without_labels_nothing_is_decided(spark):
    assert [r.lang_pred for r in language.identify(docs_of(spark, [(1, "some words", None)])).collect()] == ["und"]


def test_kernel_is_presence_over_the_root_of_sizes():
    import numpy as np

    texts = ["abcab", "bcd", "é", "abcab" * 500]
    data, bounds = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *[len(t.encode()) for t in texts]])
    own = language.presence(data, bounds)
    grams = [{t.encode()[k : k + n] for n in range(1, 5) for k in range(len(t.encode()) - n + 1)} for t in texts]
    assert [int(x) for x in own.sum(1)] == [len(g) for g in grams]
    assert int((own[0] & own[1]).sum()) == len(grams[0] & grams[1])


def test_a_label_with_few_texts_among_many_rows_without_keeps_them_all(spark):
    rows = [(k, f"mot {k}" if k % 1000 == 0 else None, "fr") for k in range(30_000)]
    rows += [(None, f"rien {k}", "fr") for k in range(5)] + [(k, f"word {k}", "en") for k in range(30_000, 34_000)]
    texts, langs = language.labelled_sample(docs_of(spark, rows), per_language=400)
    assert collections.Counter(langs) == {"fr": 35, "en": 400}
    assert {t for t, lang in zip(texts, langs, strict=True) if lang == "fr"} == {r[1] for r in rows if r[2] == "fr" and r[1]}
