import collections

import corpus_pipeline as pipeline
from postsieve.llm import packing, queries

from .brute import base_spans, contamination, near_components
from .conftest import docs_of, sentence


def plain_run(rows, items):
    """The first four stages on ``(doc_id, text)``, one row at a time."""
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    named = near_components(rows)
    rows = [r for r, (size, name) in zip(rows, named, strict=True) if r[0] == name]
    rows = [r for r in rows if not contamination(r[1], items)[1]]
    out = []
    for doc_id, text in rows:
        at, parts = 0, []
        for kind, start, end in base_spans(text):
            if start >= at:
                parts += [text[at:start], f"[{kind}]"]
                at = end
        out.append((doc_id, "".join(parts) + text[at:]))
    return out


def test_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = plain_run(docs, items)
    assert 0 < len(want) < len(docs)
    found = collections.defaultdict(list)
    for r in pipeline.run(spark, sf).collect():
        found[r.doc_id].append((r.start, r.length, r.doc_tokens))
    ids = packing.encoder(queries.vocabulary())
    import pyarrow as pa

    lengths = {d: len(i) + 1 for (d, _), i in zip(want, ids.encode(pa.array([t for _, t in want])), strict=True)}
    assert {d: spans[0][2] for d, spans in found.items()} == lengths
    for spans in found.values():
        at = 0
        for start, length, _ in sorted(spans):
            assert start == at
            at += length
        assert at == spans[0][2]


def test_stages_keep_the_columns(spark, odd, tmp_path):
    docs = odd
    spark.createDataFrame([("x", sentence(__import__("random").Random(5), 12))], "item_id string, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert docs.columns == pipeline.COLUMNS
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()


def test_empty(spark, none, tmp_path):
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == []
    assert docs_of(spark, []).count() == 0


def test_language_stage_keeps_texts_without_labels(spark):
    rows = [(1, "words without a label"), (2, "mots sans langue"), (3, "12 34"), (4, None), (5, "")]
    kept = pipeline.language_id(spark, docs_of(spark, rows), "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 2]
    # A label may have any name.
    rows = [(k, sentence(__import__("random").Random(k), 9), "und") for k in range(9)]
    assert pipeline.language_id(spark, docs_of(spark, rows), "").count() == 9


def test_language_stage_fills_in_what_it_predicts(spark):
    rng = __import__("random").Random(2)
    words = {"aa": ["aba", "bab", "abab"], "zz": ["zyz", "yzy", "zyzy"]}
    text = lambda lang: " ".join(rng.choices(words[lang], k=20))
    rows = [(k, text(lang), lang) for k, lang in enumerate(["aa", "zz"] * 20)]
    rows += [(100, text("aa"), None), (101, text("zz"), None), (102, text("zz"), "aa")]
    kept = {r.doc_id: r.lang for r in pipeline.language_id(spark, docs_of(spark, rows), "").collect()}
    assert (kept[100], kept[101], kept[102]) == ("aa", "zz", "aa") and len(kept) == 43
