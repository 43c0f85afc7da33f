import collections
import zlib

import numpy as np
import pytest

from postsieve.llm import packing, queries


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def check(rows, texts, tokenizer):
    found = collections.Counter()
    sequences = collections.defaultdict(list)
    for r in rows:
        found[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    want = collections.Counter()
    for doc_id, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        start = 0
        for n in packing.cut(len(ids)):
            want[doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)] += 1
            start += n
        assert start == len(ids)
    assert found == want
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_odd_texts(odd, odd_rows, tokenizer):
    check(packing.pack(odd, queries.vocabulary()).collect(), [r[:2] for r in odd_rows], tokenizer)


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(queries.op2_packing(spark, "/root/testdata/sf0.001").collect(), docs.select("doc_id", "text").collect(), tokenizer)


def test_empty(none):
    assert packing.pack(none, queries.vocabulary()).collect() == []


def test_cuts_fill_their_class():
    for n in range(1, 3000):
        pieces = packing.cut(n)
        assert sum(pieces) == n
        for length in pieces:
            k = packing.CAPACITY // length
            assert length * k >= packing.FILL * packing.CAPACITY or length == packing.CAPACITY // (k + 0)


def test_blanks_are_cut_where_the_pattern_cannot_reach(tokenizer):
    import pyarrow as pa

    texts = ["a  b", "a   b", " a", "a ", "a  ", "\n a", "a \nb", "a \n b", "  x", "x   y", "don't 's  's", "", None, "  ", "a\t b"]
    got = packing.encoder(queries.vocabulary()).encode(pa.array(texts))
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)
