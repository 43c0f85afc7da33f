import collections
import hashlib
import random
import time

from postsieve.llm import private

from .brute import base_spans
from .conftest import docs_of, sentence

TRICKY = [
    "a@b.c_d@e.f and x..y@z.w..v@u.t a@b a@b. a@.b @b.c a@b.c.",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 1.2.3.4.",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 4111111111111112 12- 34",
    "+1 (743) 555-3824 +1234 +49.30.1234567890 + 1 +1() +12 345 678 90)",
    "é😀 mail é@x.y 10.0.0.1é +1 555 0100 999é",
    "\x01a@b.c\x01d@e.f \x02",
    "a" * 3000 + "@" + "b." * 3000 + "c",
    "1 " * 3000 + "2",
    "9" * 4000,
    "1." * 3000,
    "+1" + "2 " * 3000,
]


def check(docs, rows):
    got = private.digest(private.personal_data(docs)).collect()
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        spans = base_spans(text)
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = collections.Counter(k for k, _, _ in spans)
        want[doc_id, *[counts[k] for k in private.KINDS], hashlib.sha256(shown.encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    return got


def test_forms(spark):
    rows = [(k, t) for k, t in enumerate(TRICKY)]
    check(docs_of(spark, rows), rows)


def test_odd_texts(odd, odd_rows, none):
    check(odd, odd_rows)
    assert private.digest(private.personal_data(none)).collect() == []


def test_contexts_find_unseen_codes(spark):
    rng = random.Random(4)
    rows = [(k, f"{sentence(rng, 8)} badge: 10.0.0.{k} {sentence(rng, 8)}") for k in range(6)]
    rows += [(10, "he wears badge EMP-204881 today"), (11, "part zz number AB12345 is fine"), (12, "part again CD99999 here")]
    found = {r.doc_id: r for r in private.digest(private.personal_data(docs_of(spark, rows))).collect()}
    assert found[10].spans == "context:15:25"
    assert found[11].spans == "" and found[12].spans == ""
    assert all(found[k].spans.startswith("ip:") and found[k].n_ip == 1 for k in range(6))


def test_masking(spark, odd):
    rows = [(1, "mail a@b.c, call +1 (743) 555-3824."), (1, "mail a@b.c, call +1 (743) 555-3824."), (2, "clean"), (None, "10.0.0.1é10.0.0.2"), (3, None)]
    docs = docs_of(spark, rows)
    masked = private.mask(docs)
    assert masked.columns == docs.columns
    want = collections.Counter([(1, "mail [email], call [phone]."), (1, "mail [email], call [phone]."), (2, "clean"), (None, "[ip]é[ip]"), (3, None)])
    assert collections.Counter((r.doc_id, r.text) for r in masked.collect()) == want


def plain_mask(text, spans):
    """The union of spans is taken out; the first of each run of overlapping spans names the kind."""
    out, at = [], 0
    for a, _, kind, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_masking_against_a_plain_version(spark, odd):
    rng = random.Random(6)
    pieces = ["a@b.co", "10.0.0.1", "4111 1111 1111 1111", "+1 743 555 3824", "é", "😀\n", "x" * 1023, " ", "word ", "\u2028", "1.2.3.4 5555 5555 5555 4444"]
    rows = [(k, "".join(rng.choices(pieces, k=rng.randrange(1, 14)))) for k in range(80)] + list(enumerate(TRICKY, 100))
    rows += [(200, "é" * 1024 + "10.0.0.1"), (201, "x" * 1016 + "10.0.0.1" + "y" * 2048), (202, "z" * 1020 + " 10.0.0.1 " + "z" * 3000)]
    docs = docs_of(spark, rows)
    spans = {r.doc_id: r.spans for r in private.personal_data(docs).collect()}
    got = {r.doc_id: r.text for r in private.mask(docs).collect()}
    assert got == {k: plain_mask(t, spans[k]) for k, t in rows}
    # A card that begins inside a network address is taken out to its end.
    assert private.mask(docs_of(spark, [(1, "1.2.3.4 5555 5555 5555 444 x")])).first().text.endswith("[ip] x")


def test_masking_a_very_long_text(spark):
    n = 40_000
    text = "".join(f"user{k}@example.org wrote é{k % 7}, " for k in range(n))
    start = time.time()
    masked = private.mask(docs_of(spark, [(1, text)])).first().text
    assert masked == "".join(f"[email] wrote é{k % 7}, " for k in range(n))
    # By its square, this took minutes.
    assert time.time() - start < 60
