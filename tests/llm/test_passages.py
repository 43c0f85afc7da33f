import collections
import random
import re

from postsieve.llm import lines, passages

from .conftest import docs_of, sentence


def brute(rows, window):
    """Text and removed spans of each row, rows in the order of their rank."""
    first, out = {}, []
    for r, (_, text) in enumerate(rows):
        found = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
        low = ["".join(c.lower() if c.isascii() else c for c in m.group()) for m in found]
        gone = set()
        for k in range(len(low) - window + 1):
            row, at = first.setdefault(tuple(low[k : k + window]), (r, k))
            if (row, at) != (r, k):
                gone |= set(range(max(k, at + window) if row == r else k, k + window))
        starts = [k for k in sorted(gone) if k - 1 not in gone]
        ends = [k for k in sorted(gone) if k + 1 not in gone]
        spans = [(found[a].start(), found[b].end()) for a, b in zip(starts, ends, strict=True)]
        cuts = [0, *[p for s in spans for p in s], len(text or "")]
        kept = "".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True)) if text is not None else None
        out.append((kept, spans))
    return out


def check(df, rows, window=50, gram=25):
    ranked = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    pairs = zip(ranked, brute([(r[0], r[1]) for r in ranked], window), strict=True)
    want = collections.Counter((r[0], text, tuple(spans)) for r, (text, spans) in pairs)
    got = passages.dedup_passages(df, window, gram).collect()
    assert collections.Counter((r.doc_id, r.text, tuple(map(tuple, r.removed))) for r in got) == want
    return got


def test_odd_texts(odd, odd_rows, none):
    check(odd.coalesce(1), odd_rows)
    assert passages.dedup_passages(none).collect() == []


def test_passage_inside_lines_and_over_short_lines(spark):
    rng = random.Random(3)
    own = lambda: sentence(rng, 40)
    shared = sentence(rng, 60)
    wrapped = re.sub(r"((?:\S+ ){4}\S+) ", r"\1\n", shared.upper())
    rows = [(1, f"{own()} {shared} {own()}"), (2, f"é {own()} {shared} {own()}"), (3, f"{own()}\n{wrapped}\n{own()}")]
    df = docs_of(spark, rows)
    # Whole lines as units leave all three as they are.
    assert all(not r.removed for r in lines.dedup_lines(df).collect())
    got = {r.doc_id: r for r in check(df, rows)}
    assert not got[1].removed and shared in got[1].text
    assert all(len(got[k].removed) == 1 and len(got[k].text.split()) == 80 + (k == 2) for k in (2, 3))


def test_random_passages(spark):
    rng = random.Random(8)
    pool = [sentence(rng, rng.randint(5, 40)).split() for _ in range(12)]
    rows = []
    for k in range(60):
        parts = [w for _ in range(rng.randint(1, 6)) for w in rng.choice([*pool, sentence(rng, 9).split(), ["a"] * 30])]
        rows.append((k, "".join(w + rng.choice([" ", "\n", "  "]) for w in parts)))
    for window, gram in ((12, 6), (10, 3), (7, 7)):
        check(docs_of(spark, rows), rows, window, gram)


def test_equal_texts_with_repeats_of_their_own(spark):
    rng = random.Random(12)
    own, other = sentence(rng, 70), sentence(rng, 49)
    texts = [f"  {own}\n{own} \u00e9 end. ", own, sentence(rng, 30) + " " + own, other, "", None, " \t"]
    rows = [(k, t) for k, t in enumerate(texts * 3)] + [(None, texts[0]), (3, texts[0]), (3, texts[0])]
    rng.shuffle(rows)
    check(docs_of(spark, rows).coalesce(1), rows)
