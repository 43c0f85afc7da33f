import collections

import pytest

from postsieve.llm import licences

from .conftest import docs_of


def best(unit):
    own = set(licences.bigram_set(unit))
    scores = [
        (-2 * len(own & g) / (len(own) + len(g)), name)
        for name, texts in licences.TEMPLATES.items()
        for g in (set(licences.bigram_set(t)) for t in texts)
        if own
    ]
    return min(scores) if scores and -min(scores)[0] >= 0.8 else None


def check(docs, rows):
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        found = (text or "").split("\n")
        units = list(enumerate(found)) + ([(-1, text)] if len(found) > 1 else [])
        matches = [(b[1], round(-b[0], 9), k) for k, u in units if (b := best(u))]
        want[doc_id, tuple(matches)] += 1
    got = licences.licence_matches(docs).collect()
    assert collections.Counter((r.doc_id, tuple((m.licence, round(m.dice, 9), m.line) for m in r.matches)) for r in got) == want
    return got


def test_odd_texts(odd, odd_rows, none):
    check(odd, odd_rows)
    assert licences.licence_matches(none).collect() == []


def test_templates_and_changed_copies(spark):
    rows = []
    for name, texts in licences.TEMPLATES.items():
        for text in texts:
            words = text.split(" ")
            rows += [(len(rows), text), (len(rows) + 1, text.upper() + "\nand more of it")]
            rows += [(len(rows), " ".join(words[: len(words) * k // 10])) for k in (6, 7, 8, 9)]
            rows += [(len(rows), " ".join([*words, *["other"] * k])) for k in (1, 2, 5)]
    rows.append((len(rows), "All rights reserved.\n1"))
    got = check(docs_of(spark, [(k, t) for k, (_, t) in enumerate(rows)]), [(k, t) for k, (_, t) in enumerate(rows)])
    assert sum(r.licence is not None for r in got) > len(rows) // 3


def test_anchors_cover_every_match():
    for texts in licences.TEMPLATES.values():
        for text in texts:
            grams = licences.bigram_set(text)
            found = licences.anchors(grams, licences.THRESHOLD)
            free = [g for g in grams if not set(g.split(" ")) & found]
            assert 200 * len(free) < licences.THRESHOLD * (len(free) + len(grams)) or not free


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
GPL = """int x;
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
int y;
"""
ISC = """def f():
# Permission to use, copy, modify, and/or distribute this software for any
# purpose with or without fee is hereby granted, provided that the above
# copyright notice and this permission notice appear in all copies.
    return 1
"""


def test_wrapped_and_embedded_notices(spark):
    rows = [
        (1, MIT, ["mit", "mit"]),
        (2, GPL, ["gpl-3.0"]),
        (3, ISC, ["isc"]),
        (4, "This package is released under the MIT License. See the docs for more of it.", ["mit"]),
        (5, "Some text before it ends. All rights reserved.", ["all-rights-reserved"]),
        (6, "All rights were reserved by the owner of the licence, and the software stays under the rug.", []),
        (7, "It is licensed under CC BY-SA 4.0. " * 2, ["cc-by-sa-4.0"] * 2),
    ]
    got = {r.doc_id: r for r in licences.licence_matches(docs_of(spark, [r[:2] for r in rows])).collect()}
    for doc_id, text, want in rows:
        assert [p.licence for p in got[doc_id].passages] == want, doc_id
        assert got[doc_id].licence == (want[0] if want else None)
        words = licences.plain_words(text)
        for p in got[doc_id].passages:
            own = set(licences.bigram_set(" ".join(words[p.start : p.start + p.words])))
            grams = [set(licences.bigram_set(t)) for t in licences.TEMPLATES[p.licence]]
            assert abs(p.dice - max(2 * len(own & g) / (len(own) + len(g)) for g in grams)) < 1e-9
    # Lines and whole texts alone miss these.
    assert not any(got[k].matches for k in (4, 5))
