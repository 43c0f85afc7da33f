"""Licence texts and notices found by the Dice coefficient over word bigrams.

Units are each line, the whole text, and every run of consecutive words of about a template's length, which finds
notices that are wrapped or stand inside longer lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.llm import text as tx

# Percent; whole numbers keep scores at the threshold exact.
THRESHOLD = 80

# Notices and short licences as published.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
    ],
    "bsd-3-clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
    ],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "all-rights-reserved": ["All rights reserved."],
}


_RUNS = "array<struct<d:double,n:int,start:int,licence:string>>"


def plain_words(text: str) -> list[str]:
    """The normal form on the driver, for templates: what :func:`normal_words` does to a column."""
    low = "".join(c.lower() if c.isascii() else c for c in text)
    return "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in low).split()


def bigram_set(text: str) -> list[str]:
    found = plain_words(text)
    return sorted({f"{a} {b}" for a, b in zip(found, found[1:], strict=False)})


def normal_words(text: Column) -> Column:
    """Words in lower case; everything that is ASCII but no letter or digit separates them."""
    return F.filter(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def bigrams(found: Column) -> Column:
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    return tx.let(found, lambda w: F.when(F.size(w) > 1, F.array_distinct(pairs(w))))


def anchors(grams: list[str], threshold: int) -> set[str]:
    """Words of which every unit that reaches the threshold holds one: of all but the required share of bigrams, one
    must occur. Longer words are taken first, as they are rarer."""
    by_length = sorted(grams, key=lambda g: (-max(map(len, g.split(" "))), g))
    needed = -(-threshold * len(grams) // (200 - threshold))
    return {max(g.split(" "), key=len) for g in by_length[: len(grams) - needed + 1]}


def passages(found: Column, table: list[tuple[str, list[str], int]], threshold: int) -> Column:
    """Runs of the words ``found`` that reach the threshold with a template, as ``(d, n, start, licence)`` in order of place.

    ``d`` is the negative Dice coefficient, ``n`` the negative number of words. Runs have at most as many words, against the template's, as
    size lets reach the threshold. Of overlapping runs the best stays, then the longer, the earlier, the first licence by name.
    """
    rest = 200 - threshold
    vocabulary = sorted({g for _, grams, _ in table for g in grams})
    entries = F.array(*[
        F.struct(
            F.lit(name).alias("licence"),
            F.array(*map(F.lit, grams)).alias("grams"),
            # So many bigrams must be shared at least, and so many places a run has at most.
            F.lit(-(-threshold * len(grams) // rest)).alias("need"),
            F.lit((size - 1) * rest // threshold).alias("span"),
        )
        for name, grams, size in table
    ])

    def run(t: Column, hits: Column, pairs: Column, j: Column) -> Column:
        """From the first of ``hits`` to the ``j``-th: runs that end elsewhere share no more and are longer."""
        begin, last = F.get(hits, F.lit(0))["p"], F.get(hits, j)["p"]
        shared = F.size(F.array_distinct(F.transform(F.slice(hits, 1, j + 1), lambda h: h["g"])))
        own = F.size(F.array_distinct(F.slice(pairs, begin + 1, last - begin + 1)))
        dice = 2.0 * shared / (own + F.size(t["grams"]))
        return F.struct((-dice).alias("d"), (begin - last - 2).alias("n"), begin.alias("start"), t["licence"].alias("licence"))

    def from_place(t: Column, hits: Column, pairs: Column, i: Column) -> Column:
        begin = F.get(hits, i)["p"]
        near = F.filter(F.slice(hits, i + 1, t["span"]), lambda h: h["p"] < begin + t["span"])
        ends = lambda own: F.transform(F.sequence(t["need"] - 1, F.size(own) - 1), lambda j: run(t, own, pairs, j))
        return tx.let(near, lambda own: F.when(F.size(own) >= t["need"], F.filter(ends(own), lambda r: -100 * r["d"] >= threshold - 1e-9)))

    def of_template(t: Column, known: Column, pairs: Column) -> Column:
        def runs(hits: Column) -> Column:
            # Enough of them must follow closely.
            full = lambda h, i: F.get(hits, i + t["need"] - 1)["p"] < h["p"] + t["span"]
            starts = F.filter(F.transform(hits, lambda h, i: F.when(full(h, i), i)), lambda i: i.isNotNull())
            return F.flatten(F.filter(F.transform(starts, lambda i: from_place(t, hits, pairs, i)), lambda r: r.isNotNull()))

        return tx.let(F.filter(known, lambda k: F.array_contains(t["grams"], k["g"])), runs)

    def of_text(pairs: Column) -> Column:
        placed = F.transform(pairs, lambda g, i: F.when(g.isin(vocabulary), F.struct(i.alias("p"), g.alias("g"))))
        known = F.filter(placed, lambda k: k.isNotNull())
        return tx.let(known, lambda own: F.flatten(F.transform(entries, lambda t: of_template(t, own, pairs))))

    def apart(runs: Column) -> Column:
        meets = lambda a, b: (a["start"] < b["start"] - b["n"]) & (b["start"] < a["start"] - a["n"])
        free = lambda taken, r: ~F.exists(taken, lambda x: meets(x, r))
        none = F.array().cast(_RUNS)
        kept = F.aggregate(F.sort_array(runs), none, lambda taken, r: F.when(free(taken, r), F.concat(taken, F.array(r))).otherwise(taken))
        return F.array_sort(kept, lambda a, b: (a["start"] - b["start"]).cast("int"))

    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    return tx.let(found, lambda w: F.when(F.size(w) > 1, apart(tx.let(pairs(w), of_text)).cast(_RUNS)).otherwise(F.array().cast(_RUNS)))


def licence_matches(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: int = THRESHOLD) -> DataFrame:
    """Licences in each row of ``(doc_id, text)``, compared with every line, the whole text and runs of its words.

    ``matches`` lists ``(licence, dice, line)`` for the best template of each line, or of the whole text as line -1,
    whose Dice coefficient reaches ``threshold`` percent; of equal scores the first licence by name counts. ``passages``
    lists ``(licence, dice, start, words)`` for runs of consecutive words, wherever lines break, that reach it and do not
    overlap; see :func:`passages`. ``licence`` and ``dice`` are the best of both, null where there is none. A unit of fewer than two words has no bigrams and never
    matches. Null text is empty. Repeated rows are answered one by one; further columns are ignored.
    """
    table = sorted((name, bigram_set(t)) for name, texts in templates.items() for t in texts)
    table = [(name, grams) for name, grams in table if grams]
    vocabulary = sorted({g for _, grams in table for g in grams})
    # A set of size a reaches the threshold with one of size b only if a * threshold <= b * rest.
    rest = 200 - threshold
    first = sorted(set().union(*[anchors(g, threshold) for _, g in table]))
    least = min(len(g) for _, g in table)
    most = max(len(g) for _, g in table)

    def scored(unit: Column) -> Column:
        """Dice of a unit's bigrams with each template whose size lets it reach the threshold."""

        def one(name: str, grams: list[str]) -> Column:
            fits = (F.size(unit) * rest >= len(grams) * threshold) & (F.size(unit) * threshold <= len(grams) * rest)
            shared = F.size(F.array_intersect(unit, F.array(*map(F.lit, grams))))
            dice = F.when(fits, 2.0 * shared / (F.size(unit) + len(grams))).otherwise(0.0)
            return F.struct((-dice).alias("d"), F.lit(name).alias("licence"))

        return F.array_min(F.array(*[one(n, g) for n, g in table]))

    def best(grams: Column) -> Column:
        """Sizes first, then how many bigrams occur in any template at all, and only then each template."""
        known = F.size(F.filter(grams, lambda g: g.isin(vocabulary)))
        sized = (F.size(grams) * rest >= least * threshold) & (F.size(grams) * threshold <= most * rest)
        return F.when(sized & (known * rest >= threshold * F.size(grams)), scored(grams))

    def unit(text: Column, line: Column) -> Column:
        return tx.let(
            tx.let(bigrams(normal_words(text)), best), lambda b: F.struct(b["licence"].alias("licence"), (-b["d"]).alias("dice"), line.cast("int").alias("line"))
        )

    def units(lines: Column) -> Column:
        # A text of one line is that line; a text beyond every template's size is not compared as a whole.
        each = F.transform(lines, lambda x, i: unit(x, i))
        return F.when(F.size(lines) == 1, each).otherwise(F.concat(each, F.array(unit(F.array_join(lines, "\n"), F.lit(-1)))))

    text = F.coalesce("text", F.lit(""))
    # Most texts hold no anchor, and end here.
    may = F.exists(normal_words(text), lambda w: w.isin(first))
    found = F.when(may, tx.let(F.split(text, "\n"), units)).otherwise(
        F.array().cast("array<struct<licence:string,dice:double,line:int>>")
    )
    sized = sorted((name, bigram_set(t), len(plain_words(t))) for name, texts in templates.items() for t in texts)
    runs = F.when(may, passages(normal_words(text), [s for s in sized if s[1]], threshold)).otherwise(F.array().cast(_RUNS))
    listed = F.transform(
        runs, lambda r: F.struct(r["licence"].alias("licence"), (-r["d"]).alias("dice"), r["start"].alias("start"), (-r["n"]).alias("words"))
    )
    matches = docs.select(
        "doc_id", F.filter(found, lambda m: 100 * m["dice"] >= threshold - 1e-9).alias("matches"), listed.alias("passages")
    )
    scores = lambda name: F.transform(name, lambda m: F.struct((-m["dice"]).alias("d"), m["licence"].alias("l")))
    top = F.array_min(F.concat(scores("matches"), scores("passages")))
    return matches.select("doc_id", top["l"].alias("licence"), (-top["d"]).alias("dice"), "matches", "passages")
