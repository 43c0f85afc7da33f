"""Plain versions of the operators, one document at a time."""

import collections
import itertools
import re


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def shingle_set(text):
    w = words(lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def near_components(rows):
    """For each row: the size of its set and the name of its component."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    shared = collections.Counter()
    by_shingle = collections.defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            by_shingle[g].append(k)
    for own in by_shingle.values():
        shared.update(itertools.combinations(own, 2))
    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[root(a)] = root(b)
    names = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            names[root(k)] = min(doc_id, names.get(root(k), doc_id))
    return [(len(s), names.get(root(k)) if s else rows[k][0]) for k, s in enumerate(sets)]


def contamination(text, items, window=10):
    """Number of words, of hit words, and the ids of items."""
    grams = collections.defaultdict(set)
    for item_id, item in items:
        w = alnum_words(item)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[k : k + n])].add("null" if item_id is None else str(item_id))
    w = alnum_words(text)
    hit, found = set(), set()
    for n in {len(g) for g in grams}:
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in grams:
                hit.update(range(k, k + n))
                found |= grams[tuple(w[k : k + n])]
    return len(w), len(hit), sorted(found)


FORMS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def _valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind != "phone" or 10 <= len(digits) <= 15


def base_spans(text):
    found = [
        (m.start(), k, kind, m.end())
        for k, (kind, form) in enumerate(FORMS)
        for m in re.finditer(form, text or "")
        if _valid(kind, m.group())
    ]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


def quality_base(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    at = collections.defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    covered = {p for own in at.values() if len(own) > 1 for k in own for p in range(k, k + 8)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def line_dedup(rows, min_words=8):
    """Text and removed spans of each row, rows in the order of their rank."""
    seen, out = set(), []
    for _, text in rows:
        start, kept, removed = 0, [], []
        for line in (text or "").split("\n"):
            w = words(line)
            key = " ".join(w).lower()
            if len(w) >= min_words and key in seen:
                removed.append((start, start + len(line)))
            else:
                kept.append(line)
            if len(w) >= min_words:
                seen.add(key)
            start += len(line) + 1
        out.append((text if not removed else "\n".join(kept), removed))
    return out
