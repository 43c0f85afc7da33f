import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from postsieve.llm import conversations

from .conftest import sentence

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
BLANK = " \t\n\x0b\x0c\r"


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def marks(rows):
    """The first fault of each row of a conversation."""
    seen, out = set(), []
    for _, _, role, text in rows:
        if not text.strip(BLANK):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append(None if text.rstrip(BLANK)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


NEXT = {"": "su", "s": "u", "u": "a", "a": "u"}


def cheapest(rows, faults):
    """Plain dynamic programming over rows, with the repaired turns: least (cost, audit) for each last initial."""
    best = {"": (0, "", ())}

    def inserted(best):
        for _ in range(4):
            for last, (cost, audit, turns) in list(best.items()):
                for role in ("user", "assistant"):
                    if role[0] in NEXT[last]:
                        new = (cost + 2, audit + "I", (*turns, f"{role}:"))
                        best[role[0]] = min(best.get(role[0], new), new)
        return best

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        for last, (cost, audit, turns) in inserted(best).items():
            ways = [(last, cost + 3, audit + "D", turns)]
            if fault in (None, "truncated"):
                cost += fault is not None
                if role[:1] and role[0] in NEXT[last]:
                    ways.append((role[0], cost, audit + "K", (*turns, f"{role}:{text}")))
                ways += [(r[0], cost + 2, audit + "R", (*turns, f"{r}:{text}")) for r in ("user", "assistant") if r[0] in NEXT[last]]
            for key, *new in ways:
                after[key] = min(after.get(key, tuple(new)), tuple(new))
        best = after
    best = inserted(best)
    return min(best[k] for k in ("", "a") if k in best)


def plain(rows, original):
    groups = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())):
        groups[r[0]].append(r)
    out = {}
    for conv in {r[0] for r in original}:
        own = groups[conv]
        faults, turns = marks(own), {r[1] for r in own} - {None}
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(own)]
        cost, audit, repaired = cheapest(own, faults)
        out[conv] = (
            conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest(),
        )
    return sorted(out.values(), key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ["pos", "chunk", "kind", "first", "same", "n", "way", "rank"]})
    got = conversations.repair_damaged(df)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = [tuple(r) for r in got.collect()]
    assert sorted(got, key=str) == plain(after_damage(rows), rows)


def random_rows(rng, conv, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "a", "", None, "Über", "System"]
    texts = ["Yes.", "No", " \t", "", None, "Why?  \n", "done!", "é", "wait…", sentence(rng, 30) + "."]
    return [(conv, rng.choice([t, t, t, t + 3, None]), rng.choice(roles), rng.choice([*texts, f"{t}.", f"{t}."])) for t in range(n)]


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [r for conv in range(60) for r in random_rows(rng, conv, rng.randrange(1, 12))]
    rows += [(None, 0, "system", "s."), (None, None, None, None), (None, 1, "user", "x" * 300_000), (99, 2**40, "user", "a."), (99, -5, "user", "\x00.")]
    check(spark, rows + rows[:20])


def test_rows_that_are_all_dropped(spark):
    lost = [k for k in range(200) if zlib.crc32(f"{k}:0".encode()) % 20 == 0][:3]
    check(spark, [(k, 0, "user", "Yes.") for k in lost])


def test_empty(spark):
    assert conversations.repair_damaged(spark.createDataFrame([], SCHEMA)).collect() == []
    found, turns = conversations.repair(spark.createDataFrame([], SCHEMA))
    assert found.collect() == turns.collect() == []


@pytest.mark.parametrize("chunk", [1, 3, 7])
def test_conversations_of_many_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rng = random.Random(chunk)
    rows = [r for conv in range(25) for r in random_rows(rng, conv, rng.randrange(1, 40))] + random_rows(rng, 50, 120)
    check(spark, rows)


def _fake(codes):
    """Rows and faults that have these codes."""
    roles = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    rows = [(0, k, roles.get(c.lower(), "user"), "") for k, c in enumerate(codes)]
    return rows, ["blank" if c == "D" else "truncated" if c.isupper() else None for c in codes]


def test_search_against_dynamic_programming():
    rng = random.Random(8)
    for _ in range(3000):
        codes = "".join(rng.choice(conversations.CODES if rng.random() < 0.5 else "ua") for _ in range(rng.randrange(0, 14)))
        assert conversations.least_edits(codes, conversations.START, conversations.ENDS) == cheapest(*_fake(codes))[:2], codes


def test_search_against_all_sequences_of_edits():
    def sequences(codes, last, inserts):
        if last in ("", "a") and not codes:
            yield 0, ""
        options = []
        if inserts:
            options += [(2, "I", r, codes, inserts - 1) for r in "ua" if r in NEXT[last]]
        if codes:
            options.append((3, "D", last, codes[1:], inserts))
            if codes[0] != "D":
                extra = codes[0].isupper()
                options += [(extra, "K", codes[0].lower(), codes[1:], inserts)] * (codes[0].lower() in NEXT[last])
                options += [(2 + extra, "R", r, codes[1:], inserts) for r in "ua" if r in NEXT[last]]
        for cost, edit, state, rest, left in options:
            for more, audit in sequences(rest, state, left):
                yield cost + more, edit + audit

    for n in range(4):
        for codes in itertools.product(conversations.CODES, repeat=n):
            want = min(sequences("".join(codes), "", 4))
            assert conversations.least_edits("".join(codes), conversations.START, conversations.ENDS) == want


def test_repaired_turns_and_a_long_conversation(spark):
    """2,500 rows that all need another neighbour; the search in three chunks equals that in one."""
    rows = [(1, k, "user", f"Turn {k}.") for k in range(2500)] + [(2, 0, "system", "S."), (2, 1, "assistant", "Hello."), (2, 2, "user", "Hi")]
    found, turns = conversations.repair(spark.createDataFrame(rows, SCHEMA))
    by_id = {r.conv_id: r for r in found.collect()}
    assert (by_id[1].cost, by_id[1].illegal, len(by_id[1].audit)) == (2 * 1250, 2499, 2500)
    assert by_id[1].audit == conversations.least_edits("u" * 2500, conversations.START, conversations.ENDS)[1]
    assert by_id[2].audit == "KIKD" and by_id[2].cost == 5
    got = [(r.edit, r.role, r.text) for r in turns.filter("conv_id = 2").orderBy("chunk", "place").collect()]
    assert got == [("K", "system", "S."), ("I", "user", ""), ("K", "assistant", "Hello.")]
    roles = [r.role for r in turns.filter("conv_id = 1").orderBy("chunk", "place").collect()]
    assert roles == ["user", "assistant"] * 1250
