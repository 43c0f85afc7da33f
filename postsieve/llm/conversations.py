"""Repair of the structure of conversations by a shortest path through the lattice of edits.

A conversation should consist of an optional system turn and then of pairs of a user's and an assistant's turn. A node of
the lattice says how many rows are used up and what came last; edges keep, rerole or delete the next row, or insert an empty
one. The path is found by a bidirectional Dijkstra search: a forward and a reverse heap meet, all crossings of equal cost
are finished, and of these the one whose edits, read as a string, come first is taken.

Equal costs are settled in the order of rows, forward from the first and in reverse from the last, since keeping a row is
free. No cheapest audit between two nodes is the beginning of another (a longer one has further inserts), so the least
halves of a crossing also make its least whole.

A conversation of any length is cut into chunks of ``CHUNK`` rows. Of a longer one each chunk is searched between all
states of its ends, in parallel, and only these results are put together in order.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.llm.text import WORD
from postsieve.operators.keyed import number_rows, same_keys
from postsieve.session import materialise

CHUNK = 1024
# What came last: nothing, a system turn, a user's, an assistant's. A conversation may end with nothing or with the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
# Stands for any of ``ENDS`` as the state after the last chunk.
END = 9
MOVES = [(START, SYSTEM, "s"), (START, USER, "u"), (SYSTEM, USER, "u"), (USER, ASSISTANT, "a"), (ASSISTANT, USER, "u")]
ROLES = {USER: "user", ASSISTANT: "assistant"}
# What the edits cost, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# Codes of rows: to be deleted, or the initial of the role, upper case if truncated, ``x`` for other roles.
GONE, CODES = "D", "DsuaxSUAX"


def _edges(code: str) -> list[tuple[int, int, int, str]]:
    """Edges ``(from, to, cost, edit)`` that use up a row; without a row, those that insert one."""
    if not code:
        return [(q, t, INSERT, "I") for q, t, i in MOVES if i != "s"]
    out = [(q, q, DELETE, "D") for q in range(4)]
    if code != GONE:
        extra = TRUNCATED if code.isupper() else 0
        out += [(q, t, extra, "K") for q, t, i in MOVES if i == code.lower()]
        out += [(q, t, REROLE + extra, "R") for q, t, i in MOVES if i != "s"]
    return out


_OUT = {c: [[(t, w, e) for q, t, w, e in _edges(c) if q == s] for s in range(4)] for c in ["", *CODES]}
_IN = {c: [[(q, w, e) for q, t, w, e in _edges(c) if t == s] for s in range(4)] for c in ["", *CODES]}


@lru_cache(100_000)
def least_edits(codes: str, entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits from a state before some rows to one of the states after them."""
    n = len(codes)
    if not n and entry in exits:
        return 0, ""
    ahead, behind = {(0, entry): (0, "")}, {(n, q): (0, "") for q in exits}
    forward, reverse = [(0, 0, entry)], [(0, -n, q) for q in exits]
    heapq.heapify(reverse)
    from_start, to_end = {}, {}
    best: tuple[int, str] | None = None
    while forward or reverse:
        near, far = forward[0][0] if forward else 0, reverse[0][0] if reverse else 0
        if best and near + far > best[0]:
            break
        if forward and (not reverse or near <= far):
            _, i, q = heapq.heappop(forward)
            if (i, q) in from_start:
                continue
            cost, audit = from_start[i, q] = ahead[i, q]
            for k, edges in ((i, _OUT[""][q]), (i + 1, _OUT[codes[i]][q] if i < n else ())):
                for t, w, edit in edges:
                    if (k, t) in to_end:
                        rest = to_end[k, t]
                        whole = cost + w + rest[0], audit + edit + rest[1]
                        best = whole if best is None else min(best, whole)
                    old, new = ahead.get((k, t)), (cost + w, audit + edit)
                    if (k, t) not in from_start and (old is None or new < old):
                        ahead[k, t] = new
                        heapq.heappush(forward, (new[0], k, t))
        else:
            _, i, q = heapq.heappop(reverse)
            i = -i
            if (i, q) in to_end:
                continue
            cost, audit = to_end[i, q] = behind[i, q]
            for k, edges in ((i, _IN[""][q]), (i - 1, _IN[codes[i - 1]][q] if i else ())):
                for t, w, edit in edges:
                    if (k, t) in from_start:
                        rest = from_start[k, t]
                        whole = cost + w + rest[0], rest[1] + edit + audit
                        best = whole if best is None else min(best, whole)
                    old, new = behind.get((k, t)), (cost + w, edit + audit)
                    if (k, t) not in to_end and (old is None or new < old):
                        behind[k, t] = new
                        heapq.heappush(reverse, (new[0], -k, t))
    return best


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest edits of each chunk, for each state before and each after it."""
    for batch in batches:
        found = []
        for codes, chunk, chunks in zip(*(batch.column(c).to_pylist() for c in ("codes", "chunk", "chunks")), strict=True):
            ends = {END: ENDS} if chunk == chunks - 1 else {q: (q,) for q in range(4)}
            own = []
            for entry, (name, exits) in itertools.product(range(4) if chunk else [START], ends.items()):
                way = least_edits(codes, entry, exits)
                if way:
                    own.append({"entry": entry, "exit": name, "cost": way[0], "audit": way[1]})
            found.append(own)
        kind = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "ways"])


def best_ways(chunks: list[list[dict]]) -> list[tuple[int, int]]:
    """The state before and after each chunk on the cheapest, then least, way through all of them.

    Audits are compared from where they first differ; what all of them share is dropped after each chunk.
    """
    so_far, back = {START: (0, "")}, []
    for ways in chunks:
        after, came = {}, {}
        for w in ways:
            if w["entry"] in so_far:
                cost, audit = so_far[w["entry"]]
                new = cost + w["cost"], audit + w["audit"]
                if w["exit"] not in after or new < after[w["exit"]]:
                    after[w["exit"]], came[w["exit"]] = new, w["entry"]
        shared = len(os.path.commonprefix([a for _, a in after.values()]))
        so_far = {q: (cost, audit[shared:]) for q, (cost, audit) in after.items()}
        back.append(came)
    out, at = [], END
    for came in reversed(back):
        out.append((came[at], at))
        at = came[at]
    return out[::-1]


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, Iterator[dict]]]:
    """Rows of sorted batches by key, one row at a time."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return itertools.groupby(rows, key=lambda row: row[key])


def _picks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for conv_id, rows in _runs(batches, "conv_id"):
        picked = best_ways(row["ways"] for row in rows)
        entry, exits = zip(*picked, strict=True)
        n = len(picked)
        yield pa.RecordBatch.from_arrays(
            [pa.array([conv_id] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(entry, pa.int32()), pa.array(exits, pa.int32())],
            ["conv_id", "chunk", "entry", "exit"],
        )


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each turn of the repaired chunks: the row that it comes from, if any, and the role if that is new."""
    for batch in batches:
        out: dict[str, list] = {c: [] for c in ("conv_id", "chunk", "place", "pos", "edit", "new_role")}
        for row in batch.to_pylist():
            state, used = row["entry"], 0
            for place, edit in enumerate(row["audit"]):
                code = row["codes"][used] if edit != "I" else ""
                used += edit != "I"
                if edit == "D":
                    continue
                kept = code.lower() if edit == "K" else None
                state = next(t for q, t, i in MOVES if q == state and (i == kept if kept else i != "s"))
                values = (row["conv_id"], row["chunk"], place, row["first"] + used - 1 if code else None, edit, None if kept else ROLES[state])
                for c, v in zip(out, values, strict=True):
                    out[c].append(v)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of each conversation's turns, fed one by one."""
    for conv_id, rows in _runs(batches, "conv_id"):
        digest, between = hashlib.sha256(), b""
        for row in rows:
            digest.update(between + f"{row['role']}:{row['text']}".encode())
            between = b"\n"
        yield pa.RecordBatch.from_arrays([pa.array([conv_id], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "sha256"])


def in_order(rows: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` with their place ``pos`` in the conversation, from 1, and ``chunk``, from 0.

    By turn, rows without turn first, then by role and text; null roles and texts count as one space.
    """
    rows = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")],
    )
    placed = number_rows(rows, ["conv_id"], ["turn", "role", "text"], "pos")
    return materialise(placed.withColumn("chunk", F.expr(f"(pos - 1) div {CHUNK}")), "turns")


def faults(placed: DataFrame) -> DataFrame:
    """``(conv_id, pos, chunk, fault, initial)`` for each row of :func:`in_order`.

    ``fault`` is the first that applies of blank (no character but blanks), duplicate (an earlier row of the conversation
    has its role and text) and truncated (the last character but blanks is none of ``.!?``), else null.
    """
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    marked = placed.select(
        "conv_id", "pos", "chunk", same.alias("same"),
        F.col("text").rlike(WORD).alias("filled"),
        F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1).isin(".", "!", "?").alias("whole"),
        F.substring("role", 1, 1).alias("initial"),
    )
    marked = materialise(marked, "marked")
    firsts = marked.groupBy("conv_id", "same").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    found = same_keys(marked, firsts, ["conv_id", "same"], "left")
    fault = F.when(~F.col("filled"), "blank").when(F.col("pos") > F.col("first"), "duplicate").when(~F.col("whole"), "truncated")
    return found.select("conv_id", "pos", "chunk", fault.alias("fault"), F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("x").alias("initial"))


def _joined(name: str) -> Column:
    """A column of a chunk's rows as one string, in their order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", name))), lambda x: x[name]), "").alias(f"{name}s")


def plan_edits(found: DataFrame) -> DataFrame:
    """``(conv_id, chunk, chunks, first, codes, blank, duplicate, truncated, illegal, entry, cost, audit)`` for each chunk of
    the rows of :func:`faults`: what is wrong with it, and the edits that the repair of the conversation takes there.

    ``first`` is the place of its first row, ``illegal`` counts pairs of neighbours whose initials are none of ``su``, ``ua``
    and ``au``, each with its second row. ``entry`` is what stands before the chunk (:data:`START` and so on).
    """
    gone = F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False))
    code = F.when(gone, GONE).when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    counts = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    chunks = found.withColumn("code", code).groupBy("conv_id", "chunk").agg(F.min("pos").alias("first"), _joined("code"), _joined("initial"), *counts)
    by_conv = Window.partitionBy("conv_id")
    before = F.coalesce(F.substring(F.lag("initials").over(by_conv.orderBy("chunk")), -1, 1), F.lit(""))
    line = F.concat(before, "initials")
    legal = F.size(F.filter(F.transform(F.sequence(F.lit(1), F.length(line)), lambda i: F.substr(line, i, F.lit(2))), lambda p: p.isin("su", "ua", "au")))
    chunks = chunks.withColumn("chunks", F.count(F.lit(1)).over(by_conv)).withColumn("illegal", (F.length(line) - 1 - legal).cast("bigint"))
    chunks = chunks.drop("initials")
    kind = "array<struct<entry: int, exit: int, cost: bigint, audit: string>>"
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema)
    ways = materialise(chunks.mapInArrow(_ways, f"{fields}, ways {kind}"), "ways")
    single = ways.filter("chunks = 1").withColumn("way", F.col("ways")[0])
    several = ways.filter("chunks > 1")
    ordered = several.select("conv_id", "chunk", "ways").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    picks = ordered.mapInArrow(_picks, "conv_id bigint, chunk bigint, entry int, exit int")
    taken = same_keys(several, picks, ["conv_id", "chunk"])
    taken = taken.withColumn("way", F.filter("ways", lambda w: (w["entry"] == F.col("entry")) & (w["exit"] == F.col("exit")))[0]).drop("entry", "exit")
    both = single.unionByName(taken)
    both = both.withColumns({c: F.col("way")[c] for c in ("entry", "cost", "audit")})
    return materialise(both.drop("ways", "way"), "edits")


def repaired(placed: DataFrame, edits: DataFrame) -> DataFrame:
    """The turns ``(conv_id, chunk, place, edit, role, text)`` of the repaired conversations, in the order of chunk and place.

    ``edit`` is K for a kept row, R for one with another role and I for an inserted one, whose text is empty.
    """
    turns = edits.select("conv_id", "chunk", "first", "codes", "entry", "audit").mapInArrow(
        _edits, "conv_id bigint, chunk bigint, place int, pos bigint, edit string, new_role string"
    )
    held = same_keys(turns, placed.select("conv_id", "pos", "role", "text"), ["conv_id", "pos"], "left")
    # Inserted turns have no place of their own and thus no row.
    return held.select("conv_id", "chunk", "place", "edit", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation of ``rows(conv_id, turn, role, text)``, and the repaired turns.

    The first table has ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256)``: turns missing
    between the first and the last, rows by fault, illegal neighbours, the cost of the repair, its edits as a string, and
    the digest of the repaired ``role:text``, joined by newlines. The second is that of :func:`repaired`. Blank and
    duplicate rows are always deleted.

    Null roles and texts count as one space, so that such a row is blank or has no legal role. Rows without turn come first
    and bring no gap. Rows without conv_id are one conversation. Rows of one turn are ordered by role and text; repeated
    rows are duplicates. An empty table gives two empty ones; further columns are ignored. One row holds the audit of a whole
    conversation, a character for each edit; texts are never gathered.
    """
    placed = in_order(rows)
    edits = plan_edits(faults(placed))
    turns = repaired(placed, edits)
    ordered = turns.select("conv_id", "chunk", "place", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "place")
    digests = ordered.mapInArrow(_digests, "conv_id bigint, sha256 string")
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "audit"))), lambda x: x["audit"]), "")
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    found = edits.groupBy("conv_id").agg(*sums, whole.alias("audit"))
    counted = placed.filter("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    gaps = counted.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("one")).alias("gaps"))
    found = same_keys(same_keys(found, gaps, ["conv_id"], "left"), digests, ["conv_id"], "left")
    nothing = hashlib.sha256().hexdigest()
    return found.select(
        "conv_id", F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.coalesce("sha256", F.lit(nothing)).alias("sha256"),
    ), turns


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults made by the CRC-32 of ``conv_id:turn`` modulo 20, null counting as one space.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats the row, 4 makes its role user. Null roles and
    texts become one space.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("_")
    ).drop("_")


def repair_damaged(rows: DataFrame) -> DataFrame:
    """The repair of all conversations of ``rows`` after :func:`damaged`; one that has lost all rows counts nothing.

    Nulls, ties, repeated rows, empty tables and further columns are as in :func:`repair`.
    """
    found, _ = repair(damaged(rows))
    all_ids = rows.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    found = same_keys(all_ids, found, ["conv_id"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256"))
