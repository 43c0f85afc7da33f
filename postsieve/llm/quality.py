"""Quality rules: a decision list learned by sequential covering, applied as one ordered CASE expression.

Statistics of every text are native columns. From the labelled rows, rules for bad documents are grown one at a time:
each is a conjunction of thresholds, extended by the condition with the best information gain on the rows not yet
covered, then pruned on rows held out from growing. A rule joins the list while it is precise enough on those, so a
document is dropped only for a reason that can be read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.llm import text as tx
from postsieve.session import materialise

# What a rule may ask for. Shares are of words or characters.
FEATURES = [
    "n_words",
    "mean_word",
    "symbol_share",
    "mark_share",
    "digit_share",
    "upper_share",
    "dup_line_share",
    "repeat_share",
    "line_words",
    "stop_share",
]
CUTS = 15
MAX_RULES = 8
MAX_CONDITIONS = 3
# On held-out rows, at least this share of what a rule drops must be labelled bad, ...
PRECISION = 0.9
# ... and it must drop at least so many.
SUPPORT = 3


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    bound: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value > F.lit(self.bound) if self.above else value <= F.lit(self.bound)


def _base(text: Column) -> Column:
    """Counts the base rule needs, in one struct."""

    def of(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            tx.repeated_cover(tx.window_hashes(hashes, 3), 8).alias("n_repeat_words"),
        )

    return tx.let(tx.words(text), of)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of each text of ``(doc_id, text)``. Null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(tx.WORD))
    duplicates = tx.let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    raw = docs.select(
        "doc_id",
        F.length(text).cast("bigint").alias("n_chars"),
        _base(text).alias("b"),
        duplicates.alias("l"),
        F.length(F.regexp_replace(text, f"{tx.BLANK}+", "")).cast("bigint").alias("word_chars"),
        tx.count_chars(text, "#*$%&|<>").alias("n_symbols"),
        tx.count_chars(text, "!?;:.,").alias("n_marks"),
        tx.count_chars(text, "0-9").alias("n_digits"),
        tx.count_chars(text, r"\p{Lu}").alias("n_upper"),
        tx.count_chars(text, r"\p{L}").alias("n_letters"),
    )
    return raw.select(
        "doc_id",
        F.col("b.n_words").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.col("l.d").cast("bigint").alias("n_dup_lines"),
        F.col("b.n_repeat_words").alias("n_repeat_words"),
        "n_marks",
        "n_digits",
        "n_upper",
        "n_letters",
        F.col("l.n").cast("bigint").alias("n_lines"),
    )


def features(stats: DataFrame) -> DataFrame:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return stats.withColumns(
        {
            "mean_word": share("word_chars", "n_words"),
            "symbol_share": share("n_symbols", "word_chars"),
            "mark_share": share("n_marks", "word_chars"),
            "digit_share": share("n_digits", "word_chars"),
            "upper_share": share("n_upper", "n_letters"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "line_words": share("n_words", "n_lines"),
            "stop_share": share("n_letters", "word_chars"),
        }
    )


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """Information gained on the bad rows by narrowing (p0, n0) to (p, n)."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _below(feature: str):
    return lambda bound: bound < F.col(feature)


def _grow(rows: DataFrame, bounds: dict[str, list[float]], p0: float, n0: float) -> list[Condition]:
    """Extend a conjunction while it gains. One aggregation over the rows per condition."""
    rule: list[Condition] = []
    while len(rule) < MAX_CONDITIONS and n0 > 0:
        entries = [
            F.struct(F.lit(f).alias("f"), F.size(F.filter(F.array(*map(F.lit, b)), _below(f))).alias("b"))
            for f, b in bounds.items()
            if b
        ]
        table = rows.filter(_all(rule)).select("bad", F.explode(F.array(*entries)).alias("e"))
        # At most one row per feature and cell.
        found = table.groupBy("e.f", "e.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
        cells = {(r["f"], r["b"]): (r["p"], r["n"]) for r in found}
        best = (0.0, None, 0.0, 0.0)
        for f, cuts in bounds.items():
            below_p = below_n = 0
            for k, bound in enumerate(cuts):
                p, n = cells.get((f, k), (0, 0))
                below_p, below_n = below_p + p, below_n + n
                for above, (bp, bn) in ((False, (below_p, below_n)), (True, (p0 - below_p, n0 - below_n))):
                    gain = _gain(bp, bn, p0, n0)
                    if gain > best[0] + 1e-9:
                        best = (gain, Condition(f, above, bound), bp, bn)
        if best[1] is None:
            break
        rule.append(best[1])
        p0, n0 = best[2], best[3]
    return rule


def learn(labelled: DataFrame) -> list[list[Condition]]:
    """The ordered rules for bad rows of a table of features with ``bad`` (0 or 1) and ``hold`` (boolean).

    Every labelled row takes part; only counts per feature and cell reach the driver. Without rows there are no rules.
    """
    cuts = [k / (CUTS + 1) for k in range(1, CUTS + 1)]
    sides = [F.percentile_approx(f, cuts, 10_000).alias(f) for f in FEATURES]
    quantiles = {}
    for bad in (0, 1):
        row = labelled.filter(F.col("bad") == bad).agg(*sides).first()
        for f in FEATURES:
            quantiles.setdefault(f, set()).update(float(v) for v in row[f] or [])
    bounds = {f: sorted(v) for f, v in quantiles.items()}
    rules: list[list[Condition]] = []
    left = labelled
    while len(rules) < MAX_RULES:
        total = left.filter(~F.col("hold")).agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).first()
        if not total["p"] or not total["n"]:
            break
        rule = _grow(left.filter(~F.col("hold")), bounds, total["p"], total["n"])
        if not rule:
            break
        held = left.filter("hold")
        tails = [_all(rule[: k + 1]) for k in range(len(rule))]
        row = held.agg(
            *[F.sum(F.when(t, F.col("bad"))).alias(f"p{k}") for k, t in enumerate(tails)],
            *[F.sum(F.when(t, 1 - F.col("bad"))).alias(f"n{k}") for k, t in enumerate(tails)],
        ).first()
        counts = [(row[f"p{k}"] or 0, row[f"n{k}"] or 0) for k in range(len(rule))]
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in counts]
        best = max(range(len(rule)), key=lambda k: (worth[k], counts[k][0], -k))
        p, n = counts[best]
        if p < SUPPORT or p < PRECISION * (p + n):
            break
        rules.append(rule[: best + 1])
        left = left.filter(~_all(rules[-1]))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one ordered conditional: the number of the first rule that holds, 0 where none does."""
    if not rules:
        return F.lit(0)
    out = F.when(_all(rules[0]), 1)
    for k, rule in enumerate(rules[1:], 2):
        out = out.when(_all(rule), k)
    return out.otherwise(0)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every row of ``(doc_id, text)`` with ``base_failed``, ``rule`` and ``kept``.

    ``labels`` has ``(doc_id, quality)``, 1 for good; several labels of one document count as the least, null labels
    not at all. Null text is empty and fails the base. Repeated rows are judged one by one; rows without doc_id are
    judged but teach nothing. Without labels only the base decides. Further columns are ignored.
    """
    stats = materialise(features(statistics(docs)), "quality")
    wanted = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = materialise(
        stats.join(wanted, "doc_id")
        .filter(~base_failed())
        .select(
            *FEATURES,
            F.when(F.col("quality") > 0, 0).otherwise(1).alias("bad"),
            (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0).alias("hold"),
        ),
        "labelled",
    )
    rule = verdict(learn(labelled))
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", rule.cast("int")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("rule") == 0)
    )
