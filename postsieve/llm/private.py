"""Personal data: fixed forms by pattern, further identifiers by bootstrapped contexts.

Mail addresses, network addresses, card and telephone numbers found by form are the seeds. The word before an
instance is a lexical pattern; words before seeds are scored by how much of their use in the whole corpus precedes
known instances, codes that follow a good word become instances themselves, and both are scored in turn. Codes whose
word or own confidence is high are reported as spans of kind ``context``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postsieve.llm import text as tx
from postsieve.session import materialise

KINDS = ["email", "ip", "card", "phone"]
CONTEXT = "context"
ROUNDS = 3
# A pattern needs this much confidence in distinct instances, ...
SUPPORT = 3.0
# ... and this share of the word's uses in the corpus must precede instances.
CONFIDENCE = 0.5
# Characters before an instance in which its word is looked for.
REACH = 64
# Characters in a piece of a text that is to be cut.
CHUNK = 1024

# The forms, over text in which dots that end no label (for mail) and blanks and hyphens that join no
# digits (for cards) are first replaced by a control character. Runs are possessive, so that matching stays linear.
_LOCAL = r"A-Za-z0-9._%+\x01-"
FORMS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9][0-9\x20-]++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    # A code: up to four letters, then digits, letters and hyphens, at least six in all.
    CONTEXT: r"(?<![A-Za-z0-9_.@-])[A-Za-z]{0,4}-?[0-9][0-9A-Za-z-]{3,30}[0-9A-Za-z](?![A-Za-z0-9_.@-])",
}
_ARRAY = "array<struct<gap:int,value:string,left:string>>"


def _prepared(text: Column) -> dict[str, Column]:
    """Text for each form, null where the form cannot occur. Every replacement keeps the number of characters."""
    digits = text.rlike("[0-9]")
    mail = F.regexp_replace(F.replace(text, F.lit("\x01"), F.lit("\x02")), r"\.(?![A-Za-z0-9-])", "\x01")
    return {
        "email": F.when(F.contains(text, F.lit("@")), mail),
        "ip": F.when(digits, text),
        "card": F.when(digits, F.regexp_replace(text, r"(?<![0-9])[\x20-]|[\x20-](?![0-9])", "\x01")),
        "phone": F.when(F.contains(text, F.lit("+")), text),
        CONTEXT: F.when(digits, text),
    }


def _found(text: Column, form: str) -> Column:
    """Matches from left to right: characters since the match before, the match, and the word before it."""

    def of(hits: Column) -> Column:
        left = lambda gap: F.lower(F.regexp_extract(F.right(gap, F.lit(REACH)), r"(\p{L}+)[^\p{L}\p{N}]*$", 1))
        entry = lambda gaps: F.transform(
            hits, lambda h, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), h.alias("value"), left(F.get(gaps, i)).alias("left"))
        )
        return F.when(F.size(hits) > 0, tx.let(F.split(text, form, -1), entry))

    return tx.let(F.regexp_extract_all(text, F.lit(form), 0), of).cast(_ARRAY)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the check sum."""

    def doubled(c: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, c).when(c > 4, 2 * c - 9).otherwise(2 * c)

    back = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(back, i, F.lit(1)).cast("int"))
    total = F.aggregate(F.transform(each, doubled), F.lit(0), lambda a, c: a + c)
    return total % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    fits = lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.try_to_number(part(p), F.lit("999")), F.lit(0)) <= 255)
    n = F.length(_digits(value))
    return (
        F.when(kind == "ip", F.forall(F.split(value, r"\."), fits))
        .when(kind == "card", F.when(n.between(14, 19), luhn(_digits(value))).otherwise(False))
        .when(kind == "phone", n.between(10, 15))
        .otherwise(True)
    )


def _mentions(rows: DataFrame) -> DataFrame:
    """Base spans that pass their checks, and codes that touch none of them, with bounds in code points."""
    kinds = [*KINDS, CONTEXT]
    tagged = [
        F.transform(
            F.coalesce(k, F.array().cast(_ARRAY)),
            _tag(k, n),
        )
        for n, k in enumerate(kinds)
    ]
    flat = rows.select("row", F.explode(F.concat(*tagged)).alias("m")).select("row", "m.*")
    before = Window.partitionBy("row", "kind").orderBy("i")
    length = F.length("value")
    end = F.sum(F.col("gap") + length).over(before)
    spans = flat.withColumn("end", end.cast("bigint")).withColumn("start", (F.col("end") - length).cast("bigint"))
    spans = spans.filter(_valid(F.col("kind"), F.col("value"))).withColumn("base", F.col("kind") != CONTEXT)
    place = Window.partitionBy("row").orderBy("start", "n")
    ended = F.max(F.when(F.col("base"), F.col("end"))).over(place.rowsBetween(Window.unboundedPreceding, -1))
    # Backwards, since a frame that reaches to the end is added up anew for every row.
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("n"))
    begun = F.min(F.when(F.col("base"), F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    free = (F.coalesce(ended, F.lit(0)) <= F.col("start")) & (F.coalesce(begun, F.col("end")) >= F.col("end"))
    spans = spans.withColumn("free", free).filter(F.col("base") | F.col("free"))
    return spans.select("row", "kind", "n", "start", "end", F.lower("value").alias("value"), "left", "base")


def _tag(kind: str, number: int):
    return lambda m, i: F.struct(
        F.lit(kind).alias("kind"), F.lit(number).alias("n"), i.alias("i"), m["gap"].alias("gap"), m["value"].alias("value"), m["left"].alias("left")
    )


def _uses(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """How often each wanted word occurs in all texts. Words are counted in every task before they are sent on."""
    found = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("left"))
    return found.join(wanted, "left").groupBy("left").agg(F.count(F.lit(1)).alias("uses"))


def _confidences(docs: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confidence of every pattern with support and of every instance that such patterns bring."""
    edges = mentions.filter("left != ''").groupBy("left", "value").agg(F.max("base").alias("seed"), F.count(F.lit(1)).alias("n"))
    edges = materialise(edges, "edges")
    # Fewer instances than the support asks for can never reach it.
    wanted = edges.groupBy("left").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= SUPPORT).select("left")
    uses = materialise(_uses(docs, materialise(wanted, "wanted")), "uses")
    edges = materialise(edges.join(uses, "left"), "graph")
    known = F.when(F.col("seed"), 1.0).otherwise(0.0)
    scored = edges.withColumn("conf", known)
    for _ in range(ROUNDS):
        support = F.sum("conf")
        share = F.sum(F.col("conf") * F.col("n")) / F.max("uses")
        patterns = scored.groupBy("left").agg(F.when(support >= SUPPORT, share).otherwise(0.0).alias("p"))
        patterns = materialise(patterns, "patterns")
        # An instance fails only if every pattern that brings it does.
        lost = F.exp(F.sum(F.log(1 - F.least("p", F.lit(0.999)))))
        instances = edges.join(patterns, "left").groupBy("value").agg(
            F.when(F.max("seed"), 1.0).otherwise(1 - lost).alias("conf")
        )
        instances = materialise(instances, "instances")
        scored = edges.join(instances, "value")
    return patterns, instances


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data in each row of ``(doc_id, text)``, as ``array<struct<start,n,kind,end>>`` in order.

    ``text_key`` is a hash of the row's text.

    Null text is empty and has none. Repeated rows are answered one by one, also without doc_id; an empty table gives
    no rows; further columns are ignored.
    """
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = {k: _found(t, FORMS[k]) for k, t in _prepared(F.col("text")).items()}
    rows = source.select("doc_id", tx.text_key(F.col("text")).alias("text_key"), F.monotonically_increasing_id().alias("row"), *[c.alias(k) for k, c in found.items()])
    rows = materialise(rows, "found")
    mentions = materialise(_mentions(rows), "mentions")
    patterns, instances = _confidences(source, mentions)
    new = (
        mentions.filter(~F.col("base"))
        .join(patterns.filter(F.col("p") >= CONFIDENCE), "left", "left")
        .join(instances.filter(F.col("conf") >= CONFIDENCE), "value", "left")
        .filter(F.col("p").isNotNull() | F.col("conf").isNotNull())
    )
    columns = ["row", "start", "kind", "n", "end"]
    spans = mentions.filter("base").select(*columns).unionByName(new.select(*columns))
    listed = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "n", "kind", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,n:int,kind:string,end:bigint>>")
    held = rows.select("doc_id", "text_key", "row").join(listed, "row", "left")
    return held.select("doc_id", "text_key", F.coalesce("spans", none).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, the base spans' checksum and all spans as text."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != CONTEXT)
    return found.select(
        "doc_id",
        *[_count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


def _cutter(chunks: Column):
    """Characters from ``a`` up to ``b`` of a text given as pieces of ``CHUNK`` characters.

    A place inside a text can only be reached from its start, so many cuts of one long text would take time by its square.
    """

    def cut(a: Column, b: Column) -> Column:
        first = F.floor(a / CHUNK).cast("int")
        last = F.floor((b - 1) / CHUNK).cast("int")
        near = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
        return F.when(b > a, F.substring(near, (a - first * CHUNK).cast("int") + 1, (b - a).cast("int"))).otherwise("")

    return cut


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; null text stays null.

    A span that begins inside those before names no kind of its own; what it adds to them goes with them. All columns and
    rows are kept. The time for a text grows with its length and its number of spans, each by itself.
    """
    found = personal_data(docs).filter(F.size("spans") > 0)
    keys = ["doc_id", "text_key"]
    # Equal texts of one doc_id have equal spans.
    one = found.groupBy(*keys).agg(F.first("spans").alias("spans")).select(*keys, F.inline("spans"))
    before = Window.partitionBy(*keys).orderBy("start", "n", "end").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("since", F.coalesce(F.max("end").over(before), F.lit(0)))
    parts = F.sort_array(F.collect_list(F.when(F.col("start") >= F.col("since"), F.struct("start", "since", "kind"))))
    cuts = one.groupBy(*keys).agg(parts.alias("_parts"), F.max("end").alias("_rest"))
    cuts = cuts.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_parts", "_rest")
    same = cuts["_id"].eqNullSafe(docs["doc_id"]) & (cuts["_key"] == tx.text_key(docs["text"]))
    text, parts, rest = docs["text"], cuts["_parts"], cuts["_rest"]

    def joined(chunks: Column) -> Column:
        cut = _cutter(chunks)
        shown = F.transform(parts, lambda s: F.concat(cut(s["since"], s["start"]), F.lit("["), s["kind"], F.lit("]")))
        return F.concat(F.array_join(shown, ""), cut(rest, F.length(text).cast("bigint")))

    masked = F.when(parts.isNull(), text).otherwise(tx.let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), 0), joined))
    out = docs.join(cuts, same, "left")
    return out.select(*[masked.alias("text") if c == "text" else docs[c] for c in docs.columns])
