"""A Merkle manifest of documents: one tree per source, one over the sources, and for each row its proof to the root.

1. Each row is a leaf. Within its source leaves ascend by doc_id and every 16 consecutive ones become one node, level by
   level, until one is left; the nodes of the sources become the leaves of a last tree in the same way. Each level holds a
   sixteenth of the one before. The leaves of a run stay in one row, as their first step is known from the run.
2. Each node points to its parent and holds its siblings on either side. By pointer jumping the table of nodes is joined
   with itself: a node takes the segment of the node that it points to behind its own, and points where that one pointed.
   Every round doubles the distance; after the logarithm of the depth every run points to the root. Nodes number a
   fifteenth of the leaves, so that no proof of a leaf is ever shuffled.
3. Each run is unfolded: a leaf's proof is its siblings in the run and then the run's segment.

Digests are lowercase hex SHA-256 of strings, all computed by Spark's own functions. Ranks within a source come from range
partitioned chunks, so a source of any size spans many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.operators.keyed import number_rows
from postsieve.session import materialise

FAN = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
# A node's siblings on its left and on its right, each joined to one string.
STEP = "struct<left: string, right: string>"


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    """The digest of a row: of each value its length in bytes, a colon and itself, or a hyphen if it is null."""
    return _sha(F.concat(*[_field(v) for v in values]))


def _siblings(hashes: Column, i: Column) -> Column:
    """What stands left and right of place ``i`` (from 0) in a run."""
    return F.struct(
        F.array_join(F.slice(hashes, 1, i), "").alias("left"),
        F.array_join(F.slice(hashes, i + 2, FAN), "").alias("right"),
    )


def _depth(n: Column) -> Column:
    """Levels above ``n`` leaves."""
    return sum((n > FAN**k).cast("int") for k in range(15))


def _node(key: Column, level: Column, pos: Column) -> Column:
    return F.concat_ws(":", level.cast("string"), pos.cast("string"), key)


def _grow(base: DataFrame, label: str) -> tuple[DataFrame, DataFrame, int]:
    """The tops ``(key, node, hash)`` of the trees over ``base(key, level, pos, depth, hash)``, the links below them, and
    the height of the highest.

    A link ``(node, up, path)`` points from a node to its parent, with one step. ``depth`` is the level of a key's top.
    """
    links = base.select(F.lit("").alias("node"), F.lit("").alias("up"), F.array().cast(f"array<{STEP}>").alias("path")).filter(F.lit(False))
    height = base.agg(F.max("depth").alias("d")).first()["d"] or 0
    tops, level = base.filter("level = depth"), base.filter("level < depth")
    for _ in range(height):
        runs = level.groupBy("key", F.expr(f"pos div {FAN}").alias("run")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "hash"))).alias("run_of"), F.first("level").alias("level"), F.first("depth").alias("depth")
        )
        runs = runs.withColumn("hashes", F.col("run_of.hash"))
        runs = materialise(runs.withColumn("hash", _sha(F.array_join("hashes", ""))), label)
        # A run is at most 16 nodes.
        each = runs.select("key", "run", "level", "hashes", F.posexplode("run_of").alias("i", "x"))
        links = links.unionByName(
            each.select(
                _node(F.col("key"), F.col("level"), F.col("x.pos")).alias("node"),
                _node(F.col("key"), F.col("level") + 1, F.col("run")).alias("up"),
                F.array(_siblings(F.col("hashes"), F.col("i"))).alias("path"),
            )
        )
        above = runs.select("key", (F.col("level") + 1).alias("level"), F.col("run").alias("pos"), "depth", "hash")
        tops = tops.unionByName(above.filter("level = depth"))
        level = above.filter("level < depth")
        if level.isEmpty():
            break
    tops = tops.select("key", _node(F.col("key"), F.col("level"), F.col("pos")).alias("node"), "hash")
    return materialise(tops, f"{label}-tops"), links, height


def _jump(links: DataFrame, longest: int) -> DataFrame:
    """``(node, path)`` with the steps from each node to the root, which is ``longest`` links away at most."""
    reach, links = 1, materialise(links, "links")
    while reach < longest:
        far = links.select(F.col("node").alias("via"), F.col("up").alias("far"), F.col("path").alias("rest"))
        joined = links.join(far, links["up"] == far["via"], "left")
        links = joined.select(
            "node", F.coalesce("far", "up").alias("up"), F.when(F.col("rest").isNull(), F.col("path")).otherwise(F.concat("path", "rest")).alias("path")
        )
        links, reach = materialise(links, "jump"), 2 * reach
    return links.select("node", "path")


def manifest(docs: DataFrame, checked: Column | None = None) -> DataFrame:
    """``(doc_id, source, leaf, checked, subroot, root, proof)`` for each row of ``docs``.

    ``subroot`` is the top of the row's source, ``root`` that of all sources. ``proof`` is an array of steps from the leaf
    to the root, each with the siblings on the left and on the right as strings of digests; a source of one row has no
    step of its own. ``checked`` is a digest per row to be held against the proof, such as the leaf of another state of the
    row; by default the leaf.

    Null fields count as a hyphen; rows without source are a source of their own, before all others. Rows without doc_id
    come first in their source; equal doc_ids are ordered by leaf, so repeated rows are leaves of their own and exchange
    places freely. An empty table gives no rows. Columns beside those of ``FIELDS`` are ignored.
    """
    own = leaf([F.col(c) for c in FIELDS])
    # Hyphen and equals sign order keys like sources: null first, then by bytes.
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("-"))
    rows = docs.select(key.alias("key"), "doc_id", own.alias("leaf"), (own if checked is None else checked).alias("checked"))
    ranked = materialise(number_rows(rows, ["key"], ["doc_id", "leaf", "checked"], "rank"), "leaves")
    depths = ranked.groupBy("key").agg(_depth(F.count(F.lit(1))).alias("depth"))
    runs = ranked.groupBy("key", F.expr(f"(rank - 1) div {FAN}").alias("pos")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "doc_id", "leaf", "checked"))).alias("leaves")
    )
    runs = runs.join(materialise(depths, "depths"), "key").withColumn("hashes", F.col("leaves.leaf"))
    # A lone leaf is the top of its source itself.
    lone = F.col("depth") == 0
    runs = runs.withColumn("level", F.when(lone, 0).otherwise(1))
    runs = runs.withColumn("hash", F.when(lone, F.col("hashes")[0]).otherwise(_sha(F.array_join("hashes", ""))))
    runs = materialise(runs.withColumn("node", _node(F.col("key"), F.col("level"), F.col("pos"))), "runs")

    subroots, links, height = _grow(runs.select("key", "level", "pos", "depth", "hash"), "level")
    order = number_rows(subroots.withColumn("all", F.lit(0)), ["all"], ["key"], "rank")
    n = subroots.count()
    over = order.select(F.lit("").alias("key"), F.lit(0).alias("level"), (F.col("rank") - 1).alias("pos"), _depth(F.lit(n)).alias("depth"), "hash", F.col("node").alias("below"))
    over = materialise(over, "sources")
    top, upper, above = _grow(over.drop("below"), "over")
    # The node of the last tree that stands for a source is that source's top.
    names = over.select(_node(F.col("key"), F.col("level"), F.col("pos")).alias("node"), "below")
    upper = upper.join(names, "node", "left").select(F.coalesce("below", "node").alias("node"), "up", "path")
    paths = _jump(links.unionByName(upper), max(height - 1, 0) + above)
    root = top.first()

    found = runs.join(paths, "node", "left").join(subroots.select("key", F.col("hash").alias("subroot")), "key")
    path = F.coalesce("path", F.array().cast(f"array<{STEP}>"))
    each = found.select("key", "depth", "subroot", "hashes", path.alias("path"), F.posexplode("leaves").alias("i", "x"))
    step = F.array(_siblings(F.col("hashes"), F.col("i")))
    return each.select(
        "x.doc_id",
        F.when(F.col("key") != "-", F.substring("key", 2, 2**31 - 1)).alias("source"),
        "x.leaf",
        "x.checked",
        "subroot",
        F.lit(root["hash"] if root else None).cast("string").alias("root"),
        F.when(F.col("depth") == 0, F.col("path")).otherwise(F.concat(step, F.col("path"))).alias("proof"),
    )


def folded(digest: Column, proof: Column) -> Column:
    """The root that ``proof`` gives for a leaf."""
    return F.aggregate(proof, digest, lambda h, s: _sha(F.concat(s["left"], h, s["right"])))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof in their order."""
    return _sha(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """Each row's place in the manifest, and whether the row as found later still belongs there.

    The later state lower-cases A-Z in the texts of rows whose doc_id, in decimal, has a CRC-32 that 5 divides; null texts
    and rows without doc_id stay as they are. Nulls, ties, repeated rows and further columns are as in :func:`manifest`.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    text = F.when(hit, lower).otherwise(F.col("text"))
    later = leaf([text if c == "text" else F.col(c) for c in FIELDS])
    found = manifest(docs, later)
    back = found.withColumn("folded_root", folded(F.col("checked"), F.col("proof")))
    return back.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
