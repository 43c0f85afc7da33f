"""DuckDB SQL for the rows of those queries that SQL can express on whole tables.

The others learn from the tables, follow a curve or encode tokens; their tests compare them with plain versions.
"""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"

_LINE_DEDUP = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
keyed AS (
  SELECT *, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS k,
         sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS start
  FROM split),
ranked AS (
  SELECT *, len(string_split(k, ' ')) >= 8 AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS gone FROM keyed)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS n_removed,
       coalesce(string_agg(CAST(start AS BIGINT) || ':' || CAST(start + length(line) AS BIGINT), ',' ORDER BY i) FILTER (gone), '') AS removed
FROM ranked GROUP BY doc_id
"""

_DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_LOW}, '{_ALNUM}') AS w FROM benchmark),
sized AS (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
sizes AS (SELECT DISTINCT n FROM sized),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, i, n FROM doc_windows JOIN item_windows USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_NEAR_DUPLICATES = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW}, '{_WORD}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], chr(10)) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y),
least AS (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       doc_id <= coalesce(m, doc_id) AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""


def _crc32(text: str) -> str:
    """CRC-32 of a string of ASCII letters and digits."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z : xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({text}, ''), lambda s : CAST(ascii(s) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b : {byte}), 4294967295)"


def _then(way: str, cost: str, edit: str) -> str:
    """A way, written as its cost in seven digits and its audit, with one more edit; ``~`` is none."""
    return f"CASE WHEN {way} = '~' THEN '~' ELSE lpad(CAST(CAST({way}[1:7] AS INT) + {cost} AS VARCHAR), 7, '0') || {way}[8:] || '{edit}' END"


def _inserted(ways: str) -> str:
    """Ways with inserts before the next row; at most a user's and an assistant's turn pay."""
    user = f"least(s2, {_then('s0', '2', 'I')}, {_then('s1', '2', 'I')}, {_then('s3', '2', 'I')})"
    return f"(SELECT *, least(s3, {_then('u', '2', 'I')}) AS a FROM (SELECT *, {user} AS u FROM {ways}))"


def _met(initial: str, ways: str) -> str:
    """The next row kept, where it has the initial, or reroled."""
    either = [_then(w, "2 + t", "R") for w in ways.split()] + [
        f"CASE WHEN initial = '{initial}' THEN {_then(w, 't', 'K')} ELSE '~' END" for w in ways.split()
    ]
    return f"CASE WHEN gone THEN '~' ELSE least({', '.join(either)}) END"


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_CONVERSATIONS = rf"""
WITH RECURSIVE kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(_KEY)} % 20 AS k FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE k <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
         rtrim(text, {_BLANKS}) AS line, role[1:1] AS initial
  FROM damaged),
marked AS (
  SELECT *, line = '' AS blank, line <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS duplicate,
         coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM placed),
coded AS (
  SELECT *, blank OR duplicate AS gone, NOT blank AND NOT duplicate AND right(line, 1) NOT IN ('.', '!', '?') AS truncated,
         CAST(NOT blank AND NOT duplicate AND right(line, 1) NOT IN ('.', '!', '?') AS INT) AS t
  FROM marked),
totals AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM coded GROUP BY conv_id),
ways AS (
  SELECT conv_id, n, CAST(0 AS BIGINT) AS pos, '0000000' AS s0, '~' AS s1, '~' AS s2, '~' AS s3 FROM totals
  UNION ALL
  SELECT w.conv_id, w.n, r.pos, {_then("s0", "3", "D")},
         least({_then("s1", "3", "D")}, CASE WHEN gone OR initial <> 's' THEN '~' ELSE {_then("s0", "t", "K")} END),
         least({_then("u", "3", "D")}, {_met("u", "s0 s1 a")}), least({_then("a", "3", "D")}, {_met("a", "u")})
  FROM {_inserted("ways")} w JOIN coded r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1),
best AS (SELECT conv_id, least(s0, a) AS way FROM {_inserted("ways")} WHERE pos = n),
edits AS (SELECT conv_id, way[8:] AS audit, unnest(range(8, len(way) + 1)) AS i, way[i : i] AS edit FROM best),
steps AS (
  SELECT conv_id, i, edit, count(*) FILTER (edit <> 'I') OVER w AS pos, count(*) FILTER (edit <> 'D') OVER w - 1 AS place
  FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
turns AS (
  SELECT s.conv_id, i, place, edit, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, role,
         max(CAST(edit = 'K' AND place = 0 AND initial = 's' AS INT)) OVER (PARTITION BY s.conv_id) AS led
  FROM steps s LEFT JOIN coded r ON r.conv_id IS NOT DISTINCT FROM s.conv_id AND r.pos = s.pos WHERE edit <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS text
  FROM turns GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(way[1:7] AS BIGINT), 0) AS cost,
       coalesce(way[8:], '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN totals ON totals.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def _level(name: str, below: str) -> str:
    """Runs of 16 nodes of the level below; a key of one node stays as it is."""
    return f"""{name} AS (
  SELECT key, pos // 16 AS pos, max(n) = 1 AS one, list(h ORDER BY pos) AS hs,
         CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM {below}) GROUP BY 1, 2)"""


def _fold(name: str, below: str, level: str) -> str:
    """Rows of the level below one step nearer to the root."""
    return f"""{name} AS (
  SELECT f.* EXCLUDE (pos, h, proof), f.pos // 16 AS pos,
         CASE WHEN one THEN f.h ELSE sha256(array_to_string(hs[1 : f.pos % 16], '') || f.h || array_to_string(hs[f.pos % 16 + 2 : 16], '')) END AS h,
         proof || array_to_string(hs[1 : f.pos % 16], '') || array_to_string(hs[f.pos % 16 + 2 : 16], '') AS proof
  FROM {below} f JOIN {level} r ON f.key = r.key AND f.pos // 16 = r.pos)"""


# Six levels hold 16 ** 6 rows of a source, four 65,536 sources.
_DEEP, _WIDE = 6, 4
_FIELDS = " || ".join(
    f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars")
)
_MANIFEST = f"""
WITH rows_of AS (
  SELECT doc_id, coalesce('=' || source, '-') AS key, {_FIELDS} AS head, text,
         CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0
              THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS later
  FROM documents),
leaves AS (
  SELECT doc_id, key, sha256(head || coalesce(CAST(strlen(text) AS VARCHAR) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(CAST(strlen(later) AS VARCHAR) || ':' || later, '-')) AS used FROM rows_of),
s0 AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
{", ".join(_level(f"s{k + 1}", f"s{k}") for k in range(_DEEP))},
t0 AS (SELECT key AS source_key, 0 AS key, h, row_number() OVER (ORDER BY key) - 1 AS pos FROM s{_DEEP}),
{", ".join(_level(f"t{k + 1}", f"t{k}") for k in range(_WIDE))},
f0 AS (SELECT doc_id, key, leaf, pos, used AS h, '' AS proof FROM s0),
{", ".join(_fold(f"f{k + 1}", f"f{k}", f"s{k + 1}") for k in range(_DEEP))},
g0 AS (
  SELECT f.doc_id, f.leaf, t.h AS subroot, t.key, t.pos, f.h, f.proof FROM f{_DEEP} f JOIN t0 t ON t.source_key = f.key),
{", ".join(_fold(f"g{k + 1}", f"g{k}", f"t{k + 1}") for k in range(_WIDE))}
SELECT doc_id, leaf, subroot, (SELECT h FROM t{_WIDE}) AS root, sha256(proof) AS proof_sha256, h AS folded_root,
       h = (SELECT h FROM t{_WIDE}) AS verified
FROM g{_WIDE}
"""

_GRID_JOIN = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x : x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x : x <> 0)) > 0),
links AS (
  SELECT a.r AS x, b.r AS y, b.vec_id AS id FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT x AS r, min(vec_id) AS m FROM reach JOIN v ON v.r = y GROUP BY x),
counts AS (SELECT x AS r, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id <= coalesce(m, vec_id) AS kept
FROM v LEFT JOIN counts USING (r) LEFT JOIN least USING (r)
"""

ORACLES: dict[str, str] = {
    "op3_near_duplicates": _NEAR_DUPLICATES,
    "op6_line_dedup": _LINE_DEDUP,
    "op7_decontamination": _DECONTAMINATION,
    "op11_conversations": _CONVERSATIONS,
    "op12_manifest": _MANIFEST,
    "op13_grid_join": _GRID_JOIN,
}
