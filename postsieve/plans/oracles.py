"""The catalogue's queries in plain SQL, for comparison on the same tables."""

from __future__ import annotations

from postsieve.functions.text import BLANKS

_BLANK = "".join(rf"\x{{{ord(c):x}}}" for c in BLANKS)

_LINKS = r"""
bare AS (
  SELECT page_id, url,
         regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS html
  FROM pages),
found AS (
  SELECT page_id, url, regexp_extract_all(html, '(?is)<a\s(?:[^>]*?\s)?href\s*=\s*"([^"]*)"', 1) AS l FROM bare),
each_link AS (SELECT page_id, url, unnest(l) AS href, generate_subscripts(l, 1) AS i FROM found),
first_link AS (SELECT page_id, url, replace(href, '&amp;', '&') AS href, min(i) AS i FROM each_link GROUP BY ALL),
links AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, url, href,
         row_number() OVER (PARTITION BY page_id ORDER BY i) AS ord
  FROM first_link)
"""

_COUNTS = (
    _LINKS
    + r""",
first_sight AS (SELECT host, href, min(page_id) AS page_id FROM links GROUP BY host, href),
n_new AS (SELECT page_id, count(*) AS n_new FROM first_sight GROUP BY page_id),
n_links AS (SELECT page_id, count(*) AS n_links FROM links GROUP BY page_id),
counts AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, p.page_id,
         coalesce(n_links, 0) AS n_links, coalesce(n_new, 0) AS n_new,
         coalesce(n_links, 0) - coalesce(n_new, 0) AS n_dup
  FROM pages p LEFT JOIN n_links USING (page_id) LEFT JOIN n_new USING (page_id))
"""
)

_EVENT_COUNTS = """
events_n AS (
  SELECT user_id, event_id AS page_no, event_type,
         CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS BIGINT) % 7 END AS n_links
  FROM events),
counts AS (
  SELECT user_id, page_no, CAST(n_links AS BIGINT) AS n_links,
         CAST(CASE WHEN event_type = 'purchase' THEN n_links ELSE 0 END AS BIGINT) AS n_new,
         CAST(CASE WHEN event_type = 'purchase' THEN 0 ELSE n_links END AS BIGINT) AS n_dup
  FROM events_n)
"""

_UPSERT = """
WITH r AS (SELECT event_id, user_id, event_type, value,
  row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, event_id DESC) AS n FROM events)
SELECT event_id, user_id, event_type, value FROM r WHERE n = 1"""

# Events as attempts: the last that counts of each user's, and how many count.
_ATTEMPTS = """
n AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
         CASE WHEN event_type = 'purchase' THEN event_id END AS reply
  FROM events WHERE ts <= {until}),
counted AS (SELECT *, min(CASE WHEN reply IS NOT NULL THEN n END) OVER (PARTITION BY user_id) AS ok FROM n WHERE n <= 4),
last AS (
  SELECT *, n AS attempts FROM counted
  QUALIFY n = coalesce(ok, max(n) OVER (PARTITION BY user_id)))
"""


def _runs(key: str, page: str) -> str:
    return f"""
islands AS (
  SELECT *, sum(CASE WHEN n_new > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY {page}) AS island,
         row_number() OVER (PARTITION BY {key} ORDER BY {page}) AS ordinal
  FROM counts),
running AS (
  SELECT {key}, {page}, n_links, n_new, n_dup, ordinal,
         CAST(sum(CASE WHEN n_new > 0 THEN 0 ELSE greatest(n_dup, 1) END)
              OVER (PARTITION BY {key}, island ORDER BY {page}) AS BIGINT) AS consec
  FROM islands),
stops AS (
  SELECT *, max(CASE WHEN consec >= 5 OR ordinal >= 10 THEN 1 ELSE 0 END)
            OVER (PARTITION BY {key} ORDER BY {page}) AS stopped
  FROM running),
kept AS (SELECT {key}, {page}, n_links, n_new, n_dup, ordinal, consec FROM stops WHERE stopped = 0)
"""


_PAGE_RUNS = _COUNTS + "," + _runs("host", "page_id")
_EVENT_RUNS = _EVENT_COUNTS + "," + _runs("user_id", "page_no")
_KEEP = "consec, n_dup, n_links, n_new"

_CANONICAL = """CASE page_id % 3 WHEN 0 THEN 'https://www.linkedin.com/jobs/view/' || page_id || '/'
  WHEN 1 THEN 'https://www.indeed.com/viewjob?jk=' || page_id ELSE 'https://www.zhipin.com/job_detail/' || page_id || '.html' END"""


def _component(text: str) -> str:
    out = f"url_encode({text})"
    for code, char in (("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")"), ("%2A", "*"), ("%7E", "~"), ("+", "%20")):
        out = f"replace({out}, '{code}', '{char}')"
    return out


def _trim(text: str) -> str:
    return f"regexp_replace({text}, '^[{_BLANK}]+|[{_BLANK}]+$', '', 'g')"


def _key(title: str, company: str) -> str:
    return f"{_trim(f'lower({title})')} || '||' || {_trim(f'lower({company})')}"


_TITLE = "split_part(text, chr(10), 1)"
_URL = "'https://jobs.example/view/' || doc_id || '/'"
_CLIPPED = "CASE WHEN length(text) > 5000 THEN substr(text, 1, 5000) || '...' ELSE text END"
_PROMPT = f"'Job URL: ' || {_URL} || chr(10) || chr(10) || 'Job Description:' || chr(10) || {_CLIPPED}"

_PLAN = """
plan AS (
  SELECT platform_pos, platform_idx, p_partkey AS keyword_idx, p_name || ' & co''s 实习 (intern)' AS keyword, page_no
  FROM part,
       (VALUES (0, 2), (1, 0), (2, 1)) AS pf(platform_pos, platform_idx),
       (SELECT unnest(range(1, 11)) AS page_no))
"""

_JOB_LINKS = (
    _LINKS
    + """,
job AS (
  SELECT page_id, ord,
         CASE page_id % 3 WHEN 0 THEN 'LinkedIn' WHEN 1 THEN 'Indeed' ELSE 'Boss直聘' END AS platform,
         CASE WHEN page_id % 3 = 0 THEN 'https://www.linkedin.com/jobs/view/' || (ord * page_id % 97) || '/'
              WHEN page_id % 3 = 1 AND ord % 2 = 1
              THEN 'https://www.indeed.com/viewjob?w=' || replace(url_encode(substr(href, 2)), '%2C', ',')
              WHEN page_id % 3 = 1 THEN 'https://www.indeed.com/viewjob?jk=' || (ord * page_id % 97)
              ELSE 'https://www.zhipin.com/job_detail/' || (ord * page_id % 97) || '.html' END AS url
  FROM links),
job_first AS (SELECT page_id, platform, url, min(ord) AS ord FROM job GROUP BY ALL),
job_links AS (
  SELECT page_id, platform, url, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS pos FROM job_first)
"""
)


def _decoded(html: str) -> str:
    return rf"""regexp_replace(regexp_replace({html}, '&quot;?', '"', 'g'), '&amp;?', '&', 'g')"""


def _text(html: str) -> str:
    """All text, blanks as they are."""
    return _trim(_decoded(rf"regexp_replace({html}, '</?(p|br|h1|b)>', '', 'g')"))


def _lines(html: str) -> str:
    """A line per tag that is not inline, blanks squeezed, empty lines dropped."""
    out = _decoded(rf"regexp_replace(regexp_replace(regexp_replace({html}, '[ \t\n\r\f]+', ' ', 'g'), '</?(p|br|h1)>', chr(10), 'g'), '</?b>', '', 'g')")
    return _trim(rf"regexp_replace(regexp_replace({out}, ' +', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')")


_WALLED = r"""walls AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host,
         page_id % 11 = 5 OR page_id % 13 = 6 AS walled
  FROM pages)"""

_UNWALLED = f"""
WITH {_WALLED}, seen AS (
  SELECT page_id, host, max(CASE WHEN walled THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY page_id) AS w FROM walls)
SELECT page_id, host FROM seen WHERE w = 0"""

_POSTINGS = f"""
postings AS (
  SELECT doc_id AS seq, lang AS run_id, {_TITLE} AS title, source AS company, lang AS location,
         CASE WHEN n_chars > 2000 THEN n_chars || ' "K"' ELSE '' END AS salary,
         lang || '; ' || source AS tech_tags, 'needs: ' || {_TITLE} AS requirements, source,
         {_URL} AS job_url, quality = 1 AS is_ai_engineer, toxic = 0 AS is_campus_or_intern
  FROM documents LEFT JOIN labels USING (doc_id))
"""

_LINE = " || ',' || ".join(
    f"""'"' || replace({c}, '"', '""') || '"'"""
    for c in ("title", "company", "location", "salary", "tech_tags", "requirements", "source", "job_url")
)

_REPLIES = f"""
replies AS (
  SELECT doc_id, lang, source, {_URL} AS job_url,
         CASE WHEN doc_id % 7 = 0 THEN 'not_json'
              WHEN doc_id % 5 = 3 THEN 'call_failed'
              WHEN doc_id % 7 IN (1, 2, 3) THEN 'bad_schema'
              WHEN doc_id % 7 = 4 THEN 'not_json'
              WHEN quality = 1 AND toxic = 0 THEN 'ok'
              ELSE 'not_qualified' END AS status
  FROM documents JOIN labels USING (doc_id))
"""

_KEYED = f"""
keyed AS (
  SELECT doc_id AS seq, lang AS run_id, {_key(_TITLE, "lang")} AS job_key, source, {_URL} AS job_url FROM documents)
"""

_CUT = f"""
WITH {_KEYED},
firsts AS (SELECT *, row_number() OVER (PARTITION BY run_id, job_key ORDER BY seq) AS n FROM keyed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS place FROM firsts WHERE n = 1)
SELECT run_id, seq, job_key FROM ranked WHERE place <= 50
"""

_START = """
runs AS (
  SELECT c_custkey AS run_id, c_nationkey AS collected,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN 'done' ELSE 'idle' END AS status
  FROM customer),
o AS (SELECT o_custkey AS run_id, 'u' || o_custkey || '-' || o_orderpriority AS url, o_orderstatus AS s FROM orders),
starts AS (
  SELECT run_id, (collected > 0 OR run_id IN (SELECT run_id FROM o WHERE s IN ('F', 'O')))
                 AND NOT (status = 'done' OR collected >= 20) AS resumed,
         CASE WHEN run_id IN (SELECT run_id FROM o WHERE s = 'O') THEN 'visiting_detail' ELSE 'searching' END AS status
  FROM runs)
"""

_OTHER_DEFAULTS = """CAST(50 AS INTEGER) AS target, CAST(0 AS INTEGER) AS current_keyword_index,
       CAST(1 AS INTEGER) AS current_page, CAST(0 AS INTEGER) AS pages_per_keyword,
       CAST(10 AS INTEGER) AS max_pages_per_keyword, CAST(0 AS INTEGER) AS consecutive_dupes,
       CAST(0 AS INTEGER) AS current_platform_index, CAST(NULL AS BIGINT) AS active_tab_id,
       '0,1,2' AS selected_platform_indices"""

_RULE_TEXT = """
texts AS (
  SELECT doc_id, lower(text || CASE doc_id % 8
    WHEN 0 THEN ' AI Engineer, intern'
    WHEN 1 THEN ' ML engineer; 5+ years'
    WHEN 2 THEN ' AI Engineer and QA Engineer, 3-5 years'
    WHEN 3 THEN ' 算法 Algorithm Engineer 校招, 10 years'
    WHEN 4 THEN ' international sales'
    WHEN 5 THEN ' NLP engineer 0-2 years'
    WHEN 6 THEN ' 机器学习工程师, 5年以上经验'
    WHEN 7 THEN ' AI engineers, at least five years'
    ELSE '' END) AS low
  FROM documents)
"""

_DETAIL_TEXT = rf"""
WITH parts AS (
  SELECT page_id, {_text("regexp_extract(html, '(?is)<h1>(.*?)</h1>', 1)")} AS title,
         {_lines("regexp_extract(html, '(?is)<article>(.*?)</article>', 1)")} AS body,
         {_text("regexp_extract(html, '(?is)<div class=.ad.>(.*?)</div>', 1)")} AS advert
  FROM pages)
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'LinkedIn' WHEN 1 THEN 'Indeed' ELSE 'Boss直聘' END AS platform, false AS parse_failed,
       CASE WHEN title <> '' THEN 'Title: ' || title || chr(10) ELSE '' END
       || CASE WHEN advert = '' THEN '' WHEN page_id % 3 = 2 THEN 'Company: ' || advert || chr(10) ELSE 'Location: ' || advert || chr(10) END
       || chr(10) || 'Job Description:' || chr(10) || body AS text
FROM parts"""

_CRAWL = rf"""
WITH RECURSIVE {_LINKS},
lists AS (SELECT page_id, list(href ORDER BY ord) AS hrefs FROM links GROUP BY page_id),
p AS (
  SELECT page_id, regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS run_id,
         regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, coalesce(hrefs, []) AS hrefs
  FROM pages LEFT JOIN lists USING (page_id)),
o AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY host, page_id) AS idx,
         row_number() OVER (PARTITION BY run_id, host ORDER BY page_id) AS ordinal
  FROM p),
walk AS (
  SELECT run_id, CAST(0 AS BIGINT) AS idx, '' AS host, CAST(0 AS BIGINT) AS page_id, CAST([] AS VARCHAR[]) AS used,
         CAST([] AS VARCHAR[]) AS visited, CAST(0 AS BIGINT) AS consec, false AS stopped
  FROM o WHERE idx = 1
  UNION ALL
  SELECT run_id, idx, host, page_id, CASE WHEN stopped THEN [] ELSE fresh END,
         CASE WHEN stopped THEN visited ELSE list_concat(visited, fresh) END, consec, stopped
  FROM (
    SELECT *, was_stopped OR consec >= 5 OR ordinal >= 10 AS stopped
    FROM (
      SELECT *, CASE WHEN len(fresh) > 0 THEN 0 ELSE before + greatest(len(hrefs), 1) END AS consec
      FROM (
        SELECT o.run_id, o.idx, o.host, o.page_id, o.ordinal, o.hrefs, w.visited,
               o.ordinal > 1 AND w.stopped AS was_stopped, CASE WHEN o.ordinal > 1 THEN w.consec ELSE 0 END AS before,
               list_filter(o.hrefs, lambda x: NOT list_contains(w.visited, x)) AS fresh
        FROM walk w JOIN o ON o.run_id = w.run_id AND o.idx = w.idx + 1)))),
steps AS (SELECT run_id, idx, host, page_id, unnest(used) AS url, generate_subscripts(used, 1) AS pos FROM walk)
SELECT run_id, host, page_id, url, row_number() OVER (PARTITION BY run_id ORDER BY idx, pos) AS seq FROM steps"""

ORACLES = {
    "expand_plan": f"WITH {_PLAN} SELECT CAST(platform_pos AS BIGINT) AS platform_pos, CAST(platform_idx AS BIGINT) AS platform_idx, keyword_idx, page_no FROM plan",
    "search_urls": f"""
WITH {_PLAN}, enc AS (SELECT *, {_component("keyword")} AS k FROM plan)
SELECT CAST(platform_idx AS BIGINT) AS platform_idx, keyword_idx, page_no, CASE platform_idx
  WHEN 0 THEN 'https://www.linkedin.com/jobs/search/?keywords=' || k || '&f_E=1%2C2&f_TPR=r7776000&start=' || (page_no - 1) * 25
  WHEN 1 THEN 'https://www.indeed.com/jobs?q=' || k || '&fromage=90&start=' || (page_no - 1) * 10
  ELSE 'https://www.zhipin.com/web/geek/job?query=' || k || '&city=100010000&publishTime=3&experience=101%2C102&page=' || page_no
  END AS search_url
FROM enc""",
    "url_component": f"SELECT doc_id, md5({_component('text')}) AS encoded FROM documents",
    "page_links": f"WITH {_LINKS} SELECT page_id, ord, href FROM links",
    "canonical_urls": f"SELECT page_id, {_CANONICAL} AS url FROM pages",
    "job_links": f"WITH {_JOB_LINKS} SELECT page_id, platform, pos, url FROM job_links",
    "detail_text": _DETAIL_TEXT,
    "job_pages": f"""
WITH {_JOB_LINKS}, n AS (SELECT page_id, count(*) AS n FROM job_links GROUP BY page_id),
named AS (
  SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'LinkedIn' WHEN 1 THEN 'Indeed' ELSE 'Boss直聘' END AS platform FROM pages)
SELECT page_id, platform, CAST(NULL AS VARCHAR) AS job_url, false AS walled, coalesce(n, 0) AS n_links, false AS has_text
FROM named LEFT JOIN n USING (page_id)
UNION ALL
SELECT page_id, platform, CASE page_id % 3 WHEN 0 THEN 'https://www.linkedin.com/jobs/view/' || page_id || '/'
  WHEN 1 THEN 'https://www.indeed.com/viewjob?jk=' || page_id
  ELSE 'https://www.zhipin.com/job_detail/' || page_id || '.html' END, false, 0, true
FROM named""",
    "platform_of_page": r"""
WITH h AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host FROM pages),
p AS (SELECT page_id, CASE WHEN contains(host, 'blog.') THEN 'Blog' WHEN contains(host, 'm.') THEN 'Mobile'
      WHEN contains(host, 'example.org') THEN 'Org' END AS platform FROM h)
SELECT page_id, platform FROM p WHERE platform IS NOT NULL""",
    "auth_wall_pages": f"WITH {_WALLED} SELECT page_id, walled FROM walls",
    "skip_walled": _UNWALLED,
    "stream_walled": _UNWALLED,
    "page_counts": f"WITH {_COUNTS} SELECT host, page_id, n_links, n_new, n_dup FROM counts",
    "consecutive_dupes": f"WITH {_PAGE_RUNS} SELECT host, page_id, {_KEEP} FROM running",
    "keyword_stop": f"WITH {_PAGE_RUNS} SELECT host, page_id, ordinal, {_KEEP} FROM kept",
    "event_consecutive_dupes": f"WITH {_EVENT_RUNS} SELECT user_id, page_no, {_KEEP} FROM running",
    "event_keyword_stop": f"WITH {_EVENT_RUNS} SELECT user_id, page_no, ordinal, {_KEEP} FROM kept",
    "resumed_keyword_stop": f"""
WITH {_EVENT_COUNTS},
saved AS (SELECT *, CASE WHEN user_id % 3 > 0 THEN user_id % 5 ELSE 0 END AS c0, CASE WHEN user_id % 3 > 0 THEN user_id % 4 ELSE 0 END AS p0
          FROM counts),
islands AS (
  SELECT *, sum(CASE WHEN n_new > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY page_no) AS island,
         row_number() OVER (PARTITION BY user_id ORDER BY page_no) + p0 AS ordinal
  FROM saved),
running AS (
  SELECT *, CAST(sum(CASE WHEN n_new > 0 THEN 0 ELSE greatest(n_dup, 1) END) OVER (PARTITION BY user_id, island ORDER BY page_no)
                 + CASE WHEN island = 0 THEN c0 ELSE 0 END AS BIGINT) AS consec
  FROM islands),
stops AS (
  SELECT *, max(CASE WHEN consec >= 5 OR ordinal >= 10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY page_no) AS stopped
  FROM running)
SELECT user_id, page_no, n_links, n_new, n_dup, ordinal, consec FROM stops WHERE stopped = 0""",
    "frontier": f"""
WITH {_PAGE_RUNS}
SELECT row_number() OVER (ORDER BY l.host, l.page_id, l.ord) AS seq, l.host, l.page_id, l.href AS url
FROM links l JOIN first_sight f ON l.host = f.host AND l.href = f.href AND l.page_id = f.page_id
JOIN kept k ON l.host = k.host AND l.page_id = k.page_id""",
    "crawl_frontier": _CRAWL,
    "incremental_frontier": _CRAWL,
    "stream_frontier": _CRAWL,
    "pending_queue": """
WITH o AS (SELECT o_custkey AS run_id, o_orderkey AS seq, 'u' || o_custkey || '-' || o_orderpriority AS url, o_orderstatus AS s
           FROM orders),
last AS (SELECT run_id, max(seq) AS n FROM o WHERE s = 'O' GROUP BY run_id),
lead AS (SELECT run_id, min(seq) AS f FROM o WHERE s = 'P' GROUP BY run_id),
queue AS (SELECT run_id, seq, url FROM o WHERE s = 'O'
          UNION ALL SELECT run_id, coalesce(seq + n + 1 - f, seq), url
          FROM o LEFT JOIN last USING (run_id) LEFT JOIN lead USING (run_id) WHERE s = 'P')
SELECT run_id, seq, url FROM queue WHERE url NOT IN (SELECT url FROM o WHERE s = 'F')""",
    "drop_visited": f"""
WITH {_LINKS} SELECT page_id, href AS url FROM links
WHERE href NOT IN (SELECT href FROM links WHERE contains(url, '/es/'))""",
    "visited_union": f"WITH {_JOB_LINKS} SELECT {_CANONICAL} AS url FROM pages UNION SELECT url FROM job_links",
    "recent_postings": """
SELECT event_id, event_type FROM events
WHERE ts >= TIMESTAMP '2024-01-31' - CASE event_type WHEN 'view' THEN INTERVAL 10 DAY WHEN 'click' THEN INTERVAL 20 DAY
  WHEN 'purchase' THEN INTERVAL 5 DAY WHEN 'signup' THEN INTERVAL 25 DAY END""",
    "level_filter": """
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
WHERE (o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) OR o_orderstatus = 'O'
   OR (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')""",
    "active_runs": """
WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events GROUP BY user_id)
SELECT event_id, user_id AS run_id, event_type FROM events
WHERE user_id IN (SELECT user_id FROM last WHERE t NOT IN ('error', 'purchase', 'signup'))""",
    "attach_source": "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "attempts": f"""
WITH {_ATTEMPTS.format(until="TIMESTAMP '9999-01-01'")}
SELECT user_id, attempts, ok IS NOT NULL AS answered, ok IS NULL AND attempts >= 4 AS gave_up, CAST(reply AS VARCHAR) AS reply,
       CASE WHEN ok IS NULL THEN event_type END AS last_error, ts AS last_at,
       CASE WHEN ok IS NULL AND attempts < 4 THEN ts + to_days(CAST(pow(2, attempts - 1) AS INT)) END AS next_at
FROM last""",
    "due_calls": f"""
WITH {_ATTEMPTS.format(until="TIMESTAMP '2024-01-03'")}
SELECT c_custkey AS user_id, coalesce(attempts, 0) + 1 AS attempt FROM customer LEFT JOIN last ON user_id = c_custkey
WHERE user_id IS NULL
   OR (ok IS NULL AND attempts < 4 AND ts + to_hours(CAST(6 * pow(2, attempts - 1) AS INT)) <= TIMESTAMP '2024-01-03')""",
    "prompt": f"SELECT doc_id, {_PROMPT} AS prompt FROM documents",
    "score_batch": f"SELECT doc_id, 'length ' || length({_PROMPT}) AS reply FROM documents",
    "scored_until_target": f"""
WITH scored AS (
  SELECT lang AS run_id, doc_id AS seq, split_part({_CLIPPED}, chr(10), 1) AS title, {_URL} AS job_url
  FROM documents WHERE length({_PROMPT}) % 3 > 0),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, {_key("title", "'c'")} ORDER BY seq) AS n FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS place FROM firsts WHERE n = 1)
SELECT run_id, seq, title, job_url FROM ranked WHERE place <= 40""",
    "reply_content": "SELECT doc_id, CASE WHEN lang <> 'es' THEN md5(text) END AS reply FROM documents",
    "reply_validation": f"""
WITH {_REPLIES}
SELECT doc_id, status, CASE WHEN status IN ('ok', 'not_qualified') THEN lang || '; ' || source END AS tags FROM replies""",
    "reply_postings": f"""
WITH {_REPLIES}
SELECT 't' AS title, source AS company, lang AS location, '' AS salary, lang || '; ' || source AS tech_tags,
       'r' AS requirements, 'LinkedIn' AS source, job_url
FROM replies WHERE status = 'ok'""",
    "quarantine": f"""
WITH {_REPLIES} SELECT lang AS run_id, status, count(*) AS n FROM replies WHERE status <> 'ok' GROUP BY lang, status""",
    "replay": f"WITH {_REPLIES} SELECT doc_id, job_url AS url FROM replies WHERE status = 'call_failed'",
    "qualified_postings": f"""
WITH {_POSTINGS} SELECT job_url, title, company, location, source FROM postings WHERE is_ai_engineer AND is_campus_or_intern""",
    "rule_labels": f"""
WITH {_RULE_TEXT}
SELECT doc_id,
       (regexp_matches(low, '(^|[^a-z0-9])((ai|ml|llm|machine learning|algorithm|ai research|nlp|cv|mlops|ai platform|ai agent) engineer|applied scientist|data scientist)s?([^a-z0-9]|$)')
        OR regexp_matches(low, '(机器学习|算法|人工智能|大模型|深度学习)工程师'))
       AND NOT regexp_matches(low, '(^|[^a-z0-9])((generic software|backend|frontend|data|big data|test|qa|operations) engineer|sdet|ai artist|aigc designer|image generator|devops|sre|product manager|business analyst|sales|marketing)s?([^a-z0-9]|$)|生图师|运维工程师') AS rule_role,
       regexp_matches(low, '(^|[^a-z0-9])(intern|internship|co-op|campus recruit|new graduate|new grad|university graduate|university grad|college graduate|new college grad|recent graduate|early career|entry level|entry-level|0-2 years|2025 graduate|2026 graduate)s?([^a-z0-9]|$)|校招|应届|实习')
       OR NOT (regexp_matches(low, '(^|[^0-9])([3-9]|[1-9][0-9])( or more)?[+]? ?(-|to|~|至)? ?[0-9]* ?([+] ?)?(years|yrs|年)')
               OR regexp_matches(low, '(three|four|five|six|seven|eight|nine|ten)( or more|[+])? ?(to [a-z]+ )?(years|yrs)')
               OR regexp_matches(low, '[三四五六七八九十]年')) AS rule_level
FROM texts""",
    "quality_flags": f"""
WITH {_POSTINGS}
SELECT job_url, location = 'en' AS no_tags, location = 'de' AS no_requirements,
       CASE WHEN location <> 'en' THEN tech_tags WHEN seq % 3 = 0 THEN 'Machine Learning'
            WHEN seq % 3 = 1 THEN 'AI; Machine Learning' ELSE '' END AS filled_tags
FROM postings""",
    "dedup_title_company": f"""
WITH {_KEYED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY job_key ORDER BY seq) AS n FROM keyed)
SELECT seq, job_key FROM ranked WHERE n = 1""",
    "new_keys": f"""
WITH {_KEYED}, l AS (SELECT doc_id AS seq FROM labels)
SELECT seq, job_key FROM keyed k WHERE seq NOT IN (SELECT seq FROM l)
AND NOT EXISTS (SELECT 1 FROM keyed o JOIN l USING (seq) WHERE o.job_key = k.job_key AND o.run_id = k.run_id)""",
    "target_cut": _CUT,
    "curated_postings": f"""
WITH {_REPLIES}, keyed AS (SELECT lang AS run_id, doc_id AS seq, 't||' || source AS job_key, job_url FROM replies WHERE status = 'ok'),
firsts AS (SELECT *, row_number() OVER (PARTITION BY run_id, job_key ORDER BY seq) AS n FROM keyed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS place FROM firsts WHERE n = 1)
SELECT run_id, seq, job_key, job_url FROM ranked WHERE place <= 20""",
    "next_batch": f"""
WITH {_KEYED}, l AS (SELECT doc_id AS seq FROM labels),
saved AS (SELECT DISTINCT run_id, job_key FROM keyed JOIN l USING (seq)),
done AS (SELECT run_id, count(*) AS n FROM saved GROUP BY run_id),
firsts AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, job_key ORDER BY seq) AS n
  FROM keyed WHERE seq NOT IN (SELECT seq FROM l)),
fresh AS (SELECT run_id, seq, job_key FROM firsts f WHERE n = 1
          AND NOT EXISTS (SELECT 1 FROM saved s WHERE s.run_id = f.run_id AND s.job_key = f.job_key)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS place FROM fresh)
SELECT run_id, seq, job_key FROM ranked LEFT JOIN done USING (run_id) WHERE place + coalesce(n, 0) <= 200""",
    "upsert": _UPSERT,
    "bucket_upsert": _UPSERT,
    "clear_postings": f"WITH {_POSTINGS} SELECT count(*) AS n_before, CAST(0 AS BIGINT) AS n_after FROM postings",
    "stored_postings": f"""
WITH {_POSTINGS}
SELECT title, company, location, CASE WHEN location = 'en' THEN 'new' ELSE salary END AS salary, tech_tags, requirements,
       source, job_url FROM postings""",
    "count_postings": "SELECT count(*) AS n_postings FROM documents",
    "state_defaults": f"""
SELECT c_custkey AS run_id, nullif(c_mktsegment, 'BUILDING') AS status, c_nationkey AS collected, {_OTHER_DEFAULTS},
       CAST(0 AS BIGINT) AS last_updated
FROM customer""",
    "reset_run_state": f"""
SELECT c_custkey AS run_id, 'idle' AS status, CAST(0 AS INTEGER) AS collected, {_OTHER_DEFAULTS},
       CAST(1700000000000 AS BIGINT) AS last_updated
FROM customer""",
    "merge_run_state": """
WITH cur AS (SELECT c_custkey AS run_id, nullif(c_mktsegment, 'BUILDING') AS status, c_nationkey AS collected FROM customer),
p AS (SELECT o_custkey AS run_id, count(*) AS collected, max(CASE WHEN o_orderstatus = 'F' THEN 'done' END) AS status
      FROM orders GROUP BY o_custkey)
SELECT coalesce(p.run_id, cur.run_id) AS run_id, CASE WHEN p.run_id IS NULL THEN cur.status ELSE p.status END AS status,
       CAST(50 AS INTEGER) AS target, CAST(coalesce(p.collected, cur.collected) AS INTEGER) AS collected,
       CAST(CASE WHEN p.run_id IS NULL THEN 0 ELSE 1700000000000 END AS BIGINT) AS last_updated
FROM cur FULL JOIN p ON cur.run_id = p.run_id""",
    "latest_run_state": """
SELECT user_id AS run_id, arg_max(event_type, event_id) AS status, max(event_id) AS last_updated FROM events GROUP BY user_id""",
    "run_progress": """
WITH r AS (SELECT source AS run_id, max(CASE WHEN lang = 'es' THEN 'done' ELSE 'analysing' END) AS status FROM documents GROUP BY source),
c AS (SELECT source AS run_id, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source),
j AS (SELECT run_id, status, coalesce(n, 0) AS n FROM r LEFT JOIN c USING (run_id))
SELECT run_id, n AS collected, CAST(40 AS BIGINT) AS target, CAST(least(100, round(100.0 * n / 40)) AS BIGINT) AS pct,
       n || '/40' AS progress, status = 'done' OR n >= 40 AS is_done, true AS has_progress
FROM j""",
    "resume": f"WITH {_START} SELECT run_id, resumed, status FROM starts",
    "resume_pending": f"""
WITH {_START}
SELECT run_id, url FROM o WHERE s = 'O' AND run_id IN (SELECT run_id FROM starts WHERE resumed)
AND url NOT IN (SELECT url FROM o WHERE s = 'F')""",
    "csv_lines": f"WITH {_POSTINGS} SELECT job_url, {_LINE} AS line FROM postings",
    "csv_export": f"""
WITH {_POSTINGS} SELECT {_LINE} AS line FROM postings
UNION ALL SELECT 'title,company,location,salary,tech_tags,requirements,source,job_url'""",
    "stream_capture": f"""
WITH {_JOB_LINKS} SELECT page_id, platform, pos, url, CAST(NULL AS BIGINT) AS n_text FROM job_links
UNION ALL SELECT page_id, platform, NULL, NULL, length(text) FROM ({_DETAIL_TEXT})""",
    "stream_dedup": f"WITH {_LINKS} SELECT DISTINCT host, href AS url FROM links",
    "stream_stop_rule": f"WITH {_EVENT_RUNS} SELECT user_id, page_no, n_links, n_new, ordinal, consec FROM kept",
    "stream_late_pages": f"WITH {_EVENT_RUNS} SELECT user_id, ordinal AS page_no, n_links, n_new, ordinal, consec FROM kept",
    "stream_upsert": _CUT,
    "toggle_platform": """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN '1,2' WHEN 1 THEN '0,2' WHEN 2 THEN '0,1' ELSE '0,1,2,3' END AS chosen FROM pages""",
    "run_state_files": f"""
SELECT c_custkey AS run_id, c_mktsegment AS status, CASE WHEN c_custkey % 2 = 0 THEN 50 ELSE nullif(c_nationkey, 3) END AS target
FROM customer""",
    "captured_replies": f"""
WITH {_REPLIES}, keyed AS (SELECT lang AS run_id, doc_id AS seq, 't||' || source AS job_key, job_url, status FROM replies),
firsts AS (SELECT *, row_number() OVER (PARTITION BY run_id, job_key ORDER BY seq) AS n FROM keyed WHERE status = 'ok'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS place FROM firsts WHERE n = 1)
SELECT run_id, seq, job_url, 'saved' AS outcome FROM ranked WHERE place <= 20
UNION ALL SELECT run_id, seq, job_url, status FROM keyed WHERE status <> 'ok'""",
    "whole_run": f"""
WITH f AS ({_CRAWL}),
ok AS (SELECT run_id, seq, url, substr(url, 2) AS title FROM f WHERE length(url) % 5 <> 4 AND length(url) % 3 > 0),
firsts AS (SELECT *, row_number() OVER (PARTITION BY run_id, {_key("title", "'c'")} ORDER BY seq) AS n FROM ok),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS place FROM firsts WHERE n = 1)
SELECT run_id, seq, title, url AS job_url FROM ranked WHERE place <= 30""",
    "two_writers": f"""
WITH {_KEYED},
early AS (SELECT * FROM keyed WHERE seq % 3 = 0), firsts AS (
  SELECT run_id, seq, job_key, row_number() OVER (PARTITION BY run_id, job_key ORDER BY seq) AS n FROM early),
a AS (SELECT run_id, seq, job_key FROM firsts WHERE n = 1),
b AS (SELECT run_id, seq, job_key FROM (SELECT run_id, seq, job_key, row_number() OVER (PARTITION BY run_id, job_key ORDER BY seq) AS n
      FROM keyed k WHERE seq % 3 = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.run_id = k.run_id AND a.job_key = k.job_key)) WHERE n = 1),
c AS (SELECT run_id, seq, job_key FROM (SELECT run_id, seq, job_key, row_number() OVER (PARTITION BY run_id, job_key ORDER BY seq) AS n
      FROM keyed k WHERE seq % 3 = 2 AND NOT EXISTS (SELECT 1 FROM (FROM a UNION ALL FROM b) s WHERE s.run_id = k.run_id AND s.job_key = k.job_key)) WHERE n = 1)
FROM a UNION ALL FROM b UNION ALL FROM c""",
}
