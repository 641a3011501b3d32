"""The registered queries restated in DuckDB SQL, for comparison only."""

from ..functions.text import STOPWORDS
from .queries import HOUR, INDEXED, MANY, SEARCH, SEEN_GLOB, TURNS_TTL, WILDCARD_SEARCH

_SPACE = r"\x09-\x0d\x1c-\x1f\x{85}\p{Z}"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def _clean(x: str) -> str:
    no_punct = rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}_{_SPACE}]', '', 'g')"
    no_digits = rf"regexp_replace({no_punct}, '\p{{Nd}}+', '', 'g')"
    words = f"string_split_regex(lower({no_digits}), '[{_SPACE}]+')"
    kept = f"list_filter({words}, lambda w: w <> '' AND w NOT IN ({_STOP}))"
    return f"nullif(array_to_string({kept}, ' '), '')"


def _decode(x: str) -> str:
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = rf"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    return x


def _array_text(x: str) -> str:
    quoted = (
        f"list_transform({x}, lambda v: CASE WHEN contains(v, ' ') OR lower(v) = 'null' "
        "THEN '\"' || v || '\"' ELSE v END)"
    )
    return f"'{{' || array_to_string({quoted}, ',') || '}}'"


def _key(url: str) -> str:
    bare = f"split_part({url}, '#', 1)"
    path = f"split_part({bare}, '?', 1)"
    query = f"substr({bare}, length({path}) + 2)"
    ordered = f"array_to_string(list_sort(string_split({query}, '&')), '&')"
    origin = f"regexp_extract({path}, '^[a-zA-Z]+://[^/]*')"
    rest = f"substr({path}, length({origin}) + 1)"
    plain = f"lower({origin}) || CASE WHEN {origin} <> '' AND {rest} = '' THEN '/' ELSE {rest} END"
    return f"CASE WHEN {query} = '' THEN {plain} ELSE {plain} || '?' || {ordered} END"


_SHOWN = (
    r"regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script[\s/>].*?(?:</script[^>]*>|\z)"
    r"|<style[\s/>].*?(?:</style[^>]*>|\z)', '<!---->', 'g')"
)
_HEADING = _clean(_decode(r"regexp_replace(x, '<[^>]*>', ' ', 'g')"))

# Fields of every page; pages hold neither meta names, dates nor lower headings.
_PARSED = rf"""
shown AS (SELECT page_id, url, {_SHOWN} AS h FROM pages),
parsed AS (
  SELECT page_id, url, h,
    {_decode(r"nullif(regexp_extract(h, '(?is)<title[^>]*>([^<]*)</title', 1), '')")} AS title,
    NULL::VARCHAR AS author, NULL::VARCHAR AS description, NULL::VARCHAR AS published_date,
    list_filter(
      list_transform(regexp_extract_all(h, '(?is)<h1[^>]*>(.*?)(?:</h1|\z)', 1), lambda x: {_HEADING}),
      lambda x: x IS NOT NULL) AS headings
  FROM shown)"""

_DOCS = rf"""{_PARSED},
docs AS (
  SELECT page_id AS id, author, {_array_text('headings')} AS content, description, published_date, title, url
  FROM parsed WHERE title IS NOT NULL AND len(headings) > 0)"""

_DOCUMENT_FIELDS = rf"""
wrapped AS (
  SELECT doc_id, 'https://docs.example/' || lang || '/' || md5(text) AS url, nullif(text, '') AS title,
    text AS description, source AS author, n_chars::VARCHAR AS published_date,
    list_filter([{_clean("lang || ' ' || source")}, {_clean('text')}], lambda x: x IS NOT NULL) AS headings
  FROM documents)"""

_DOCUMENT_JUDGED = rf"""{_DOCUMENT_FIELDS},
judged AS (
  SELECT *, CASE WHEN title IS NULL THEN 'invalid'
    WHEN length(rtrim(substr(title, 256), ' ')) > 0 THEN 'too_long:title' END AS fault
  FROM wrapped),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY url, fault IS NULL ORDER BY doc_id) AS nth FROM judged)"""

_ATTEMPTS = rf"""{_DOCS}, {_DOCUMENT_JUDGED},
attempts AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) AS id FROM ranked WHERE fault IS NULL OR fault LIKE 'too_long%'),
kept AS (
  SELECT id, author, {_array_text('headings')} AS content, description, published_date, left(title, 255) AS title, url
  FROM attempts WHERE fault IS NULL AND nth = 1)"""

_STORED = f"""{_ATTEMPTS},
stored AS (
  SELECT * FROM kept UNION ALL
  SELECT (SELECT count(*) FROM attempts) + row_number() OVER (ORDER BY id), author, content, description,
    published_date, title, url FROM docs)"""

_NAV = r"""
nav AS (
  SELECT page_id, url,
    regexp_extract_all(regexp_extract(h, '(?is)<nav[^>]*>(.*?)</nav', 1), '(?is)<a\s[^>]*?href="([^"]*)"', 1) AS hrefs
  FROM shown),
links AS (
  SELECT page_id, url, unnest(range(len(hrefs)))::INTEGER AS pos, unnest(hrefs) AS href FROM nav)"""

_EDGES = rf"""
shown AS (SELECT page_id, url, {_SHOWN} AS h FROM pages), {_NAV},
edges AS (
  SELECT url AS src_url, pos, href,
    regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || regexp_replace(href, '#.*$', '') AS dst_url
  FROM links)"""


def _seen(key: str, ttl: int) -> str:
    return f"""
WITH RECURSIVE e AS (
  SELECT {key} AS key, epoch_us(ts) AS t, min(event_id) AS id FROM events GROUP BY ALL),
chain AS (
  SELECT key, min(t) AS t FROM e GROUP BY key
  UNION ALL
  SELECT e.key, min(e.t) AS t FROM chain c JOIN e ON e.key = c.key AND e.t >= c.t + {ttl} GROUP BY e.key)
SELECT e.key, e.t, e.id FROM chain JOIN e USING (key, t)"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _ilike(pattern: str) -> str:
    return f"(title ILIKE {pattern} OR description ILIKE {pattern} OR content ILIKE {pattern})"


def _search(query: str) -> str:
    return f"SELECT * FROM docs WHERE {_ilike(_literal(f'%{query}%'))} ORDER BY id LIMIT 20"


_ASKED = ", ".join(f"({_literal(q)})" for q in MANY if q)
_FOUND = f"WITH {_DOCS} {_search(SEARCH)}"
_STATUS = "CASE WHEN html LIKE '%</html>' THEN 200 ELSE 206 END"
_HOST = "regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)"

ORACLES = {
    "search_top20": _FOUND,
    "search_bound": _FOUND,
    "search_wildcard": f"WITH {_DOCS} {_search(WILDCARD_SEARCH)}",
    "search_empty_query": f"WITH {_DOCS} SELECT * FROM docs WHERE false",
    "search_queries": f"""
WITH {_DOCS}, asked(q) AS (VALUES {_ASKED})
SELECT q, docs.* FROM docs JOIN asked ON {_ilike("'%' || q || '%'")}
QUALIFY row_number() OVER (PARTITION BY q ORDER BY id) <= 20""",
    "search_display": f"""
SELECT row_number() OVER (ORDER BY id) - 1 AS position, url, title, description FROM ({_FOUND})""",
    "search_response": f"""
SELECT to_json({{'results': {{'sites': coalesce(list(s ORDER BY s.id), []), 'defaultQuery': '{SEARCH}'}}}})::VARCHAR AS json
FROM ({_FOUND}) s""",
    "parsed_docs": f"""
WITH {_PARSED}
SELECT page_id, url, title, description, author, published_date,
  CASE WHEN len(headings) > 0 THEN array_to_string(headings, '|') END AS content FROM parsed""",
    "parsed_documents": f"""
WITH {_DOCUMENT_FIELDS}
SELECT doc_id, url, title, description, author, published_date, array_to_string(headings, '|') AS content
FROM wrapped""",
    "content_text": f"WITH {_DOCUMENT_FIELDS} SELECT doc_id, {_array_text('headings')} AS content_text FROM wrapped",
    "valid_docs": f"WITH {_DOCS} SELECT id, title, content, url FROM docs",
    "rejected_docs": f"""
WITH {_PARSED}
SELECT page_id, url,
  CASE WHEN title IS NULL OR len(headings) = 0 THEN 'invalid'
    WHEN length(rtrim(substr(title, 256), ' ')) > 0 THEN 'too_long:title'
    ELSE 'too_long:url' END AS reject_reason
FROM parsed
WHERE title IS NULL OR len(headings) = 0 OR length(rtrim(substr(title, 256), ' ')) > 0 OR length(url) > 255""",
    "document_quarantine": f"""
WITH {_DOCUMENT_JUDGED}
SELECT url, coalesce(fault, 'duplicate_url') AS reject_reason, doc_id
FROM ranked WHERE fault IS NOT NULL OR nth > 1""",
    "document_winners": f"""
WITH {_DOCUMENT_JUDGED}
SELECT doc_id, url, left(title, 255) AS title, {_array_text('headings')} AS content_text
FROM ranked WHERE fault IS NULL AND nth = 1""",
    "clean_documents": f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents",
    "clean_conversations": f"SELECT conv_id, turn, {_clean('text')} AS cleaned FROM conversations",
    "clean_benchmark": f"SELECT item_id, {_clean('text')} AS cleaned FROM benchmark",
    "page_nav_links": f"""
WITH shown AS (SELECT page_id, url, {_SHOWN} AS h FROM pages), {_NAV}
SELECT page_id, pos, href FROM links""",
    "page_link_edges": f"WITH {_EDGES} SELECT * FROM edges",
    "page_url_parts": f"""
SELECT page_id,
  lower(regexp_extract(url, '^([a-zA-Z]+):', 1)) AS scheme,
  {_HOST} AS netloc,
  regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path,
  '' AS params,
  regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS query,
  regexp_extract(url, '#(.*)$', 1) AS fragment,
  {_key('url')} AS url_key
FROM pages""",
    "undiscovered_links": f"""
WITH {_EDGES}, targets AS (
  SELECT {_key('dst_url')} AS url_key, min(dst_url) AS url, count(*) AS links FROM edges GROUP BY 1)
SELECT * FROM targets WHERE url_key NOT IN (SELECT {_key('url')} FROM pages)""",
    "frontier_urls": f"""
WITH {_EDGES}, urls AS (SELECT url FROM pages UNION ALL SELECT dst_url FROM edges)
SELECT {_key('url')} AS url_key, min(url) AS url FROM urls GROUP BY 1""",
    "frontier_reach": f"""
WITH RECURSIVE {_EDGES}, there AS (
  SELECT DISTINCT {_key('src_url')} AS a, {_key('dst_url')} AS b FROM edges),
links_both AS (SELECT a, b FROM there UNION SELECT b, a FROM there),
reach(k, d) USING KEY (k) AS (
  SELECT {_key('url')}, 0 FROM pages WHERE html NOT LIKE '%</html>'
  UNION
  SELECT l.b, min(d) + 1 FROM reach JOIN links_both l ON l.a = k
  WHERE l.b NOT IN (SELECT r.k FROM recurring.reach r) GROUP BY l.b)
SELECT k AS url_key, d::INTEGER AS depth FROM reach""",
    "fetched_pages": f"SELECT page_id, url, md5(html) AS content_md5 FROM pages WHERE {_STATUS} = 200",
    "refused_pages": f"SELECT page_id, url, ({_STATUS})::INTEGER AS status FROM pages WHERE {_STATUS} <> 200",
    "crawl_stats_by_host": f"""
SELECT {_HOST} AS host, count(*) AS responses, count(*) FILTER (WHERE {_STATUS} = 200) AS fetched,
  count(*) FILTER (WHERE {_STATUS} <> 200) AS refused FROM pages GROUP BY 1""",
    "crawl_stats_stream": f"""
SELECT count(*) AS responses, count(*) FILTER (WHERE {_STATUS} = 200) AS fetched,
  count(*) FILTER (WHERE {_STATUS} <> 200) AS refused FROM pages""",
    "unique_urls": """
SELECT 'https://talk.example/' || conv_id AS url, turn, role, text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1""",
    "unique_sources": """
SELECT source AS url, doc_id, lang, text FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1""",
    "feed_batches": """
SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS idx,
  (row_number() OVER (ORDER BY page_id) - 1) // 25 + 1 AS batch_id FROM pages""",
    "feed_objects": """
SELECT url, (row_number() OVER (ORDER BY page_id) - 1) // 25 + 1 AS batch_id, md5(html) AS content_md5 FROM pages""",
    "feed_roundtrip": "SELECT url, md5(html) AS content_md5 FROM pages",
    "feed_arrays": r"""
WITH e AS (
  SELECT *, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS t FROM documents)
SELECT 'https://docs.example/' || lang || '/' || md5(text) AS url, md5(
  '<html><head><title>' || t || '</title><meta name="description" content="' || t || '"><META content=''' || source ||
  ''' name=author></head><body><time datetime=' || n_chars || '></time><h3>' || t || '</h3><h1 id=''>''>' || lang || '<i>' ||
  source || '</i></h1><script>''<h2>none</h2>''</script></body></html>') AS content_md5 FROM e""",
    # Numbers go to whatever the store is asked to take; copies and over-long records leave gaps.
    "store_ingest": f"""
WITH {_ATTEMPTS}
SELECT id, author, content, description, published_date, title, url FROM kept
UNION ALL
SELECT 2 * (SELECT count(*) FROM attempts) + row_number() OVER (ORDER BY id), author, content, description,
  published_date, title, url FROM docs""",
    "search_indexed": f"""
WITH {_STORED}, asked(q) AS (VALUES {", ".join(f"({_literal(q)})" for q in INDEXED)})
SELECT q, stored.* FROM stored JOIN asked ON {_ilike("'%' || q || '%'")}
QUALIFY row_number() OVER (PARTITION BY q ORDER BY id) <= 20""",
    "search_thousands": rf"""
WITH {_DOCS}, texts AS (SELECT doc_id, replace(text, '\', '/') AS t, doc_id % 23 + 1 AS p FROM documents),
asked AS (
  SELECT DISTINCT CASE WHEN doc_id % 10 = 0 THEN substr(t, p, 5) || '%' || substr(t, p + 20, 3)
    WHEN doc_id % 10 = 1 THEN substr(t, p, 3) || '_' || substr(t, p + 4, 2)
    WHEN doc_id % 100 = 2 THEN substr(t, p, 2) ELSE substr(t, p, 7) END AS q FROM texts)
SELECT q, docs.* FROM docs JOIN asked ON q <> '' AND {_ilike("'%' || q || '%'")}
QUALIFY row_number() OVER (PARTITION BY q ORDER BY id) <= 20""",
    "stream_batches": f"""
WITH {_STORED} SELECT url, content, true AS several, true AS distinct_ids FROM stored""",
    "stream_ingest": f"WITH {_DOCS} SELECT author, content, description, published_date, title, url FROM docs",
    "assign_ids": "SELECT page_id, url, row_number() OVER (ORDER BY url, page_id) + 99 AS id FROM pages",
    "seen_users": _seen("user_id", 6 * HOUR),
    "seen_event_types": _seen("event_type", HOUR // 6),
    "seen_whole_span": _seen("event_type", 100_000 * HOUR),
    "dropped_users_stream": "SELECT user_id AS key, 1::BIGINT AS kept FROM events GROUP BY 1",
    "feed_faults": """
SELECT CASE doc_id % 10 WHEN 0 THEN 'corrupt_json' WHEN 1 THEN 'missing_url' WHEN 2 THEN 'missing_content'
  WHEN 3 THEN 'invalid' WHEN 4 THEN 'invalid' WHEN 5 THEN 'too_long:title' WHEN 6 THEN 'too_long:author'
  WHEN 7 THEN 'too_long:published_date' WHEN 8 THEN 'too_long:url' END AS reject_reason, count(*) AS records
FROM documents GROUP BY 1""",
    "feed_fields": """
SELECT 'https://feed.example/' || doc_id AS url, 'It''s a title' AS title, source AS author, lang AS published_date,
  '{heading}' AS content_text FROM documents WHERE doc_id % 10 = 9""",
    "document_links": """
WITH links(pos, href, target) AS (VALUES
  (0, 'https://o.example/p#f', 'https://o.example/p#f'), (1, '//cdn.example/y', 'https://cdn.example/y'),
  (2, 'foo/', '/foo/'), (3, 'mailto:x@y.z', '/x@y.z'), (4, '/a;v=1?q=2#f', '/a?q=2'), (5, '', '')),
sources AS (
  SELECT 'https://d' || doc_id || '.example' AS host, source, '/' || lang || '/x?n=' || n_chars AS rest
  FROM documents WHERE doc_id % 5 > 1)
SELECT host || rest AS src_url, pos, href || CASE WHEN pos = 2 THEN source ELSE '' END AS href,
  CASE WHEN pos > 1 THEN host ELSE '' END || target || CASE WHEN pos = 2 THEN source ELSE '' END AS dst_url
FROM sources, links""",
    "document_bodies": f"""
SELECT doc_id, {_clean("""CASE doc_id % 4 WHEN 0 THEN text || ' tail' WHEN 2 THEN 'head ' || text || ' inner rest'
  WHEN 3 THEN text END""")} AS body_text FROM documents""",
    "nested_headings": f"""
WITH t AS (SELECT doc_id, coalesce({_clean('text')}, '') AS c, doc_id % 3 AS kind FROM documents)
SELECT doc_id, array_to_string(list_filter(CASE kind
  WHEN 0 THEN ['first ' || c || ' last', c, 'third']
  WHEN 1 THEN ['top', trim(c || ' second third'), 'second']
  ELSE ['top small end', 'open', c] END, lambda x: x <> ''), '|').replace('first  last', 'first last') AS headings FROM t""",
    "nested_nav_links": """
SELECT doc_id, pos, href FROM documents JOIN (VALUES
  (0, 0, '/one'), (0, 1, '/two'), (0, 2, '/three'), (1, 0, '/late')) AS v(kind, pos, href) ON doc_id % 2 = kind""",
    "crawl_next": f"""
WITH shown AS (SELECT page_id, url, {_SHOWN} AS h FROM pages WHERE {_STATUS} = 200), {_NAV},
edges AS (
  SELECT regexp_extract(url, '^[a-z]+://[^/?#]*', 0) || regexp_replace(href, '#.*$', '') AS dst_url FROM links),
targets AS (SELECT {_key('dst_url')} AS url_key, min(dst_url) AS url, count(*) AS links FROM edges GROUP BY 1)
SELECT * FROM targets WHERE url_key NOT IN (SELECT {_key('url')} FROM pages WHERE {_STATUS} = 200)""",
    "search_stored": f"""
WITH {_DOCS}, stored AS (SELECT * REPLACE (row_number() OVER (ORDER BY id) AS id) FROM docs)
SELECT * FROM stored WHERE {_ilike(_literal(f'%{SEARCH}%'))} ORDER BY id LIMIT 20""",
    "clean_spoken": f"""
SELECT conv_id, turn, {_clean("CASE WHEN role <> 'system' THEN text END")} AS cleaned FROM conversations""",
    "seen_users_stream": _seen("user_id", 6 * HOUR),
    "seen_users_in_order": _seen("user_id", 6 * HOUR),
    "crawled_turns": f"""
WITH RECURSIVE fetched AS (SELECT * FROM conversations WHERE role <> 'system'),
chain AS (
  SELECT conv_id, min(turn) AS turn FROM fetched GROUP BY conv_id
  UNION ALL
  SELECT f.conv_id, min(f.turn) AS turn FROM chain c
  JOIN fetched f ON f.conv_id = c.conv_id AND f.turn >= c.turn + {TURNS_TTL} GROUP BY f.conv_id)
SELECT 'https://talk.example/' || conv_id AS url, turn, text AS content FROM chain JOIN fetched USING (conv_id, turn)""",
    "seen_pages_lookup": f"SELECT page_id, url FROM pages WHERE url GLOB '{SEEN_GLOB}'",
}


def _seed_oracle() -> str:
    from ..sources.seeds import START_URLS

    rows = ", ".join(f"({_literal(u)})" for u in START_URLS)
    return f"""
SELECT url FROM (VALUES {rows}) AS seeds(url)
WHERE {_key('url')} NOT IN (SELECT {_key('pages.url')} FROM pages)"""


ORACLES["undiscovered_seeds"] = _seed_oracle()
