"""DuckDB statements for the queries, written against the given tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


# ---------------------------------------------------------------- chunking

TOKENS = r"""
toks AS (
  SELECT doc_id, lang, source,
         list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS t
  FROM documents)"""

WINDOWS = """
windows AS (
  SELECT doc_id, lang, source, s // 100 AS seq, least(100, len(t) - s) AS n_tokens,
         array_to_string(t[s + 1 : s + 100], ' ') AS text
  FROM (SELECT *, unnest(range(0, len(t), 100)) AS s FROM toks))"""

LINES5 = r"""
doc_lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos,
         len(string_split(text, chr(10))) AS n
  FROM documents),
win5 AS (
  SELECT doc_id, source, ((pos - 1) // 5) * 5 + 1 AS start_line,
         least(((pos - 1) // 5) * 5 + 5, any_value(n)) AS end_line,
         string_agg(line, chr(10) ORDER BY pos) AS text
  FROM doc_lines GROUP BY doc_id, source, (pos - 1) // 5
  HAVING bool_or(regexp_matches(line, '\S')))"""

ORACLES["line_windows"] = _with(LINES5) + """
SELECT doc_id, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line,
       'fallback_chunk' AS type, text FROM win5"""

ORACLES["token_windows"] = _with(TOKENS, WINDOWS) + """
SELECT doc_id, CAST(seq AS BIGINT) AS seq, CAST(n_tokens AS BIGINT) AS n_tokens, text FROM windows"""

ORACLES["token_windows_overlap"] = _with(TOKENS) + """
SELECT doc_id, CAST(s // 80 AS BIGINT) AS seq, CAST(least(100, len(t) - s) AS BIGINT) AS n_tokens,
       array_to_string(t[s + 1 : s + 100], ' ') AS text
FROM (SELECT *, unnest(range(0, greatest(len(t) - 1 - 20, 0) + 1, 80)) AS s FROM toks WHERE len(t) > 0)"""

ORACLES["token_counts"] = _with(TOKENS) + "SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens FROM toks"

ORACLES["paragraph_pack"] = r"""
WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
counted AS (
  SELECT *, list_filter(string_split_regex(line, '\s+'), lambda x: x <> '') AS t FROM lines),
pieces AS (
  SELECT doc_id, pos, 0 AS part, line AS text, len(t) AS n FROM counted WHERE len(t) <= 200
  UNION ALL
  SELECT doc_id, pos, s // 200, array_to_string(t[s + 1 : s + 200], ' '), least(200, len(t) - s)
  FROM (SELECT *, unnest(range(0, len(t), 200)) AS s FROM counted WHERE len(t) > 200)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) AS i FROM pieces),
packed AS (
  SELECT doc_id, i, n, text, CAST(0 AS BIGINT) AS seq, CAST(n AS BIGINT) AS run FROM numbered WHERE i = 1
  UNION ALL
  SELECT x.doc_id, x.i, x.n, x.text,
         CASE WHEN p.run + x.n <= 200 THEN p.seq ELSE p.seq + 1 END,
         CASE WHEN p.run + x.n <= 200 THEN p.run + x.n ELSE x.n END
  FROM packed p JOIN numbered x ON x.doc_id = p.doc_id AND x.i = p.i + 1)
SELECT doc_id, seq, CAST(sum(n) AS BIGINT) AS n_tokens, string_agg(text, chr(10) ORDER BY i) AS text
FROM packed GROUP BY doc_id, seq
HAVING regexp_matches(string_agg(text, chr(10) ORDER BY i), '\S')"""

# Line i of the derived Python file: 0 class, 1 method, 2 body, 3 blank, 4 statement.
PY_LINES = """
py_lines AS (
  SELECT doc_id AS file_id, lang, source || '/doc_' || doc_id || '.py' AS path, i, n,
         CASE i % 5 WHEN 0 THEN 'class C' || i || ':' WHEN 1 THEN '    def f' || i || '(self):'
              WHEN 2 THEN '        x = ''' || line || '''' WHEN 3 THEN ''
              ELSE 'print(''' || line || ''')' END AS line
  FROM (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i,
               len(string_split(text, chr(10))) AS n FROM documents)),
py_ends AS (
  SELECT h.file_id, h.path, h.lang, h.i AS first,
         least(CASE h.i % 5 WHEN 0 THEN h.i + 2 ELSE h.i + 1 END, h.n - 1) AS last,
         CASE h.i % 5 WHEN 0 THEN 'class_definition' ELSE 'function_definition' END AS type
  FROM py_lines h WHERE h.i % 5 IN (0, 1)),
py_blocks AS (
  SELECT b.file_id, any_value(b.path) AS path, any_value(b.lang) AS lang, b.first + 1 AS start_line,
         any_value(b.last) + 1 AS end_line, any_value(b.type) AS type,
         ltrim(string_agg(l.line, chr(10) ORDER BY l.i), ' ') AS text
  FROM py_ends b JOIN py_lines l ON l.file_id = b.file_id AND l.i BETWEEN b.first AND b.last
  GROUP BY b.file_id, b.first)"""

ORACLES["code_blocks"] = _with(PY_LINES) + """
SELECT file_id, path, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line,
       type, text FROM py_blocks"""

ORACLES["code_blocks_js"] = """
WITH js AS (
  SELECT doc_id AS file_id, source || '/doc_' || doc_id || '.js' AS path, i, n,
         CASE i % 4 WHEN 0 THEN 'class C' || i || ' {' WHEN 1 THEN '  m' || i || '(a) { // {'
              WHEN 2 THEN '    return "{ ' || replace(line, '"', '') || '";' ELSE '} }' END AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i,
               len(string_split(text, chr(10))) AS n FROM documents)),
heads AS (
  SELECT file_id, path, i AS first, least((i // 4) * 4 + 3, n - 1) AS last,
         CASE i % 4 WHEN 0 THEN 'class_declaration' ELSE 'method_definition' END AS type
  FROM js WHERE i % 4 IN (0, 1))
SELECT h.file_id, any_value(h.path) AS path, CAST(h.first + 1 AS BIGINT) AS start_line,
       CAST(any_value(h.last) + 1 AS BIGINT) AS end_line, any_value(h.type) AS type,
       ltrim(string_agg(j.line, chr(10) ORDER BY j.i), ' ') AS text
FROM heads h JOIN js j ON j.file_id = h.file_id AND j.i BETWEEN h.first AND h.last
GROUP BY h.file_id, h.first"""

_EXPORT_NAME = "regexp_replace(stem, '[^\\p{{L}}\\p{{N}}]', '_', 'g') || '_20240506_070809.json'"

ORACLES["chunk_export"] = _with(LINES5) + """
SELECT source || '/doc-' || doc_id || '.txt' AS source_file,
       'doc_' || doc_id || '_20240506_070809.json' AS chunks_file,
       count(*) AS num_chunks, md5(string_agg(text, chr(10) ORDER BY start_line)) AS chunks_md5
FROM win5 GROUP BY source, doc_id"""

ORACLES["chunk_summary"] = _with(LINES5) + """
SELECT source || '/doc-' || doc_id || '.txt' AS source_file,
       'doc_' || doc_id || '_20240506_070809.json' AS chunks_file, count(*) AS num_chunks
FROM win5 GROUP BY source, doc_id
UNION ALL SELECT NULL, NULL, count(*) FROM win5"""

ORACLES["chunk_counts"] = _with(LINES5) + """
SELECT source, count(*) AS num_chunks FROM win5 GROUP BY ROLLUP (source)"""

CHUNKS = """
chunks AS (
  SELECT md5(text) AS chunk_id, doc_id, seq, lang, n_tokens, text FROM windows
  QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id, seq) = 1)"""

ORACLES["chunk_insert_incremental"] = _with(TOKENS, WINDOWS, CHUNKS) + """
SELECT chunk_id, doc_id, CAST(seq AS BIGINT) AS seq, CAST(n_tokens AS BIGINT) AS n_tokens FROM chunks
WHERE chunk_id NOT IN (SELECT md5(text) FROM windows WHERE doc_id IN (SELECT doc_id FROM labels))"""

ORACLES["stream_ingest"] = _with(TOKENS, WINDOWS, CHUNKS) + """
SELECT chunk_id, doc_id, CAST(seq AS BIGINT) AS seq, CAST(n_tokens AS BIGINT) AS n_tokens FROM chunks"""

# ---------------------------------------------------------------- sources and routing

DOC_ITEMS = """
doc_items AS (
  SELECT source || '/doc_' || doc_id || CASE lang WHEN 'de' THEN '.pdf' WHEN 'fr' THEN '.PDF'
         WHEN 'es' THEN '.git' ELSE '.txt' END AS item FROM documents)"""

ITEMS = DOC_ITEMS + """,
hosts AS (
  SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages),
git_items AS (
  SELECT unnest([
    'https://github.com/' || split_part(host, '.', 1) || '/r' || page_id,
    'http://github.com/u/' || split_part(host, '.', 1) || page_id || '.git/',
    'https://github.com/u/' || host,
    'https://gitlab.com/u/r' || page_id,
    'git@github.com:u/r' || page_id || '.git',
    'https://github.com/u/r/blob/main/x' || page_id]) AS item FROM hosts),
items AS (
  SELECT item, CASE WHEN item LIKE 'http://%' OR item LIKE 'https://%' THEN 'url' ELSE 'file' END AS kind
  FROM (SELECT url AS item FROM pages UNION ALL SELECT item FROM git_items
        UNION ALL SELECT item FROM doc_items)),
routed AS (
  SELECT item, kind,
         CASE WHEN kind = 'file' AND lower(item) LIKE '%.pdf' THEN 'pdf'
              WHEN item LIKE '%.git' OR contains(item, 'github.com') OR contains(item, 'gitlab.com') THEN 'git'
              WHEN kind = 'url' THEN 'url' END AS source_type,
         regexp_matches(item, '^https?://github\\.com/[\\w-]+/[\\w-]+(\\.git)?/?$')
           OR regexp_matches(item, '^git@github\\.com:[\\w-]+/[\\w-]+(\\.git)?/?$') AS valid
  FROM items)"""

ORACLES["src_invalid_paths"] = _with(DOC_ITEMS) + """
SELECT item, 'Invalid input path: ' || item AS error FROM doc_items"""

ORACLES["route_sources"] = _with(ITEMS) + "SELECT item, kind, source_type FROM routed"
ORACLES["git_url_valid"] = _with(ITEMS) + "SELECT item, valid FROM routed"

ORACLES["page_lookup"] = """
WITH wanted AS (SELECT DISTINCT split_part(url, '#', 1) AS url FROM pages)
SELECT w.url, p.page_id, p.page_id IS NOT NULL AS found, CAST(length(p.html) AS BIGINT) AS html_chars
FROM wanted w LEFT JOIN pages p ON p.url = w.url"""

ORACLES["url_parts"] = r"""
SELECT page_id, split_part(url, '://', 1) AS scheme, host, path,
       CASE WHEN contains(url, '?') THEN split_part(split_part(url, '?', 2), '#', 1) ELSE '' END AS query,
       split_part(url, '://', 1) || '://' || host
         || CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END || 'sitemap.xml' AS sitemap_url,
       rtrim(url, '/') AS base_url
FROM (SELECT page_id, url, split_part(split_part(split_part(rest, '/', 1), '?', 1), '#', 1) AS host,
             split_part(split_part(substr(rest, length(split_part(split_part(split_part(rest, '/', 1), '?', 1), '#', 1)) + 1), '?', 1), '#', 1) AS path
      FROM (SELECT page_id, url, substr(url, strpos(url, '://') + 3) AS rest FROM pages))"""

# The file name of a URL read as a path, without its last suffix.
_SAFE = r"""
SELECT page_id, regexp_replace(
  CASE WHEN regexp_matches(base, '[^.]\.[^.]+$')
       THEN regexp_replace(base, '\.[^.]+$', '') ELSE base END,
  '[^\p{L}\p{N}]', '_', 'g') AS safe
FROM (SELECT page_id, list_last(string_split(rtrim(url, '/'), '/')) AS base FROM pages)"""

ORACLES["safe_name"] = f"SELECT page_id, safe AS safe_name FROM ({_SAFE})"
ORACLES["export_name"] = f"SELECT page_id, safe || '_20240506_070809.json' AS chunks_file FROM ({_SAFE})"

TREE = """
tree AS (
  SELECT page_id, host AS repo, html,
         CASE WHEN host LIKE 'm.%' THEN 'node_modules/' WHEN host LIKE 'blog.%' THEN '.github/'
              WHEN host LIKE 'www.%' THEN 'src/' ELSE '' END AS folder,
         CASE WHEN host LIKE '%.net' THEN '.PNG' WHEN host LIKE '%.org' THEN '.py' ELSE '.html' END AS ending
  FROM (SELECT page_id, html, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)),
kept AS (
  SELECT *, folder || 'page_' || page_id || ending AS path,
         folder NOT IN ('node_modules/', '.github/') AND ending <> '.PNG' AS path_allowed FROM tree)"""

ORACLES["repo_files"] = _with(TREE) + """
SELECT repo, path, CAST(octet_length(encode(html)) AS BIGINT) AS n_bytes FROM kept WHERE path_allowed"""
ORACLES["processable_files"] = _with(TREE) + """
SELECT repo, path, path_allowed, true AS is_text, ending = '.py' AS is_code,
       CASE WHEN ending = '.py' THEN 'python' END AS language FROM kept"""
ORACLES["repo_file_counts"] = _with(TREE) + """
SELECT repo, count(*) AS file_count FROM kept WHERE path_allowed GROUP BY repo"""

_SITE = "'https://site.example/"

ORACLES["sitemap_flat"] = f"""
WITH p AS (SELECT page_id, url, page_id // 25 AS b FROM pages),
n AS (SELECT DISTINCT b FROM p), x AS (SELECT DISTINCT b // 10 AS i FROM n),
urls AS (
  SELECT {_SITE}b' || b || '/' AS base_url, row_number() OVER (PARTITION BY b ORDER BY page_id) - 1 AS pos, url FROM p
  UNION ALL
  SELECT {_SITE}i' || (b // 10) || '/', row_number() OVER (PARTITION BY b // 10 ORDER BY b) - 1,
         {_SITE}b' || b || '/sitemap.xml' FROM n
  UNION ALL
  SELECT {_SITE}i' || i || '/', (SELECT count(*) FROM n WHERE n.b // 10 = x.i), {_SITE}i' || i || '/sitemap.xml' FROM x
  UNION ALL
  SELECT {_SITE}b' || b || '/none/', 0, {_SITE}b' || b || '/none' FROM n
  UNION ALL
  SELECT {_SITE}i' || i || '/none/', 0, {_SITE}i' || i || '/none' FROM x)
SELECT base_url, CAST(pos AS BIGINT) AS pos, url, CAST(NULL AS VARCHAR) AS error FROM urls"""

SITEMAP = f"""
listed AS (
  SELECT {_SITE}i' || (page_id // 250) || '/sitemap.xml' AS sitemap_url,
         ((page_id // 25) - min(page_id // 25) OVER (PARTITION BY page_id // 250)) || '.'
           || (row_number() OVER (PARTITION BY page_id // 25 ORDER BY page_id) - 1) AS pos,
         url, {_SITE}b' || (page_id // 25) || '/sitemap.xml' AS via, html
  FROM pages)"""

ORACLES["sitemap_recursive"] = _with(SITEMAP) + "SELECT sitemap_url, pos, url, via FROM listed"
ORACLES["sitemap_counts"] = _with(SITEMAP) + """
SELECT sitemap_url, count(*) AS n_urls, count(DISTINCT via) AS n_sitemaps FROM listed GROUP BY sitemap_url"""
ORACLES["sitemap_route"] = f"""
SELECT {_SITE}b' || b || '/sitemap.xml' AS item, true AS expand FROM (SELECT DISTINCT page_id // 25 AS b FROM pages)
UNION ALL SELECT {_SITE}i' || i || '/sitemap.xml', true FROM (SELECT DISTINCT page_id // 250 AS i FROM pages)
UNION ALL SELECT url, url LIKE '%sitemap.xml' FROM pages"""

# ---------------------------------------------------------------- conversion


def _chain(column: str, steps: list[tuple[str, str]]) -> str:
    for pattern, replacement in steps:
        p, r = pattern.replace("'", "''"), replacement.replace("'", "''")
        column = f"regexp_replace({column}, '{p}', E'{r}', 'g')"
    return column


_DROP = [
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<script(\s[^>]*)?>.*?</script\s*>", ""),
    (r"(?is)<style(\s[^>]*)?>.*?</style\s*>", ""),
]
_HEAD = [(r"(?is)<head(\s[^>]*)?>.*?</head\s*>", "")]
_HEADINGS = [
    (rf"(?is)<h{n}(\s[^>]*)?>(.*?)</h{n}\s*>", r"\n" + "#" * n + r" \\2\n") for n in range(1, 7)
]
_HREF = r"""(?is)<a\s(?:[^>]*\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_INLINE = [
    (_HREF + r"[^>]*>(.*?)</a\s*>", r"[\\4](\\1\\2\\3)"),
    (r"(?i)</?(b|strong)(\s[^>]*)?>", "**"),
]
_BLOCKS = [
    (r"(?i)<li(\s[^>]*)?>", r"\n- "),
    (r"(?i)<br(\s[^>]*)?/?>", r"\n"),
    (r"(?i)</?(p|div|ul|ol|article|section|nav|table|tr|footer|header)(\s[^>]*)?>", r"\n"),
]
_GAPS = [(r"(?i)</?(br|p|div|li|ul|ol|article|section|nav|table|tr|td|th|footer|header)(\s[^>]*)?/?>", " ")]
# Names the given pages use, and the commonest besides; "&amp;" comes last.
_PLAIN = [
    (r"<[^>]*>", ""),
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&copy;", "\u00a9"),
    ("&reg;", "\u00ae"),
    ("&middot;", "\u00b7"),
    ("&eacute;", "\u00e9"),
    ("&euro;", "\u20ac"),
    ("&amp;", "&"),
]
_SPACE = [(r"[ \t\r]+", " "), (r" ?\n ?", r"\n"), (r"\n{3,}", r"\n\n"), (r"^\s+|\s+$", "")]
_TRIM = [(r"^\s+|\s+$", "")]

_MARKDOWN = _chain("html", _DROP + _HEAD + _HEADINGS + _INLINE + _BLOCKS + _PLAIN + _SPACE)
ORACLES["html_markdown"] = f"SELECT page_id, {_MARKDOWN} AS markdown FROM pages"
ORACLES["html_nested"] = """
SELECT page_id, '1. ' || w[1] || chr(10) || '  - ' || w[2] || chr(10) || '  - ' || w[3] || chr(10) || chr(10)
  || '2. **' || w[2] || '**' || chr(10) || chr(10)
  || '| page | a & b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || page_id || ' | [' || w[1] || '](' || url || ') |' || chr(10) || chr(10)
  || '```' || chr(10) || '  ' || w[2] || chr(10) || '    {' || w[3] || '}' || chr(10) || '```' || chr(10) || chr(10) || w[1] AS markdown
FROM (SELECT page_id, url, regexp_extract_all(url, '[A-Za-z]+') AS w FROM pages)"""
ORACLES["html_text"] = (
    f"SELECT page_id, {_chain('html', _DROP + _HEAD + _BLOCKS + _PLAIN + _SPACE)} AS text FROM pages"
)
ORACLES["sitemap_convert"] = _with(SITEMAP) + f"""
SELECT sitemap_url, pos, url, md5({_MARKDOWN}) AS document_md5 FROM listed"""

SECTIONS = f"""
md_lines AS (
  SELECT page_id, url, unnest(string_split(m, chr(10))) AS line, generate_subscripts(string_split(m, chr(10)), 1) AS pos
  FROM (SELECT page_id, url, {_MARKDOWN} AS m FROM pages)),
marks AS (
  SELECT page_id, pos, length(regexp_extract(line, '^(#{{1,6}}) ', 1)) AS level,
         trim(regexp_replace(line, '^#{{1,6}} ', '')) AS title
  FROM md_lines WHERE regexp_matches(line, '^#{{1,6}} ')),
-- A heading is open at another one if none of its level or above stands between.
paths AS (
  SELECT page_id, own AS section, string_agg(title, ' > ' ORDER BY pos) AS headings
  FROM (SELECT s.page_id, s.pos AS own, h.pos, any_value(h.title) AS title
        FROM marks s JOIN marks h ON h.page_id = s.page_id AND h.pos <= s.pos
        LEFT JOIN marks g ON g.page_id = s.page_id AND g.pos > h.pos AND g.pos <= s.pos AND g.level <= h.level
        GROUP BY s.page_id, s.pos, h.pos HAVING count(g.pos) = 0)
  GROUP BY page_id, own),
body AS (
  SELECT * FROM (
    SELECT l.page_id, l.url, l.pos, l.line, m.pos IS NOT NULL AS heading,
           coalesce(max(m.pos) OVER (PARTITION BY l.page_id ORDER BY l.pos), 0) AS section
    FROM md_lines l LEFT JOIN marks m ON m.page_id = l.page_id AND m.pos = l.pos) WHERE NOT heading),
sec_counted AS (
  SELECT *, list_filter(string_split_regex(line, '\\s+'), lambda x: x <> '') AS t FROM body),
sec_pieces AS (
  SELECT page_id, url, section, pos, 0 AS part, line AS text, len(t) AS n FROM sec_counted WHERE len(t) <= 30
  UNION ALL
  SELECT page_id, url, section, pos, s // 30, array_to_string(t[s + 1 : s + 30], ' '), least(30, len(t) - s)
  FROM (SELECT *, unnest(range(0, len(t), 30)) AS s FROM sec_counted WHERE len(t) > 30)),
sec_numbered AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, section ORDER BY pos, part) AS i FROM sec_pieces),
sec_packed AS (
  SELECT page_id, url, section, i, n, text, CAST(0 AS BIGINT) AS k, CAST(n AS BIGINT) AS run FROM sec_numbered WHERE i = 1
  UNION ALL
  SELECT x.page_id, x.url, x.section, x.i, x.n, x.text,
         CASE WHEN p.run + x.n <= 30 THEN p.k ELSE p.k + 1 END,
         CASE WHEN p.run + x.n <= 30 THEN p.run + x.n ELSE x.n END
  FROM sec_packed p JOIN sec_numbered x ON x.page_id = p.page_id AND x.section = p.section AND x.i = p.i + 1),
sec_chunks AS (
  SELECT page_id, url, coalesce(headings, '') AS headings, n_tokens, text,
         row_number() OVER (PARTITION BY page_id ORDER BY c.section, k) - 1 AS seq
  FROM (SELECT page_id, url, section, k, CAST(sum(n) AS BIGINT) AS n_tokens, string_agg(text, chr(10) ORDER BY i) AS text
        FROM sec_packed GROUP BY page_id, url, section, k HAVING regexp_matches(string_agg(text, chr(10) ORDER BY i), '\\S')) c
  LEFT JOIN paths USING (page_id, section))"""
ORACLES["structured_chunks"] = _with(SECTIONS) + """
SELECT page_id, seq, headings, n_tokens, text FROM sec_chunks"""

_BODY = _chain("html", _DROP)
ORACLES["html_struct"] = rf"""
WITH b AS (SELECT page_id, {_BODY} AS h FROM pages),
parts AS (
  SELECT page_id, {_chain(r"regexp_extract(h, '(?is)<title(\s[^>]*)?>(.*?)</title\s*>', 2)", _GAPS + _PLAIN + _TRIM)} AS title,
         list_transform(regexp_extract_all(h, '(?is)<h[1-6](\s[^>]*)?>(.*?)</h[1-6]\s*>', 2),
                        lambda x: {_chain("x", _GAPS + _PLAIN + _TRIM)}) AS headings,
         list_filter(list_transform(regexp_extract_all(h, '(?is)<p(\s[^>]*)?>(.*?)</p\s*>', 2),
                        lambda x: {_chain("x", _GAPS + _PLAIN + _TRIM)}), lambda x: x <> '') AS paragraphs,
         list_transform(regexp_extract_all(h, '{_HREF.replace("'", "''")}', 0),
                        lambda x: regexp_replace(x, '{_HREF.replace("'", "''")}', E'\\1\\2\\3')) AS links
  FROM b)
SELECT page_id, title, array_to_string(headings, ' | ') AS headings, array_to_string(links, ' | ') AS links,
       CAST(len(paragraphs) AS BIGINT) AS n_paragraphs,
       md5(array_to_string(paragraphs, chr(10))) AS paragraphs_md5
FROM parts"""
ORACLES["html_json"] = ORACLES["html_struct"]

# ---------------------------------------------------------------- graph

GAZETTEER = r"""
gazetteer AS (
  SELECT DISTINCT w AS term
  FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM benchmark)
  WHERE length(w) >= 6)"""


def _mentions(name: str, source: str, kind: str) -> str:
    return rf"""
{name}_w AS (
  SELECT chunk_id, doc_id, {kind} AS kind, unnest(ws) AS name,
         generate_subscripts(ws, 1) - 1 AS pos, ws
  FROM (SELECT chunk_id, doc_id, {kind}, regexp_extract_all(lower(text), '\p{{L}}+') AS ws FROM {source})),
{name} AS (
  SELECT chunk_id, doc_id, pos, name, kind AS entity_type,
         ws[pos + 2] AS link
  FROM {name}_w WHERE name IN (SELECT term FROM gazetteer))"""


def _nodes(name: str, found: str) -> str:
    return f"""
{name}_s AS (
  SELECT chunk_id, doc_id, name, entity_type, count(*) AS n FROM {found} GROUP BY ALL),
{name}_t AS (
  SELECT name, entity_type, sum(n) AS n, count(*) AS c, min(doc_id) AS d FROM {name}_s GROUP BY ALL),
{name} AS (
  SELECT name AS id, first(entity_type ORDER BY n DESC, entity_type) AS entity_type,
         name || ': ' || CAST(sum(n) AS BIGINT) || ' mentions in ' || CAST(sum(c) AS BIGINT) || ' chunks' AS description,
         CAST(min(d) AS VARCHAR) AS source_id, CAST(sum(n) AS BIGINT) AS n_mentions,
         CAST(sum(c) AS BIGINT) AS n_sources
  FROM {name}_t GROUP BY name)"""


MENTIONS = GAZETTEER + "," + _mentions("mentions", "chunks", "lang")
NODES = _nodes("nodes", "mentions")
PAIRS = """
pairs AS (
  SELECT a.chunk_id, a.doc_id, least(a.name, b.name) AS source, greatest(a.name, b.name) AS target,
         count(*) AS weight, list_sort(list_distinct(list(a.link) FILTER (b.pos > a.pos + 1))) AS links
  FROM mentions a JOIN mentions b
    ON a.chunk_id = b.chunk_id AND b.pos > a.pos AND b.pos <= a.pos + 5 AND a.name <> b.name
  GROUP BY ALL)"""
EDGES = """
words_between AS (
  SELECT source, target, keyword, count(*) AS n_chunks
  FROM (SELECT source, target, unnest(links) AS keyword FROM pairs) GROUP BY ALL),
shown_words AS (
  SELECT source, target, string_agg(keyword, ',' ORDER BY n_chunks DESC, keyword) AS keywords
  FROM (SELECT * FROM words_between
        QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY n_chunks DESC, keyword) <= 5)
  GROUP BY source, target),
edges AS (
  SELECT source, target, weight, description, keywords, source_id, n_sources
  FROM (SELECT source, target, CAST(sum(weight) AS DOUBLE) AS weight,
               source || ' with ' || target || ' in ' || count(*) || ' chunks' AS description,
               CAST(min(doc_id) AS VARCHAR) AS source_id, count(*) AS n_sources
        FROM pairs GROUP BY source, target) LEFT JOIN shown_words USING (source, target))"""
GRAPH = (TOKENS, WINDOWS, CHUNKS, MENTIONS, NODES, PAIRS, EDGES)
TALK_NODES = (
    """
talks AS (
  SELECT conv_id || '-' || turn AS chunk_id, conv_id AS doc_id, role, text FROM conversations)""",
    _mentions("talk_mentions", "talks", "role"),
    _nodes("talk_nodes", "talk_mentions"),
)

ORACLES["entity_mentions"] = _with(TOKENS, WINDOWS, CHUNKS, MENTIONS) + """
SELECT chunk_id, CAST(pos AS BIGINT) AS pos, name, entity_type, link FROM mentions"""
ORACLES["entity_patterns"] = _with(TOKENS, WINDOWS, CHUNKS) + """
SELECT chunk_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) AS name, 'email' AS entity_type FROM chunks
UNION ALL
SELECT chunk_id, unnest(regexp_extract_all(text, '[0-9][0-9.-]+[0-9]')), 'number' FROM chunks"""
ORACLES["entity_phrases"] = _with(TOKENS, WINDOWS, CHUNKS, r"""
asked_words AS (
  SELECT item_id, w, i, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3
  FROM (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
        FROM (SELECT item_id, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM benchmark))
  WINDOW o AS (PARTITION BY item_id ORDER BY i)),
names AS (
  SELECT w || ' ' || w2 AS term, 2 AS n FROM asked_words WHERE length(w) >= 6 AND length(w2) >= 6
  UNION SELECT w || ' ' || w2 || ' ' || w3, 3 FROM asked_words WHERE length(w) >= 6 AND length(w2) >= 6 AND length(w3) >= 6),
chunk_words AS (
  SELECT chunk_id, lang, w, pos, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
  FROM (SELECT chunk_id, lang, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos
        FROM (SELECT chunk_id, lang, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM chunks))
  WINDOW o AS (PARTITION BY chunk_id ORDER BY pos)),
hits AS (
  SELECT chunk_id, lang, pos, n, term, link FROM (
    SELECT c.chunk_id, c.lang, c.pos, t.n, t.term, CASE t.n WHEN 2 THEN w3 ELSE w4 END AS link
    FROM chunk_words c JOIN names t ON t.term = c.w || ' ' || c.w2 AND t.n = 2
    UNION ALL
    SELECT c.chunk_id, c.lang, c.pos, t.n, t.term, w4
    FROM chunk_words c JOIN names t ON t.term = c.w || ' ' || c.w2 || ' ' || c.w3 AND t.n = 3)
  QUALIFY row_number() OVER (PARTITION BY chunk_id, pos ORDER BY n DESC) = 1),
-- From the left: the first hit at or after the end of the one before.
chosen AS (
  SELECT chunk_id, arg_min(pos, pos) AS pos, arg_min(n, pos) AS n FROM hits GROUP BY chunk_id
  UNION ALL
  SELECT c.chunk_id, h.pos, h.n FROM chosen c, LATERAL (
    SELECT pos, n FROM hits x WHERE x.chunk_id = c.chunk_id AND x.pos >= c.pos + c.n ORDER BY pos LIMIT 1) h)""") + """
SELECT h.chunk_id, h.pos, h.term AS name, h.lang AS entity_type, h.link
FROM hits h JOIN chosen c ON c.chunk_id = h.chunk_id AND c.pos = h.pos"""
ORACLES["entity_sources"] = _with(TOKENS, WINDOWS, CHUNKS, MENTIONS) + """
SELECT chunk_id, name, count(*) AS n FROM mentions GROUP BY ALL"""
ORACLES["entity_merge"] = _with(TOKENS, WINDOWS, CHUNKS, MENTIONS, NODES) + "SELECT * FROM nodes"
ORACLES["relation_pairs"] = _with(TOKENS, WINDOWS, CHUNKS, MENTIONS, PAIRS) + """
SELECT chunk_id, source, target, weight, coalesce(array_to_string(links, ','), '') AS links FROM pairs"""
ORACLES["relation_pairs_chunk"] = _with(TOKENS, WINDOWS, CHUNKS, MENTIONS, PAIRS.replace("AND b.pos <= a.pos + 5 ", "")) + """
SELECT chunk_id, source, target, weight, md5(coalesce(array_to_string(links, ','), '')) AS links_md5 FROM pairs"""
ORACLES["relation_keywords"] = _with(*GRAPH) + "SELECT * FROM words_between"
ORACLES["relation_merge"] = _with(*GRAPH) + "SELECT * FROM edges"

ORACLES["node_upsert"] = _with(*GRAPH, *TALK_NODES) + """
SELECT id, entity_type, description, source_id, id AS display_name
FROM nodes WHERE id NOT IN (SELECT id FROM talk_nodes)
UNION ALL SELECT id, entity_type, description, source_id, id FROM talk_nodes"""
ORACLES["label_counts"] = _with(TOKENS, WINDOWS, CHUNKS, MENTIONS, NODES) + """
SELECT entity_type AS label, count(*) AS n_nodes FROM nodes GROUP BY 1"""
ORACLES["relation_type"] = _with(*GRAPH) + """
SELECT e.source, e.target, e.keywords,
       CASE WHEN t.lead THEN 'lead' WHEN t.participate THEN 'participate' WHEN t.uses THEN 'uses'
            WHEN t.located THEN 'located' WHEN t.occurs THEN 'occurs'
            ELSE replace(split_part(e.keywords, ',', 1), '"', '') END AS rel_type
FROM edges e LEFT JOIN (
  SELECT source, target, bool_or(contains(keyword, 'lead')) AS lead, bool_or(contains(keyword, 'participate')) AS participate,
         bool_or(contains(keyword, 'uses')) AS uses, bool_or(contains(keyword, 'located')) AS located,
         bool_or(contains(keyword, 'occurs')) AS occurs
  FROM words_between GROUP BY source, target) t ON e.source = t.source AND e.target = t.target"""
ORACLES["edge_endpoints"] = _with(*GRAPH, *TALK_NODES) + """
SELECT source, target, weight, keywords, source_id FROM edges
WHERE source IN (SELECT id FROM talk_nodes) AND target IN (SELECT id FROM talk_nodes)"""
ORACLES["edge_dropped"] = _with(*GRAPH, *TALK_NODES) + """
SELECT source, target, source NOT IN (SELECT id FROM talk_nodes) AS source_missing,
       target NOT IN (SELECT id FROM talk_nodes) AS target_missing
FROM edges WHERE NOT (source IN (SELECT id FROM talk_nodes) AND target IN (SELECT id FROM talk_nodes))"""
ORACLES["graph_two_hop"] = _with(*GRAPH, """
seeds AS (
  SELECT id AS seed FROM nodes
  QUALIFY row_number() OVER (PARTITION BY entity_type ORDER BY n_mentions DESC, id) = 1)""", """
adj AS (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges)""", """
one AS (SELECT DISTINCT seed, b AS id FROM seeds JOIN adj ON a = seed)""", """
two AS (SELECT DISTINCT seed, b AS id FROM one JOIN adj ON a = id)""") + """
SELECT seed, id, CAST(min(hop) AS BIGINT) AS hop
FROM (SELECT seed, seed AS id, 0 AS hop FROM seeds UNION ALL SELECT seed, id, 1 FROM one
      UNION ALL SELECT seed, id, 2 FROM two) GROUP BY seed, id"""
ORACLES["graph_subgraph"] = _with(*GRAPH, """
chosen AS (SELECT id FROM nodes WHERE n_sources > (SELECT avg(n_sources) FROM nodes))""") + """
SELECT source, target, weight FROM edges
WHERE source IN (SELECT id FROM chosen) AND target IN (SELECT id FROM chosen)"""
ORACLES["graph_filter_nodes"] = _with(TOKENS, WINDOWS, CHUNKS, MENTIONS, NODES) + """
SELECT id FROM nodes WHERE entity_type IN ('fr', 'de')"""
ORACLES["graph_filter_edges"] = _with(*GRAPH) + """
SELECT source AS id FROM edges WHERE weight IN (1, 2) UNION SELECT target FROM edges WHERE weight IN (1, 2)"""
ORACLES["triples_limit"] = _with(*GRAPH) + """
SELECT source, s.entity_type AS source_type, target, t.entity_type AS target_type, weight, keywords
FROM edges JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target ORDER BY source, target LIMIT 300"""
ORACLES["graph_counts"] = _with(*GRAPH) + """
SELECT 'nodes' AS kind, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges"""
ORACLES["graph_batches"] = _with(*GRAPH, """
keys AS (
  SELECT 'nodes' AS kind, id AS key, 500 AS size FROM nodes
  UNION ALL SELECT 'edges', source || '|' || target, 100 FROM edges)""", """
placed AS (
  SELECT kind, key, (row_number() OVER (PARTITION BY kind ORDER BY substr(md5(key), 1, 3), key) - 1) // size AS batch
  FROM keys)""") + """
SELECT kind, CAST(batch AS BIGINT) AS batch, count(*) AS n_rows, min(key) AS min_key, max(key) AS max_key
FROM placed GROUP BY kind, batch"""
ORACLES["graph_incremental"] = ORACLES["graphml_read"] = _with(*GRAPH) + """
SELECT 'node' AS kind, id AS key, entity_type, description, CAST(NULL AS DOUBLE) AS weight,
       CAST(NULL AS VARCHAR) AS keywords, source_id FROM nodes
UNION ALL SELECT 'edge', source || '|' || target, NULL, description, weight, keywords, source_id FROM edges"""
ORACLES["graph_json_read"] = _with(*GRAPH) + """
SELECT 'node' AS kind, id AS key, description, CAST(NULL AS DOUBLE) AS weight FROM nodes
UNION ALL SELECT 'edge', source || '|' || target, description, weight FROM edges"""

# ---------------------------------------------------------------- retrieval

ORACLES["tfidf_weights"] = r"""
WITH postings AS (
  SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term)
SELECT doc_id, term, tf, df, round(tf * ln((SELECT count(*) FROM documents) / df), 6) AS weight
FROM postings JOIN df USING (term)"""


def _questions(k: int) -> str:
    return rf"""
qt AS (
  SELECT query_id, term, count(*) AS tf
  FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS term FROM benchmark)
  GROUP BY ALL),
total AS (SELECT count(*) AS n FROM chunks),
limits AS (SELECT {k} AS k)"""


NAIVE = r"""
postings AS (
  SELECT chunk_id, term, count(*) AS tf
  FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM chunks) GROUP BY ALL),
item_norm AS (SELECT chunk_id, sqrt(sum((1 + ln(tf)) * (1 + ln(tf)))) AS norm FROM postings GROUP BY chunk_id),
tdf AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
qw AS (
  SELECT query_id, term, w / nullif(sqrt(sum(w * w) OVER (PARTITION BY query_id)), 0) AS w
  FROM (SELECT query_id, term, (1 + ln(tf)) * ln((SELECT n FROM total) / df) AS w FROM qt JOIN tdf USING (term))),
naive AS (
  SELECT query_id, 'chunk' AS part, chunk_id AS item, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT query_id, chunk_id, round(sum((1 + ln(p.tf)) / norm * w), 6) AS score
        FROM postings p JOIN qw USING (term) JOIN item_norm USING (chunk_id) GROUP BY query_id, chunk_id)
  WHERE score > 0
  QUALIFY rank <= (SELECT k FROM limits))"""

LOCAL = """
ends AS (
  SELECT source AS term, source, target, ln(1 + weight) AS strength FROM edges
  UNION ALL SELECT target, source, target, ln(1 + weight) FROM edges),
l_ent AS (
  SELECT query_id, term AS item, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term) AS rank
  FROM (SELECT query_id, term, round((1 + ln(tf)) * ln((SELECT n FROM total) / n_sources), 6) AS score
        FROM qt JOIN nodes ON id = term) WHERE score > 0
  QUALIFY rank <= (SELECT k FROM limits)),
l_rel AS (
  SELECT query_id, source || ' | ' || target AS item, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source || ' | ' || target) AS rank
  FROM (SELECT query_id, source, target, round(sum(score) * max(strength), 6) AS score
        FROM ends JOIN l_ent ON item = term GROUP BY ALL) WHERE score > 0
  QUALIFY rank <= (SELECT k FROM limits)),
l_chunk AS (
  SELECT query_id, chunk_id AS item, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT query_id, chunk_id, round(sum(score), 6) AS score
        FROM (SELECT DISTINCT chunk_id, name FROM mentions) JOIN l_ent ON item = name GROUP BY ALL)
  QUALIFY rank <= (SELECT k FROM limits)),
local_ AS (
  SELECT query_id, 'entity' AS part, item, score, rank FROM l_ent
  UNION ALL SELECT query_id, 'relation', item, score, rank FROM l_rel
  UNION ALL SELECT query_id, 'chunk', item, score, rank FROM l_chunk)"""

GLOBAL = """
g_rel AS (
  SELECT query_id, source, target, source || ' | ' || target AS item, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source || ' | ' || target) AS rank
  FROM (SELECT query_id, source, target, round(sum(w) * max(strength), 6) AS score
        FROM ends JOIN (SELECT query_id, term, (1 + ln(tf)) * ln((SELECT n FROM total) / n_sources) AS w
                        FROM qt JOIN nodes ON id = term) USING (term)
        GROUP BY ALL) WHERE score > 0
  QUALIFY rank <= (SELECT k FROM limits)),
g_ent AS (
  SELECT query_id, item, max(score) AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY max(score) DESC, item) AS rank
  FROM (SELECT query_id, source AS item, score FROM g_rel UNION ALL SELECT query_id, target, score FROM g_rel)
  GROUP BY query_id, item
  QUALIFY rank <= (SELECT k FROM limits)),
g_chunk AS (
  SELECT query_id, chunk_id AS item, score,
         row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT query_id, chunk_id, round(sum(score), 6) AS score
        FROM pairs JOIN g_rel USING (source, target) GROUP BY ALL)
  QUALIFY rank <= (SELECT k FROM limits)),
global_ AS (
  SELECT query_id, 'entity' AS part, item, score, rank FROM g_ent
  UNION ALL SELECT query_id, 'relation', item, score, rank FROM g_rel
  UNION ALL SELECT query_id, 'chunk', item, score, rank FROM g_chunk)"""

HYBRID = """
hybrid AS (
  SELECT query_id, part, item, score,
         row_number() OVER (PARTITION BY query_id, part ORDER BY score DESC, item) AS rank
  FROM (SELECT query_id, part, item, max(score) AS score
        FROM (SELECT * FROM local_ UNION ALL SELECT * FROM global_) GROUP BY ALL)
  QUALIFY rank <= (SELECT k FROM limits))"""

MIX = """
together AS (
  SELECT coalesce(h.query_id, v.query_id) AS query_id, coalesce(h.item, v.item) AS item,
         h.score AS graph_score, v.score AS text_score,
         CASE WHEN h.item IS NULL THEN 'vector' WHEN v.item IS NULL THEN 'graph' ELSE 'both' END AS part,
         round(coalesce(h.score, 0) + coalesce(v.score, 0), 6) AS score
  FROM (SELECT * FROM hybrid WHERE part = 'chunk') h
  FULL JOIN naive v ON h.query_id = v.query_id AND h.item = v.item),
mixed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM together
  QUALIFY rank <= (SELECT k FROM limits))"""

_Q10, _Q5 = _questions(10), _questions(5)
ORACLES["search_naive_index"] = ORACLES["search_naive"] = _with(TOKENS, WINDOWS, CHUNKS, _Q10, NAIVE) + "SELECT * FROM naive"
ORACLES["search_local"] = _with(*GRAPH, _Q10, LOCAL) + "SELECT * FROM local_"
ORACLES["search_global"] = _with(*GRAPH, _Q10, LOCAL, GLOBAL) + "SELECT * FROM global_"
ORACLES["search_hybrid"] = _with(*GRAPH, _Q10, LOCAL, GLOBAL, HYBRID) + "SELECT * FROM hybrid"
ORACLES["search_mix"] = _with(*GRAPH, _Q10, NAIVE, LOCAL, GLOBAL, HYBRID, MIX) + "SELECT query_id, item, graph_score, text_score, part FROM mixed"
ORACLES["search_all_modes"] = _with(*GRAPH, _Q5, NAIVE, LOCAL, GLOBAL, HYBRID, MIX) + """
SELECT *, 'naive' AS mode FROM naive UNION ALL SELECT *, 'local' FROM local_
UNION ALL SELECT *, 'global' FROM global_ UNION ALL SELECT *, 'hybrid' FROM hybrid
UNION ALL
SELECT query_id, 'chunk', item, score, rank, 'mix' FROM mixed"""
ORACLES["search_modes"] = """
SELECT item_id AS query_id, unnest(['naive', 'local', 'global', 'hybrid', 'mix']) AS mode FROM benchmark"""
ORACLES["search_no_hits"] = _with(*GRAPH, r"""
asked AS (
  SELECT conv_id || '-' || turn AS query_id, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM conversations)""") + """
SELECT query_id, 'No results found' AS message FROM asked
WHERE query_id NOT IN (
  SELECT query_id FROM (SELECT query_id, unnest(ws) AS w FROM asked) JOIN nodes ON id = w
  WHERE n_sources < (SELECT count(*) FROM chunks))"""

ORACLES["vector_topk"] = """
WITH means AS (
  SELECT label, list(x ORDER BY i) AS v
  FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x
        FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
        GROUP BY label, i) GROUP BY label),
scored AS (
  SELECT CAST(m.label AS BIGINT) AS query_id, vec_id AS item_id,
         round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 6) AS score
  FROM embeddings CROSS JOIN means m)
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
FROM scored QUALIFY rank <= 5"""

ORACLES["vector_index_topk"] = """
WITH scored AS (
  SELECT q.vec_id AS query_id, v.vec_id AS item_id,
         round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0)
SELECT query_id, item_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank
FROM scored QUALIFY rank <= 5"""

# ---------------------------------------------------------------- contexts

HITS = """
top5 AS (SELECT * FROM hybrid WHERE rank <= 5),
ent AS (
  SELECT t.query_id, t.rank, n.id, n.entity_type, n.description
  FROM top5 t JOIN nodes n ON t.part = 'entity' AND n.id = t.item),
rel AS (
  SELECT t.query_id, t.rank, e.* FROM top5 t JOIN edges e
    ON t.part = 'relation' AND t.item = e.source || ' | ' || e.target),
src AS (
  SELECT t.query_id, t.rank, c.text FROM top5 t JOIN chunks c ON t.part = 'chunk' AND c.chunk_id = t.item)"""
_CONTEXT = (*GRAPH, _Q5, LOCAL, GLOBAL, HYBRID, HITS)
_Q = lambda c: f"""'"' || replace(coalesce({c}, ''), '"', '""') || '"'"""

ORACLES["context_assemble"] = _with(*_CONTEXT, f"""
lines AS (
  SELECT query_id, rank, 1 AS s, (rank - 1) || ',' || {_Q('id')} || ',' || {_Q('entity_type')} || ',' || {_Q('description')} AS line FROM ent
  UNION ALL
  SELECT query_id, rank, 2, (rank - 1) || ',' || {_Q('source')} || ',' || {_Q('target')} || ',' || {_Q('description')}
         || ',' || {_Q('keywords')} || ',' || weight || ',' || {_Q('source_id')} FROM rel
  UNION ALL
  SELECT query_id, rank, 3, (rank - 1) || ',' || {_Q('text')} FROM src)""") + """
SELECT query_id,
  '-----Entities-----' || chr(10) || '```csv' || chr(10) || 'id,entity,type,description'
  || coalesce(string_agg(chr(10) || line, '' ORDER BY rank) FILTER (s = 1), '') || chr(10) || '```' || chr(10)
  || '-----Relationships-----' || chr(10) || '```csv' || chr(10) || 'id,source,target,description,keywords,weight,source_id'
  || coalesce(string_agg(chr(10) || line, '' ORDER BY rank) FILTER (s = 2), '') || chr(10) || '```' || chr(10)
  || '-----Sources-----' || chr(10) || '```csv' || chr(10) || 'id,content'
  || coalesce(string_agg(chr(10) || line, '' ORDER BY rank) FILTER (s = 3), '') || chr(10) || '```' AS context
FROM lines GROUP BY query_id"""
ORACLES["context_entities"] = _with(*_CONTEXT) + f"""
SELECT query_id, rank AS row_no, CAST(1 AS BIGINT) AS col_no, 'id' AS column, CAST(rank - 1 AS VARCHAR) AS value FROM ent
UNION ALL SELECT query_id, rank, 2, 'entity', {_Q('id')} FROM ent
UNION ALL SELECT query_id, rank, 3, 'type', {_Q('entity_type')} FROM ent
UNION ALL SELECT query_id, rank, 4, 'description', {_Q('description')} FROM ent"""
ORACLES["context_relationships"] = _with(*_CONTEXT) + """
SELECT query_id, rank AS row_no, CAST(rank - 1 AS VARCHAR) AS id, source, target, description, keywords, weight, source_id FROM rel"""
ORACLES["context_sources"] = _with(*_CONTEXT) + f"""
SELECT query_id, rank AS row_no, CAST(rank - 1 AS VARCHAR) AS id, {_Q('text')} AS content FROM src"""
ORACLES["context_number"] = """
SELECT conv_id || '-' || turn AS query_id, CAST(generate_subscripts(l, 1) AS BIGINT) AS number, unnest(l) AS context
FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations)"""

# ---------------------------------------------------------------- summaries

RESULTS = """
results AS (
  SELECT item, CASE WHEN source_type = 'pdf' THEN 'Error processing PDF ' || item || ': no converter given'
       WHEN source_type = 'git' AND valid THEN 'Error processing Git repository: no working tree for ' || item
       WHEN source_type = 'git' THEN 'Invalid Git repository URL: ' || item
       WHEN source_type IS NULL THEN 'No processor found for ' || item END AS error
  FROM routed)"""
ORACLES["process_summary"] = _with(ITEMS, RESULTS) + """
SELECT count(*) AS total_files, count(*) FILTER (error IS NULL) AS successful_files,
       count(error) AS failed_files, count(error) AS n_errors, count(error) = 0 AS ok FROM results"""
ORACLES["process_run"] = _with(ITEMS, RESULTS, SECTIONS) + """
SELECT md5(text) AS chunk_id, url AS source, seq, headings, n_tokens
FROM sec_chunks WHERE url IN (SELECT item FROM results WHERE error IS NULL)
QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY url, seq) = 1"""
ORACLES["process_run_summary"] = _with(ITEMS, RESULTS, SECTIONS, """
run_files AS (
  SELECT item, (SELECT count(*) FROM sec_chunks c WHERE c.url = r.item) AS n FROM results r WHERE error IS NULL)""") + """
SELECT count(*) AS total_files, count(*) FILTER (error IS NULL) AS successful_files,
       count(error) AS failed_files, count(error) AS n_errors, count(error) = 0 AS ok,
       (SELECT count(*) FILTER (n > 0) FROM run_files) AS successful_stores,
       (SELECT count(*) FILTER (n = 0) FROM run_files) + count(error) AS failed_stores,
       (SELECT CAST(sum(n) AS BIGINT) FROM run_files) AS total_chunks,
       (SELECT CAST(sum(n) AS BIGINT) FROM run_files) AS saved_chunks, 'first' AS run FROM results"""
ORACLES["process_errors"] = _with(ITEMS, RESULTS) + "SELECT item, error FROM results WHERE error IS NOT NULL"
ORACLES["store_summary"] = _with(ITEMS, RESULTS, LINES5, """
files AS (
  SELECT d.doc_id, (SELECT count(*) FROM win5 w WHERE w.doc_id = d.doc_id) AS n, coalesce(l.toxic, 0) = 0 AS fine
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""") + """
SELECT count(*) FILTER (n > 0 AND fine) AS successful_stores,
       count(*) FILTER (NOT (n > 0 AND fine)) + (SELECT count(error) FROM results) AS failed_stores,
       CAST(coalesce(sum(n) FILTER (fine), 0) AS BIGINT) AS total_chunks, CAST(sum(n) AS BIGINT) AS saved_chunks
FROM files"""

# ---------------------------------------------------------------- chat log

ORACLES["chat_transcript"] = "SELECT conv_id, turn, role, text AS content FROM conversations"
ORACLES["chat_pairs"] = """
SELECT conv_id, turn AS prompt_turn, next_turn AS reply_turn, text AS prompt, next_text AS reply
FROM (SELECT *, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND next_role = 'assistant'"""
ORACLES["chat_append"] = """
WITH c AS (SELECT conv_id, max(turn) AS last, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id)
SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT conv_id, last + 1, 'user', text FROM c
UNION ALL SELECT conv_id, last + 2, 'assistant', md5(text) FROM c
UNION ALL SELECT conv_id + 1 + (SELECT max(conv_id) FROM c), 0, 'user', text FROM c
UNION ALL SELECT conv_id + 1 + (SELECT max(conv_id) FROM c), 1, 'assistant', md5(text) FROM c"""

# ---------------------------------------------------------------- file dispatch

ORACLES["chunk_dispatch"] = r"""
WITH RECURSIVE """ + PY_LINES.replace("FROM documents", "FROM documents WHERE lang = 'en'") + r""",
fr AS (
  SELECT doc_id AS file_id, source || '/doc_' || doc_id || CASE lang WHEN 'fr' THEN '.lua' ELSE '.js' END AS path,
         unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos,
         len(string_split(text, chr(10))) AS n
  FROM documents WHERE lang IN ('fr', 'de')),
windows AS (
  SELECT file_id, path, ((pos - 1) // 5) * 5 + 1 AS start_line, least(((pos - 1) // 5) * 5 + 5, any_value(n)) AS end_line,
         string_agg(line, chr(10) ORDER BY pos) AS text
  FROM fr GROUP BY file_id, path, (pos - 1) // 5 HAVING bool_or(regexp_matches(line, '\S'))),
counted AS (
  SELECT doc_id, source, pos, line, list_filter(string_split_regex(line, '\s+'), lambda x: x <> '') AS t
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE lang NOT IN ('en', 'fr', 'de'))),
pieces AS (
  SELECT doc_id, source, pos, 0 AS part, line AS text, len(t) AS n FROM counted WHERE len(t) <= 200
  UNION ALL
  SELECT doc_id, source, pos, s // 200, array_to_string(t[s + 1 : s + 200], ' '), least(200, len(t) - s)
  FROM (SELECT *, unnest(range(0, len(t), 200)) AS s FROM counted WHERE len(t) > 200)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, part) AS i FROM pieces),
packed AS (
  SELECT doc_id, source, i, n, text, CAST(0 AS BIGINT) AS seq, CAST(n AS BIGINT) AS run FROM numbered WHERE i = 1
  UNION ALL
  SELECT x.doc_id, x.source, x.i, x.n, x.text,
         CASE WHEN p.run + x.n <= 200 THEN p.seq ELSE p.seq + 1 END,
         CASE WHEN p.run + x.n <= 200 THEN p.run + x.n ELSE x.n END
  FROM packed p JOIN numbered x ON x.doc_id = p.doc_id AND x.i = p.i + 1)
SELECT file_id, path, type, CAST(start_line AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line,
       CAST(NULL AS BIGINT) AS seq, md5(text) AS text_md5 FROM py_blocks
UNION ALL
SELECT file_id, path, 'fallback_chunk', start_line, end_line, NULL, md5(text) FROM windows
UNION ALL
SELECT doc_id, source || '/doc_' || doc_id || '.md', 'document_chunk', NULL, NULL, seq,
       md5(string_agg(text, chr(10) ORDER BY i))
FROM packed GROUP BY doc_id, source, seq HAVING regexp_matches(string_agg(text, chr(10) ORDER BY i), '\S')"""
