"""DuckDB SQL for the registered queries, written from the tables and not from the engine."""

from __future__ import annotations

from derived_corpora import LEVELS, md_sql, nested_sql, py_sql

DOC_LINES = """l AS (
  SELECT doc_id, unnest(generate_series(0, len(s) - 1)) AS line_no, unnest(s) AS text FROM (
    SELECT doc_id, list_transform(string_split(CASE WHEN right(text, 1) = chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)),
      lambda x: regexp_replace(x, '\\r$', '')) AS s FROM documents WHERE length(text) > 0))"""
HIT_ROWS = f"{DOC_LINES}, r AS (SELECT doc_id, line_no FROM l WHERE regexp_matches(text, 'qu|der|sh '))"
# rows to show with a single hidden row between two hits filled in
FILLED = """f AS (
  SELECT doc_id, line_no FROM r UNION
  SELECT a.doc_id, a.line_no + 1 FROM r a JOIN r b ON a.doc_id = b.doc_id AND b.line_no = a.line_no + 2)"""
ISLANDS = """SELECT doc_id, min(line_no) AS start_line, max(line_no) + 1 AS end_line FROM (
  SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM {}) GROUP BY doc_id, g"""

PY = f"py AS ({py_sql('duckdb')})"
PY_LINES = f"""{PY}, pl AS (
  SELECT path, unnest(generate_series(0, len(s) - 1)) AS line_no, unnest(s) AS text FROM (
    SELECT path, string_split(rtrim(content, chr(10)), chr(10)) AS s FROM py))"""
MD = f"md AS ({md_sql('duckdb')})"
MD_LINES = f"""{MD}, ml AS (
  SELECT path, unnest(generate_series(0, len(s) - 1)) AS line_no, unnest(s) AS text, len(s) AS n FROM (
    SELECT path, string_split(left(content, length(content) - 1), chr(10)) AS s FROM md))"""
MD_HEADS = f"""{MD_LINES}, h AS (
  SELECT path, line_no, n, length(regexp_extract(text, '^(#+) ', 1)) AS level, regexp_extract(text, '^#+ (.*)$', 1) AS name
  FROM ml WHERE regexp_matches(text, '^#{{1,6}} '))"""

CUSTOMER_PATH = "concat('src/nation_', c_nationkey, '/customer_', c_custkey, '.py')"
BRAND_PATH = "concat('src/parts/', lower(replace(p_brand, '#', '_')), '.py')"
CALLED = "(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"
STYLES = """w AS (SELECT DISTINCT lower(concat_ws(' ', p_name, p_type)) AS w FROM part),
  s AS (SELECT w, unnest([replace(w, ' ', '_'), replace(w, ' ', '-'),
    list_aggregate(list_transform(string_split(w, ' '), lambda x: concat(upper(left(x, 1)), substr(x, 2))), 'string_agg', '')]) AS name FROM w)"""
# where each order, part, unit and customer of the Python corpus stands, and which orders call one part
PLACES = f"""{PY_LINES}, od AS (
    SELECT path, k, line_no - 2 AS a, line_no + 1 + greatest(1, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_orderkey = k)) AS b FROM (
      SELECT path, line_no, CAST(regexp_extract(text, 'def order_([0-9]+)', 1) AS BIGINT) AS k FROM pl WHERE starts_with(text, '    def order_'))),
  pr AS (SELECT p_partkey AS p, p_size, {BRAND_PATH} AS path, 3 * (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) AS a FROM part),
  ur AS (SELECT p_size, 3 * (row_number() OVER (ORDER BY p_size) - 1) AS a FROM (SELECT DISTINCT p_size FROM part)),
  cr AS (SELECT path, CAST(regexp_extract(path, 'customer_([0-9]+)', 1) AS BIGINT) AS c, max(line_no) + 1 AS b FROM pl WHERE starts_with(path, 'src/nation_') GROUP BY path),
  co AS (SELECT o_custkey AS c, min(l_partkey) AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey HAVING min(l_partkey) = max(l_partkey)),
  oo AS (SELECT l_orderkey AS k, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey HAVING min(l_partkey) = max(l_partkey))"""
ENTITY = "&(?:#(?:[xX][0-9a-fA-F]+|[0-9]+)|[A-Za-z][A-Za-z0-9]*);?"

ORACLES: dict[str, str] = {
    "lines_explode": f"WITH {DOC_LINES} SELECT doc_id, line_no, text FROM l",
    "candidate_files": f"WITH {DOC_LINES} SELECT DISTINCT doc_id FROM l WHERE regexp_matches(text, '[Ll]icense|[Cc]opyright')",
    "candidate_files_icase": f"WITH {DOC_LINES} SELECT DISTINCT doc_id FROM l WHERE regexp_matches(text, '^(licen[cs]e|the)[^a-z]', 'i')",
    "range_union_gap0": f"WITH {HIT_ROWS} {ISLANDS.format('r')}",
    "range_union_gap1": f"WITH {HIT_ROWS}, {FILLED} {ISLANDS.format('f')}",
    "range_end": f"WITH {HIT_ROWS}, e AS (SELECT doc_id, line_no, line_no + 1 + line_no % 3 AS end_line FROM r) "
    "SELECT doc_id, arg_max(end_line, line_no) AS last_range_end, max(end_line) AS max_end FROM e GROUP BY doc_id",
    "excerpt_lines": f"WITH {HIT_ROWS}, {FILLED}, i AS ({ISLANDS.format('f')}), n AS ("
    "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_line) AS range_no FROM i) "
    "SELECT l.doc_id, range_no, line_no + 1 AS line_no, text FROM l JOIN n ON l.doc_id = n.doc_id AND line_no >= start_line AND line_no < end_line",
    "case_style_terms": f"WITH {STYLES} SELECT a.name AS term, b.name FROM s a JOIN s b ON a.w = b.w",
    "case_style_rejects": "SELECT DISTINCT p_name AS term, CASE WHEN contains(p_name, ' ') THEN 'not_recaseable' ELSE 'ok' END AS status, "
    "CASE WHEN contains(p_name, ' ') THEN strlen(split_part(p_name, ' ', 1)) END AS bad_at FROM part",
    "only_names": f"""SELECT concat('order_', o_orderkey) AS name FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)
        UNION SELECT concat('Customer_', c_custkey) FROM customer
        UNION SELECT concat('part_', p_partkey) FROM part UNION SELECT concat('unit_', p_size) FROM part
        UNION SELECT unnest(['self', 'qty', 'n', 'segment', 'brand_mod'])""",
    "complete_prefix": "SELECT concat('Customer_', c_custkey) AS name FROM customer WHERE starts_with(CAST(c_custkey AS varchar), '1')",
    "language_by_extension": f"""SELECT language, count(*) AS n_files FROM (
          SELECT CASE WHEN regexp_matches(url, '^[^?#]*\\.html([?#]|$)') THEN 'HTML' ELSE 'unknown' END AS language FROM pages
          UNION ALL SELECT 'Python' FROM customer
          UNION ALL SELECT 'Python' FROM (SELECT DISTINCT p_brand FROM part)
          UNION ALL SELECT 'Python') GROUP BY language""",
    "language_candidates": """WITH b AS (SELECT p_partkey, p_size % 8 AS o, p_partkey % 8 AS n, ['C', 'C++', 'Objective-C'] AS c FROM part),
          s AS (SELECT p_partkey, list_filter(c, lambda x, i: (o // CAST(2 ** (i - 1) AS INT)) % 2 = 1) AS old,
            list_filter(c, lambda x, i: (n // CAST(2 ** (i - 1) AS INT)) % 2 = 1) AS new FROM b),
          t AS (SELECT p_partkey, old, new, list_filter(new, lambda x: list_contains(old, x)) AS common FROM s)
          SELECT p_partkey, array_to_string(CASE WHEN len(old) = 0 THEN new WHEN len(common) = 0 THEN old ELSE common END, ',') AS candidates FROM t""",
    "alias_lookup": """WITH t(k, hint, language) AS (VALUES (0, 'PY', 'Python'), (1, 'js', 'JavaScript'), (2, 'TS', 'TypeScript'),
            (3, 'CPlusPlus', 'C++'), (4, 'golang', 'Go'), (5, 'rust', 'Rust'), (6, 'md', 'Markdown'), (7, 'Bash', 'Shell'))
          SELECT p_partkey, CASE WHEN p_size > 40 THEN concat(hint, '?') ELSE hint END AS hint,
            CASE WHEN p_size <= 40 THEN language END AS language FROM part JOIN t ON k = p_size % 8""",
    "skip_status": """SELECT status, count(*) AS n_files FROM (
          SELECT CASE WHEN length(text) = 0 THEN 'empty_input' WHEN k = 1 THEN 'unknown_language' WHEN k = 2 THEN 'unsupported_language' ELSE 'ok' END AS status
          FROM (SELECT text, CAST(substr(source, 4) AS INT) % 4 AS k FROM documents)
          UNION ALL SELECT CASE WHEN length(html) = 0 THEN 'empty_input' WHEN regexp_matches(url, '^[^?#]*\\.html([?#]|$)') THEN 'ok' ELSE 'unknown_language' END FROM pages
          ) GROUP BY status""",
    "html_headings": f"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<(h[1-6])[^>]*>([^<]*)</h', 2)) AS t FROM pages),
          s AS (SELECT page_id, trim(unnest(regexp_split_to_array(t, '{ENTITY}')), E' \\n\\t\\r') AS name FROM h)
          SELECT page_id, name FROM s WHERE name <> ''""",
    "html_fragments": """WITH f AS (
            SELECT page_id, 'JavaScript' AS language, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) AS content FROM pages
            UNION ALL SELECT page_id, 'CSS', unnest(regexp_extract_all(html, '(?s)<style[^>]*>(.*?)</style>', 1)) FROM pages)
          SELECT page_id, language, content FROM f WHERE trim(content) <> ''""",
    "fragment_definitions": """WITH f AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)) AS content FROM pages)
          SELECT page_id, unnest(regexp_extract_all(content, '\\bvar (t)\\b', 1)) AS name FROM f""",
    "json_keys": "SELECT event_id, unnest(json_keys(props)) AS name FROM events",
    "markdown_sections": f"""WITH {MD_HEADS} SELECT path AS file_id, name, line_no AS start_line,
          coalesce((SELECT min(b.line_no) FROM h b WHERE b.path = a.path AND b.line_no > a.line_no AND b.level <= a.level), n) AS end_line FROM h a""",
    "front_matter_keys": """SELECT concat('docs/', source, '/doc_', doc_id, '.md') AS file_id, unnest(['source', 'lang']) AS name,
          CAST(unnest([1, 2]) AS BIGINT) AS line_no FROM documents""",
    "fenced_blocks": f"""WITH {MD_LINES} SELECT path AS file_id, 'python' AS hint, 'Python' AS language, line_no + 1 AS start_line,
          concat('def doc_', regexp_extract(path, 'doc_([0-9]+)', 1), '():', chr(10), '    return ', n_chars, chr(10)) AS content
          FROM ml JOIN documents ON path = concat('docs/', source, '/doc_', doc_id, '.md') WHERE ml.text = '```python'""",
    "nested_fragments": f"""WITH n AS ({nested_sql('duckdb')})
          SELECT doc_id, concat('deep_', doc_id) AS name, len(string_split(content, chr(10))) - 1 - {LEVELS} - 3 AS start_line FROM n""",
    "unclosed_headings": f"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<(h[1-6])[^>]*>([^<]*)</h', 2)) AS t FROM pages),
          s AS (SELECT page_id, trim(unnest(regexp_split_to_array(t, '{ENTITY}')), E' \\n\\t\\r') AS name FROM h)
          SELECT page_id, name FROM s WHERE name <> ''
          UNION ALL SELECT page_id, concat('Kept ', page_id) FROM pages WHERE html IS NOT NULL
          UNION ALL SELECT page_id, concat('Also ', page_id) FROM pages WHERE html IS NOT NULL""",
    "fence_context": f"""WITH {MD_LINES}, r AS (
            SELECT path, line_no, unnest([line_no, line_no + 1, line_no + 2, line_no - 2]) AS row FROM ml WHERE text = '```python'
            UNION ALL SELECT path, line_no, 5 FROM ml WHERE text = '```python')
          SELECT path AS file_id, concat('doc_', regexp_extract(path, 'doc_([0-9]+)', 1)) AS name, min(row) AS start_line, max(row) + 1 AS end_line
          FROM (SELECT DISTINCT path, row + 1 - row_number() OVER (PARTITION BY path ORDER BY row) AS g, row FROM (SELECT DISTINCT path, row FROM r))
          GROUP BY path, g""",
    "notebook_markdown": """SELECT conv_id, 'ok' AS status, string_agg(part, '' ORDER BY turn) AS content FROM (
          SELECT conv_id, turn, CASE WHEN role = 'assistant'
            THEN concat('```python', chr(10), text, chr(10), '```', chr(10), chr(10), '```', chr(10), role, chr(10), '```', chr(10), chr(10))
            ELSE concat(text, chr(10), chr(10)) END AS part FROM conversations) GROUP BY conv_id""",
    "indent_blocks": f"""WITH {PY_LINES}, c AS (
            SELECT path, line_no, text, length(text) - length(ltrim(text)) AS indent FROM pl WHERE trim(text) <> '' AND NOT starts_with(trim(text), '#')),
          h AS (SELECT path, line_no, indent, regexp_extract(text, '(?:class|def) (\\w+)', 1) AS name FROM c WHERE regexp_matches(text, '^ *(class|def) ')),
          e AS (SELECT h.path, h.name, h.line_no, min(c.line_no) AS stop FROM h LEFT JOIN c ON c.path = h.path AND c.line_no > h.line_no AND c.indent <= h.indent
            GROUP BY h.path, h.name, h.line_no)
          SELECT e.path AS file_id, e.name, e.line_no AS start_line, max(c.line_no) + 1 AS end_line
          FROM e JOIN c ON c.path = e.path AND (e.stop IS NULL OR c.line_no < e.stop) GROUP BY e.path, e.name, e.line_no""",
    "logical_lines": f"""WITH {PY_LINES} SELECT path AS file_id, count(*) FILTER (trim(text) <> '' AND NOT starts_with(trim(text), '#')) AS n_statements,
          CAST(0 AS BIGINT) AS open_at_end FROM pl GROUP BY path""",
    "definition_index": f"""WITH o AS (SELECT {CUSTOMER_PATH} AS p, c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey)
          SELECT concat('order_', o_orderkey) AS name, p AS file_id, 'block' AS kind, count(*) AS n_definitions FROM o GROUP BY ALL
          UNION ALL SELECT unnest(['self', 'qty']), p, 'parameter', count(*) FROM o GROUP BY p
          UNION ALL SELECT concat('Customer_', c_custkey), {CUSTOMER_PATH}, 'block', 1 FROM customer
          UNION ALL SELECT 'segment', {CUSTOMER_PATH}, 'variable', 1 FROM customer
          UNION ALL SELECT 'brand_mod', {CUSTOMER_PATH}, 'alias', 1 FROM customer
          UNION ALL SELECT concat('part_', p_partkey), {BRAND_PATH}, 'block', 1 FROM part
          UNION ALL SELECT 'n', {BRAND_PATH}, 'parameter', count(*) FROM part GROUP BY 2
          UNION ALL SELECT DISTINCT concat('unit_', p_size), 'src/parts/units.py', 'block', 1 FROM part
          UNION ALL SELECT 'n', 'src/parts/units.py', 'parameter', count(DISTINCT p_size) FROM part""",
    "lookup_term": f"""WITH {PY_LINES} SELECT path AS file_id, CAST(2 AS BIGINT) AS start_line, max(line_no) + 1 AS end_line FROM pl
          WHERE regexp_matches(path, 'customer_[0-9]*7\\.py') GROUP BY path""",
    "lookup_batch": f"""WITH {PY_LINES}, u AS (SELECT DISTINCT p_size FROM part)
          SELECT concat('part_', p_partkey) AS term_id, {BRAND_PATH} AS file_id,
            3 * (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) AS start_line,
            3 * (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) + 2 AS end_line FROM part
          UNION ALL SELECT concat('UNIT-', p_size), 'src/parts/units.py', 3 * (row_number() OVER (ORDER BY p_size) - 1),
            3 * (row_number() OVER (ORDER BY p_size) - 1) + 2 FROM u
          UNION ALL SELECT 'brand_m.d', path, 0, 1 FROM py WHERE starts_with(path, 'src/nation_')
          UNION ALL SELECT 'segm[a-z]+', path, 3, 5 FROM py WHERE starts_with(path, 'src/nation_')""",
    "attached_context": f"""WITH {PY_LINES}
          SELECT path AS file_id, 'block' AS kind, regexp_extract(text, '(?:class|def) (\\w+)', 1) AS name,
            line_no - CASE WHEN starts_with(text, 'class') THEN 1 ELSE 2 END AS attach_start, line_no FROM pl
          WHERE starts_with(path, 'src/nation_') AND regexp_matches(text, '^ *(class|def) ')
          UNION ALL SELECT path, 'parameter', unnest(['self', 'qty']), line_no - 1, line_no FROM pl
          WHERE starts_with(path, 'src/nation_') AND regexp_matches(text, '^ *def ')""",
    "ancestor_headers": f"SELECT {CUSTOMER_PATH} AS file_id, concat('order_', o_orderkey) AS name, CAST(3 AS BIGINT) AS header_start, CAST(4 AS BIGINT) AS header_end "
    "FROM customer JOIN orders ON o_custkey = c_custkey",
    "calls_by_definition": f"""SELECT concat('order_', o_orderkey) AS caller, concat('part_', l_partkey) AS callee
            FROM {CALLED} x JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          UNION SELECT concat('Customer_', c_custkey), concat('part_', l_partkey)
            FROM {CALLED} x JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
          UNION SELECT concat('part_', p_partkey), concat('unit_', p_size) FROM part""",
    "single_callee_chain": f"""WITH one AS (SELECT l_orderkey, min(l_partkey) AS p FROM {CALLED} x GROUP BY l_orderkey HAVING count(*) = 1),
          c AS (SELECT o_orderkey, p FROM orders JOIN customer ON o_custkey = c_custkey JOIN one ON l_orderkey = o_orderkey)
          SELECT o_orderkey AS term_id, CAST(0 AS BIGINT) AS step, concat('order_', o_orderkey) AS name FROM orders
          UNION ALL SELECT o_orderkey, 1, concat('part_', p) FROM c
          UNION ALL SELECT o_orderkey, 2, concat('unit_', p_size) FROM c JOIN part ON p_partkey = p""",
    "recursive_lookup": f"""WITH {PLACES},
          shown AS (SELECT 'order' AS kind, k, path, a, b FROM od UNION ALL SELECT 'order', k, path, 3, 4 FROM od
            UNION ALL SELECT 'part', p, path, a, a + 2 FROM pr UNION ALL SELECT 'unit', p_size, 'src/parts/units.py', a, a + 2 FROM ur
            UNION ALL SELECT 'customer', c, path, 2, b FROM cr),
          asked AS (SELECT concat('o:', k) AS term_id, 1 AS round, 'order' AS kind, k FROM od
            UNION ALL SELECT concat('o:', k), 2, 'part', p FROM oo JOIN od USING (k)
            UNION ALL SELECT concat('o:', k), 3, 'unit', p_size FROM oo JOIN od USING (k) JOIN part ON p_partkey = p
            UNION ALL SELECT concat(m, k), 1, 'order', k FROM oo CROSS JOIN (VALUES ('p:'), ('i:')) v(m)
            UNION ALL SELECT concat(m, k), 1, 'part', p FROM oo CROSS JOIN (VALUES ('p:'), ('i:')) v(m)
            UNION ALL SELECT concat(m, k), 2, 'unit', p_size FROM oo JOIN part ON p_partkey = p CROSS JOIN (VALUES ('p:'), ('i:')) v(m)
            UNION ALL SELECT concat('c:', c), 1, 'customer', c FROM cr
            UNION ALL SELECT concat('c:', c), 2, 'part', p FROM co JOIN cr USING (c)
            UNION ALL SELECT concat('c:', c), 3, 'unit', p_size FROM co JOIN cr USING (c) JOIN part ON p_partkey = p)
          SELECT term_id, CAST(round AS BIGINT) AS round, path AS file_id, CAST(a AS BIGINT) AS start_line, CAST(b AS BIGINT) AS end_line
          FROM asked JOIN shown USING (kind, k)""",
    "pattern_batch": """WITH names AS (SELECT concat('part_', p_partkey) AS name FROM part UNION SELECT concat('unit_', p_size) FROM part UNION SELECT concat('order_', o_orderkey) FROM orders)
          SELECT term_id, unnest([concat('part_', p_partkey), concat('unit_', p_size)]) AS name, 'ok' AS status
            FROM (SELECT *, concat('pa?r[st]{1}_0*', p_partkey, '|unit_(?:x|', p_size, ')') AS term_id FROM part)
          UNION ALL SELECT concat('ORDER_', a.o_orderkey, '[05]?'), concat('order_', b.o_orderkey), 'ok' FROM orders a JOIN orders b
            ON concat('', b.o_orderkey) IN (concat('', a.o_orderkey), concat(a.o_orderkey, '0'), concat(a.o_orderkey, '5'))
          UNION ALL SELECT DISTINCT concat('ba[', p_size), NULL, 'bad_pattern' FROM part
          UNION ALL SELECT t, name, 'ok' FROM (SELECT DISTINCT p_size % 10 AS d, concat('.*_', p_size % 10, '9') AS t FROM part) JOIN names ON regexp_matches(name, concat('^.*_', d, '9$'))""",
    "import_pairs": """SELECT 'Python' AS language, 'src.parts' AS origin, 'brands as brand_mod' AS name, count(*) AS n_files
          FROM customer""",
    "bracketed_statements": """SELECT CAST(CAST(floor(o_orderkey / 64) AS bigint) AS varchar) AS file_id, 4 * count(*) AS n_statements, 2 AS deepest, 0 AS open_at_end FROM orders GROUP BY 1""",
    "import_names": """WITH k AS (SELECT CAST(o_orderkey AS varchar) AS k FROM orders), v(o, n) AS (VALUES ('lib_{k}.sub', 'one_{k} as uno_{k}'), ('lib_{k}.sub', 'two_{k}'),
            ('deep_{k}', 'three_{k}'), ('deep_{k}', 'four_{k} as vier_{k}'), ('pkg_{k}', 'mod'), ('pkg_{k}.mod', 'fn'))
          SELECT 'Python' AS language, replace(o, '{k}', k) AS origin, replace(n, '{k}', k) AS name FROM k CROSS JOIN v""",
    "import_ranking": f"""SELECT DISTINCT concat('other.parts.', lower(replace(p_brand, '#', '_'))) AS origin, {BRAND_PATH} AS path, CAST(2 AS BIGINT) AS score FROM part""",
    "rule_override": """WITH b AS (SELECT p_brand AS language, p_type AS field, max(p_name) AS v FROM part GROUP BY ALL),
          u AS (SELECT p_brand AS language, p_type AS field, min(p_name) AS v FROM part WHERE p_size > 45 GROUP BY ALL)
          SELECT b.language, b.field, coalesce(u.v, b.v) AS value, CASE WHEN u.v IS NULL THEN 'builtin' ELSE 'user' END AS layer
          FROM b LEFT JOIN u ON b.language = u.language AND b.field = u.field""",
    "rule_extends": """WITH n AS (SELECT n_name, n_nationkey, n_regionkey, c_mktsegment AS field, max(c_name) AS v
            FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
          r AS (SELECT r_name, r_regionkey, c_mktsegment AS field, min(c_name) AS v
            FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
          SELECT r_name AS language, field, v AS value, 'ok' AS status FROM r WHERE r_regionkey > 2
          UNION ALL SELECT n_name, n.field, CASE WHEN n_nationkey % 2 = 0 THEN concat(r.v, n.v) ELSE n.v END, 'ok'
            FROM n LEFT JOIN r ON r_regionkey = n_regionkey AND r.field = n.field WHERE n_regionkey > 2
          UNION ALL SELECT n_name, r.field, r.v, 'ok' FROM nation JOIN r ON r_regionkey = n_regionkey
            WHERE n_regionkey > 2 AND n_name IN (SELECT n_name FROM n) AND NOT EXISTS (SELECT 1 FROM n WHERE n.n_nationkey = nation.n_nationkey AND n.field = r.field)
          UNION ALL SELECT DISTINCT r_name, NULL, NULL, CASE WHEN r_regionkey < 2 THEN 'cycle' ELSE 'unknown_base' END FROM r WHERE r_regionkey <= 2
          UNION ALL SELECT DISTINCT n_name, NULL, NULL, CASE WHEN n_regionkey < 2 THEN 'cycle' ELSE 'unknown_base' END FROM n WHERE n_regionkey <= 2""",
}
