"""DuckDB SQL of the engine's queries over the same tables."""

from codeloom.operators.prompts import SHAPE
from codeloom.sources.export import page

_STAR = """
star AS (
  SELECT 'RegionController' AS caller_class, n_regionkey::VARCHAR AS caller_method, 'Nation' AS callee_class, n_nationkey::VARCHAR AS callee_method, n_nationkey::BIGINT AS edge_ord FROM nation
  UNION ALL SELECT 'Nation', n_nationkey::VARCHAR, 'RegionController', n_regionkey::VARCHAR, n_nationkey + 1000 FROM nation
  UNION ALL SELECT 'Nation', s_nationkey::VARCHAR, 'Supplier', s_suppkey::VARCHAR, s_suppkey + 10000 FROM supplier
  UNION ALL SELECT 'Supplier', l_suppkey::VARCHAR, 'Part', l_partkey::VARCHAR, min(l_orderkey * 10 + l_linenumber)::BIGINT * 1048576 + l_partkey + 100000000 FROM lineitem GROUP BY l_suppkey, l_partkey
)"""

_FLOW = f"""
WITH RECURSIVE {_STAR},
keyed AS (SELECT lower(caller_class || '::' || caller_method) AS from_key, lower(callee_class || '::' || callee_method) AS to_key, * FROM star),
entries AS (SELECT DISTINCT caller_method AS flow, lower(caller_class || '::' || caller_method) AS node FROM star WHERE caller_class ILIKE '%controller'),
r(flow, node, lvl, path) USING KEY (flow, node) AS (
  SELECT flow, node, 0::BIGINT, []::BIGINT[] FROM entries
  UNION
  (SELECT x.* FROM (
    SELECT r.flow, e.to_key AS node, min(r.lvl) + 1 AS lvl, min(list_append(r.path, e.edge_ord)) AS path FROM r JOIN keyed e ON e.from_key = r.node GROUP BY 1, 2
  ) x LEFT JOIN recurring.r AS seen ON seen.flow = x.flow AND seen.node = x.node WHERE seen.flow IS NULL)
),
steps AS (
  SELECT r.flow, r.lvl AS level, row_number() OVER (PARTITION BY r.flow ORDER BY r.lvl, r.path, e.edge_ord) AS step_order, e.caller_class, e.caller_method, e.callee_class, e.callee_method
  FROM r JOIN keyed e ON e.from_key = r.node
)"""


def _mermaid(edges: str, order: str, group: str, direction: str, separator: str) -> str:
    """Diagram text of the rows of ``edges``; ``group`` is a column or a constant."""
    return f"""
ends AS (
  SELECT {group} AS g, {order} AS place, 0 AS side, caller_class || '{separator}' || caller_method AS node, caller_class || '.' || caller_method AS shown FROM {edges}
  UNION ALL SELECT {group}, {order}, 1, callee_class || '{separator}' || callee_method, callee_class || '.' || callee_method FROM {edges}
),
firsts AS (SELECT g, node, arg_min(shown, place * 2 + side) AS shown, min(place * 2 + side) AS f FROM ends GROUP BY g, node),
ids AS (SELECT *, 'N' || (row_number() OVER (PARTITION BY g ORDER BY f) - 1) AS id FROM firsts),
all_lines AS (
  SELECT g, f // 2 AS place, f % 2 AS part, '    ' || id || '["' || replace(replace(replace(shown, '"', ''''), '<', '&lt;'), '>', '&gt;') || '"]' AS line FROM ids
  UNION ALL
  SELECT {group}, {order}, 2, '    ' || a.id || ' --> ' || b.id FROM {edges} e
  JOIN ids a ON a.g = {group} AND a.node = caller_class || '{separator}' || caller_method JOIN ids b ON b.g = {group} AND b.node = callee_class || '{separator}' || callee_method
),
drawn AS (SELECT g, 'graph {direction}' || chr(10) || string_agg(line, chr(10) ORDER BY place, part, line) || chr(10) AS mermaid FROM all_lines GROUP BY g)"""


_RUNS = "SELECT c_custkey AS id, c_name AS repo_name, c_mktsegment AS repo_language, c_acctbal AS created_at, c_nationkey % 2 = 0 AS is_public FROM customer"
_EXAMPLES = """SELECT item_id::VARCHAR AS id, text AS question, CASE item_id % 3 WHEN 0 THEN 'hard' WHEN 1 THEN 'medium' ELSE 'easy' END AS difficulty, CASE WHEN item_id % 2 = 0 THEN 'Even' END AS tag, item_id AS created_at FROM benchmark"""
_STEPS = "SELECT conv_id, turn, role AS caller, coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role), 'end') AS callee FROM conversations"

_URLS = "['https://github.com/o/r', 'https://gitlab.com/o/r/tree/main', ' http://Bitbucket.org/a/b/ ', 'x.GIT', 'https://example.org/o/r', '/local/path']"
_CLONES = "['https://github.com/o/r.git', 'https://gitlab.com/o/r.git', 'https://bitbucket.org/a/b.git', 'x.GIT', 'https://example.org/o/r', '/local/path']"


def _parsed(entry: str, callee: str, caller: str = "load", called: str = "fetch", to: str = "'OrderStore'") -> str:
    edges = f"SELECT o_custkey AS file_ord, 'Customer' || o_custkey AS caller_class, '{caller}' || o_orderkey AS caller_method, {to} AS callee_class, '{called}' || o_orderkey AS callee_method FROM orders JOIN customer ON c_custkey = o_custkey"
    if not entry:
        return edges
    return f"{edges} UNION ALL SELECT o_custkey, 'Customer' || o_custkey, '__CLASS__', 'Customer' || o_custkey, '{caller}' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey"


def _facts(methods: list[tuple], edges: list[tuple]) -> str:
    """Rows for each supplier; ``{k}`` stands for its key."""
    rows = [("method", *m, None, None) for m in methods] + [("edge", *e) for e in edges]
    values = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in row) + ")" for row in rows)
    own = ", ".join(f"replace({c}, '{{k}}', s_suppkey::VARCHAR) AS {c}" for c in ("class_name", "method_name", "callee_class", "callee_method"))
    return f"SELECT s_suppkey AS file_ord, kind, {own} FROM supplier, (VALUES {values}) AS f(kind, class_name, method_name, callee_class, callee_method)"


_JAVA, _MODULE, _CLASS, _FILE, _RUN = "handles{k}", "shop{k}", "Shop{k}", "MyShop{k}", ("Desk{k}", "Run")
_CSHARP_EDGES = [
    ("SqlStore{k}", "Load", "Base{k}", "Note"), ("IStore{k}", "Load", "SqlStore{k}", "Load"), (*_RUN, "IStore{k}", "Load"), (*_RUN, "Order{k}", "Pay"),
    (*_RUN, "Helper{k}", "Go"), (*_RUN, "Helper{k}", "Stop"), (*_RUN, "Helper{k}", "Make"), (*_RUN, "Base{k}", "Note"),
]
_CSHARP_METHODS = [
    ("IStore{k}", "Load"), ("Base{k}", "Note"), ("SqlStore{k}", "Load"), ("Half{k}", "Load"), ("Desk{k}", "Run"), ("Helper{k}", "Go"), ("Helper{k}", "Stop"), ("Helper{k}", "Make"), ("Order{k}", "Pay"),
]


SQL: dict[str, str] = {
    "flow_trace": f"{_FLOW} SELECT * FROM steps",
    "entry_points": f"WITH {_STAR} SELECT caller_class AS class_name, caller_method AS method_name, min(edge_ord) AS first_ord FROM star WHERE caller_class ILIKE '%controller' GROUP BY 1, 2",
    "edge_dedup": "SELECT 'Supplier' AS caller_class, l_suppkey::VARCHAR AS caller_method, 'Part' AS callee_class, l_partkey::VARCHAR AS callee_method, min(l_orderkey * 10 + l_linenumber)::BIGINT AS edge_ord FROM lineitem GROUP BY l_suppkey, l_partkey",
    "diagram_text": f"""WITH {_STAR}, {_mermaid('star', 'edge_ord', '1', 'LR', '::')},
whole AS (SELECT string_split(rtrim(mermaid, chr(10)), chr(10)) AS lines FROM drawn) SELECT unnest(range(1, len(lines) + 1)) AS number, unnest(lines) AS line FROM whole""",
    "call_graph_diagram": f"WITH {_STAR}, {_mermaid('star', 'edge_ord', '1', 'LR', '::')} SELECT mermaid FROM drawn",
    "flow_diagrams": f"{_FLOW}, {_mermaid('steps', 'step_order', 'flow', 'TD', '.')} SELECT g AS entry_method, mermaid FROM drawn",
    "call_sites": r"SELECT page_id, (unnest(range(len(m))))::BIGINT AS pos, unnest(m) AS name FROM (SELECT page_id, regexp_extract_all(html, '(\w+)\s*\(', 1) AS m FROM pages)",
    "link_edges": """SELECT page_id, (unnest(range(len(m))))::BIGINT AS pos, unnest(m) AS target FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS m FROM pages)""",
    "source_lines": "SELECT doc_id, (unnest(range(len(m))))::BIGINT AS line_no, length(unnest(m))::BIGINT AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS m FROM documents)",
    "run_page": f"SELECT * FROM ({_RUNS}) WHERE contains(lower(repo_language), 'build') AND is_public ORDER BY created_at DESC, id LIMIT 10 OFFSET 10",
    "page_meta": f"SELECT count(*) AS total_count, 2::BIGINT AS page, 7::BIGINT AS page_size, ceil(count(*) / 7)::BIGINT AS total_pages, true AS has_previous, 2 < ceil(count(*) / 7) AS has_next FROM ({_RUNS}) WHERE contains(lower(repo_language), 'build')",
    "point_lookup": f"SELECT * FROM ({_RUNS}) WHERE id = 42",
    "in_list": "SELECT o_custkey::VARCHAR AS id, o_orderkey FROM orders WHERE o_custkey % 2 = 0 AND o_custkey < 4000",
    "flow_summary": "SELECT conv_id AS id, 'conversation ' || conv_id AS name, count(*) FILTER (turn > 0)::BIGINT AS step_count, true AS has_mermaid_graph, conv_id % 2 <> 0 AS has_data_flow_graph FROM conversations GROUP BY conv_id",
    "flow_detail": f"SELECT conv_id AS id, count(*)::BIGINT AS step_count, string_agg('Turn.' || caller || ' → Turn.' || callee, '|' ORDER BY turn, caller, callee) AS labels FROM ({_STEPS}) GROUP BY conv_id",
    "step_listing": f"SELECT conv_id AS business_flow_id, string_agg('  [' || turn || '] Turn.' || caller || ' --> Turn.' || callee, chr(10) ORDER BY turn, caller, callee) AS listing FROM ({_STEPS}) GROUP BY conv_id",
    "example_page": f"SELECT id, difficulty, tag, created_at FROM ({_EXAMPLES}) WHERE difficulty = 'hard' AND contains(lower(tag), 'eve') ORDER BY created_at DESC, id LIMIT 10",
    "example_choice": f"SELECT id, difficulty FROM ({_EXAMPLES}) WHERE difficulty = 'easy' ORDER BY created_at, id LIMIT 5",
    "class_semi": """
WITH named AS (SELECT 's' || s_suppkey AS c FROM supplier WHERE s_acctbal < 0 UNION SELECT 'p' || p_partkey FROM part WHERE p_size = 1)
SELECT ' S' || l_suppkey AS caller_class, 'p' || l_partkey AS callee_class, l_orderkey FROM lineitem
WHERE 's' || l_suppkey IN (SELECT c FROM named) OR 'p' || l_partkey IN (SELECT c FROM named)""",
    "event_edges": "SELECT event_id, user_id, event_type AS caller, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS callee FROM events",
    "pascal_case": """
SELECT DISTINCT o_orderpriority,
  list_aggregate(list_transform(list_filter(regexp_split_to_array(lower(o_orderpriority), '[-_ ]'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), 'string_agg', '') AS pascal,
  upper(lower(o_orderpriority)[1]) || lower(o_orderpriority)[2:] AS upper_first FROM orders""",
    "git_urls": f"SELECT c_custkey, [true, true, true, true, true, false][c_custkey % 6 + 1] AS is_git, ({_CLONES})[c_custkey % 6 + 1] AS clone_url FROM customer",
    "files_by_language": "SELECT lang AS language, count(*) AS n_files, min(doc_id) AS first_path FROM documents GROUP BY lang",
    "feature_map": """
SELECT n_regionkey::VARCHAR AS feature_name, 'n' || n_nationkey AS method_source_id FROM nation
UNION SELECT n_regionkey::VARCHAR, 's' || s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey""",
    "code_flow": "SELECT n_regionkey::VARCHAR AS feature_name, count(*) AS n_methods, string_agg(n_name, ',' ORDER BY n_nationkey::VARCHAR) AS sources FROM nation GROUP BY n_regionkey",
    "patch_update": f"SELECT id, CASE WHEN id % 20 = 0 THEN 'renamed' ELSE repo_name END AS repo_name, CASE WHEN id % 10 = 0 THEN 'SET' ELSE repo_language END AS repo_language, created_at, is_public FROM ({_RUNS})",
    "cascade_delete": """
WITH c AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
SELECT 'customer' AS kept, count(*) AS n, sum(c_custkey)::BIGINT AS ids FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM c)
UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)
UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey * 10 + l_linenumber)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o)""",
    "mapping_cascade": """
WITH r AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey <> 1), f AS (SELECT s_suppkey AS id FROM supplier WHERE s_nationkey IN (SELECT id FROM r)),
m AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 25 IN (SELECT id FROM r) AND p_size <= 40),
x AS (SELECT DISTINCT l_suppkey * 1000000000 + l_partkey AS id FROM lineitem WHERE l_suppkey IN (SELECT id FROM f) AND l_partkey IN (SELECT id FROM m))
SELECT 'analysis_runs' AS kept, count(*) AS n, sum(id)::BIGINT AS ids FROM r UNION ALL SELECT 'feature_records', count(*), sum(id)::BIGINT FROM f
UNION ALL SELECT 'method_sources', count(*), sum(id)::BIGINT FROM m UNION ALL SELECT 'feature_method_mappings', count(*), sum(id)::BIGINT FROM x""",
    "replace_by_path": """
WITH fresh AS (SELECT p_partkey + 1000000 AS id, upper(p_name) AS repository_path FROM part WHERE p_partkey % 7 = 0)
SELECT p_partkey AS id, p_name AS repository_path FROM part WHERE lower(p_name) NOT IN (SELECT lower(repository_path) FROM fresh) UNION ALL SELECT * FROM fresh""",
    "request_violations": """
SELECT doc_id AS id, 'repository_path is required' AS violation FROM documents WHERE doc_id % 50 = 0 OR trim(text, ' ') = ''
UNION ALL SELECT doc_id, 'repository_path is longer than 2000' FROM documents WHERE doc_id % 50 <> 0 AND length(text) > 2000
UNION ALL SELECT doc_id, 'repo_name is longer than 255' FROM documents WHERE length(source) > 255
UNION ALL SELECT doc_id, 'repo_stars is out of range' FROM documents WHERE doc_id > 100""",
    "parse_python": _parsed("entry", "", "load_", "fetch_"),
    "parse_java": _parsed("entry", ""),
    "parse_node": _parsed("entry", ""),
    "parse_csharp": _parsed("", "", "Load", "Fetch", "'Store' || o_custkey"),
    "data_flow": """
SELECT 'M' || o_orderkey AS method_name, s.seq::BIGINT AS seq, s.a AS source_token, s.b AS target_token, s.r AS relation_type FROM orders,
LATERAL (VALUES (0, 'x', 'this.y', 'Assignment'), (1, 'a + ' || o_orderkey, 'x', 'Assignment'), (2, 'x * 2', 'RETURN_VALUE', 'Return')) AS s(seq, a, b, r)""",
    "interface_calls": """
SELECT c_custkey AS file_ord, 'Customer' || c_custkey AS caller_class, 'Load' AS caller_method, 'IStore' || c_custkey AS callee_class, 'Fetch' AS callee_method FROM customer
UNION ALL SELECT c_custkey, 'IStore' || c_custkey, 'Fetch', 'SqlStore' || c_custkey, 'Fetch' FROM customer""",
    "csharp_scopes": """
SELECT c_custkey + 100 AS file_ord, 'Desk' || c_custkey AS caller_class, 'Run' AS caller_method, CASE WHEN c_custkey % 5 = 3 THEN 'Line' ELSE 'Account' END AS callee_class,
  CASE WHEN c_custkey % 5 = 3 THEN 'Print' ELSE 'Pay' END || c_nationkey AS callee_method FROM customer""",
    "csharp_chains": """
WITH o AS (SELECT o_custkey AS file_ord, 'Customer' || o_custkey AS caller_class, 'Run' || o_orderkey AS caller_method, o_orderkey AS k, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT file_ord, caller_class, caller_method, 'Box' AS callee_class, 'Next' AS callee_method, n FROM o
UNION ALL SELECT file_ord, caller_class, caller_method, 'Bin', 'Open', 1 FROM o
UNION ALL SELECT file_ord, caller_class, caller_method, 'Order' || k, 'Pay' || k, 1 FROM o""",
    "method_parameters": "SELECT o_orderkey, 'Map&lt;int, string&gt; a' || o_orderkey || '|string b|int[] c' AS params FROM orders",
    "feature_prompts": f"""
WITH {_STAR}, own AS (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2),
code AS (SELECT string_agg('Source of nation.' || n_nationkey || ':' || chr(10) || n_name || chr(10), chr(10) ORDER BY 'n' || n_nationkey) AS t FROM own),
calls AS (SELECT string_agg(caller_class || '.' || caller_method || ' -> ' || callee_class || '.' || callee_method, chr(10) ORDER BY edge_ord, caller_class || '.' || caller_method) AS t FROM star WHERE lower(caller_class) = 'nation' OR lower(callee_class) = 'nation')
SELECT concat_ws(chr(10), 'Number of questions: 5', 'Difficulty: easy', 'Focus: names', '', '== Methods of the feature ==', code.t, '', '== Calls from and to their classes ==', calls.t, '', '{SHAPE}') AS prompt FROM code, calls""",
    "flow_prompts": f"""
WITH steps AS ({_STEPS}),
listed AS (SELECT conv_id AS id, count(*) AS total_steps, string_agg('  [' || turn || '] Turn.' || caller || ' --> Turn.' || callee, chr(10) ORDER BY turn, caller, callee) AS listing FROM steps GROUP BY conv_id),
few AS (SELECT *, row_number() OVER (ORDER BY created_at, id) AS k FROM (SELECT * FROM ({_EXAMPLES}) WHERE difficulty = 'hard' ORDER BY created_at, id LIMIT 5)),
shown AS (
  SELECT count(*) AS few_shot_used, string_agg('[Example ' || k || ']' || chr(10) || '  Question: ' || question || chr(10) || '  Answer: answer' || chr(10) || '  Difficulty: ' || difficulty
    || CASE WHEN tag IS NULL THEN '' ELSE chr(10) || '  Tag: ' || tag END || chr(10), chr(10) ORDER BY k) AS t FROM few
)
SELECT id, total_steps, few_shot_used, concat_ws(chr(10), 'Number of questions: 7' || chr(10) || 'Difficulty: hard' || chr(10), '== Flow ==', 'Name: conversation ' || id, 'Entry point: conversation ' || id, '', '== Steps ==', listing, '',
  CASE WHEN id % 2 <> 0 THEN '== Data flow ==' || chr(10) || 'y' || chr(10) END, CASE WHEN few_shot_used > 0 THEN '== Samples ==' || chr(10) || shown.t END, '{SHAPE}') AS prompt FROM listed, shown""",
    "data_flow_diagrams": f"""
WITH steps AS ({_STEPS}),
nodes AS (SELECT DISTINCT conv_id, n FROM (SELECT conv_id, caller AS n FROM steps UNION ALL SELECT conv_id, callee FROM steps)),
blocks AS (
  SELECT conv_id, string_agg('    subgraph "Turn.' || n || '"' || chr(10) || CASE WHEN lower(n) = 'user' THEN '        param: int a' || chr(10) || '        a &lt; 1 -- Assignment --> x' || chr(10) || '        x -. Return --> RETURN_VALUE' || chr(10) ELSE '' END || '    end', chr(10) ORDER BY n) AS t
  FROM nodes GROUP BY conv_id
),
calls AS (SELECT conv_id, string_agg('    Turn.' || caller || ' --> Turn.' || callee, chr(10) ORDER BY turn, '    Turn.' || caller || ' --> Turn.' || callee) AS t FROM steps GROUP BY conv_id)
SELECT conv_id::VARCHAR AS entry_method, 'graph TD' || chr(10) || blocks.t || chr(10) || calls.t || chr(10) AS mermaid FROM blocks JOIN calls USING (conv_id)""",
    "java_rules": _facts(
        [(_JAVA, "load{k}"), (_JAVA, "quiet{k}"), (_JAVA, "shown{k}"), (_JAVA, "reset{k}"), (_JAVA, "name{k}")],
        [
            (_JAVA, "__CLASS__", _JAVA, "load{k}"), (_JAVA, "load{k}", "OrderStore", "fetch{k}"), (_JAVA, "load{k}", _JAVA, "Item{k}"),
            (_JAVA, "quiet{k}", "OrderStore", "count{k}"), (_JAVA, "__CLASS__", _JAVA, "GET shown{k}"),
        ],
    ),
    "python_rules": _facts(
        [(_MODULE, "first{k}"), (_MODULE, "second{k}"), (_CLASS, "__init__"), (_CLASS, "third{k}"), (_CLASS, "fourth{k}")],
        [
            (_MODULE, "__CLASS__", _MODULE, "GET first{k}"), (_MODULE, "GET first{k}", "UserStore", "load{k}"), (_MODULE, "GET first{k}", "Self", "go{k}"), (_MODULE, "GET first{k}", _MODULE, "helper{k}"),
            (_MODULE, "__CLASS__", _MODULE, "second{k}"), (_CLASS, "__CLASS__", _CLASS, "third{k}"), (_CLASS, "__CLASS__", _CLASS, "fourth{k}"), (_CLASS, "fourth{k}", "Stock", "count{k}"),
        ],
    ),
    "node_rules": _facts(
        [(_FILE, "first{k}"), (_FILE, "short{k}"), (_CLASS, "run{k}")],
        [
            (_FILE, "__CLASS__", _FILE, "GET /list{k}"), (_FILE, "__CLASS__", _FILE, "first{k}"), (_FILE, "first{k}", "UserApi", "load{k}"), (_FILE, "first{k}", _FILE, "helper{k}"),
            (_FILE, "__CLASS__", _FILE, "short{k}"), (_FILE, "short{k}", "Stock", "count{k}"), (_CLASS, "__CLASS__", _CLASS, "POST run{k}"),
        ],
    ),
    "csharp_rules": f"SELECT file_ord, class_name AS caller_class, method_name AS caller_method, callee_class, callee_method FROM ({_facts([], _CSHARP_EDGES)})",
    "csharp_methods": f"SELECT file_ord, class_name, method_name FROM ({_facts(_CSHARP_METHODS, [])})",
    "parse_report": """
SELECT 'm' || c_custkey || '.py' AS path, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 THEN 'f' || c_custkey END AS found,
  CASE WHEN c_custkey % 5 = 0 THEN 'OSError: unreadable' WHEN c_custkey % 7 = 0 THEN 'KeyError: ' || chr(39) || 'none' || chr(39) END AS error FROM customer""",
    "source_paths": """
WITH f AS (SELECT p_partkey, ['', 'src/', 'src/Node_Modules/x/', 'Target/', 'objects/', 'a/.git/'][p_partkey % 6 + 1] AS folder, ['.cs', '.JAVA', '.py', '.ts', '.txt', '', '.mjs'][p_partkey % 7 + 1] AS e FROM part)
SELECT folder || 'f' || p_partkey || e AS path, lower(e) AS ext,
  CASE lower(e) WHEN '.cs' THEN 'C# (.NET)' WHEN '.java' THEN 'Java (Spring Boot)' WHEN '.py' THEN 'Python (FastAPI)' ELSE 'Node.js (Express)' END AS language
FROM f WHERE folder IN ('', 'src/', 'objects/') AND e NOT IN ('.txt', '')""",
    "repository_scan": """
WITH f AS (SELECT p_partkey, p_name, ['', 'src/', 'src/Node_Modules/x/', 'Target/', 'objects/', 'a/.git/'][p_partkey % 6 + 1] AS folder, ['.cs', '.JAVA', '.py', '.ts', '.txt', '', '.mjs'][p_partkey % 7 + 1] AS e FROM part)
SELECT folder || 'f' || p_partkey || e AS path,
  CASE lower(e) WHEN '.cs' THEN 'C# (.NET)' WHEN '.java' THEN 'Java (Spring Boot)' WHEN '.py' THEN 'Python (FastAPI)' ELSE 'Node.js (Express)' END AS language,
  row_number() OVER (ORDER BY folder || 'f' || p_partkey || e) - 1 AS file_ord, '# ' || coalesce(p_name, '') AS content
FROM f WHERE folder IN ('', 'src/', 'objects/') AND e NOT IN ('.txt', '')""",
    "model_ledger": """
WITH c AS (SELECT c_custkey::VARCHAR AS id, c_custkey % 10 AS k FROM customer)
SELECT id, CASE WHEN k NOT IN (5, 9) THEN 'answer about ' || id END AS first, CASE k WHEN 5 THEN 'down' WHEN 9 THEN 'refused' END AS error,
  CASE WHEN k IN (5, 9) THEN 'later about ' ELSE 'answer about ' END || id AS second FROM c""",
    "feature_methods": "SELECT s_suppkey::VARCHAR AS id, s_name AS method_name FROM supplier WHERE s_nationkey = 3 AND s_acctbal > 0",
    "stable_ids": "SELECT s_suppkey, sha256('run' || chr(31) || s_name || chr(31) || CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::VARCHAR ELSE '' END)[:32] AS id FROM supplier",
    "generated_questions": """
WITH c AS (SELECT c_custkey::VARCHAR AS id, c_custkey % 10 AS k FROM customer)
SELECT id, 'about ' || id AS question, 'yes' AS suggested_answer, 'easy' AS difficulty, NULL::VARCHAR AS error FROM c WHERE k NOT IN (7, 9)
UNION ALL SELECT id, 'again', '', '', NULL FROM c WHERE k NOT IN (7, 9)
UNION ALL SELECT id, NULL, NULL, NULL, CASE k WHEN 9 THEN 'refused' ELSE 'not an answer: no json' END FROM c WHERE k IN (7, 9)""",
    "store_changes": """
WITH n AS (SELECT * FROM nation WHERE n_nationkey % 7 <> 0 AND n_nationkey <> 1), s AS (SELECT * FROM supplier WHERE s_nationkey % 7 <> 0 AND s_nationkey <> 1)
SELECT 'analysis_runs' AS kept, n_nationkey::VARCHAR AS id, n_name || ':' || CASE WHEN n_nationkey % 5 = 0 THEN 'new' ELSE 'old' END AS what FROM n
UNION ALL SELECT 'analysis_runs', 'fresh', lower(n_name) FROM nation WHERE n_nationkey = 1
UNION ALL SELECT 'method_sources', s_suppkey::VARCHAR, s_nationkey::VARCHAR FROM s
UNION ALL SELECT 'method_sources', 'only', 'fresh'
UNION ALL SELECT 'feature_records', 'f' || s_suppkey, s_nationkey::VARCHAR FROM s
UNION ALL SELECT 'feature_method_mappings', 'm' || s_suppkey, 'f' || s_suppkey FROM s""",
    "exports": f"""
WITH e AS (SELECT 'Region<1>' AS caller_class, n_regionkey::VARCHAR AS caller_method, 'Nation' AS callee_class, n_nationkey::VARCHAR AS callee_method, n_nationkey AS edge_ord FROM nation),
{_mermaid('e', 'edge_ord', '1', 'LR', '::')},
listed AS (
  SELECT string_agg('    {{' || chr(10) || '      "CallerClass": "' || caller_class || '",' || chr(10) || '      "CallerMethod": "' || caller_method || '",' || chr(10) || '      "CalleeClass": "' || callee_class || '",' || chr(10)
    || '      "CalleeMethod": "' || callee_method || '"' || CASE WHEN edge_ord % 2 = 0 THEN ',' || chr(10) || '      "Language": "C# (.NET)"' ELSE '' END || chr(10) || '    }}', ',' || chr(10) ORDER BY edge_ord) AS t FROM e
),
shown AS (SELECT replace(replace(replace(replace(replace(mermaid, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#x27;') AS t FROM drawn)
SELECT 'output_graph.json' AS file, '{{' || chr(10) || '  "CallGraph": [' || chr(10) || t || chr(10) || '  ]' || chr(10) || '}}' || chr(10) AS content FROM listed
UNION ALL SELECT 'call_graph.md', '# Call Graph' || chr(10) || chr(10) || '```mermaid' || chr(10) || mermaid || chr(10) || '```' FROM drawn
UNION ALL SELECT unnest(['call_graph.html', 'output_graph.html']), replace('{page('BODY')}', 'BODY', '<pre class="mermaid">' || t || '</pre>') FROM shown""",
    "analysis_response": "SELECT 'analysis completed' AS message, 28 * count(*) AS edges_count, 22 * count(*) AS methods_count, 4 * count(*) AS parsed_count, 1::BIGINT AS error_count, 28 * count(*) AS stored_edges, 'shop' AS repo_name FROM nation",
}
