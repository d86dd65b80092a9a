"""Queries over source code made from tables, and over graphs of keys."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeseek.operators import running
from lodeseek.operators import evaluate as E
from lodeseek.operators import graph as G
from lodeseek.operators import render as R
from lodeseek.operators.extract_generic import generic_capsules
from lodeseek.operators.extract_markup import markup_capsules
from lodeseek.operators.extract_python import python_capsules
from lodeseek.operators.frameworks import detect_frameworks
from lodeseek.plans.registry import query, table
from lodeseek.plans.text_queries import documents
from lodeseek.schema import CAPSULE, prop
from lodeseek.sources.shared import stored
from lodeseek.sources.synthetic import source_files

C = F.col
NL = "chr(10)"

# What extraction must find, from the same columns (DuckDB): functions, classes, tests, entry points, headers, imports, constants.
PART_BODY = f"""'def make_' || p_partkey || '(size: int, rate=1.5) -> float:' || {NL} || CASE WHEN p_partkey % 3 <> 0 THEN '    \"\"\"Builds ' || p_brand || ' things.\"\"\"' || {NL} ELSE '' END || '    return scale_' || p_partkey % 25 || '(size) + check(rate)'"""
NATION_BODY = f"""'def scale_' || n_nationkey || '(x):' || {NL} || '    return x'"""
CLASS_BODY = f"""'class Nation' || n_nationkey || '(Base):' || {NL} || '    \"\"\"Region ' || n_regionkey || '.\"\"\"' || {NL} || '    def scale(self):' || {NL} || '        return make_' || n_nationkey + 1 || '(1)'"""
TEST_BODY = f"""'def test_supplier_' || s_suppkey || '():' || {NL} || '    assert scale_' || s_suppkey % 25 || '(1) == 1'"""
PART_PATH, NATION_PATH, TEST_PATH = "'src/parts/p' || p_partkey % 10 || '/part_' || p_partkey || '.py'", "'src/lib/nation_' || n_nationkey || '.py'", "'tests/test_supplier_' || s_suppkey || '.py'"
FUNCTIONS = f"""
    SELECT 'function' AS type, 'make_' || p_partkey AS name, {PART_PATH} AS file_path, 4 AS start_line, CASE WHEN p_partkey % 3 <> 0 THEN 6 ELSE 5 END AS end_line,
        'def make_' || p_partkey || '(size: int, rate = 1.5) -> float' AS signature, {PART_BODY} AS content,
        CASE WHEN p_partkey % 3 <> 0 THEN 'Builds ' || p_brand || ' things.' ELSE substr({PART_BODY}, 1, 300) END AS docstring, ['scale_' || p_partkey % 25, 'check'] AS calls,
        'size: int, rate = 1.5' AS params, 'float' AS ret FROM part
    UNION ALL SELECT 'function', 'scale_' || n_nationkey, {NATION_PATH}, 7, 8, 'def scale_' || n_nationkey || '(x) -> None', {NATION_BODY}, {NATION_BODY}, []::VARCHAR[], 'x', 'None' FROM nation
    UNION ALL SELECT 'test', 'test_supplier_' || s_suppkey, {TEST_PATH}, 3, 4, 'def test_supplier_' || s_suppkey || '() -> None', {TEST_BODY}, {TEST_BODY}, ['scale_' || s_suppkey % 25], '', 'None' FROM supplier"""
CLASSES = f"""SELECT 'class' AS type, 'Nation' || n_nationkey AS name, {NATION_PATH} AS file_path, 1 AS start_line, 4 AS end_line, 'class Nation' || n_nationkey || '(Base)' AS signature, {CLASS_BODY} AS content,
        'Region ' || n_regionkey || '.' AS docstring, ['make_' || n_nationkey + 1] AS calls, NULL AS params, NULL AS ret FROM nation"""
OTHERS = f"""
    SELECT 'module' AS type, 'math' AS name, {PART_PATH} AS file_path, 1 AS start_line, 1 AS end_line, 'import math' AS signature FROM part
    UNION ALL SELECT 'constant', 'RATE_' || p_partkey, {PART_PATH}, 2, 2, 'RATE_' || p_partkey || ' = ' || p_size FROM part
    UNION ALL SELECT 'function', 'src.lib.scale_' || s_suppkey % 25, {TEST_PATH}, 1, 1, 'from src.lib import scale_' || s_suppkey % 25 FROM supplier
    UNION ALL SELECT 'entrypoint', 'test_supplier_' || s_suppkey || '.__main__', {TEST_PATH}, 6, 7, 'if __name__ == ''__main__''' FROM supplier"""
IDS = "substr(sha256(file_path || '::' || start_line || '::' || signature), 1, 32)"
CODE_SQL = f"(SELECT *, {IDS} AS id FROM ({FUNCTIONS} UNION ALL {CLASSES}))"


def capsules(spark, d):
    return python_capsules(source_files(spark, d))


def index(spark, d):
    """The stored capsules: files are extracted once, and requests read the columns they need."""
    path = stored(spark, f"capsules of {d}", lambda path: capsules(spark, d).write.parquet(path))
    return spark.read.schema(CAPSULE).parquet(path)


def code(spark, d, caps=None):
    """Functions, tests and classes only (imports of the same name left out)."""
    return (caps if caps is not None else index(spark, d)).where(C("type").isin("function", "test", "class") & ~F.contains("name", F.lit(".")))


@query("py_functions", f"SELECT id, type, name, file_path, start_line, end_line, signature, docstring, array_to_string(calls, ',') AS calls, params, ret, CAST(end_line - start_line + 1 AS VARCHAR) AS n_lines FROM {CODE_SQL} WHERE type <> 'class'")
def py_functions(spark, d):
    c = code(spark, d, capsules(spark, d)).where("type <> 'class'")
    return c.select("id", "type", "name", "file_path", "start_line", "end_line", "signature", "docstring", F.array_join("calls", ",").alias("calls"), prop("parametros").alias("params"), prop("tipo_retorno").alias("ret"), prop("lineas").alias("n_lines"))


@query("py_classes", f"SELECT id, name, file_path, start_line, end_line, signature, content, docstring, array_to_string(calls, ',') AS calls, 'scale' AS methods, 'Base' AS bases FROM {CODE_SQL} WHERE type = 'class'")
def py_classes(spark, d):
    c = capsules(spark, d).where("type = 'class'")
    return c.select("id", "name", "file_path", "start_line", "end_line", "signature", "content", "docstring", F.array_join("calls", ",").alias("calls"), prop("metodos").alias("methods"), prop("hereda_de").alias("bases"))


@query("py_imports", f"SELECT * FROM ({OTHERS})")
def py_imports(spark, d):
    c = capsules(spark, d).where("type in ('module', 'constant', 'entrypoint') or (type = 'function' and contains(name, '.'))")
    return c.select("type", "name", "file_path", "start_line", "end_line", "signature")


@query("py_header", f"""SELECT file_path, imports, constants FROM (SELECT {PART_PATH} AS file_path, 'math' AS imports, 'RATE_' || p_partkey AS constants FROM part UNION ALL SELECT {TEST_PATH}, 'src.lib', '' FROM supplier)""")
def py_header(spark, d):
    c = capsules(spark, d).where("type = 'file_header'")
    return c.select("file_path", F.array_join("imports", ",").alias("imports"), prop("constants").alias("constants"))


EDGES = f"(SELECT a.id AS src, b.id AS dst FROM (SELECT id, unnest(calls) AS callee FROM {CODE_SQL}) a JOIN {CODE_SQL} b ON a.callee = b.name)"


@query("call_graph", f"SELECT src, dst, 'LLAMA' AS type FROM {EDGES}")
def call_graph(spark, d):
    return G.call_edges(code(spark, d)).select("src", "dst", "type")


@query("called_by", f"SELECT dst AS id, string_agg(DISTINCT src, ',' ORDER BY src) AS called_by FROM {EDGES} GROUP BY dst")
def called_by(spark, d):
    return G.called_by(code(spark, d)).select("id", F.array_join("called_by", ",").alias("called_by"))


@query("name_resolution_last_wins", "SELECT p_name AS name, max(p_partkey) AS last, min(p_partkey) AS first FROM part GROUP BY p_name")
def name_resolution(spark, d):
    p = table(spark, d, "part").select(C("p_name").alias("name"), C("p_partkey").alias("id"), F.lit("f").alias("file_path"), C("p_partkey").alias("start_line"), F.lit(0).alias("seq"))
    return G.names(p).withColumnRenamed("target", "last").join(G.names(p, last=False).withColumnRenamed("target", "first"), "name")


@query("generic_extract")
def generic_extract(spark, d):
    """Pattern extraction over made-up files in many languages."""
    from lodeseek.plans.text_queries import CODE, LANGS

    lang = F.element_at(F.array(*[F.lit(x) for x in LANGS]), (C("p_partkey") % len(LANGS) + 1).cast("int"))
    files = table(spark, d, "part").select(F.concat(F.lit("g/f"), C("p_partkey").cast("string")).alias("file_path"), F.expr(CODE).alias("content"), lang.alias("language"))
    return generic_capsules(files).select("id", "type", "name", "language", "start_line", "end_line", "signature", F.array_join("calls", ",").alias("calls"))


@query("js_functions", """SELECT 'function' AS type, 'make' || p_partkey AS name, 2 AS start_line, 5 AS end_line, 'function make' || p_partkey || '(a)' AS signature, 'call_' || p_partkey % 9 || ',make' || p_partkey || ',other' AS calls FROM part""")
def js_functions(spark, d):
    from lodeseek.plans.text_queries import CODE

    files = table(spark, d, "part").select(F.concat(F.lit("g/f"), C("p_partkey").cast("string"), F.lit(".js")).alias("file_path"), F.expr(CODE).alias("content"), F.lit("javascript").alias("language"))
    return generic_capsules(files).select("type", "name", "start_line", "end_line", "signature", F.array_join("calls", ",").alias("calls"))


@query("markup_capsules", """SELECT 'pages/p' || page_id || '.html' AS file_path, 'p' || page_id || '.html' AS name, '[html] p' || page_id AS signature, substr(sha256('pages/p' || page_id || '.html::1::html_structure'), 1, 32) AS id, CAST(length(html) AS VARCHAR) AS chars FROM pages""")
def markup(spark, d):
    files = table(spark, d, "pages").select(F.concat(F.lit("pages/p"), C("page_id").cast("string"), F.lit(".html")).alias("file_path"), C("html").alias("content"), F.lit("html").alias("language"))
    return markup_capsules(files).select("file_path", "name", "signature", "id", prop("chars").alias("chars"))


# Framework rules, over rows that each hit one rule.
SNIPPETS = [
    ("python", "function", "@routes.get('/x')", "", "", "endpoint", "aiohttp"), ("python", "function", "x", "router.get('/a')", "", "endpoint", "fastapi"),
    ("python", "function", "x", "bp.route('/a')", "", "endpoint", "flask"), ("python", "class", "x", "", "BaseModel", "model", "pydantic"),
    ("python", "class", "x", "", "models.Model", "model", "django"), ("python", "class", "x", "", "db.Model", "model", "sqlalchemy"),
    ("python", "function", "@shared_task", "shared_task", "", "task", "celery"), ("python", "class", "x", "", "SQLModel", "model", "sqlmodel"),
    ("python", "class", "@strawberry.type", "strawberry.type", "", "schema", "strawberry"), ("javascript", "function", "app.get('/')", "", "", "endpoint", "express"),
    ("typescript", "class", "@Controller()", "", "", "controller", "nestjs"), ("java", "class", "@RestController", "", "", "controller", "spring"),
    ("php", "function", "Route::get('/')", "", "", "endpoint", "laravel"), ("csharp", "class", "[ApiController]", "", "", "controller", "dotnet"),
    ("go", "function", "func h(c *gin.Context)", "", "", "endpoint", "gin"), ("go", "function", "echo.New()", "", "", "function", "echo"),
    ("rust", "function", "#[get(\"/\")]", "", "", "endpoint", "actix"), ("rust", "function", "axum::Router", "", "", "function", "axum"),
    ("ruby", "class", "class A < ApplicationRecord", "", "", "model", "rails"), ("ruby", "function", "get '/x' do", "", "", "endpoint", "sinatra"),
    ("elixir", "function", "use Phoenix.Controller", "", "", "function", "phoenix"), ("kotlin", "class", "@Entity", "", "", "model", "hibernate"),
    ("javascript", "function", "const a = useFetch(", "", "", "component", "nuxt"), ("python", "function", "plain", "", "", "function", ""),
]


def _snips() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({i}, {', '.join(q(x) for x in row)})" for i, row in enumerate(SNIPPETS))


@query("framework_rules", f"SELECT p_partkey, type, framework FROM part JOIN (SELECT * FROM (VALUES {_snips()}) AS t(i, language, kind, content, deco, base, type, framework)) ON p_partkey % {len(SNIPPETS)} = i")
def framework_rules(spark, d):
    rows = spark.createDataFrame([(i, *r[:5]) for i, r in enumerate(SNIPPETS)], "i int, language string, type string, content string, deco string, base string")
    caps = table(spark, d, "part").select("p_partkey").join(F.broadcast(rows), C("p_partkey") % len(SNIPPETS) == C("i"))
    pair = lambda k, v: F.struct(F.lit(k).alias("k"), C(v).alias("v"))
    caps = caps.withColumn("properties", F.array(pair("decorators", "deco"), pair("hereda_de", "base"))).withColumn("name", F.lit("handler")).withColumn("file_path", F.lit("a/b"))
    return detect_frameworks(caps).select("p_partkey", "type", "framework")


# Graph of keys: lineitem -> order -> customer -> nation -> region, and lineitem -> part.
KEYS_SQL = """(SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'HEREDA' AS type FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'USA' FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'DEFINE' FROM nation
    UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'LLAMA' FROM lineitem)"""
NODES_SQL = """(SELECT 'c' || c_custkey AS id, c_name AS name, 'customer' AS type FROM customer UNION ALL SELECT 'n' || n_nationkey, n_name, 'nation' FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, 'region' FROM region UNION ALL SELECT 'p' || p_partkey, p_name, 'part' FROM part)"""


def _s(prefix: str, col: str):
    return F.concat(F.lit(prefix), C(col).cast("string"))


def key_edges(spark, d):
    t = lambda n: table(spark, d, n)
    parts = [("orders", "o", "o_orderkey", "c", "o_custkey", "HEREDA"), ("customer", "c", "c_custkey", "n", "c_nationkey", "USA"), ("nation", "n", "n_nationkey", "r", "n_regionkey", "DEFINE"), ("lineitem", "o", "l_orderkey", "p", "l_partkey", "LLAMA")]
    frames = [t(n).select(_s(a, x).alias("src"), _s(b, y).alias("dst"), F.lit(k).alias("type")) for n, a, x, b, y, k in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


def key_nodes(spark, d):
    parts = [("customer", "c", "c_custkey", "c_name"), ("nation", "n", "n_nationkey", "n_name"), ("region", "r", "r_regionkey", "r_name"), ("part", "p", "p_partkey", "p_name")]
    frames = [table(spark, d, n).select(_s(a, k).alias("id"), C(v).alias("name"), F.lit(n).alias("type")) for n, a, k, v in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


def seeds(spark, d):
    return table(spark, d, "orders").select(_s("o", "o_orderkey").alias("seed"))


REACH = f"""r(seed, node, level) AS (SELECT 'o' || o_orderkey, 'o' || o_orderkey, 0 FROM orders UNION ALL SELECT r.seed, e.dst, r.level + 1 FROM r JOIN {KEYS_SQL} e ON r.node = e.src WHERE r.level < 3)"""


@query("bfs_levels", f"WITH RECURSIVE {REACH} SELECT seed, node, min(level) AS level FROM r GROUP BY seed, node")
def bfs_levels(spark, d):
    return G.bfs(key_edges(spark, d), seeds(spark, d), 3)


@query("bfs_nodes", f"WITH RECURSIVE {REACH} SELECT id, name, type, level FROM (SELECT node, min(level) AS level FROM r WHERE level <= 2 GROUP BY node) JOIN {NODES_SQL} ON id = node")
def bfs_nodes(spark, d):
    return G.subgraph(key_nodes(spark, d), key_edges(spark, d), seeds(spark, d), 2)[0].select("id", "name", "type", "level")


@query("bfs_edges", f"WITH RECURSIVE {REACH} SELECT DISTINCT src, type, dst FROM {KEYS_SQL} WHERE src IN (SELECT node FROM r GROUP BY node HAVING min(level) < 2)")
def bfs_edges(spark, d):
    return G.subgraph(key_nodes(spark, d), key_edges(spark, d), seeds(spark, d), 2)[1]


@query(
    "expand_seeds",
    f"""WITH RECURSIVE r(seed, node, level) AS (SELECT 'c' || c_custkey, 'c' || c_custkey, 0 FROM customer UNION ALL SELECT r.seed, e.dst, r.level + 1 FROM r JOIN {KEYS_SQL} e ON r.node = e.src WHERE r.level < 2),
        f AS (SELECT node AS id, min(CAST(substr(seed, 2) AS BIGINT) * 10 + level) AS f FROM r GROUP BY node),
        g AS (SELECT id, f // 10 AS place, CAST(f % 10 AS INT) AS level FROM f WHERE id IN (SELECT id FROM {NODES_SQL})),
        t AS (SELECT place, sum(n) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT place, count(*) AS n FROM g GROUP BY place))
        SELECT id, place, level FROM g JOIN t USING (place) WHERE coalesce(before, 0) < 200""",
)
def expand_seeds(spark, d):
    s = table(spark, d, "customer").select(_s("c", "c_custkey").alias("seed"), C("c_custkey").alias("place"))
    return G.expand(key_nodes(spark, d), key_edges(spark, d), s, 2).select("id", "place", "level")


@query("relation_filter", f"SELECT id, name FROM {NODES_SQL} WHERE id IN (SELECT src FROM {KEYS_SQL} WHERE type IN ('USA', 'DEFINE') UNION SELECT dst FROM {KEYS_SQL} WHERE type IN ('USA', 'DEFINE')) OR id = 'p1'")
def relation_filter(spark, d):
    start = table(spark, d, "part").where("p_partkey = 1").select(_s("p", "p_partkey").alias("seed"))
    return G.filter_by_relation(key_nodes(spark, d), key_edges(spark, d), start, ["USA", "DEFINE"])[0].select("id", "name")


@query("relation_edges", f"SELECT type, count(*) AS n FROM {KEYS_SQL} WHERE type IN ('USA', 'DEFINE') GROUP BY type")
def relation_edges(spark, d):
    start = table(spark, d, "part").where("p_partkey = 1").select(_s("p", "p_partkey").alias("seed"))
    return G.filter_by_relation(key_nodes(spark, d), key_edges(spark, d), start, ["USA", "DEFINE"])[1].groupBy("type").agg(F.count("*").alias("n"))


# Rendering.
@query("serialize_nodes", """SELECT id, '[' || name || '|supplier]' || ' balance=' || CASE WHEN length(v) > 120 THEN substr(v, 1, 117) || '...' ELSE v END || CASE WHEN nk <> 0 THEN ', valor=' || nk ELSE '' END AS line
    FROM (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nk, repeat(s_name || ' ', 1 + s_suppkey::INT % 9) || 'x' AS v FROM supplier)""")
def serialize_nodes(spark, d):
    v = F.concat(F.repeat(F.concat("s_name", F.lit(" ")), (1 + C("s_suppkey") % 9).cast("int")), F.lit("x"))
    n = table(spark, d, "supplier").select(C("s_suppkey").alias("id"), C("s_name").alias("name"), F.lit("supplier").alias("type"), R.pairs(balance=v, status=F.lit("hidden"), docstring=F.lit("")).alias("properties"), C("s_nationkey").alias("valor"))
    return R.serialize_nodes(n)


@query("serialize_edges", f"""SELECT e.src, e.dst, '[' || coalesce(a.name, substr(e.src, 1, 12)) || ']-[' || e.type || ']-[' || coalesce(b.name, substr(e.dst, 1, 12)) || ']' AS line FROM {KEYS_SQL} e LEFT JOIN {NODES_SQL} a ON a.id = e.src LEFT JOIN {NODES_SQL} b ON b.id = e.dst WHERE e.type <> 'LLAMA'""")
def serialize_edges(spark, d):
    return R.edge_lines(key_edges(spark, d).where("type <> 'LLAMA'"), key_nodes(spark, d)).select("src", "dst", "line")


def top_parts(spark, d, n=20):
    """The first parts' functions, ranked by key."""
    caps = code(spark, d)
    key = F.regexp_extract("name", r"^make_(\d+)$", 1)
    top = caps.where(key != "").withColumn("k", key.cast("long")).where(C("k") < n)
    return top.withColumn("place", F.row_number().over(Window.orderBy("k"))).drop("k"), caps


def _clip(x: str) -> str:
    x = f"trim(replace({x}, chr(10), ' '))"
    return f"CASE WHEN length({x}) > 120 THEN substr({x}, 1, 117) || '...' ELSE {x} END"


def _node(*props: tuple[str, str]) -> str:
    shown = ", ".join(f"'{k}=' || nullif({_clip(v)}, '')" for k, v in props)
    return f"'[' || name || '|' || type || '] ' || concat_ws(', ', {shown})"


FACTS = [("signature", "signature"), ("file_path", "file_path"), ("docstring", "docstring")]
CALLS8 = ("calls", "array_to_string(calls[1:8], ', ')")
TOP_SQL = f"(SELECT *, row_number() OVER (ORDER BY CAST(substr(name, 6) AS BIGINT)) AS place FROM {CODE_SQL} WHERE name LIKE 'make\\_%' ESCAPE '\\' AND CAST(substr(name, 6) AS BIGINT) < 20)"
PARAMS, RET, LINES = ("parametros", "params"), ("tipo_retorno", "ret"), ("lineas", "CAST(end_line - start_line + 1 AS VARCHAR)")
ADV = {k: "'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for k, v in R.ADVICE.items()}
ZERO = "lpad(CAST({} AS VARCHAR), 12, '0')"


@query(
    "render_query",
    f"""WITH b AS (SELECT *, '[' || name || '|' || type || '] ' || file_path || {NL} || '```' || {NL} || content || {NL} || '```' AS body FROM {TOP_SQL}),
        c AS (SELECT *, CASE WHEN place = 1 THEN length(body) ELSE length(name) + length(signature) + length(docstring) END AS cost FROM b),
        r AS (SELECT *, sum(cost) OVER (ORDER BY place) AS run FROM c),
        l AS (SELECT string_agg(CASE WHEN place = 1 THEN body ELSE {_node(*FACTS, CALLS8, PARAMS, RET)} END, {NL} ORDER BY place) AS x FROM r WHERE run <= 2000),
        e AS (SELECT string_agg('[' || name || ']-[LLAMA]-[' || call || ']', {NL} ORDER BY place, pos) AS y FROM (SELECT place, name, unnest(calls[1:5]) AS call, generate_subscripts(calls[1:5], 1) AS pos FROM {TOP_SQL} ORDER BY place, pos LIMIT 5))
        SELECT x || {NL} || '---' || {NL} || y AS context FROM l, e""",
)
def render_query(spark, d):
    return R.query(top_parts(spark, d)[0], 500)


@query("render_edit", f"SELECT string_agg({_node(*FACTS, PARAMS, LINES)}, {NL} ORDER BY place) || {ADV['code_edit']} AS context FROM {TOP_SQL} WHERE place <= 5")
def render_edit(spark, d):
    return R.code_edit(top_parts(spark, d)[0])


CALLEES = f"(SELECT 1 AS part, {ZERO.format('pos - 1')} AS o, b.* FROM (SELECT unnest(calls) AS callee, generate_subscripts(calls, 1) AS pos FROM {TOP_SQL} WHERE place = 1) t JOIN {CODE_SQL} b ON b.name = t.callee)"
CALLERS = f"(SELECT 2 AS part, file_path AS o, c.* FROM {CODE_SQL} c WHERE list_contains(calls, (SELECT name FROM {TOP_SQL} WHERE place = 1)))"


def _agg(parts: list[str], tail: str = "''") -> str:
    return f"SELECT string_agg(line, {NL} ORDER BY part, o) || {tail} AS context FROM ({' UNION ALL '.join(parts)})"


@query("render_refactor", _agg([f"SELECT 0 AS part, '' AS o, {_node(*FACTS, PARAMS)} AS line FROM {TOP_SQL} WHERE place = 1", f"SELECT part, o, {_node(*FACTS)} AS line FROM {CALLEES}", f"SELECT part, o, {_node(*FACTS)} AS line FROM {CALLERS}"]))
def render_refactor(spark, d):
    return R.refactor(*top_parts(spark, d))


@query("render_debug", _agg([f"SELECT 0 AS part, '' AS o, {_node(*FACTS, ('content', 'content'), PARAMS, RET, LINES)} AS line FROM {TOP_SQL} WHERE place = 1", f"SELECT part, o, {_node(*FACTS, PARAMS)} AS line FROM {CALLEES}", f"(SELECT part, o, {_node(*FACTS, CALLS8)} AS line FROM {CALLERS} ORDER BY o LIMIT 5)"], ADV["debug"]))
def render_debug(spark, d):
    return R.debug(*top_parts(spark, d))


@query("render_review", _agg([f"SELECT 0 AS part, '' AS o, {_node(*FACTS, PARAMS, RET, LINES, CALLS8)} AS line FROM {TOP_SQL} WHERE place = 1", f"SELECT 1 AS part, {ZERO.format('place')} AS o, {_node(*FACTS, CALLS8)} AS line FROM {TOP_SQL} WHERE place BETWEEN 2 AND 10"], ADV["review"]))
def render_review(spark, d):
    return R.review(top_parts(spark, d)[0])


@query("render_optimize", f"""WITH r AS (SELECT *, sum(length(signature) + length(file_path) + length(docstring) + length(content) + length(array_to_string(calls[1:8], ', '))) OVER (ORDER BY place) AS run FROM {TOP_SQL})
    SELECT string_agg({_node(*FACTS, LINES, CALLS8, ('content', 'content'))}, {NL} ORDER BY place) || {ADV['optimize']} AS context FROM (SELECT * FROM r WHERE run <= 6000 ORDER BY place LIMIT 5)""")
def render_optimize(spark, d):
    return R.optimize(top_parts(spark, d)[0])


@query("render_audit", f"SELECT string_agg({_node(*FACTS, PARAMS, CALLS8)}, {NL} ORDER BY place) || {ADV['audit']} AS context FROM {TOP_SQL} WHERE place <= 10")
def render_audit(spark, d):
    return R.audit(top_parts(spark, d)[0])


@query(
    "render_testgen",
    f"""WITH n AS (SELECT count(*) AS n FROM supplier) SELECT context || CASE WHEN n > 0 THEN ' Hay ' || n || ' tests en el repo. Lee los mas relevantes con read_file.' ELSE '' END AS context FROM n, ("""
    + _agg(
        [
            f"SELECT 0 AS part, '' AS o, {_node(*FACTS, PARAMS, RET, CALLS8)} AS line FROM {TOP_SQL} WHERE place = 1",
            "SELECT 1, '', '[__tests__|section] descripcion=' || count(*) || ' tests existentes en el repo' FROM supplier",
            f"(SELECT 2, file_path, {_node(*FACTS)} FROM (SELECT * REPLACE ('function' AS type) FROM {CODE_SQL} WHERE type = 'test') ORDER BY file_path LIMIT 8)",
        ],
        ADV["test_gen"],
    )
    + ")",
)
def render_testgen(spark, d):
    top, every = top_parts(spark, d)
    return R.test_gen(top, every.withColumn("type", F.when(C("type") == "test", "function").otherwise(C("type"))))


DIRS = f"(SELECT regexp_replace(file_path, '/[^/]*$', '') AS dir, count(*) AS n FROM {CODE_SQL} GROUP BY 1)"


@query("render_onboard", f"""SELECT 'ESTRUCTURA DEL PROYECTO:' || {NL} || (SELECT string_agg('  ' || dir || '/ (' || n || ' archivos)', {NL} ORDER BY dir) FROM {DIRS}) || {NL} || {NL} || 'Total: ' || (SELECT count(*) FROM {CODE_SQL}) || ' capsulas, ' || (SELECT count(*) FROM {DIRS}) || ' modulos' || {NL} || 'Usa search_code y list_files para explorar en detalle.' AS context""")
def render_onboard(spark, d):
    return R.onboard(code(spark, d))


@query("dir_rollup", f"SELECT dir, count(*) AS n FROM (SELECT array_to_string(p[1:i], '/') AS dir FROM (SELECT string_split(file_path, '/') AS p FROM {CODE_SQL}), unnest(range(1, len(p))) AS t(i)) GROUP BY dir")
def dir_rollup(spark, d):
    return R.ancestors(code(spark, d))


@query(
    "code_tree",
    f"""SELECT 0 AS part, '' AS o, 'Estructura del repositorio:' AS line
        UNION ALL SELECT DISTINCT 1, dir, '  ' || dir || '/' FROM (SELECT array_to_string(p[1:i], '/') AS dir FROM (SELECT string_split(file_path, '/') AS p FROM {CODE_SQL}), unnest(range(1, len(p))) AS t(i))
        UNION ALL SELECT DISTINCT 2, file_path, '  ' || file_path || ' (python)' FROM {CODE_SQL}
        UNION ALL SELECT 3, '', {NL} || 'Total: ' || count(DISTINCT file_path) || ' archivos, ' || count(*) || ' capsulas' FROM {CODE_SQL}
        UNION ALL SELECT 4, '', 'Usa search_code para explorar el codigo si necesitas detalles.'""",
)
def code_tree(spark, d):
    return R.code_tree(code(spark, d))


@query(
    "render_search_counts",
    f"SELECT 'RESUMEN: ' || count(*) FILTER (WHERE docstring = '') || ' funciones/clases SIN docstring, ' || count(*) FILTER (WHERE docstring <> '') || ' CON docstring.' AS head, 'Total: ' || (SELECT count(*) FROM {CODE_SQL}) || ' capsulas en ' || (SELECT count(DISTINCT file_path) FROM {CODE_SQL}) || ' archivos' AS tail FROM {CODE_SQL} WHERE type IN ('function', 'class')",
)
def render_search_counts(spark, d):
    got = R.search_map(*top_parts(spark, d), 500)
    lines = F.split("context", "\n")
    return got.select(F.element_at(lines, 1).alias("head"), F.element_at(lines, -1).alias("tail"))


@query("render_search")
def render_search(spark, d):
    return R.search_map(*top_parts(spark, d), 500)


@query("render_design")
def render_design(spark, d):
    files = table(spark, d, "pages").select(F.concat(F.lit("pages/p"), F.lpad(C("page_id").cast("string"), 6, "0"), F.lit(".html")).alias("file_path"), C("html").alias("content"), F.lit("html").alias("language"))
    pages = markup_capsules(files)
    return R.design_review(pages.limit(0).withColumn("place", F.lit(1)), pages)


@query("render_nocode", f"""WITH t AS (SELECT doc_id, 'doc_' || doc_id AS name, 'docs/' || source || '/doc_' || doc_id || '.txt' AS file_path, trim(text) AS b FROM documents ORDER BY length(text), doc_id LIMIT 1)
    SELECT '[' || name || '|doc] ' || file_path || {NL} || b AS context FROM t""")
def render_nocode(spark, d):
    docs = documents(spark, d).withColumn("k", F.regexp_extract("name", r"(\d+)$", 1).cast("long"))
    return R.compress(docs.orderBy(F.length("content"), "k").limit(1).withColumn("place", F.lit(1)).drop("k"), docs, 6000, "no_code")


@query("render_dispatch", f"SELECT 'ARCHIVOS: ' || (SELECT string_agg(file_path, ', ' ORDER BY place) FROM {TOP_SQL} WHERE place <= 8) || {NL} || {NL} || string_agg({_node(*FACTS, PARAMS, CALLS8)}, {NL} ORDER BY place) || {ADV['audit']} AS context FROM {TOP_SQL} WHERE place <= 10")
def render_dispatch(spark, d):
    top, every = top_parts(spark, d)
    return R.compress(top, every, 1000, "audit", "check the security")


@query("budget_prefix", "SELECT doc_id FROM (SELECT doc_id, sum(length(text)) OVER (ORDER BY doc_id) AS run FROM documents) WHERE run <= 20000")
def budget_prefix(spark, d):
    docs = table(spark, d, "documents").select("doc_id", C("doc_id").alias("place"), F.length("text").alias("n"))
    return running.within(docs, "place", C("n"), 20000).select("doc_id")


@query("index_stats", f"SELECT grouping, key, n, files FROM (SELECT 'all' AS grouping, '' AS key, count(*) AS n, count(DISTINCT file_path) AS files FROM {CODE_SQL} UNION ALL SELECT 'type', type, count(*), count(DISTINCT file_path) FROM {CODE_SQL} GROUP BY type UNION ALL SELECT 'language', 'python', count(*), count(DISTINCT file_path) FROM {CODE_SQL})")
def index_stats(spark, d):
    c = code(spark, d).groupingSets([[], ["type"], ["language"]], "type", "language").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.countDistinct("file_path").alias("files"))
    return c.select(F.when(C("g") == 3, "all").when(C("g") == 1, "type").otherwise("language").alias("grouping"), F.when(C("g") == 3, "").when(C("g") == 1, C("type")).otherwise(C("language")).alias("key"), "n", "files")


@query("type_filter", f"SELECT type, docstring <> '' AS documented, count(*) AS n FROM {CODE_SQL} WHERE type IN ('function', 'class') GROUP BY ALL")
def type_filter(spark, d):
    return code(spark, d).where(C("type").isin("function", "class")).groupBy("type", (F.coalesce("docstring", F.lit("")) != "").alias("documented")).agg(F.count("*").alias("n"))


@query("search_projection", f"SELECT id, name, type, file_path, start_line, signature FROM {CODE_SQL} WHERE file_path LIKE 'src/lib/%'")
def search_projection(spark, d):
    return code(spark, d).where(F.startswith("file_path", F.lit("src/lib/"))).select("id", "name", "type", "file_path", "start_line", "signature")


# Evaluation.
CRITERIA = ["the", "Thing", "über", "nation", "ésta"]


@query("criteria_score", "SELECT doc_id, round(len(list_filter(['the','thing','uber','nation','esta'], lambda c: contains(strip_accents(lower(text)), c)))::DOUBLE / 5, 2) AS score FROM documents")
def criteria_score(spark, d):
    return table(spark, d, "documents").select("doc_id", E.criteria_score(C("text"), F.array(*[F.lit(c) for c in CRITERIA])).alias("score"))


NAMED = "(SELECT p_partkey AS id, split_part(p_name, ' ', 2) AS name FROM part)"
EVI_SQL = f"""(SELECT conv_id, turn, node_id, name, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(name) DESC, low) AS place FROM (SELECT conv_id, turn, lower(text) || ' ' || ['a bolt','ring and gear','widget','none'][conv_id % 4 + 1] AS a FROM conversations),
    (SELECT lower(name) AS low, max(id) AS node_id, max_by(name, id) AS name FROM {NAMED} WHERE length(name) >= 2 GROUP BY 1) WHERE contains(a, low))"""


ANSWER = ["conv_id", "turn"]


def _evidence(spark, d):
    nodes = table(spark, d, "part").select(C("p_partkey").alias("id"), F.element_at(F.split("p_name", " "), 2).alias("name"))
    extra = F.element_at(F.array(*[F.lit(x) for x in ("a bolt", "ring and gear", "widget", "none")]), (C("conv_id") % 4 + 1).cast("int"))
    answers = table(spark, d, "conversations").select(*ANSWER, F.concat("text", F.lit(" "), extra).alias("answer"))
    return E.evidence(answers, nodes, ANSWER, "answer"), nodes


@query("evidence", f"SELECT * FROM {EVI_SQL}")
def evidence(spark, d):
    return _evidence(spark, d)[0]


@query("uncited", f"SELECT conv_id, turn, (SELECT count(*) FROM {NAMED}) - count(DISTINCT node_id) AS n FROM {EVI_SQL} GROUP BY conv_id, turn HAVING n > 0")
def uncited(spark, d):
    found, nodes = _evidence(spark, d)
    return E.uncited_counts(nodes, found, ANSWER)


@query("grounding", f"SELECT conv_id, turn, count(*) AS cited, count(*) AS verified, round(count(*)::DOUBLE / (SELECT count(*) FROM {NAMED}), 3) AS score, CASE WHEN round(count(*)::DOUBLE / (SELECT count(*) FROM {NAMED}), 3) < 0.70 THEN 'low' ELSE 'ok' END AS level FROM {EVI_SQL} GROUP BY conv_id, turn")
def grounding(spark, d):
    found, nodes = _evidence(spark, d)
    return E.grounding(found, nodes, ANSWER)
