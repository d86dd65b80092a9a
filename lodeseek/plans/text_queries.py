"""Queries over documents, conversations, embeddings and pages."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeseek.functions import tasks as K
from lodeseek.functions.text import clip, strip
from lodeseek.operators import extract_markup as M
from lodeseek.operators import fusion, lexical, vectors
from lodeseek.operators import extract_generic as X
from lodeseek.operators.graph import find_by_name
from lodeseek.plans.registry import query, table
from lodeseek.sources.shared import stored
from lodeseek.schema import prop
from lodeseek.sources import files as S

C = F.col


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def any_sql(col: str, words) -> str:
    return f"len(list_filter([{quoted(words)}], lambda w: contains({col}, w))) > 0"


def edge_sql(col: str, word: str) -> str:
    import re

    return f"regexp_matches({col}, '(^|[^\\p{{L}}\\p{{N}}_]){re.escape(word).replace(chr(39), chr(39) * 2)}($|[^\\p{{L}}\\p{{N}}_])')"


def count_sql(col: str, words) -> str:
    return " + ".join(f"CAST({edge_sql(col, w)} AS INT)" for w in words)


BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"
DOC_PATH_SQL = "'docs/' || source || '/doc_' || doc_id || '.txt'"


def documents(spark, d):
    docs = table(spark, d, "documents")
    path = F.concat(F.lit("docs/"), "source", F.lit("/doc_"), C("doc_id").cast("string"), F.lit(".txt"))
    name = F.concat(F.lit("doc_"), C("doc_id").cast("string"))
    return M.document_capsules(docs, path, name, C("text"), C("lang"))


@query(
    "doc_capsules",
    f"""SELECT substr(sha256({DOC_PATH_SQL} || '::1::[doc] doc_' || doc_id), 1, 32) AS id, 'document' AS type, 'doc_' || doc_id AS name, {DOC_PATH_SQL} AS file_path,
        length(text) - length(replace(text, chr(10), '')) + 1 AS end_line, lang AS language, md5(trim(text, {BLANKS})) AS content_md5,
        substr(trim(text, {BLANKS}), 1, 300) AS docstring, CAST(length(text) AS VARCHAR) AS chars FROM documents""",
)
def doc_capsules(spark, d):
    return documents(spark, d).select("id", "type", "name", "file_path", "end_line", "language", F.md5(C("content").cast("binary")).alias("content_md5"), "docstring", prop("chars").alias("chars"))


EXT_SQL = "CASE " + " ".join(f"WHEN e IN ({quoted(v)}) THEN '{k}'" for k, v in S.EXTENSIONS.items()) + " ELSE 'text' END"


def paths(spark, d):
    p = table(spark, d, "part")
    exts = F.array(*[F.lit(x) for x in ("py", "JS", "tsx", "go", "rs", "txt", "md", "png", "css", "html", "unknown", "R", "jl", "sql")])
    dirs = F.array(*[F.lit(x) for x in ("src", "docs", "node_modules/x", "build", "data", "lib/.git", "app")])
    k = C("p_partkey")
    return p.select("p_partkey", F.concat(F.element_at(dirs, (k % 7 + 1).cast("int")), F.lit("/"), F.lower(F.regexp_replace("p_brand", "#", "")), F.lit("/f"), k.cast("string"), F.lit("."), F.element_at(exts, (k % 14 + 1).cast("int"))).alias("path"))


PATHS_SQL = """SELECT p_partkey, ['src','docs','node_modules/x','build','data','lib/.git','app'][p_partkey % 7 + 1] || '/' || lower(replace(p_brand, '#', '')) || '/f' || p_partkey || '.' ||
    ['py','JS','tsx','go','rs','txt','md','png','css','html','unknown','R','jl','sql'][p_partkey % 14 + 1] AS path FROM part"""


@query("lang_detect", f"SELECT p_partkey, path, {EXT_SQL} AS language FROM (SELECT *, regexp_extract(lower(path), '\\.([^./]+)$', 1) AS e FROM ({PATHS_SQL}))")
def lang_detect(spark, d):
    return paths(spark, d).withColumn("language", S.detect_language(C("path")))


@query(
    "path_prune",
    f"""SELECT p_partkey, path FROM (SELECT *, string_split(path, '/') AS parts FROM ({PATHS_SQL}))
        WHERE NOT list_has_any(parts, [{quoted(S.PRUNED)}]) AND (NOT lower(path) LIKE '%.txt' OR list_has_any(string_split(lower(path), '/'), [{quoted(S.DOCUMENT_DIRS)}]))""",
)
def path_prune(spark, d):
    return paths(spark, d).where(S.admitted(C("path")))


@query("list_files", f"SELECT p_partkey, path FROM ({PATHS_SQL}) WHERE len(string_split(path, '/')) <= 3 AND list_extract(string_split(path, '/'), -1) LIKE 'f%.py'")
def list_files(spark, d):
    return S.list_files(paths(spark, d), "path", 3, "f*.py")


@query("repo_filter", f"SELECT p_partkey, path FROM ({PATHS_SQL}) WHERE path = 'src' OR starts_with(path, 'src/')")
def repo_filter(spark, d):
    return paths(spark, d).where(S.in_repo(C("path"), F.lit("src")))


@query(
    "dir_filter",
    f"SELECT p_partkey, path FROM ({PATHS_SQL}) WHERE contains('/' || lower(path), '/src/') OR contains('/' || lower(path), '/brand2/')",
)
def dir_filter(spark, d):
    dirs = fusion.directories("what is in src/ and brand2/?")
    return paths(spark, d).where(F.exists(F.array(*[F.lit(f"/{x}/") for x in dirs]), lambda x: F.contains(F.concat(F.lit("/"), F.lower("path")), x)))


@query(
    "keyword_documents",
    f"SELECT doc_id, lang FROM documents WHERE {any_sql('lower(text)', ['with', 'schön', 'thing'])}",
)
def keyword_documents(spark, d):
    docs = table(spark, d, "documents").withColumn("file_path", C("doc_id"))
    return K.no_code_documents(docs, "que es with schön el thing", "text").select("doc_id", "lang")


@query("find_by_name", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE contains(lower(c_name), '7') ORDER BY id LIMIT 5")
def named(spark, d):
    nodes = table(spark, d, "customer").select(C("c_custkey").alias("id"), C("c_name").alias("name"))
    return find_by_name(nodes, "7")


@query("grep_lines", """SELECT doc_id, line_no, substr(trim(line), 1, 120) AS line FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
        WHERE contains(lower(line), 'license') ORDER BY doc_id, line_no LIMIT 20""")
def grep_lines(spark, d):
    return S.grep(table(spark, d, "documents"), "License", "doc_id", "text")


@query("clip_text", "SELECT doc_id, CASE WHEN length(text) > 120 THEN substr(text, 1, 117) || '...' ELSE text END AS short, length(text) // 2 AS half, length(text) // 4 AS quarter FROM documents")
def clip_text(spark, d):
    from lodeseek.operators.service import token_estimates

    half, quarter = token_estimates(C("text"))
    return table(spark, d, "documents").select("doc_id", clip(C("text")).alias("short"), half.alias("half"), quarter.alias("quarter"))


# Requests: whole conversation texts with signal words mixed in, so that every class occurs.
ASKS = [s for v in K.TASK_SIGNALS.values() for s in v[:6]] + ["", "fastapi", "login page", "snake_case_name", "camelCase", "rediseñar", "imports usa hereda", "spring boot", "next.js", "summarize"]


def requests(spark, d):
    ask = F.array(*[F.lit(a) for a in ASKS])
    i = ((C("conv_id") * 7 + C("turn")) % len(ASKS) + 1).cast("int")
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.element_at(ask, i), F.lit(" "), C("text")).alias("q"))


REQ_SQL = f"SELECT conv_id, turn, [{quoted(ASKS)}][(conv_id * 7 + turn) % {len(ASKS)} + 1] || ' ' || text AS q FROM conversations"
NEEDS_SQL = f"({any_sql('lower(q)', K.CODE_SIGNALS)} OR regexp_matches(q, '[\\p{{L}}\\p{{N}}_]+_[\\p{{L}}\\p{{N}}_]+') OR regexp_matches(q, '{K.CAMEL}'))"
TASK_SQL = f"""SELECT conv_id, turn, q, CASE WHEN list_max(n) > 0 THEN [{quoted(K.TASK_SIGNALS)}][list_position(n, list_max(n))] WHEN {NEEDS_SQL} THEN 'code_query' ELSE 'no_code' END AS task
    FROM (SELECT *, [{', '.join(f"({count_sql('lower(q)', v)})" for v in K.TASK_SIGNALS.values())}] AS n FROM ({REQ_SQL}))"""
BUDGET_SQL = "CASE task " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in K.TOKEN_BUDGET.items()) + " END"


@query("classify_task", TASK_SQL)
def classify_task(spark, d):
    return K.classify_task(requests(spark, d), "q")


@query("needs_code", f"SELECT conv_id, turn, {NEEDS_SQL} AS needs_code FROM ({REQ_SQL})")
def needs_code(spark, d):
    return requests(spark, d).select("conv_id", "turn", K.needs_code(C("q")).alias("needs_code"))


@query("budget", f"SELECT conv_id, turn, task, {BUDGET_SQL} AS budget FROM ({TASK_SQL})")
def budget(spark, d):
    return K.classify_task(requests(spark, d), "q").select("conv_id", "turn", "task", K.budget(C("task")).alias("budget"))


@query(
    "complexity",
    "SELECT conv_id, turn, CASE " + " ".join(f"WHEN {any_sql('lower(q)', v)} THEN '{k}'" for k, v in K.COMPLEXITY.items()) + f" ELSE 'medium' END AS complexity FROM ({REQ_SQL})",
)
def complexity(spark, d):
    return requests(spark, d).select("conv_id", "turn", K.complexity(C("q")).alias("complexity"))


def _frame_sql(hit) -> str:
    return "CASE " + " ".join(f"WHEN {hit(v)} THEN '{k}'" for k, v in K.FRAMEWORK_QUERIES.items()) + " ELSE '' END"


@query("framework_mention", f"SELECT conv_id, turn, {_frame_sql(lambda v: '(' + count_sql('lower(q)', v) + ') > 0')} AS framework, {_frame_sql(lambda v: any_sql('lower(q)', v))} AS framework_substring FROM ({REQ_SQL})")
def framework_mention(spark, d):
    return requests(spark, d).select("conv_id", "turn", K.framework_mention(C("q")).alias("framework"), K.framework_mention(C("q"), False).alias("framework_substring"))


@query("relation_detect", f"""SELECT conv_id, turn, coalesce((SELECT string_agg(DISTINCT r, ',' ORDER BY r) FROM (VALUES {', '.join(f"('{k}', '{v}')" for k, v in K.RELATIONS.items())}) AS t(k, r) WHERE contains(lower(q), k)), '') AS relations FROM ({REQ_SQL})""")
def relation_detect(spark, d):
    return requests(spark, d).select("conv_id", "turn", F.array_join(K.relations(C("q")), ",").alias("relations"))


WORDS_SQL = """list_sort(list_distinct(list_concat(w, list_filter(flatten(list_transform(w, lambda x: string_split(x, '_'))), lambda x: length(x) >= 4))))"""


@query("query_words", f"SELECT conv_id, turn, array_to_string({WORDS_SQL}, ' ') AS words FROM (SELECT *, list_distinct(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}_]{{4,}}')) AS w FROM ({REQ_SQL}))")
def words_of_query(spark, d):
    return requests(spark, d).select("conv_id", "turn", F.array_join(K.query_words(C("q")), " ").alias("words"))


SKILLS = [
    ("debugging", 5, ["debug"], ["crash", "traceb.ck"], ["log"]),
    ("testing", 9, ["test_gen"], ["tests?\\b", "pytest"], ["py"]),
    ("reviewing", 7, ["review", "audit"], ["revis", "security"], []),
    ("writing", 1, ["code_gen", "code_edit"], ["crea", "build"], ["py", "js"]),
    ("tour", 3, ["onboard"], ["guide", "overview"], ["md"]),
]


@query(
    "skill_match",
    f"""WITH s AS (SELECT * FROM (VALUES {', '.join(f"('{n}', {p}, [{quoted(t)}]::VARCHAR[], [{quoted(g)}]::VARCHAR[], [{quoted(e)}]::VARCHAR[])" for n, p, t, g, e in SKILLS)}) AS v(name, priority, tt, tr, ex)),
        r AS (SELECT *, conv_id * 1000 + turn AS k, [CASE WHEN conv_id % 2 = 0 THEN 'py' ELSE 'md' END] AS e FROM ({TASK_SQL})),
        m AS (SELECT k, name, priority, CASE WHEN list_contains(tt, task) THEN 100 ELSE 0 END + CASE WHEN len(list_filter(tr, lambda x: regexp_matches(lower(q), x))) > 0 THEN 50 ELSE 0 END + CASE WHEN list_has_any(e, ex) THEN 30 ELSE 0 END AS score FROM r, s)
        SELECT k, name, score, place FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, priority DESC, name) AS place FROM m WHERE score > 0) WHERE place <= 3""",
)
def skill_match(spark, d):
    skills = spark.createDataFrame(SKILLS, "name string, priority int, task_types array<string>, triggers array<string>, file_extensions array<string>")
    r = K.classify_task(requests(spark, d), "q").withColumn("k", C("conv_id") * 1000 + C("turn")).withColumn("e", F.array(F.when(C("conv_id") % 2 == 0, "py").otherwise("md")))
    return K.skill_match(r, skills, "k", "q", "task", "e")


# Lexical retrieval.
TOK_SQL = "SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') AS w FROM documents"
ASK = "the and with thing"


def _bm25_sql(ask: str) -> str:
    words = ask.split()
    parts = " + ".join(
        f"CASE WHEN tf{i} > 0 THEN ln((n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE) + 1.0::DOUBLE) * tf{i} * 2.5::DOUBLE / greatest(tf{i} + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl), 0.001::DOUBLE) ELSE 0.0::DOUBLE END"
        for i in range(len(words))
    )
    tf = ", ".join(f"len(list_filter(w, lambda t: t = '{x}'))::DOUBLE AS tf{i}" for i, x in enumerate(words))
    df = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS df{i}" for i in range(len(words)))
    return f"""WITH r AS (SELECT doc_id, lang, len(w)::DOUBLE AS dl, {tf} FROM ({TOK_SQL})),
        s AS (SELECT count(*)::DOUBLE AS n, greatest(avg(dl), 1.0::DOUBLE) AS avgdl, {df} FROM r),
        b AS (SELECT doc_id, lang, {parts} AS score FROM r, s)"""


@query("bm25_idf", f"""SELECT token, df, round(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE), 6) AS idf FROM
    (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS token FROM ({TOK_SQL})) GROUP BY token), (SELECT count(*)::DOUBLE AS n FROM documents)""")
def bm25_idf(spark, d):
    return lexical.document_frequencies(table(spark, d, "documents"), "doc_id", "text").select("token", "df", F.round("idf", 6).alias("idf"))


def document_index(spark, d):
    """The folder of the stored postings of all documents."""
    return stored(spark, f"documents of {d}", lambda path: lexical.write_index(table(spark, d, "documents"), "doc_id", "text", path))


@query("bm25_search", _bm25_sql(ASK) + " SELECT doc_id, round(score, 6) AS score FROM b WHERE score > 0 ORDER BY b.score DESC, doc_id LIMIT 20")
def bm25_search(spark, d):
    return lexical.top(lexical.search_index(spark, document_index(spark, d), ASK, "doc_id"), 20, "score", "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("bm25_per_lang", _bm25_sql("de la the die") + " SELECT lang, place, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS place FROM b WHERE score > 0) WHERE place <= 10")
def bm25_per_lang(spark, d):
    got = lexical.bm25(table(spark, d, "documents"), "de la the die", "doc_id", "text", ["lang"])
    return lexical.top_per(got, 10, "lang", "score", "doc_id").select("lang", "place", "doc_id", F.round("score", 6).alias("score"))


@query("postings", f"SELECT token, count(*) AS docs, sum(tf) AS tf FROM (SELECT doc_id, token, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(w) AS token FROM ({TOK_SQL})) GROUP BY ALL) GROUP BY token")
def postings(spark, d):
    return lexical.postings(table(spark, d, "documents"), "doc_id", "text").groupBy("token").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))


# Dense retrieval.
COS_SQL = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query("vector_topk", f"SELECT a.vec_id, a.label, round({COS_SQL}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b ORDER BY {COS_SQL} DESC, a.vec_id LIMIT 50")
def vector_topk(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id = 0").first().embedding
    return vectors.search(v, q, 50).withColumn("score", F.round("score", 6))


@query(
    "vector_topk_per_label",
    f"SELECT label, place, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS place FROM (SELECT a.label, a.vec_id, {COS_SQL} AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 1) b)) WHERE place <= 5",
)
def vector_topk_per_label(spark, d):
    v = table(spark, d, "embeddings")
    q = F.array(*[F.lit(float(x)) for x in v.where("vec_id = 1").first().embedding])
    rows = v.select("label", "vec_id", vectors.cosine(C("embedding"), q).alias("score"))
    return lexical.top_per(rows, 5, "label", "score", "vec_id").select("label", "place", "vec_id", F.round("score", 6).alias("score"))


@query(
    "vector_same_label_rate",
    f"""WITH p AS (SELECT b.vec_id AS q_id, b.label AS ql, a.label AS al, row_number() OVER (PARTITION BY b.vec_id ORDER BY {COS_SQL} DESC, a.vec_id) AS place
        FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
        SELECT ql AS label, count(*) AS n, sum(CASE WHEN al = ql THEN 1 ELSE 0 END)::BIGINT AS same FROM p WHERE place <= 10 GROUP BY ql""",
)
def vector_same_label_rate(spark, d):
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(C("vec_id").alias("q_id"), C("embedding").alias("q_vec"), C("label").alias("ql"))
    return vectors.search_many(v, q, 10).groupBy(C("ql").alias("label")).agg(F.count("*").alias("n"), F.sum((C("label") == C("ql")).cast("long")).alias("same"))


@query("hash_encoder")
def hash_encoder(spark, d):
    """Nearest documents of the first, by the hashing encoder."""
    docs = table(spark, d, "documents").select("doc_id", vectors.encode(F.coalesce("text", F.lit(""))).alias("embedding"))
    q = docs.where("doc_id = 0").first().embedding
    return vectors.search(docs, q, 15, "doc_id").withColumn("score", F.round("score", 5))


@query("rerank", "SELECT doc_id, len(list_intersect(['the','thing','with'], w))::DOUBLE / 3 AS score FROM (" + TOK_SQL + ") ORDER BY score DESC, doc_id LIMIT 15")
def rerank(spark, d):
    return table(spark, d, "documents").select("doc_id", vectors.rerank_score("thing with the", C("text")).alias("score")).orderBy(F.desc("score"), "doc_id").limit(15)


# Fusion: documents as capsules, the query names a source directory and words of paths and names.
ASK_TIERS = "show doc_7 in src3/ with source src12 doc_15"
TIER_WORDS = ["doc_15", "doc_7", "show", "source", "src12", "src3", "with"]


def _tier_sql() -> str:
    w = "['doc_7', 'show', 'with', 'source', 'doc_15', 'src12', 'src3']"
    words = f"list_filter({w}, lambda x: length(x) >= 4)"
    return f"""caps AS (SELECT doc_id AS id, {DOC_PATH_SQL} AS path, 'doc_' || doc_id AS name FROM documents),
        m AS (SELECT *, list_contains({words}, name) OR list_contains({words}, replace(name, '_', '')) AS named,
              len(list_filter({words}, lambda x: contains(path, x))) AS inp, len(list_filter({words}, lambda x: contains(name, x))) AS inn, contains(path, '/src3/') AS near FROM caps),
        t AS (SELECT *, CASE WHEN named THEN 1 WHEN inp > 0 THEN 2 WHEN inn > 0 THEN 3 END AS tier FROM m),
        e AS (SELECT id, tier, row_number() OVER (PARTITION BY tier ORDER BY CASE WHEN tier = 1 THEN near END DESC, CASE WHEN tier = 1 THEN inp END DESC, CASE WHEN tier = 1 THEN inn END DESC, path, id) AS place FROM t WHERE tier IS NOT NULL),
        x AS (SELECT * FROM e WHERE place <= CASE tier WHEN 1 THEN 20 WHEN 2 THEN 5 ELSE 3 END)"""


def tier_capsules(spark, d):
    docs = documents(spark, d)
    key = F.regexp_extract("name", r"(\d+)$", 1).cast("long")
    return docs.withColumn("id", key)


@query("exact_tiers", f"WITH {_tier_sql()} SELECT id, tier, place FROM x")
def exact_tiers(spark, d):
    return fusion.exact_tiers(tier_capsules(spark, d), ASK_TIERS)


def _lists(spark, d):
    v = table(spark, d, "embeddings")
    sparse = fusion.ranked(lexical.top(lexical.search_index(spark, document_index(spark, d), ASK), 15, "score", "id"), [F.desc("score"), "id"])
    q = v.where("vec_id = 0").first().embedding
    dense = fusion.ranked(vectors.search(v, q, 15).withColumnRenamed("vec_id", "id"), [F.desc("score"), "id"])
    return dense, sparse


LISTS_SQL = f"""s AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM ({_bm25_sql(ASK)} SELECT * FROM b WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 15)),
    dn AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS rank FROM (SELECT a.vec_id, {COS_SQL} AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b ORDER BY score DESC, vec_id LIMIT 15))"""


@query("rrf_fusion", f"WITH {LISTS_SQL} SELECT id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rank + 1)), 9) AS score FROM (SELECT * FROM dn UNION ALL SELECT * FROM s) GROUP BY id")
def rrf_fusion(spark, d):
    return fusion.rrf(list(_lists(spark, d))).select("id", F.round("score", 9).alias("score"))


@query(
    "hybrid_search",
    f"""WITH {_tier_sql()}, {LISTS_SQL}, f AS (SELECT id, row_number() OVER (ORDER BY tier, place) - 1 AS rank FROM x),
        se AS (SELECT id, row_number() OVER (ORDER BY rank, id) - 1 AS rank FROM dn WHERE id NOT IN (SELECT id FROM f)),
        u AS (SELECT id, rank, 0 AS l FROM f UNION ALL SELECT id, rank, 1 FROM se UNION ALL SELECT id, rank, 2 FROM s),
        g AS (SELECT id, sum(1.0::DOUBLE / (60.0::DOUBLE + rank + 1)) AS score, min(l * 1000 + rank) AS seen FROM u GROUP BY id),
        o AS (SELECT g.id, score, row_number() OVER (ORDER BY coalesce(f.rank, 1000000), score DESC, seen) AS place FROM g LEFT JOIN f ON g.id = f.id)
        SELECT id, place, round(score, 9) AS score FROM o WHERE place <= CASE WHEN (SELECT count(*) FROM x WHERE tier = 1) > 0 THEN 25 ELSE 15 END""",
)
def hybrid_search(spark, d):
    dense, sparse = _lists(spark, d)
    return fusion.hybrid(fusion.exact_tiers(tier_capsules(spark, d), ASK_TIERS), dense, sparse, "code_query").withColumn("score", F.round("score", 9))


# Pages.
@query("html_tag_counts", "SELECT page_id, tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<\\s*([\\p{L}\\p{N}_]+)', 1)) AS tag FROM pages) GROUP BY ALL")
def html_tag_counts(spark, d):
    return M.tag_counts(table(spark, d, "pages"), "page_id", "html")


@query("html_structure", """SELECT page_id, (SELECT string_agg(tag || '(' || n || ')', ', ' ORDER BY tag) FROM (SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<\\s*([\\p{L}\\p{N}_]+)', 1)) AS tag) GROUP BY tag)) AS tags,
    length(html) AS chars, length(html) - length(replace(html, chr(10), '')) + 1 AS end_line FROM pages""")
def html_structure(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", M.tag_summary(C("html")).alias("tags"), F.length("html").cast("long").alias("chars"), (F.length("html") - F.length(F.translate("html", "\n", "")) + 1).cast("long").alias("end_line"))


@query("html_classes", """SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(regexp_extract_all(html, 'class=["'']([^"'']+)["'']', 1), lambda c: regexp_split_to_array(c, '\\s+'))), lambda x: x <> '')))[1:30], ',') AS classes FROM pages""")
def html_classes(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(M.classes(C("html")), ",").alias("classes"))


@query("html_headings", """SELECT page_id, array_to_string(list_transform(list_zip(regexp_extract_all(html, '<(h[1-6])\\b[^>]*>(.*?)</h[1-6]>', 1)[1:10], regexp_extract_all(html, '<(h[1-6])\\b[^>]*>(.*?)</h[1-6]>', 2)[1:10]), lambda z: upper(z[1]) || ': ' || substr(trim(z[2], """ + BLANKS + """), 1, 100)), ' | ') AS headings FROM pages""")
def html_headings(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(M.headings(C("html")), " | ").alias("headings"))


META_PAGES = "concat(html, '<meta name=\"a\" content=\"', url, '\"><meta property=\"og:x\" content=\"1\"><meta name=\"a\" content=\"last\">')"


@query("html_meta", f"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(h, '<meta\\s+([^>]+)>', 1)) AS a, generate_subscripts(regexp_extract_all(h, '<meta\\s+([^>]+)>', 1), 1) AS pos FROM (SELECT page_id, {META_PAGES} AS h FROM pages)),
    m AS (SELECT page_id, pos, coalesce(nullif(regexp_extract(a, 'name=["'']([^"'']+)["'']', 1), ''), nullif(regexp_extract(a, 'property=["'']([^"'']+)["'']', 1), '')) AS name, nullif(regexp_extract(a, 'content=["'']([^"'']+)["'']', 1), '') AS value FROM a)
    SELECT page_id, name, max_by(value, pos) AS value FROM m WHERE name IS NOT NULL AND value IS NOT NULL GROUP BY page_id, name""")
def html_meta(spark, d):
    return M.metas(table(spark, d, "pages").select("page_id", F.expr(META_PAGES).alias("h")), "page_id", "h")


@query("html_text", r"""SELECT page_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 3000) AS text FROM pages""")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", M.plain_text(C("html")).alias("text"))


@query("html_parsed_text")
def html_parsed_text(spark, d):
    return table(spark, d, "pages").select("page_id", M.parsed_text("html").alias("text"))


LD_PAGES = "concat(html, '<script type=\"application/ld+json\">{\"u\": ', page_id, '}</script>')"


@query("html_json_ld", f"""SELECT page_id, substr(coalesce(regexp_extract_all(h, '(?s)<script\\s[^>]*type=["'']application/ld\\+json["''][^>]*>(.*?)</script>', 1)[1], ''), 1, 500) AS json_ld FROM (SELECT page_id, {LD_PAGES} AS h FROM pages)""")
def html_json_ld(spark, d):
    return table(spark, d, "pages").select("page_id", M.json_ld(F.expr(LD_PAGES)).alias("json_ld"))


CSS = """concat('.c', page_id % 7, '{color:#ff00', page_id % 10, page_id % 10, ';font-family: Arial, x', page_id % 3, ';}@media (max-width:', page_id, 'px){#main{background:rgb(1, 2, ', page_id % 5, ')}}p{margin:0}')"""


@query("css_structure", f"""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(c, '([.#@]?[a-zA-Z][\\p{{L}}\\p{{N}}_-]*)\\s*\\{{', 1)))[1:30], ',') AS selectors,
    array_to_string(list_sort(list_distinct(regexp_extract_all(c, '(#[0-9a-fA-F]{{3,8}}|rgba?\\([^)]+\\)|hsla?\\([^)]+\\))', 1)))[1:20], ',') AS colors,
    array_to_string(list_transform(regexp_extract_all(c, 'font-family\\s*:\\s*([^;]+);', 1)[1:10], lambda x: trim(x)), '|') AS fonts,
    array_to_string(list_transform(regexp_extract_all(c, '@media\\s+([^{{]+)\\{{', 1)[1:5], lambda x: trim(x)), '|') AS media FROM (SELECT page_id, {CSS} AS c FROM pages)""")
def css_structure(spark, d):
    c = table(spark, d, "pages").select("page_id", F.expr(CSS).alias("c"))
    j = lambda x, s=",": F.array_join(x, s)
    return c.select("page_id", j(M.css_selectors(C("c"))).alias("selectors"), j(M.css_colours(C("c"))).alias("colors"), j(M.css_fonts(C("c")), "|").alias("fonts"), j(M.css_media(C("c")), "|").alias("media"))


# Column forms of the pattern extractor, over made-up code.
CODE = """concat(CASE WHEN p_partkey % 2 = 0 THEN '// part ' ELSE '# part ' END, p_name, chr(10), 'function make', p_partkey, '(a) {', chr(10), '  if (a) { return call_', p_partkey % 9, '(a); }', chr(10), '  print(x); other(a)', chr(10), '}', chr(10), 'export const z', p_partkey, ' = 1')"""


@query("call_names", f"""SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(c, '([\\p{{L}}\\p{{N}}_]+)\\s*\\(', 1)), lambda x: length(x) >= 2 AND NOT list_contains(['if', 'for', 'while', 'switch', 'return', 'new', 'throw', 'catch', 'else', 'case', 'default', 'import', 'require', 'print', 'fmt', 'log', 'super', 'this', 'self', 'sizeof', 'typeof', 'void', 'println'], x)))[1:10], ',') AS calls FROM (SELECT p_partkey, {CODE} AS c FROM part)""")
def call_names(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(X.call_names(F.expr(CODE)), ",").alias("calls"))


LANGS = list(X.G.PATTERNS)
# Written out here, so that the values are stated twice.
MARK_SQL = "CASE WHEN lang IN ('julia', 'ruby', 'perl', 'r', 'shell', 'elixir') THEN '#' WHEN lang IN ('sql', 'haskell', 'lua') THEN '--' ELSE '//' END"
WORD_SQL = """CASE WHEN lang IN ('javascript', 'typescript', 'php', 'lua', 'r', 'julia', 'shell') THEN 'function' WHEN lang IN ('go', 'c', 'cpp', 'swift', 'dart', 'haskell') THEN 'func'
    WHEN lang = 'rust' THEN 'fn' WHEN lang = 'kotlin' THEN 'fun' WHEN lang = 'perl' THEN 'sub' WHEN lang = 'sql' THEN 'FUNCTION' ELSE 'def' END"""


@query("comment_lines", f"""WITH l AS (SELECT p_partkey, lang, unnest(string_split(c, chr(10))) AS line, generate_subscripts(string_split(c, chr(10)), 1) AS line_no FROM (SELECT p_partkey, [{quoted(LANGS)}][p_partkey % {len(LANGS)} + 1] AS lang, {CODE} AS c FROM part))
    SELECT p_partkey, line_no FROM l WHERE starts_with(trim(line), {MARK_SQL})""")
def comment_lines(spark, d):
    lang = F.element_at(F.array(*[F.lit(x) for x in LANGS]), (C("p_partkey") % len(LANGS) + 1).cast("int"))
    lines = table(spark, d, "part").select("p_partkey", lang.alias("lang"), F.posexplode(F.split(F.expr(CODE), "\n")).alias("pos", "line"))
    return lines.where(X.is_comment(C("line"), C("lang"))).select("p_partkey", (C("pos") + 1).alias("line_no"))


KINDS = ["class", "struct", "enum", "import", "function", "method"]


@query("signatures", f"""WITH s AS (SELECT p_partkey, [{quoted(LANGS)}][p_partkey % {len(LANGS)} + 1] AS lang, [{quoted(KINDS)}][p_partkey % {len(KINDS)} + 1] AS k, 'n' || p_partkey AS name, repeat('ab ', (p_partkey % 60)::INT) AS pr FROM part)
    SELECT p_partkey, CASE WHEN k IN ('class', 'struct', 'enum') THEN k || ' ' || name WHEN k = 'import' THEN 'import ' || name
    ELSE {WORD_SQL} || ' ' || name || '(' || CASE WHEN length(pr) > 120 THEN substr(pr, 1, 117) || '...' ELSE pr END || ')' END AS signature FROM s""")
def signatures(spark, d):
    k = C("p_partkey")
    pick = lambda v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", X.signatures(pick(LANGS), pick(KINDS), F.concat(F.lit("n"), k.cast("string")), F.repeat(F.lit("ab "), (k % 60).cast("int"))).alias("signature"))


@query("block_end", f"""WITH l AS (SELECT p_partkey, unnest(string_split(c, chr(10))) AS line, generate_subscripts(string_split(c, chr(10)), 1) AS ln FROM (SELECT p_partkey, {CODE} AS c FROM part)),
    r AS (SELECT *, sum(length(line) - length(replace(line, '{{', '')) - length(line) + length(replace(line, '}}', ''))) OVER w AS depth, max(CAST(contains(line, '{{') AS INT)) OVER w AS begun FROM l WINDOW w AS (PARTITION BY p_partkey ORDER BY ln))
    SELECT p_partkey, coalesce(min(CASE WHEN begun = 1 AND depth = 0 THEN ln END), least(21, max(ln))) AS end_line FROM r GROUP BY p_partkey""")
def block_end(spark, d):
    return X.brace_ends(table(spark, d, "part").select("p_partkey", F.expr(CODE).alias("c")), "p_partkey", "c").select("p_partkey", C("end_line").cast("long").alias("end_line"))


@query("heuristic_lines", f"""WITH l AS (SELECT p_partkey, trim(unnest(string_split(c, chr(10)))) AS line, generate_subscripts(string_split(c, chr(10)), 1) AS line_no FROM (SELECT p_partkey, {CODE} AS c FROM part))
    SELECT p_partkey, line_no, substr(line, 1, 200) AS signature FROM l WHERE line <> '' AND NOT regexp_matches(line, '^(#|//|/\\*|\\*|;)') AND regexp_matches(line, '^\\s*(pub|export|static|async|virtual|inline|const|fn|func|def|function|class)\\b')""")
def heuristic_lines(spark, d):
    return X.heuristic_lines(table(spark, d, "part").select("p_partkey", F.expr(CODE).alias("c")), "p_partkey", "c")


@query("first_per_name", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def first_per_name(spark, d):
    w = Window.partitionBy("p_name").orderBy("p_partkey")
    return table(spark, d, "part").withColumn("n", F.row_number().over(w)).where("n = 1").select("p_name", "p_partkey")


@query("topn_per_file", "SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents) WHERE place <= 10")
def topn_per_file(spark, d):
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, d, "documents").select("source", "doc_id", F.row_number().over(w).alias("place")).where("place <= 10")


@query("stripped_text", f"SELECT doc_id, length(trim(text, {BLANKS})) AS n FROM documents")
def stripped_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(strip(C("text"))).cast("long").alias("n"))
