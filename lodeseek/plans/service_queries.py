"""Queries over events, conversations as sessions, and small rule tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeseek.operators import evaluate as E
from lodeseek.operators import service as V
from lodeseek.operators import sessions as Z
from lodeseek.operators import store as T
from lodeseek.plans.registry import query, table
from lodeseek.plans.text_queries import quoted
from lodeseek.sources import files as S
from lodeseek.streaming import events as EV
from lodeseek.streaming import incremental as I

C = F.col


# Sessions: a conversation is a session, a turn a message.
def messages(spark, d):
    return table(spark, d, "conversations").withColumn("text", F.concat("text", F.expr(MORE)))


MORE = """CASE WHEN turn % 2 = 0 THEN concat(' see file src/app_', conv_id % 5, '.py and function load_', turn, ' or def if') ELSE '' END"""
MSG_SQL = f"(SELECT conv_id, turn, role, concat(text, {MORE}) AS text FROM conversations)"


@query("session_rollup", f"SELECT conv_id, count(*) AS message_count, sum(length(text) // 4) AS total_tokens, max(turn) AS updated_at FROM {MSG_SQL} GROUP BY conv_id")
def session_rollup(spark, d):
    return Z.rollup(messages(spark, d), "conv_id", F.floor(F.length("text") / 4), "turn")


@query("list_sessions", f"SELECT conv_id, max(turn) AS updated_at FROM {MSG_SQL} GROUP BY conv_id ORDER BY updated_at DESC, conv_id LIMIT 20")
def list_sessions(spark, d):
    return Z.rollup(messages(spark, d), "conv_id", F.lit(0), "turn").select("conv_id", "updated_at").orderBy(F.desc("updated_at"), "conv_id").limit(20)


@query("history_last_n", f"SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM {MSG_SQL}) WHERE p <= 3")
def history_last_n(spark, d):
    return Z.history(messages(spark, d), "conv_id", ["turn"], 3).select("conv_id", "turn", "role")


REF = "list_distinct(regexp_extract_all(text, '(?:en|in|archivo|file|path)[\\s:]+([\\p{L}\\p{N}_./-]+\\.[\\p{L}\\p{N}_]+)', 1))"
FUN = f"""list_filter(list_distinct(regexp_extract_all(text, '(?:función|funcion|function|def|class)\\s+[`''"]?([\\p{{L}}\\p{{N}}_]+)[`''"]?', 1)), lambda x: NOT list_contains([{quoted(Z.NO_FUNCTION)}], x))"""


@query("code_refs", f"SELECT conv_id, turn, array_to_string(list_sort({REF}), ',') AS files, array_to_string(list_sort({FUN}), ',') AS functions FROM {MSG_SQL}")
def code_refs(spark, d):
    j = lambda a: F.array_join(F.array_sort(a), ",")
    return messages(spark, d).select("conv_id", "turn", j(Z.file_refs(C("text"))).alias("files"), j(Z.function_refs(C("text"))).alias("functions"))


@query(
    "compact_history",
    f"""WITH m AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM {MSG_SQL}),
        o AS (SELECT conv_id, {REF} AS f, {FUN} AS g FROM m WHERE NOT (n <= 4 OR p > n - 2)),
        a AS (SELECT conv_id, list_sort(list_distinct(flatten(list(f))))[1:10] AS f, list_sort(list_distinct(flatten(list(g))))[1:10] AS g FROM o GROUP BY conv_id)
        SELECT conv_id, p AS place, role, md5(text) AS h FROM m WHERE n <= 4 OR p > n - 2
        UNION ALL SELECT conv_id, 0, 'system', md5('{Z.SUMMARY}' || CASE WHEN len(f) > 0 THEN chr(10) || 'Archivos mencionados: ' || array_to_string(f, ', ') ELSE '' END || CASE WHEN len(g) > 0 THEN chr(10) || 'Funciones discutidas: ' || array_to_string(g, ', ') ELSE '' END) FROM a""",
)
def compact_history(spark, d):
    got = Z.compact(messages(spark, d), "conv_id", "turn", "text", 4)
    return got.select("conv_id", C("place").cast("long").alias("place"), "role", F.md5(C("content").cast("binary")).alias("h"))


@query(
    "loop_compaction",
    f"""WITH m AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM {MSG_SQL})
        SELECT conv_id, p AS place, role, md5(text) AS h FROM m WHERE n <= 4 OR p <= 2 OR p > n - 2 UNION ALL SELECT conv_id, p, 'system', md5('[' || (n - 4) || ' mensajes omitidos]') FROM m WHERE p = 3 AND n > 4""",
)
def loop_compaction(spark, d):
    got = Z.compact_loop(messages(spark, d), "conv_id", "turn", "text", 2)
    return got.select("conv_id", C("place").cast("long").alias("place"), "role", F.md5(C("content").cast("binary")).alias("h"))


@query("delete_cascade", "SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id")
def delete_cascade(spark, d):
    m = table(spark, d, "conversations")
    s = m.select("conv_id").distinct()
    kept, rest = Z.delete(s, m, s.where("conv_id % 3 = 0"), "conv_id")
    return kept.join(rest, "conv_id").groupBy("conv_id").agg(F.count("*").alias("n"))


# Service: events as calls; the value is a latency.
MS = "CAST(floor(value * 10) AS BIGINT)"


@query(
    "metrics_snapshot",
    f"""WITH e AS (SELECT {MS} AS ms, event_type FROM events), s AS (SELECT list_sort(list(ms)) AS l, count(ms) AS n, sum(CASE WHEN event_type = 'view' THEN 1500 ELSE 700 END)::BIGINT AS used,
        sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS hits, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS misses, avg(ms) AS m FROM e)
        SELECT n AS queries_total, used AS tokens_used, greatest(0, n * 20000 - used) AS tokens_saved, hits AS cache_hits, misses AS cache_misses, round(hits::DOUBLE / (hits + misses), 9) AS hit_rate, round(m, 6) AS avg_latency,
        l[n // 2 + 1]::DOUBLE AS p50_latency, l[CASE WHEN n > 100 THEN CAST(floor(n * 0.99) AS BIGINT) + 1 ELSE n END]::DOUBLE AS p99_latency FROM s""",
)
def metrics_snapshot(spark, d):
    e = table(spark, d, "events").withColumn("ms", F.floor(C("value") * 10).cast("double"))
    got = V.metrics(e, "ms", F.when(C("event_type") == "view", 1500).otherwise(700), C("event_type") == "click", C("event_type") == "error")
    return got.withColumn("hit_rate", F.round("hit_rate", 9)).withColumn("avg_latency", F.round("avg_latency", 6))


@query("latency_retention", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS p, count(*) OVER () AS n FROM events) WHERE p <= CASE WHEN n <= 100 THEN n ELSE 50 + (n - 101) % 51 END")
def latency_retention(spark, d):
    return V.retained(table(spark, d, "events"), ["ts", "event_id"], 100, 50).select("event_id")


SECONDS = "(unix_micros(CAST(ts AS TIMESTAMP)) / 1000000)"


@query("rate_limit_upper", "SELECT event_id, count(*) OVER (PARTITION BY user_id % 5 ORDER BY s RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW) AS recent FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)")
def rate_limit_upper(spark, d):
    e = table(spark, d, "events").select("event_id", (C("user_id") % 5).alias("u"), F.unix_timestamp(C("ts").cast("timestamp")).alias("s"))
    return V.rate_upper(e, "u", "s", 30, 3600).select("event_id", "recent")


# One event of each user group a step, with what the step before left behind.
STEPS_SQL = """e AS MATERIALIZED (SELECT event_id, u, s, ok, row_number() OVER (PARTITION BY u ORDER BY s, event_id) AS p
        FROM (SELECT event_id, user_id % 5 AS u, epoch_us(ts) / 1000000 AS s, event_type <> 'error' AS ok FROM events))"""


@query(
    "rate_limit_admit",
    f"""WITH RECURSIVE {STEPS_SQL},
        r AS (SELECT u, 0::BIGINT AS p, []::DOUBLE[] AS stamps, NULL::BIGINT AS event_id, NULL::BOOLEAN AS admitted FROM e WHERE p = 1
            UNION ALL SELECT u, p, CASE WHEN len(live) < 3 THEN list_append(live, s) ELSE live END, event_id, len(live) < 3
            FROM (SELECT e.u, e.p, e.s, e.event_id, list_filter(r.stamps, lambda t: e.s - t < 3600) AS live FROM r JOIN e ON e.u = r.u AND e.p = r.p + 1))
        SELECT event_id, u, admitted FROM r WHERE p > 0""",
)
def rate_limit_admit(spark, d):
    e = table(spark, d, "events").select("event_id", (C("user_id") % 5).alias("u"), F.expr(f"{SECONDS} AS s"))
    return V.rate_limit(e, "u", "s", "event_id", 3, 3600.0).select("event_id", "u", "admitted")


@query(
    "circuit_breaker",
    f"""WITH RECURSIVE {STEPS_SQL},
        r AS (SELECT u, 0::BIGINT AS p, 0 AS f, 0.0::DOUBLE AS last, NULL::BIGINT AS event_id, NULL::VARCHAR AS state FROM e WHERE p = 1
            UNION ALL SELECT u, p, CASE state WHEN 'open' THEN f WHEN 'ok' THEN 0 ELSE CASE WHEN f >= 3 THEN 1 ELSE f + 1 END END, CASE WHEN state = 'failed' THEN s ELSE last END, event_id, state
            FROM (SELECT e.u, e.p, e.s, r.f, r.last, e.event_id, CASE WHEN r.f >= 3 AND e.s - r.last <= 30 THEN 'open' WHEN e.ok THEN 'ok' ELSE 'failed' END AS state FROM r JOIN e ON e.u = r.u AND e.p = r.p + 1))
        SELECT event_id, u, state FROM r WHERE p > 0""",
)
def circuit_breaker(spark, d):
    e = table(spark, d, "events").select("event_id", (C("user_id") % 5).alias("u"), F.expr(f"{SECONDS} AS s"), (C("event_type") != "error").alias("ok"))
    return V.circuit_breaker(e, "u", "s", "event_id", "ok").select("event_id", "u", "state")


@query("hit_rate", "SELECT user_id, round(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS rate FROM events WHERE event_type IN ('click', 'error') GROUP BY user_id")
def hit_rate(spark, d):
    e = table(spark, d, "events").where(C("event_type").isin("click", "error"))
    return e.groupBy("user_id").agg(F.round(F.sum((C("event_type") == "click").cast("int")).cast("double") / F.count("*"), 6).alias("rate"))


@query("cache_key", "SELECT event_id, md5(lower(trim(' ' || event_type || ' ' || user_id || ' '))) AS key, concat_ws('|', event_type, user_id::VARCHAR, 'search', '500') AS context_key FROM events")
def cache_key(spark, d):
    q = F.concat(F.lit(" "), "event_type", F.lit(" "), C("user_id").cast("string"), F.lit(" "))
    return table(spark, d, "events").select("event_id", V.cache_key(q).alias("key"), V.context_key(C("event_type"), C("user_id").cast("string"), F.lit("search"), F.lit(500)).alias("context_key"))


@query("ttl_lookup", "SELECT event_id FROM events WHERE epoch(ts)::BIGINT + 300 > epoch(TIMESTAMP '2024-01-15 12:00:00')::BIGINT")
def ttl_lookup(spark, d):
    e = table(spark, d, "events").withColumn("ts", C("ts").cast("timestamp"))
    return V.live(e, "ts", F.lit("2024-01-15 12:00:00").cast("timestamp"), V.SUBGRAPH_TTL).select("event_id")


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.expr("variant_get(parse_json(props), '$.k', 'bigint')").alias("k"))


# Written out here as SQL, so that the values of the catalogue are stated twice.
MODELS_SQL = """(SELECT pos, model, provider, ci::DOUBLE AS ci, co::DOUBLE AS co, cr::DOUBLE AS cr, cw::DOUBLE AS cw, win, tier FROM (VALUES
    (0, 'anthropic/claude-opus-4', 'anthropic', 15.0, 75.0, 1.5, 7.5, 200000, 'premium'),
    (1, 'anthropic/claude-sonnet-4', 'anthropic', 3.0, 15.0, 0.3, 7.5, 200000, 'medium'),
    (2, 'anthropic/claude-haiku-4', 'anthropic', 0.8, 4.0, 0.08, 2.0, 200000, 'budget'),
    (3, 'openai/gpt-5.5', 'openai', 5.0, 40.0, 2.5, 10.0, 256000, 'premium'),
    (4, 'openai/gpt-5-mini', 'openai', 1.0, 8.0, 0.5, 2.0, 256000, 'budget'),
    (5, 'openai/gpt-4o', 'openai', 2.5, 10.0, 1.25, 5.0, 128000, 'medium'),
    (6, 'deepseek/deepseek-v4-pro', 'openai', 1.74, 3.48, 0.14, 0.14, 1048576, 'premium'),
    (7, 'deepseek/deepseek-v4-flash', 'openai', 0.14, 0.28, 0.014, 0.014, 1048576, 'budget'),
    (8, 'deepseek/deepseek-chat', 'openai', 0.29, 0.43, 0.0, 0.0, 65536, 'budget'),
    (9, 'deepseek/deepseek-reasoner', 'openai', 0.55, 2.19, 0.0, 0.0, 65536, 'medium'),
    (10, 'openrouter/anthropic/claude-sonnet-4', 'openrouter', 3.0, 15.0, 0.0, 0.0, 200000, 'medium'),
    (11, 'openrouter/openai/gpt-4o', 'openrouter', 2.5, 10.0, 0.0, 0.0, 128000, 'medium'),
    (12, 'openrouter/google/gemini-2.5-flash', 'openrouter', 0.15, 0.6, 0.0, 0.0, 1048576, 'free'),
    (13, 'openrouter/meta-llama/llama-4-maverick', 'openrouter', 0.2, 0.8, 0.0, 0.0, 256000, 'free'),
    (14, 'google/gemini-2.5-pro', 'google', 1.25, 10.0, 0.0, 0.0, 1048576, 'premium'),
    (15, 'google/gemini-2.5-flash', 'google', 0.15, 0.6, 0.0, 0.0, 1048576, 'free'),
    (16, 'mistral/mistral-large', 'mistral', 2.0, 6.0, 0.0, 0.0, 128000, 'medium'),
    (17, 'mistral/mistral-small', 'mistral', 0.2, 0.6, 0.0, 0.0, 32000, 'budget'),
    (18, 'mistral/codestral', 'mistral', 1.0, 3.0, 0.0, 0.0, 256000, 'medium'),
    (19, 'ollama/qwen2.5-coder:7b', 'ollama', 0.0, 0.0, 0.0, 0.0, 32768, 'free'),
    (20, 'ollama/qwen2.5-coder:14b', 'ollama', 0.0, 0.0, 0.0, 0.0, 32768, 'free'),
    (21, 'ollama/qwen2.5-coder:32b', 'ollama', 0.0, 0.0, 0.0, 0.0, 32768, 'free'),
    (22, 'ollama/deepseek-coder-v2', 'ollama', 0.0, 0.0, 0.0, 0.0, 32768, 'free'),
    (23, 'ollama/llama3.1:8b', 'ollama', 0.0, 0.0, 0.0, 0.0, 131072, 'free'),
    (24, 'groq/llama-4-scout-17b-16e-instruct', 'groq', 0.1, 0.4, 0.0, 0.0, 131072, 'free'),
    (25, 'groq/llama-4-maverick-17b-128e-instruct', 'groq', 0.2, 0.6, 0.0, 0.0, 131072, 'budget'),
    (26, 'groq/deepseek-r1-distill-llama-70b', 'groq', 0.75, 0.99, 0.0, 0.0, 131072, 'medium'),
    (27, 'cohere/command-r-plus', 'cohere', 2.5, 10.0, 0.0, 0.0, 128000, 'medium'),
    (28, 'cohere/command-r', 'cohere', 0.5, 1.5, 0.0, 0.0, 128000, 'budget'),
    (29, 'together/meta-llama/Llama-4-Maverick-17B-128E-Instruct-FP8', 'together', 0.2, 0.6, 0.0, 0.0, 131072, 'budget'),
    (30, 'together/Qwen/Qwen3-Coder-480B-A35B-Instruct', 'together', 1.2, 2.5, 0.0, 0.0, 32768, 'medium'),
    (31, 'together/deepseek-ai/DeepSeek-V3', 'together', 1.25, 1.25, 0.0, 0.0, 65536, 'medium'),
    (32, 'bedrock/anthropic.claude-sonnet-4-20250514-v1:0', 'bedrock', 3.0, 15.0, 0.0, 0.0, 200000, 'medium'),
    (33, 'bedrock/anthropic.claude-opus-4-20250514-v1:0', 'bedrock', 15.0, 75.0, 0.0, 0.0, 200000, 'premium'),
    (34, 'bedrock/meta.llama4-maverick-17b-instruct-v1:0', 'bedrock', 0.3, 0.6, 0.0, 0.0, 131072, 'budget'),
    (35, 'azure/gpt-4o', 'azure', 2.5, 10.0, 0.0, 0.0, 128000, 'medium'),
    (36, 'azure/gpt-4o-mini', 'azure', 0.15, 0.6, 0.0, 0.0, 128000, 'budget')
    ) AS m(pos, model, provider, ci, co, cr, cw, win, tier))"""
N_MODELS = 37


@query("list_models", f"SELECT model, provider, win AS context_window, tier FROM {MODELS_SQL}")
def list_models(spark, d):
    return V.models(spark).select("model", "provider", "context_window", "tier")


@query("list_providers", f"SELECT provider, count(*) AS n FROM {MODELS_SQL} GROUP BY provider")
def list_providers(spark, d):
    return V.models(spark).groupBy("provider").agg(F.count("*").alias("n"))


@query(
    "cost_estimate",
    f"""SELECT model, count(*) AS n, round(sum(coalesce(ci * i / 1e6 + co * o / 1e6 + cr * r / 1e6 + cw * w / 1e6, 0)) * 1e6, 2) AS micro_usd FROM (SELECT event_id, CASE WHEN event_id % 50 = 49 THEN 'unknown' ELSE (SELECT list(model ORDER BY pos) FROM {MODELS_SQL})[event_id % {N_MODELS} + 1] END AS model,
        event_id % 1000 AS i, user_id AS o, event_id % 7 AS r, event_id % 3 AS w FROM events) u LEFT JOIN {MODELS_SQL} m USING (model) GROUP BY model""",
)
def cost_estimate(spark, d):
    names = F.array(*[F.lit(r[0]) for r in V.MODELS])
    pick = F.when(C("event_id") % 50 == 49, "unknown").otherwise(F.element_at(names, (C("event_id") % N_MODELS + 1).cast("int")))
    u = table(spark, d, "events").select(pick.alias("model"), (C("event_id") % 1000).alias("input_tokens"), C("user_id").alias("output_tokens"), (C("event_id") % 7).alias("cache_read"), (C("event_id") % 3).alias("cache_write"))
    return V.cost(u, V.models(spark)).groupBy("model").agg(F.count("*").alias("n"), F.round(F.sum("cost") * 1e6, 2).alias("micro_usd"))


def _route_sql(lists: dict[str, list[str]], default: str, want: str) -> str:
    pick = "CASE " + " ".join(f"WHEN want = '{k}' THEN [{quoted(v)}]" for k, v in lists.items()) + f" ELSE [{quoted(lists[default])}] END"
    return f"""SELECT event_id, coalesce(list_filter({pick}, lambda m: list_contains(pr, split_part(m, '/', 1)))[1], f.model, '{V.LAST_RESORT}') AS model FROM
        (SELECT event_id, {want} AS want, CASE event_id % 4 WHEN 0 THEN ['openai', 'google'] WHEN 1 THEN ['cohere'] WHEN 2 THEN []::VARCHAR[] ELSE ['ollama', 'deepseek'] END AS pr FROM events)
        LEFT JOIN (SELECT provider, min_by(model, pos) AS model FROM {MODELS_SQL} GROUP BY provider) f ON f.provider = pr[1]"""


def _providers():
    arr = lambda *x: F.array(*[F.lit(y) for y in x])
    k = C("event_id") % 4
    return F.when(k == 0, arr("openai", "google")).when(k == 1, arr("cohere")).when(k == 2, F.array().cast("array<string>")).otherwise(arr("ollama", "deepseek"))


@query("route_model", _route_sql(V.ROUTES, "medium", "['simple','medium','complex','code','other'][event_id % 5 + 1]"))
def route_model(spark, d):
    want = F.element_at(F.array(*[F.lit(x) for x in ("simple", "medium", "complex", "code", "other")]), (C("event_id") % 5 + 1).cast("int"))
    r = table(spark, d, "events").select("event_id", want.alias("want"), _providers().alias("pr"))
    return V.route(r, "event_id", "want", "pr", V.ROUTES, "medium", V.models(spark))


@query("recommended_model", _route_sql(V.PREFERRED, "general", "['code','general','cheap','local'][event_id % 3 + 1]"))
def recommended_model(spark, d):
    want = F.element_at(F.array(*[F.lit(x) for x in ("code", "general", "cheap", "local")]), (C("event_id") % 3 + 1).cast("int"))
    r = table(spark, d, "events").select("event_id", want.alias("want"), _providers().alias("pr"))
    return V.route(r, "event_id", "want", "pr", V.PREFERRED, "general", V.models(spark))


@query("available_models", f"SELECT model FROM {MODELS_SQL} WHERE provider IN ('openai', 'groq')")
def available_models(spark, d):
    have = spark.createDataFrame([("openai",), ("groq",)], "provider string")
    return V.models(spark).join(F.broadcast(have), "provider", "left_semi").select("model")


@query(
    "permissions",
    """SELECT event_id, CASE WHEN mode = 'deny' THEN false WHEN mode = 'auto' THEN true WHEN event_type IN ('view') THEN true WHEN event_type IN ('error') THEN false WHEN path <> '' AND NOT starts_with(path, '/repo') THEN false ELSE true END AS allowed,
        CASE WHEN mode = 'deny' THEN 'deny mode' WHEN mode = 'auto' THEN 'auto' WHEN event_type IN ('view') THEN 'auto-allow' WHEN event_type IN ('error') THEN 'auto-deny' WHEN path <> '' AND NOT starts_with(path, '/repo') THEN 'outside the project' ELSE 'ask' END AS reason
        FROM (SELECT event_id, event_type, ['ask','ask','deny','auto'][event_id % 4 + 1] AS mode, ['', '/repo/x', '/etc/x'][event_id % 3 + 1] AS path FROM events)""",
)
def permissions(spark, d):
    pick = lambda v: F.element_at(F.array(*[F.lit(x) for x in v]), (C("event_id") % len(v) + 1).cast("int"))
    p = V.permitted(pick(("ask", "ask", "deny", "auto")), C("event_type"), ["view"], ["error"], pick(("", "/repo/x", "/etc/x")), "/repo")
    return table(spark, d, "events").select("event_id", p.alias("p")).select("event_id", "p.allowed", "p.reason")


@query("repeated_calls", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, substr(props, 1, 80) ORDER BY ts, event_id) > 1 AS repeated FROM events")
def repeated_calls(spark, d):
    return V.repeated_calls(table(spark, d, "events"), "user_id", "event_type", "props", ["ts", "event_id"]).select("event_id", "repeated")


@query("goal_totals", "SELECT user_id, count(*) AS steps, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::BIGINT AS done, sum(event_id % 100)::BIGINT AS tokens, round(sum(event_id % 9 / 4.0::DOUBLE), 3) AS seconds FROM events GROUP BY user_id")
def goal_totals(spark, d):
    s = table(spark, d, "events").select("user_id", F.when(C("event_type") == "purchase", "done").otherwise("open").alias("status"), (C("event_id") % 100).alias("tokens"), ((C("event_id") % 9) / F.lit(4.0)).alias("seconds"))
    return V.goal_totals(s, "user_id")


# Benchmark reports over scores made from labels.
RES_SQL = """(SELECT ['ours','tools','bare'][doc_id % 3 + 1] AS system, doc_id // 3 AS task, doc_id % 977 AS tokens, CAST(quality AS DOUBLE) * 4 + doc_id % 5 AS score, doc_id % 313 AS ms, toxic FROM labels)"""


def results(spark, d):
    k = C("doc_id")
    return table(spark, d, "labels").select(F.element_at(F.array(F.lit("ours"), F.lit("tools"), F.lit("bare")), (k % 3 + 1).cast("int")).alias("system"), F.floor(k / 3).alias("task"), (k % 977).alias("tokens"), (C("quality").cast("double") * 4 + k % 5).alias("score"), (k % 313).alias("ms"), "toxic")


@query("system_report", f"SELECT system, count(*) AS n, sum(tokens)::BIGINT AS total_tokens, round(avg(tokens), 2) AS avg_tokens, round(avg(score), 2) AS avg_score, round(avg(ms), 2) AS avg_ms FROM {RES_SQL} GROUP BY system")
def system_report(spark, d):
    return E.system_report(results(spark, d))


@query("token_reduction", f"SELECT count(*) AS tasks, sum(CASE WHEN a.score >= b.score THEN 1 ELSE 0 END)::BIGINT AS wins, round((1 - sum(a.tokens)::DOUBLE / sum(b.tokens)) * 100, 1) AS reduction_pct FROM {RES_SQL} a JOIN {RES_SQL} b ON a.task = b.task AND a.system = 'ours' AND b.system = 'tools'")
def token_reduction(spark, d):
    return E.token_reduction(results(spark, d), "ours", "tools")


@query("benchmark_summary", f"SELECT count(*) AS n, round(avg(score / 10), 2) AS coverage, round(avg(CASE WHEN toxic = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 2) AS judge_ratio, sum(tokens)::BIGINT AS tokens, round(avg(tokens), 2) AS avg_tokens FROM {RES_SQL}")
def benchmark_summary(spark, d):
    r = results(spark, d).select((C("score") / 10).alias("criteria_score"), E.verdict(F.when(C("toxic") == 0, "Sí, claro").otherwise("No")).alias("verdict"), "tokens")
    return E.benchmark_summary(r)


@query("judge_composite", "SELECT doc_id, round((doc_id % 11) * 0.30::DOUBLE + (doc_id % 7) * 0.30::DOUBLE + (doc_id % 5) * 0.25::DOUBLE + quality * 0.15::DOUBLE, 2) AS score FROM labels")
def judge_composite(spark, d):
    k = C("doc_id")
    return table(spark, d, "labels").select("doc_id", E.judge_composite(relevancia=k % 11, correccion=k % 7, completitud=k % 5, accionabilidad=C("quality")).alias("score"))


# Events in time, and the index as a table.
@query("event_tumbling", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_tumbling(spark, d):
    return I.tumbling(table(spark, d, "events"), ["event_type"], "1 day").select(C("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("event_sliding", "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '2024-01-01') - INTERVAL '12 hours' * k AS s FROM events, range(2) AS t(k)) GROUP BY ALL")
def event_sliding(spark, d):
    return I.sliding(table(spark, d, "events"), ["event_type"], "24 hours", "12 hours").select(C("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "event_session",
    """WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '1 hour' OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events),
        s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
        SELECT min(ts) AS start, max(ts) + INTERVAL '1 hour' AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""",
)
def event_session(spark, d):
    return I.sessions(table(spark, d, "events"), "user_id", "1 hour").select(C("start").cast("timestamp_ntz").alias("start"), C("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


@query("upsert", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_name || '*' ELSE s_name END AS s_name FROM supplier UNION ALL SELECT -1, 'new*'")
def upsert(spark, d):
    old = table(spark, d, "supplier").select("s_suppkey", "s_name")
    new = old.where("s_suppkey % 4 = 0").withColumn("s_name", F.concat("s_name", F.lit("*"))).unionByName(spark.createDataFrame([(-1, "new*")], "s_suppkey long, s_name string"))
    return S.upsert(old, new, "s_suppkey")


@query("indexed_repos", "SELECT DISTINCT source AS repo FROM documents")
def indexed_repos(spark, d):
    return S.indexed_repos(table(spark, d, "documents"), "source").withColumnRenamed("source", "repo")


@query("not_indexed", "SELECT DISTINCT l_partkey % 40 AS key FROM lineitem WHERE l_partkey % 40 NOT IN (SELECT s_nationkey FROM supplier)")
def not_indexed(spark, d):
    plan = table(spark, d, "lineitem").select((C("l_partkey") % 40).alias("key")).distinct()
    return plan.join(table(spark, d, "supplier").select(C("s_nationkey").alias("key")), "key", "left_anti")


@query("top_spend_per_segment", "SELECT c_mktsegment, c_custkey, place FROM (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 5")
def top_spend_per_segment(spark, d):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_mktsegment", "c_custkey", F.row_number().over(w).alias("place")).where("place <= 5")


# Stored sessions, their costs, gauges of the indexer, cached results, events of a run.
def stored_sessions(spark, d):
    """A session for each conversation and one without messages; tokens are a quarter of the characters."""
    m = table(spark, d, "conversations")
    ids = m.select("conv_id").distinct().unionByName(spark.createDataFrame([(-1,)], "conv_id long"))
    names = F.array(*[F.lit(x) for x in SESSION_MODELS])
    s = ids.select("conv_id", F.element_at(names, (F.pmod("conv_id", F.lit(3)) + 1).cast("int")).alias("model"), F.lit(-5).cast("long").alias("created_at"))
    return Z.with_totals(s, m, "conv_id", F.floor(F.length("text") / 4), "turn")


SESSION_MODELS = ["openai/gpt-4o", "mistral/codestral", "unknown"]
SESSIONS_SQL = """(SELECT conv_id, ['openai/gpt-4o','mistral/codestral','unknown'][(conv_id % 3 + 3) % 3 + 1] AS model, -5::BIGINT AS created_at, coalesce(l, -5) AS updated_at, coalesce(n, 0) AS message_count, coalesce(t, 0)::BIGINT AS total_tokens
    FROM (SELECT DISTINCT conv_id FROM conversations UNION ALL SELECT -1) LEFT JOIN (SELECT conv_id, max(turn) AS l, count(*) AS n, sum(length(text) // 4) AS t FROM conversations GROUP BY conv_id) USING (conv_id))"""


@query("session_table", f"SELECT * FROM {SESSIONS_SQL}")
def session_table(spark, d):
    return stored_sessions(spark, d)


@query(
    "session_costs",
    f"""SELECT conv_id, round((total_tokens // 2) * CASE model WHEN 'openai/gpt-4o' THEN 12.5 WHEN 'mistral/codestral' THEN 4.0 ELSE 0.0 END::DOUBLE, 3) AS micro_usd, greatest(0, message_count * 20000 - total_tokens) AS saved FROM {SESSIONS_SQL}""",
)
def session_costs(spark, d):
    return V.session_costs(stored_sessions(spark, d), V.models(spark)).select("conv_id", F.round(C("cost") * 1e6, 3).alias("micro_usd"), "saved")


@query("index_gauges", "SELECT max(n) AS capsules, count(*) AS repos FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def index_gauges(spark, d):
    return V.index_gauges(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), "n")


@query("model_info", f"SELECT provider, model, (SELECT count(*) FROM {MODELS_SQL} m WHERE m.model IN (a.provider || '/' || a.model, a.model)) AS found FROM (VALUES ('openai', 'gpt-4o'), ('x', 'mistral/codestral'), ('x', 'none')) AS a(provider, model)")
def model_info(spark, d):
    asked = [("openai", "gpt-4o"), ("x", "mistral/codestral"), ("x", "none")]
    rows = [V.model_info(V.models(spark), p, m).agg(F.count("*").alias("found")).select(F.lit(p).alias("provider"), F.lit(m).alias("model"), "found") for p, m in asked]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def stored_results(spark, d):
    """Events as cache rows: a request, subgraph or ontology by its number, one user a key."""
    e = table(spark, d, "events").withColumn("at", F.unix_micros(C("ts").cast("timestamp")) / F.lit(1e6))
    kinds = [e.where(F.pmod("user_id", F.lit(3)) == i).select(T.cache_name(k, F.concat(F.lit(" User "), C("user_id").cast("string"))).alias("key"), C("event_id").cast("string").alias("value"), C("at").alias("stored_at"), T.expiry(k, C("at")).alias("expires_at")) for i, k in enumerate(T.LIFETIMES)]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


CACHE_SQL = """(SELECT CASE user_id % 3 WHEN 0 THEN 'query:' || md5('user ' || user_id) WHEN 1 THEN 'subgraph: User ' || user_id ELSE 'ontology: User ' || user_id END AS key, event_id::VARCHAR AS value, epoch_us(ts) / 1e6::DOUBLE AS stored,
    CASE user_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 300 END AS ttl FROM events)"""
NOW = "epoch_us(TIMESTAMP '2024-01-30 23:00:00') / 1e6::DOUBLE"


@query("cache_lookup", f"SELECT key, CASE WHEN ttl IS NULL OR stored + ttl > {NOW} THEN value END AS value FROM (SELECT key, arg_max(value, stored) AS value, max(stored) AS stored, any_value(ttl) AS ttl FROM {CACHE_SQL} GROUP BY key) UNION ALL SELECT 'query:none', NULL")
def cache_lookup(spark, d):
    cache = stored_results(spark, d)
    asked = cache.select("key").distinct().unionByName(spark.createDataFrame([("query:none",)], "key string"))
    return T.lookup(cache, asked, F.unix_micros(F.lit("2024-01-30 23:00:00").cast("timestamp")) / F.lit(1e6))


@query("cache_clear", f"SELECT DISTINCT key FROM {CACHE_SQL} WHERE key LIKE 'subgraph:%1_'")
def cache_clear(spark, d):
    return T.matching(stored_results(spark, d), "subgraph:*1?")


AGENT_JSON = """CASE event_type WHEN 'view' THEN concat('{"type": "token", "text": "', event_type, user_id, '"}') WHEN 'click' THEN concat('{"type": "tool_start", "name": "read_file", "args": {"path": "', event_id, '"}}')
    WHEN 'purchase' THEN concat('{"type": "done", "respuesta": "ok", "iterations": 2, "total_tokens": ', event_id, ', "duration_ms": 5}') ELSE 'no json' END"""


@query(
    "agent_run_totals",
    """SELECT user_id, count(*) AS events, sum((event_type = 'click')::BIGINT)::BIGINT AS tools, coalesce(sum(CASE WHEN event_type = 'view' THEN 4 + length(user_id::VARCHAR) END), 0)::BIGINT AS text_length,
        max(CASE WHEN event_type = 'purchase' THEN event_id END) AS total_tokens, max(event_type = 'purchase') AS finished FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id""",
)
def agent_run_totals(spark, d):
    lines = table(spark, d, "events").select("user_id", F.expr(AGENT_JSON).alias("line"))
    return EV.run_totals(EV.parsed(lines, "line", EV.AGENT_EVENTS), "user_id")


@query(
    "benchmark_run",
    """SELECT item_id, round(len(hits)::DOUBLE / 4, 2) AS criteria_score, len(hits)::BIGINT AS criteria_hits, 4::BIGINT AS criteria_total, (contains(upper(text), 'SI') OR contains(upper(text), 'SÍ') OR contains(upper(text), 'YES')) AS llm_correct
        FROM (SELECT *, list_filter(['the', 'of', 'zzz', item_id::VARCHAR], lambda c: contains(lower(strip_accents(text)), lower(c))) AS hits FROM benchmark)""",
)
def benchmark_run(spark, d):
    q = table(spark, d, "benchmark").withColumn("criteria", F.array(F.lit("the"), F.lit("of"), F.lit("zzz"), C("item_id").cast("string")))
    got = E.benchmark_queries(q, lambda df: df.withColumn("answer", F.upper("text")), lambda df: df.withColumn("said", C("text")))
    return got.select("item_id", "criteria_score", C("criteria_hits").cast("long").alias("criteria_hits"), C("criteria_total").cast("long").alias("criteria_total"), "llm_correct")
