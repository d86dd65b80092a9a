"""Operating the service: metrics, rate limits, caches, permissions, costs, routing, goals."""

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.operators.model_catalogue import COLUMNS, MODELS

# Preferred models by complexity and by task, the last resort, and constants of the service.
ROUTES = {
    "simple": ["ollama/qwen2.5-coder:7b", "deepseek/deepseek-v4-flash", "openrouter/google/gemini-2.5-flash", "openrouter/meta-llama/llama-4-maverick"],
    "medium": ["anthropic/claude-sonnet-4", "deepseek/deepseek-v4-pro", "openai/gpt-4o", "mistral/codestral"],
    "complex": ["anthropic/claude-opus-4", "openai/gpt-5.5", "deepseek/deepseek-v4-pro", "google/gemini-2.5-pro"],
    "code": ["anthropic/claude-sonnet-4", "deepseek/deepseek-v4-pro", "deepseek/deepseek-v4-flash", "mistral/codestral", "ollama/qwen2.5-coder:14b"],
}
PREFERRED = {
    "code": ["anthropic/claude-sonnet-4", "deepseek/deepseek-v4-pro", "deepseek/deepseek-v4-flash", "ollama/qwen2.5-coder:14b"],
    "general": ["anthropic/claude-sonnet-4", "openai/gpt-4o", "deepseek/deepseek-v4-flash"],
    "cheap": ["deepseek/deepseek-v4-flash", "ollama/qwen2.5-coder:7b", "openrouter/google/gemini-2.5-flash"],
    "local": ["ollama/qwen2.5-coder:14b", "ollama/deepseek-coder-v2", "ollama/llama3.1:8b"],
}
LAST_RESORT = "deepseek/deepseek-chat"
TOKENS_PER_QUERY = 20_000
RATE_LIMIT, RATE_SECONDS = 30, 10.0
BREAK_AFTER, BREAK_SECONDS = 3, 30.0
KEEP_MOST, KEEP_LAST = 10_000, 5_000
RESULT_TTL, SUBGRAPH_TTL = 60, 300
# End of the fixed values.


def models(spark: SparkSession) -> DataFrame:
    """The model catalogue: one row per model, numbered by pos in order."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(MODELS)], f"pos int, {COLUMNS}")


def model_info(catalogue: DataFrame, provider: str, model: str) -> DataFrame:
    """The model whose id is provider/model or, without such a one, model: one row or none."""
    both = catalogue.where(F.col("model").isin(f"{provider}/{model}", model))
    return both.orderBy(F.col("model") != f"{provider}/{model}").limit(1)


def active_models(fetched: DataFrame) -> DataFrame:
    """Rows of a fetched catalogue that are not deprecated."""
    return fetched.where(F.coalesce(F.col("status"), F.lit("active")) != "deprecated")


def cost(usage: DataFrame, catalogue: DataFrame) -> DataFrame:
    """usage (model, input_tokens, output_tokens, cache_read, cache_write) with its cost; an unknown model costs 0."""
    parts = [F.col(f"cost_{a}") * F.col(b) / 1e6 for a, b in (("input", "input_tokens"), ("output", "output_tokens"), ("cache_read", "cache_read"), ("cache_write", "cache_write"))]
    price = catalogue.select("model", *[c for c in catalogue.columns if c.startswith("cost_")])
    return usage.join(F.broadcast(price), "model", "left").select(*usage.columns, F.coalesce(sum(parts[1:], parts[0]), F.lit(0.0)).alias("cost"))


def session_costs(sessions: DataFrame, catalogue: DataFrame) -> DataFrame:
    """sessions (model, message_count, total_tokens, ...) with cost, half of the tokens taken as read and half as written, and tokens saved."""
    half = F.floor(F.col("total_tokens") / 2)
    none = F.lit(0)
    priced = cost(sessions.withColumns({"input_tokens": half, "output_tokens": half, "cache_read": none, "cache_write": none}), catalogue)
    saved = F.greatest(F.lit(0), F.col("message_count") * TOKENS_PER_QUERY - F.col("total_tokens"))
    return priced.select(*sessions.columns, "cost", saved.alias("saved"))


def route(requests: DataFrame, key: str, want: str, providers: str, table: dict[str, list[str]], default: str, catalogue: DataFrame) -> DataFrame:
    """(key, model): the first candidate whose provider is in the array `providers`, else the first provider's first model, else the last resort."""
    first = catalogue.groupBy("provider").agg(F.min_by("model", "pos").alias("_first"))
    lists = F.coalesce(*[F.when(F.col(want) == k, F.array(*[F.lit(m) for m in v])) for k, v in table.items()], F.array(*[F.lit(m) for m in table[default]]))
    pick = F.try_element_at(F.filter(lists, lambda m: F.array_contains(F.col(providers), F.substring_index(m, "/", 1))), F.lit(1))
    rows = requests.select(key, pick.alias("_pick"), F.try_element_at(F.col(providers), F.lit(1)).alias("provider"))
    return rows.join(F.broadcast(first), "provider", "left").select(key, F.coalesce("_pick", "_first", F.lit(LAST_RESORT)).alias("model"))


def metrics(events: DataFrame, latency: str, tokens: Column, hit: Column, miss: Column) -> DataFrame:
    """One row: totals, tokens saved, hit rate, mean, median and 99th percentile of latency as the service defines them.

    Percentiles are elements of the sorted list at floor(n / 2) and floor(0.99 n) (the last up to 100): they come from
    a running sum over the distinct values, of which latencies in whole milliseconds have few.
    """
    one = events.agg(
        F.count(latency).alias("queries_total"), F.coalesce(F.sum(tokens), F.lit(0)).alias("tokens_used"), F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("cache_hits"),
        F.coalesce(F.sum(miss.cast("long")), F.lit(0)).alias("cache_misses"), F.coalesce(F.avg(latency), F.lit(0.0)).alias("avg_latency"),
    )
    n = F.col("queries_total")
    counts = events.where(F.col(latency).isNotNull()).groupBy(F.col(latency).alias("v")).agg(F.count("*").alias("c"))
    mid, top = F.floor(n / 2), F.when(n > 100, F.floor(n * 0.99)).otherwise(n - 1)
    run = F.sum("c").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    upto = counts.withColumn("upto", run).crossJoin(F.broadcast(one.select(mid.alias("mid"), top.alias("top"))))
    pick = upto.agg(F.min(F.when(F.col("upto") > F.col("mid"), F.col("v"))).alias("p50_latency"), F.min(F.when(F.col("upto") > F.col("top"), F.col("v"))).alias("p99_latency"))
    saved = F.greatest(F.lit(0), n * TOKENS_PER_QUERY - F.col("tokens_used"))
    seen = F.col("cache_hits") + F.col("cache_misses")
    rate = F.when(seen > 0, F.col("cache_hits").cast("double") / seen).otherwise(0.0)
    return one.crossJoin(pick).select("queries_total", "tokens_used", saved.alias("tokens_saved"), "cache_hits", "cache_misses", rate.alias("hit_rate"), "avg_latency", F.coalesce("p50_latency", F.lit(0.0)).alias("p50_latency"), F.coalesce("p99_latency", F.lit(0.0)).alias("p99_latency"))


def index_gauges(runs: DataFrame, capsules: str) -> DataFrame:
    """One row over runs of the indexer: capsules (the most that one run found, 0 without runs) and repos (number of runs)."""
    return runs.agg(F.coalesce(F.max(capsules), F.lit(0)).alias("capsules"), F.count("*").alias("repos"))


def retained(events: DataFrame, order: list[str], most: int = KEEP_MOST, last: int = KEEP_LAST) -> DataFrame:
    """What a bounded buffer holds at the end: it is cut to the last `last` whenever it exceeds `most`."""
    n = events.count()
    extra = n - most
    size = n if extra <= 0 else last + (extra - 1) % (most - last + 1)
    return events.orderBy(*[F.desc(c) for c in order]).limit(size)


class Limiter:
    """Admits up to `most` calls within `seconds`; only admitted calls count."""

    def __init__(self, stamps=(), most: int = RATE_LIMIT, seconds: float = RATE_SECONDS):
        self.stamps, self.most, self.seconds = deque(stamps), most, seconds

    def admit(self, at: float) -> bool:
        while self.stamps and at - self.stamps[0] >= self.seconds:
            self.stamps.popleft()
        if len(self.stamps) >= self.most:
            return False
        self.stamps.append(at)
        return True


class Breaker:
    """Opens after BREAK_AFTER failures in a row, for BREAK_SECONDS after the last; calls made while open count as skipped."""

    def __init__(self, failures: int = 0, last: float = 0.0):
        self.failures, self.last = failures, last

    def call(self, at: float, ok: bool) -> str:
        if self.failures >= BREAK_AFTER:
            if at - self.last <= BREAK_SECONDS:
                return "open"
            self.failures = 0
        if ok:
            self.failures = 0
            return "ok"
        self.failures, self.last = self.failures + 1, at
        return "failed"


def _folded(events: DataFrame, key: str, at: str, tie: str, extra: list[str], make, use, out: str, kind: str) -> DataFrame:
    """One sequential pass per key over events in order of time. Rows stream through, so a long key needs no memory."""
    cols = [key, tie, at, *extra]
    rows = events.select(*cols).repartition(key).sortWithinPartitions(key, at, tie)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + f", {out} {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state = object(), None
        for b in batches:
            got = []
            for row in b.itertuples(index=False):
                if row[0] != held:
                    held, state = row[0], make()
                got.append(use(state, *row[2:]))
            yield b.assign(**{out: got})

    return rows.mapInPandas(run, schema)


def rate_limit(events: DataFrame, key: str, at: str, tie: str, most: int = RATE_LIMIT, seconds: float = RATE_SECONDS) -> DataFrame:
    """(key, tie, at, admitted): at is in seconds."""
    return _folded(events, key, at, tie, [], lambda: Limiter((), most, seconds), lambda s, t: s.admit(t), "admitted", "boolean")


def rate_upper(events: DataFrame, key: str, at: str, most: int = RATE_LIMIT, seconds: int = int(RATE_SECONDS)) -> DataFrame:
    """events with the number of calls in the last seconds, rejected ones included, and whether that is within the limit."""
    w = Window.partitionBy(key).orderBy(F.col(at).cast("long")).rangeBetween(-(seconds - 1), 0)
    return events.withColumn("recent", F.count("*").over(w)).withColumn("within", F.col("recent") <= most)


def circuit_breaker(events: DataFrame, key: str, at: str, tie: str, ok: str) -> DataFrame:
    """(key, tie, at, ok, state): ok, failed, or open (not tried)."""
    return _folded(events, key, at, tie, [ok], Breaker, lambda s, t, good: s.call(t, bool(good)), "state", "string")


def cache_key(query: Column) -> Column:
    return F.md5(F.lower(F.trim(query)).cast("binary"))


def context_key(query: Column, repo: Column, task: Column, budget: Column) -> Column:
    return F.concat_ws("|", query, repo, task, budget.cast("string"))


def live(cache: DataFrame, stored: str, now: Column, seconds: int = RESULT_TTL) -> DataFrame:
    """Cache rows that have not expired; both times count as the nearest whole second, halves as the even one."""
    second = lambda t: F.rint(F.unix_micros(t.cast("timestamp")) / F.lit(1e6))
    return cache.where(second(F.col(stored)) + seconds > second(now))


def permitted(mode: Column, tool: Column, allow: list[str], deny: list[str], path: Column | None = None, repo: str = "") -> Column:
    """struct(allowed, reason) for a tool call: mode, allow and deny lists, then the directory scope of its path."""
    yes = lambda r: F.struct(F.lit(True).alias("allowed"), F.lit(r).alias("reason"))
    no = lambda r: F.struct(F.lit(False).alias("allowed"), F.lit(r).alias("reason"))
    out = F.when(mode == "deny", no("deny mode")).when(mode == "auto", yes("auto")).when(tool.isin(allow), yes("auto-allow")).when(tool.isin(deny), no("auto-deny"))
    if path is not None:
        out = out.when((path != "") & ~F.startswith(path, F.lit(repo)), no("outside the project"))
    return out.otherwise(yes("ask"))


def repeated_calls(calls: DataFrame, session: str, name: str, args: str, order: list[str]) -> DataFrame:
    """calls with `repeated`: whether the session made a call of this name and the same first 80 characters of arguments before."""
    w = Window.partitionBy(session, name, F.substring(F.col(args), 1, 80)).orderBy(*order)
    return calls.withColumn("repeated", F.row_number().over(w) > 1)


def goal_totals(steps: DataFrame, goal: str) -> DataFrame:
    """(goal, steps, done, tokens, seconds). steps (goal, status, tokens, seconds)."""
    return steps.groupBy(goal).agg(F.count("*").alias("steps"), F.sum((F.col("status") == "done").cast("long")).alias("done"), F.sum("tokens").alias("tokens"), F.round(F.sum("seconds"), 3).alias("seconds"))


def token_estimates(text: Column) -> tuple[Column, Column]:
    """The two estimates in use: half and a quarter of the characters."""
    return F.floor(F.length(text) / 2), F.floor(F.length(text) / 4)
