"""Evaluation: criteria, evidence, grounding, judge scores and benchmark reports."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the judge's four marks, in this order.
MARKS = {"relevancia": 0.30, "correccion": 0.30, "completitud": 0.25, "accionabilidad": 0.15}


def plain(text: Column) -> Column:
    """Lower case without accents, compared by a collation that ignores both."""
    return F.collate(text, "UNICODE_CI_AI")


def criteria_score(answer: Column, criteria: Column) -> Column:
    """Share of the criteria (array) that the answer holds, without case and accents, to two places; 0 without criteria."""
    hits = F.size(F.filter(criteria, lambda c: F.contains(plain(answer), plain(c))))
    return F.when(F.size(criteria) > 0, F.round(hits.cast("double") / F.size(criteria), 2)).otherwise(0.0)


def benchmark_queries(queries: DataFrame, answer, judge=None) -> DataFrame:
    """A benchmark over a table of queries (criteria array, ...): each row with its answer, criteria_score, criteria_hits, criteria_total, llm_correct.

    answer adds a column `answer` to the table, judge a column `said` to that; both are functions of DataFrames. Without a judge llm_correct is null.
    """
    rows = queries.transform(answer)
    said = rows.transform(judge) if judge else rows.withColumn("said", F.lit(None).cast("string"))
    text = F.coalesce("answer", F.lit(""))
    hits = F.size(F.filter("criteria", lambda c: F.contains(plain(text), plain(c))))
    return said.select(*rows.columns, criteria_score(text, F.col("criteria")).alias("criteria_score"), hits.alias("criteria_hits"), F.size("criteria").alias("criteria_total"), verdict(F.col("said")).alias("llm_correct"))


def judge_composite(**marks: Column) -> Column:
    return F.round(sum((marks[k] * w for k, w in MARKS.items()), F.lit(0.0)), 2)


def verdict(text: Column) -> Column:
    """A judge's yes, in Spanish or English, anywhere in what it said.

    Case is folded letter by letter: a long s and a dotless i are capital S and I, but ß is no SS, so `großi` holds no SI.
    """
    return F.rlike(text, F.lit("[Ssſ][IiıÍí]|[Yy][Ee][Ssſ]"))


#: Candidates share a name's first characters, up to so many, with the answer.
GRAM = 5


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else key


def evidence(answers: DataFrame, nodes: DataFrame, key: str | list[str], answer: str) -> DataFrame:
    """(key, node_id, name): nodes whose name (two letters at least) the answer holds; of equal names the last node, longest names first by place.

    Names are found by an equi-join of their first characters with the answer's n-grams, and each candidate is then checked on the whole text.
    Keys identify answers.
    """
    keys = _keys(key)
    last = nodes.where(F.length("name") >= 2).groupBy(F.lower("name").alias("low")).agg(F.max_by(F.struct("id", "name"), "id").alias("n")).select("low", F.col("n.id").alias("node_id"), F.col("n.name").alias("name"))
    texts = answers.select(*keys, F.lower(F.col(answer)).alias("_a"))
    texts = texts.withColumn("_c", F.split("_a", ""))
    of = lambda n: F.transform("_c", lambda _, i: F.array_join(F.slice("_c", i + 1, n), ""))
    grams = F.array_distinct(F.flatten(F.array(*[of(n) for n in range(2, GRAM + 1)])))
    pairs = texts.select(*keys, F.explode(grams).alias("_g")).join(last.withColumn("_g", F.substring("low", 1, GRAM)), "_g").drop("_g")
    hits = pairs.join(texts.drop("_c"), keys).where(F.contains(F.col("_a"), F.col("low")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.length("name")), "low"))
    return hits.select(*keys, "node_id", "name", place.alias("place"))


def uncited(nodes: DataFrame, found: DataFrame, key: str | list[str]) -> DataFrame:
    """(key, node_id): nodes that an answer does not cite."""
    keys = _keys(key)
    every = found.select(*keys).distinct().crossJoin(nodes.select(F.col("id").alias("node_id")))
    return every.join(found.select(*keys, "node_id"), [*keys, "node_id"], "left_anti")


def uncited_counts(nodes: DataFrame, found: DataFrame, key: str | list[str]) -> DataFrame:
    """(key, n): how many rows uncited has for each answer, as all nodes less the cited ones, without making those rows."""
    keys = _keys(key)
    total = nodes.agg(F.count("*").alias("total"))
    same = nodes.groupBy(F.col("id").alias("node_id")).agg(F.count("*").alias("m"))
    cited = found.select(*keys, "node_id").distinct().join(same, "node_id", "left").groupBy(*keys).agg(F.sum(F.coalesce("m", F.lit(0))).alias("c"))
    return cited.crossJoin(F.broadcast(total)).select(*keys, (F.col("total") - F.col("c")).alias("n")).where("n > 0")


def grounding(found: DataFrame, nodes: DataFrame, key: str | list[str]) -> DataFrame:
    """(key, cited, verified, score, level): cited nodes that exist over all nodes; low under 0.70."""
    keys = _keys(key)
    total = nodes.agg(F.count("*").alias("total"))
    ok = found.join(nodes.select(F.col("id").alias("node_id"), F.lit(1).alias("real")), "node_id", "left")
    out = ok.groupBy(*keys).agg(F.count("*").alias("cited"), F.count("real").alias("verified")).crossJoin(F.broadcast(total))
    score = F.when(F.col("total") > 0, F.round(F.col("verified").cast("double") / F.col("total"), 3)).otherwise(0.0)
    return out.select(*keys, "cited", "verified", score.alias("score"), F.when(score < 0.70, "low").otherwise("ok").alias("level"))


def system_report(results: DataFrame) -> DataFrame:
    """Per system: tasks, total and mean tokens, mean score and time. results (system, task, tokens, score, ms)."""
    r2 = lambda c: F.round(F.avg(F.col(c).cast("double")), 2)
    return results.groupBy("system").agg(F.count("*").alias("n"), F.sum("tokens").alias("total_tokens"), r2("tokens").alias("avg_tokens"), r2("score").alias("avg_score"), r2("ms").alias("avg_ms"))


def token_reduction(results: DataFrame, ours: str, other: str) -> DataFrame:
    """One row: tasks that both have, wins of ours (score at least as good), and the token reduction in percent."""
    a = results.where(F.col("system") == ours).select("task", F.col("tokens").alias("t1"), F.col("score").alias("s1"))
    b = results.where(F.col("system") == other).select("task", F.col("tokens").alias("t2"), F.col("score").alias("s2"))
    pct = F.round((1 - F.sum("t1").cast("double") / F.sum("t2")) * 100, 1)
    return a.join(b, "task").agg(F.count("*").alias("tasks"), F.sum((F.col("s1") >= F.col("s2")).cast("long")).alias("wins"), pct.alias("reduction_pct"))


def benchmark_summary(rows: DataFrame) -> DataFrame:
    """One row: coverage of criteria, share of yes verdicts, tokens. rows (criteria_score, verdict, tokens)."""
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("criteria_score"), 2).alias("coverage"), F.round(F.avg(F.col("verdict").cast("double")), 2).alias("judge_ratio"), F.sum("tokens").alias("tokens"), F.round(F.avg(F.col("tokens").cast("double")), 2).alias("avg_tokens"))
