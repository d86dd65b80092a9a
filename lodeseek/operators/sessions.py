"""Sessions and messages: roll-ups, histories, compaction, references to code, deletion."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Patterns of references, words that are no function names, and what tool calls are called.
FILE_REF = r"(?U)(?:en|in|archivo|file|path)[\s:]+([\w./-]+\.[\w]+)"
FUNCTION_REF = r"(?U)(?:función|funcion|function|def|class)\s+[`'\"]?(\w+)[`'\"]?"
NO_FUNCTION = ["if", "for", "while", "return", "new", "class"]
ACTIONS = {
    "read_file": "archivos leidos", "write_file": "archivos escritos", "replace_in_file": "cambios realizados", "run_tests": "tests ejecutados",
    "execute_command": "comandos ejecutados", "gh_pr_create": "PR creado",
}
SUMMARY = "[Resumen de conversacion anterior]"
# End of the fixed values.


def rollup(messages: DataFrame, session: str, tokens: Column, at: str) -> DataFrame:
    """(session, message_count, total_tokens, updated_at)"""
    return messages.groupBy(session).agg(F.count("*").alias("message_count"), F.sum(tokens).alias("total_tokens"), F.max(at).alias("updated_at"))


def with_totals(table: DataFrame, messages: DataFrame, session: str, tokens: Column, at: str) -> DataFrame:
    """Sessions (session, ..., created_at) with updated_at, message_count and total_tokens; without messages 0, as of their creation."""
    totals = rollup(messages, session, tokens, at).withColumnRenamed("updated_at", "_last")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table.join(totals, session, "left").select(*table.columns, F.coalesce("_last", "created_at").alias("updated_at"), zero("message_count"), zero("total_tokens"))


def history(messages: DataFrame, session: str, order: list[str], n: int) -> DataFrame:
    """The last n messages of each session."""
    place = F.row_number().over(Window.partitionBy(session).orderBy(*[F.desc(c) for c in order]))
    return messages.withColumn("_p", place).where(F.col("_p") <= n).drop("_p")


def delete(sessions: DataFrame, messages: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions of `gone`."""
    return sessions.join(gone.select(key), key, "left_anti"), messages.join(gone.select(key), key, "left_anti")


def file_refs(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(FILE_REF), F.lit(1)))


def function_refs(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(FUNCTION_REF), F.lit(1)), lambda x: ~x.isin(NO_FUNCTION)))


def actions(tools: Column) -> Column:
    """Sorted distinct descriptions of the tools called (array of names)."""
    named = F.transform(tools, lambda t: F.coalesce(*[F.when(t == k, v) for k, v in ACTIONS.items()]))
    return F.array_sort(F.array_distinct(F.filter(named, lambda x: x.isNotNull())))


def compact(messages: DataFrame, session: str, order: str, text: str, most: int = 30, tools: str | None = None) -> DataFrame:
    """(session, place, role, content): short sessions as they are; of longer ones a summary of references, then the last most - 2."""
    w = Window.partitionBy(session)
    rows = messages.withColumn("_n", F.count("*").over(w)).withColumn("_p", F.row_number().over(w.orderBy(order)))
    recent = (F.col("_n") <= most) | (F.col("_p") > F.col("_n") - (most - 2))
    body = F.coalesce(F.col(text), F.lit(""))
    old = rows.where(~recent).select(session, file_refs(body).alias("f"), function_refs(body).alias("g"), (actions(F.col(tools)) if tools else F.array().cast("array<string>")).alias("a"))
    ten = lambda c, n: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, n)
    refs = old.groupBy(session).agg(ten("f", 10).alias("f"), ten("g", 10).alias("g"), ten("a", 5).alias("a"))
    line = lambda title, c, sep: F.when(F.size(c) > 0, F.concat(F.lit(f"\n{title}: "), F.array_join(c, sep))).otherwise("")
    summary = refs.select(session, F.lit(0).alias("place"), F.lit("system").alias("role"), F.concat(F.lit(SUMMARY), line("Archivos mencionados", "f", ", "), line("Funciones discutidas", "g", ", "), line("Acciones realizadas", "a", "; ")).alias("content"))
    return rows.where(recent).select(session, F.col("_p").alias("place"), "role", body.alias("content")).unionByName(summary)


def compact_loop(messages: DataFrame, session: str, order: str, text: str, keep: int = 6) -> DataFrame:
    """(session, place, role, content): the first two messages, a note of how many were left out, and the last `keep`."""
    w = Window.partitionBy(session)
    rows = messages.withColumn("_n", F.count("*").over(w)).withColumn("_p", F.row_number().over(w.orderBy(order)))
    stay = (F.col("_n") <= keep + 2) | (F.col("_p") <= 2) | (F.col("_p") > F.col("_n") - keep)
    note = F.concat(F.lit("["), (F.col("_n") - keep - 2).cast("string"), F.lit(" mensajes omitidos]"))
    cut = rows.where((F.col("_p") == 3) & ~stay).select(session, F.col("_p").alias("place"), F.lit("system").alias("role"), note.alias("content"))
    return rows.where(stay).select(session, F.col("_p").alias("place"), "role", F.coalesce(F.col(text), F.lit("")).alias("content")).unionByName(cut)
