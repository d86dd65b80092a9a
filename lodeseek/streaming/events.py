"""Events that a request or a goal sends while it runs: their fields, and frames of them from lines of JSON."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Event types with the names and types of their fields.
AGENT_EVENTS = {
    "context": {"task_type": "string", "tokens": "bigint"},
    "plugins": {"plugins": "array<struct<name:string,type:string,running:boolean,tool_count:bigint>>"},
    "skills": {"skills": "array<struct<name:string,source:string,priority:bigint>>"},
    "token": {"text": "string"},
    "tool_start": {"name": "string", "args": "map<string,string>"},
    "tool_result": {"name": "string", "output": "string"},
    "done": {"respuesta": "string", "iterations": "bigint", "total_tokens": "bigint", "duration_ms": "bigint"},
}
GOAL_EVENTS = {
    "goal_start": {"goal": "string", "description": "string"},
    "goal_phase": {"phase": "string"},
    "plan": {"steps": "array<string>"},
    "step_start": {"step": "bigint", "total": "bigint", "description": "string"},
    "step_error": {"step": "bigint", "error": "string"},
    "step_done": {"step": "bigint", "status": "string", "progress": "string", "tokens": "bigint", "duration_ms": "bigint"},
    "replan": {"added_steps": "array<string>"},
    "verify": {"result": "string"},
    "goal_continue": {"remaining": "array<string>"},
    "goal_done": {"goal": "string", "status": "string", "steps_done": "bigint", "total_steps": "bigint", "tokens": "bigint", "duration_ms": "bigint"},
    "goal_error": {"error": "string"},
}
# End of the fixed values.


def schema(kinds: dict[str, dict[str, str]]) -> str:
    """One struct with the fields of all types; a field's type is the same wherever it occurs."""
    fields: dict[str, str] = {"type": "string"}
    for own in kinds.values():
        for name, kind in own.items():
            if fields.setdefault(name, kind) != kind:
                raise ValueError(f"{name} has two types")
    return ", ".join(f"`{n}` {k}" for n, k in fields.items())


def parsed(lines: DataFrame, column: str, kinds: dict[str, dict[str, str]]) -> DataFrame:
    """lines with a struct `event`; lines that are no JSON or no known type are dropped. Works on streams."""
    got = lines.withColumn("event", F.from_json(F.col(column), schema(kinds)))
    return got.where(F.col("event.type").isin(*kinds))


def of_type(events: DataFrame, kind: str, kinds: dict[str, dict[str, str]], *keep: str) -> DataFrame:
    """Events of one type, with that type's fields as columns."""
    return events.where(F.col("event.type") == kind).select(*keep, *[F.col(f"event.{n}").alias(n) for n in kinds[kind]])


def run_totals(events: DataFrame, key: str) -> DataFrame:
    """(key, events, tools, text_length, total_tokens, finished): one row for each request."""
    kind: Column = F.col("event.type")
    return events.groupBy(key).agg(
        F.count("*").alias("events"), F.sum((kind == "tool_start").cast("long")).alias("tools"), F.coalesce(F.sum(F.when(kind == "token", F.length("event.text"))), F.lit(0)).cast("long").alias("text_length"),
        F.max(F.when(kind == "done", F.col("event.total_tokens"))).alias("total_tokens"), F.max(kind == "done").alias("finished"),
    )
