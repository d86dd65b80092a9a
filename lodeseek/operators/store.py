"""State that outlives a request: sessions with their messages, and cached results, as tables that only grow.

Every change appends rows (a message, a deletion, a cleared key), so writers never rewrite what others read and a repeated
task cannot lose a row. Roll-ups and the latest row of a key are computed when read. Single appends make small files: write
many messages with one DataFrame where they come in numbers.
"""

import fnmatch
import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.operators import service, sessions

SESSIONS = "session string, repo string, model string, created_at double"
MESSAGES = "session string, role string, content string, tool_calls string, tokens long, created_at double, seq long"
GONE = "session string"
CACHE = "key string, value string, stored_at double, expires_at double"

# Prefixes of cache keys and seconds until they expire (None: never).
LIFETIMES = {"query": 60, "subgraph": 300, "ontology": None}
# End of the fixed values.


class Tables:
    """Append-only Parquet tables in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, home: str, schemas: dict[str, str]):
        self.spark, self.home, self.schemas = spark, home, schemas
        for name, schema in schemas.items():
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{home}/{name}")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.home}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.home}/{name}")

    def append_row(self, name: str, *row) -> None:
        self.append(name, self.spark.createDataFrame([row], self.schemas[name]).coalesce(1))


class SessionStore:
    """Sessions and their messages."""

    def __init__(self, spark: SparkSession, home: str):
        self.tables = Tables(spark, home, {"sessions": SESSIONS, "messages": MESSAGES, "gone": GONE})

    def create(self, repo: str, model: str = "") -> str:
        """A new session's id."""
        sid = uuid.uuid4().hex[:16]
        self.tables.append_row("sessions", sid, repo, model, time.time())
        return sid

    def add(self, session: str, role: str, content: str = "", tool_calls: list[dict] | None = None, tokens: int = 0) -> None:
        now = time.time_ns()
        self.tables.append_row("messages", session, role, content, json.dumps(tool_calls or [], ensure_ascii=False), tokens, now / 1e9, now)

    def add_all(self, messages: DataFrame) -> None:
        """Many messages at once; columns as in MESSAGES."""
        self.tables.append("messages", messages.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in MESSAGES.split(", ")]))

    def messages(self) -> DataFrame:
        return self.tables.read("messages").join(self.tables.read("gone"), "session", "left_anti")

    def sessions(self) -> DataFrame:
        """(session, repo, model, created_at, updated_at, message_count, total_tokens) of sessions that were not deleted."""
        return sessions.with_totals(self.tables.read("sessions").join(self.tables.read("gone"), "session", "left_anti"), self.tables.read("messages"), "session", F.col("tokens"), "created_at")

    def get(self, session: str) -> DataFrame:
        """One row, or none."""
        return self.sessions().where(F.col("session") == session)

    def list(self, n: int = 20) -> DataFrame:
        return self.sessions().orderBy(F.desc("updated_at"), "session").limit(n)

    def history(self, session: str, n: int = 50) -> DataFrame:
        """(role, content, tool_calls) of the last n messages in order of time; tool_calls is null where there were none."""
        last = sessions.history(self.messages().where(F.col("session") == session), "session", ["created_at", "seq"], n)
        return last.orderBy("created_at", "seq").select("role", "content", F.when(F.col("tool_calls") != "[]", F.col("tool_calls")).alias("tool_calls"))

    def delete(self, session: str) -> None:
        """The session and its messages are gone for every reader."""
        self.tables.append_row("gone", session)


def cache_name(kind: str, of: Column) -> Column:
    """Key of a cached result: queries by a digest without case and outer blanks, subgraphs and ontologies by their name."""
    return F.concat(F.lit(f"{kind}:"), service.cache_key(of) if kind == "query" else of)


def expiry(kind: str, stored: Column) -> Column:
    seconds = LIFETIMES[kind]
    return (stored + F.lit(float(seconds))) if seconds is not None else F.lit(None).cast("double")


def latest(cache: DataFrame) -> DataFrame:
    """The last row of each key."""
    return cache.groupBy("key").agg(F.max_by(F.struct("value", "stored_at", "expires_at"), "stored_at").alias("r")).select("key", "r.*")


def lookup(cache: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """asked (key, ...) with value: null where nothing is stored, or it has expired or was cleared."""
    live = latest(cache.join(asked.select("key").distinct(), "key", "left_semi")).where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return asked.join(live.select("key", "value"), "key", "left")


def matching(cache: DataFrame, pattern: str = "*") -> DataFrame:
    """Keys that fit a shell pattern."""
    return cache.where(F.rlike("key", F.lit("^" + fnmatch.translate(pattern).replace(r"\Z", r"\z")))).select("key").distinct()


class ResultCache:
    """Results of requests, subgraphs and ontologies, each with its lifetime."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.tables = spark, Tables(spark, home, {"cache": CACHE})

    def put(self, kind: str, rows: DataFrame, of: str, value: str, now: float | None = None) -> None:
        at = F.lit(time.time() if now is None else now)
        self.tables.append("cache", rows.select(cache_name(kind, F.col(of)).alias("key"), F.col(value).cast("string").alias("value"), at.alias("stored_at"), expiry(kind, at).alias("expires_at")))

    def get(self, kind: str, of: str, now: float | None = None) -> str | None:
        asked = self.spark.range(1).select(cache_name(kind, F.lit(of)).alias("key"))
        return lookup(self.tables.read("cache"), asked, F.lit(time.time() if now is None else now)).first().value

    def clear(self, pattern: str = "*", now: float | None = None) -> None:
        """Forget keys that fit a shell pattern, as rows without a value."""
        at = F.lit(time.time() if now is None else now)
        none = F.lit(None)
        self.tables.append("cache", matching(self.tables.read("cache"), pattern).select("key", none.cast("string").alias("value"), at.alias("stored_at"), none.cast("double").alias("expires_at")))
