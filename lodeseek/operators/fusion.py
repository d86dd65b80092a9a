"""Hybrid retrieval: exact-match tiers, reciprocal rank fusion, and the cut."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodeseek.functions.tasks import query_words

RRF_K = 60


def words_of(spark, query: str) -> list[str]:
    return spark.range(1).select(query_words(F.lit(query)).alias("w")).first().w


def directories(query: str) -> list[str]:
    import re

    return sorted({d.lower() for d in re.findall(r"\b([\w-]+)/", query)})


def exact_tiers(capsules: DataFrame, query: str) -> DataFrame:
    """(id, tier, place) of exact matches: up to 20 from files named in the query, 5 files by path, 3 by name.

    The query's words are literals, so this is one scan of id, path, name and type; tiers are exclusive: a file matched
    by path gives its first capsule only, and its others are not tried by name.
    """
    words = words_of(capsules.sparkSession, query)
    dirs = directories(query)
    arr = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    path, name = F.lower(F.regexp_replace("file_path", r"\\", "/")), F.lower("name")
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(.)\.[^.]*$", "$1")
    named = F.array_contains(arr, stem) | F.array_contains(arr, F.regexp_replace(stem, "_", ""))
    in_path = F.size(F.filter(arr, lambda w: F.contains(path, w)))
    in_name = F.size(F.filter(arr, lambda w: F.contains(name, w)))
    tier = F.when(named, 1).when(in_path > 0, 2).when(in_name > 0, 3)
    near = F.exists(F.array(*[F.lit(f"/{d}/") for d in dirs]), lambda d: F.contains(path, d)).cast("int") if dirs else F.lit(0)
    plain = (F.col("type").isin("function", "class") & ~F.contains("name", F.lit("."))).cast("int")
    rows = capsules.select("id", "file_path", "start_line", "seq", tier.alias("tier"), F.when(tier == 1, near).otherwise(0).alias("a"), F.when(tier == 1, in_path).otherwise(0).alias("b"), F.when(tier == 1, plain).otherwise(0).alias("c"), F.when(tier == 1, in_name).otherwise(0).alias("d")).where("tier is not null")
    one = rows.where("tier = 2").groupBy("file_path").agg(F.min_by("id", F.struct("start_line", "seq")).alias("id")).select("id")
    rows = rows.where("tier <> 2").unionByName(rows.where("tier = 2").join(one, "id", "left_semi"))
    order = [F.desc("a"), F.desc("b"), F.desc("c"), F.desc("d"), "file_path", "start_line", "seq", "id"]
    place = F.row_number().over(Window.partitionBy("tier").orderBy(*order))
    cut = F.when(F.col("tier") == 1, 20).when(F.col("tier") == 2, 5).otherwise(3)
    return rows.withColumn("place", place).where(F.col("place") <= cut).select("id", "tier", "place")


def ranked(df: DataFrame, order: list) -> DataFrame:
    """(id, rank): rank from 0; df is already cut to a few rows."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1).select("id", "rank")


def rrf(lists: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(id, score, first) of ranked lists (id, rank): the sum of 1 / (k + rank + 1), and where an id was first seen."""
    rows = reduce(DataFrame.unionByName, [x.select("id", "rank", F.lit(i).alias("list")) for i, x in enumerate(lists)])
    return rows.groupBy("id").agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank") + 1)).alias("score"), F.min(F.struct("list", "rank")).alias("first"))


def hybrid(exact: DataFrame, dense: DataFrame, sparse: DataFrame, task: str) -> DataFrame:
    """(id, place, score): exact matches in their order, then the rest by fused score; cut to 30, 25 or 15.

    dense and sparse are ranked lists (id, rank); ranks of dense count after the exact ones are taken out.
    """
    first = ranked(exact, ["tier", "place"])
    semantic = ranked(dense.join(first.select("id"), "id", "left_anti"), ["rank", "id"])
    fused = rrf([first, semantic, sparse]).join(first.withColumnRenamed("rank", "exact"), "id", "left")
    place = F.row_number().over(Window.orderBy(F.coalesce("exact", F.lit(1 << 30)), F.desc("score"), "first"))
    named = F.lit(30) if task == "search" else F.when(F.lit(bool(exact.where("tier = 1").limit(1).count())), 25).otherwise(15)
    return fused.withColumn("place", place).where(F.col("place") <= named).select("id", "place", "score")
