"""Corpus pipeline: quality, exact copies, near copies, benchmark leaks, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. run() writes each stage's rows
to the shared folder and reads them again as the next one's docs. All stages but the last keep the columns of docs.
Copies go row by row: where ids repeat or are missing, rows are told apart by numbers of their own, so that exactly one
row of a group stays and no other row goes because it shares an id. The near stage takes shingles of five words. SQL
cannot express the classifier, so ORACLE_SQL is None and the tests compare run() with a plain version of each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.common import free_name, join_groups, row_ids, settle
from lodeseek.llm.decontaminate import decontaminate
from lodeseek.llm.exact_dedup import exact_dedup
from lodeseek.llm.near_dedup import near_dedup
from lodeseek.llm.packing import packing
from lodeseek.llm.quality import quality_scores

#: Documents with a lower probability of good quality go.
QUALITY = 0.3


def without(docs: DataFrame, key: str, dropped: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the rows of docs whose key is not in dropped (one column): hashes the few keys, and sorts no texts."""
    return docs.join(dropped.hint("shuffle_hash"), key, "left_anti").select(*[F.col(f"`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    r = free_name(docs, "result")
    got = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=docs.columns, result=r)
    return got.where(F.col(r).score >= QUALITY).drop(r)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = row_ids(docs, "doc_id")
    got = exact_dedup(rows, row_col=key)
    return without(rows, key, got.where(~F.col("kept")).select(key), docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, key = row_ids(docs, "doc_id")
    got = near_dedup(rows, id_col=key, shingle=5, percent=80)
    if key != "doc_id":  # of a group the smallest doc_id stays, not the smallest row number
        got = got.select(key, F.col("component_id").alias("c")).join(rows.select(key, F.col("doc_id").alias("i")), key)
        first = got.groupBy("c").agg(F.min(F.struct(F.col("i").isNull().alias("no"), "i", F.col(key).alias("row"))).alias("f"), F.count("*").alias("n")).where("n > 1")
        got = join_groups(got, first, "c", "n", got.count()).select(key, F.coalesce(F.col(key) == F.col("group.f.row"), F.lit(True)).alias("kept"))
    return without(rows, key, got.where(~F.col("kept")).select(key), docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    r = free_name(docs, "result")
    got = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=docs.columns, result=r)
    return got.where(F.col(r).n_hit == 0).drop(r)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing(docs)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", leaks), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
