"""Lexical retrieval: postings, document frequencies and BM25.

write_index stores postings (token, id, tf, dl) in order of token and id, cut by ranges of both, so the postings of a common
word are many files and a search reads only row groups that hold its words. bm25 scores without an index, in one pass over
the texts for the counts and one for the scores. Counts become doubles before any arithmetic.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.functions.text import words

K1, B = 1.5, 0.75


def tokens(docs: DataFrame, id_col: str, text_col: str, extra: list[str] | None = None) -> DataFrame:
    return docs.select(id_col, *(extra or []), words(F.col(text_col)).alias("w"))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return tokens(docs, id_col, text_col).select(id_col, F.explode("w").alias("token")).groupBy("token", id_col).agg(F.count("*").cast("double").alias("tf"))


def stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row: number of documents and mean length (at least 1)."""
    return tokens(docs, id_col, text_col).agg(F.count("*").cast("double").alias("n"), F.greatest(F.avg(F.size("w").cast("double")), F.lit(1.0)).alias("avgdl"))


def idf(df_col: str = "df") -> F.Column:
    d = F.col(df_col).cast("double")
    return F.ln((F.col("n") - d + 0.5) / (d + 0.5) + 1.0)


def document_frequencies(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    df = tokens(docs, id_col, text_col).select(F.explode(F.array_distinct("w")).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(stats(docs, id_col, text_col))).select("token", "df", idf().alias("idf"))


def _same(word: str):
    return lambda t: t == F.lit(word)


def bm25(docs: DataFrame, query: str, id_col: str, text_col: str, extra: list[str] | None = None) -> DataFrame:
    """Scores above 0 of the documents for a query; a repeated word counts again.

    For texts without an index. Nothing of the texts is shuffled.
    """
    extra = extra or []
    asked = query_words(query)
    if not asked:
        return docs.select(id_col, *extra, F.lit(0.0).alias("score")).where(F.lit(False))
    own = tokens(docs, id_col, text_col, extra)
    tf = [F.size(F.filter("w", _same(w))).cast("double").alias(f"tf{i}") for i, w in enumerate(asked)]
    rows = own.select(id_col, *extra, F.size("w").cast("double").alias("dl"), *tf)
    sums = [F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"df{i}") for i in range(len(asked))]
    one = rows.agg(F.count("*").cast("double").alias("n"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"), *sums)
    rows = rows.where(" or ".join(f"tf{i} > 0" for i in range(len(asked)))).crossJoin(F.broadcast(one))
    score = F.lit(0.0)
    for i, times in enumerate(asked.values()):
        t = F.col(f"tf{i}")
        score = score + F.when(t > 0, weight(t, f"df{i}") * float(times)).otherwise(0.0)
    return rows.withColumn("score", score).where("score > 0").select(id_col, *extra, "score")


def query_words(query: str) -> dict[str, int]:
    """Words of a query with the times they occur."""
    asked: dict[str, int] = {}
    for w in query.lower().split():
        asked[w] = asked.get(w, 0) + 1
    return asked


def weight(tf: Column, df_col: str) -> Column:
    """What one word adds to a document's score; needs n, dl and avgdl."""
    return idf(df_col) * tf * (K1 + 1) / F.greatest(tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")), F.lit(0.001))


def write_index(docs: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """Store postings (path/postings) and the row of stats (path/stats). Ids are those of documents: rows of one id are one text each."""
    own = tokens(docs, id_col, text_col).select(F.col(id_col).alias("id"), F.size("w").cast("double").alias("dl"), F.explode("w").alias("token"))
    rows = own.groupBy("token", "id", "dl").agg(F.count("*").cast("double").alias("tf"))
    rows.repartitionByRange("token", "id").sortWithinPartitions("token", "id").write.mode("overwrite").parquet(f"{path}/postings")
    stats(docs, id_col, text_col).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def search_index(spark: SparkSession, path: str, query: str, id_col: str = "id") -> DataFrame:
    """Scores above 0 as bm25 gives them, from the stored postings of the query's words."""
    asked = query_words(query)
    rows = spark.read.parquet(f"{path}/postings").where(F.col("token").isin(*asked) if asked else F.lit(False))
    df = rows.groupBy("token").agg(F.count("*").alias("df"))  # a row for each word of the query
    rows = rows.join(F.broadcast(df), "token").crossJoin(F.broadcast(spark.read.parquet(f"{path}/stats")))  # one row
    times = F.coalesce(*[F.when(F.col("token") == w, float(k)) for w, k in asked.items()], F.lit(1.0))
    return rows.groupBy(F.col("id").alias(id_col)).agg(F.sum(weight(F.col("tf"), "df") * times).alias("score")).where("score > 0")


def top(df: DataFrame, k: int, score: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(score), tie).limit(k)


def top_per(df: DataFrame, k: int, key: str, score: str, tie: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), tie))
    return df.withColumn("place", place).where(F.col("place") <= k)
