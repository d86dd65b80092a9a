"""The engine's interface: index a repository, search it, and build contexts for requests.

The index is a Parquet table partitioned by repository and language, so a request on one repository reads its
partitions only. Vectors are stored with the records, and postings in a table of each repository.
"""

import hashlib
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.functions import tasks
from lodeseek.operators import extract, fusion, graph, lexical, render, vectors
from lodeseek.sources import files as sources


def lexical_text() -> F.Column:
    return F.concat_ws(" ", "name", "signature", F.coalesce("docstring", F.lit("")))


class Engine:
    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home, self.path = spark, home, f"{home}/capsules"
        self.worker = ThreadPoolExecutor(1, "index")

    def index(self, root: str, repo: str, languages: list[str] | None = None) -> int:
        """Extract and store a repository, replacing what is stored of it; the number of records."""
        return self.index_files(sources.read_sources(self.spark, root, languages), repo)

    def index_later(self, root: str, repo: str, languages: list[str] | None = None) -> Future:
        """Index in the background; calls run one after the other, and the result is the number of records."""
        return self.worker.submit(self.index, root, repo, languages)

    def index_files(self, files: DataFrame, repo: str) -> int:
        found = extract.capsules(files).where("type <> 'error'").withColumn("repo", F.lit(repo))
        found = found.withColumn("embedding", vectors.encode(vectors.dense_text(F.col("name"), F.col("type"), F.col("signature"), F.col("docstring"))))
        (found.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("repo", "language").parquet(self.path))
        caps = self.capsules(repo)
        lexical.write_index(caps.select("id", lexical_text().alias("text")), "id", "text", self.postings(repo))
        return caps.count()

    def postings(self, repo: str) -> str:
        """The folder of a repository's lexical index."""
        return f"{self.home}/postings/{hashlib.sha256(repo.encode()).hexdigest()[:32]}"

    def capsules(self, repo: str) -> DataFrame:
        return self.spark.read.parquet(self.path).where(F.col("repo") == repo)

    def repos(self) -> list[str]:
        return [r.repo for r in sources.indexed_repos(self.spark.read.parquet(self.path)).orderBy("repo").collect()]

    def stats(self, repo: str) -> DataFrame:
        """(grouping, key, n, files): all, by type, by language."""
        got = self.capsules(repo).groupingSets([[], ["type"], ["language"]], "type", "language").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.countDistinct("file_path").alias("files"))
        return got.select(F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "type").otherwise("language").alias("grouping"), F.when(F.col("g") == 1, F.col("type")).when(F.col("g") == 2, F.col("language")).otherwise("").alias("key"), "n", "files")

    def dense(self, caps: DataFrame, query: str, k: int) -> DataFrame:
        q = self.spark.range(1).select(vectors.encode(F.lit(query)).alias("v")).first().v
        return vectors.search(caps.select("id", "embedding"), q, k, "id")

    def search(self, query: str, repo: str, k: int = 10) -> DataFrame:
        """The nearest records: id, name, type, file_path, start_line, signature, score."""
        caps = self.capsules(repo)
        cols = ["id", "name", "type", "file_path", "start_line", "signature"]
        return caps.select(*cols).join(F.broadcast(self.dense(caps, query, k).select("id", "score")), "id").orderBy(F.desc("score"), "id")

    def ranked(self, query: str, repo: str, task: str) -> DataFrame:
        """Records for a request with their place: exact matches, then fused dense and lexical ones."""
        caps = self.capsules(repo)
        dense = fusion.ranked(self.dense(caps, query, 15), [F.desc("score"), "id"])
        sparse = lexical.top(lexical.search_index(self.spark, self.postings(repo), query), 15, "score", "id")
        places = fusion.hybrid(fusion.exact_tiers(caps, query), dense, fusion.ranked(sparse, [F.desc("score"), "id"]), task)
        return caps.join(F.broadcast(places.select("id", "place")), "id")

    def context(self, query: str, repo: str, task: str = "auto", budget: int = 0) -> str:
        """The text for a request; task and budget are found from the request unless given."""
        if task == "auto":
            task = tasks.classify_task(self.spark.range(1).select(F.lit(query).alias("q")), "q").first().task
        if budget <= 0:
            budget = tasks.TOKEN_BUDGET[task]
        caps = self.capsules(repo)
        if task == "no_code":
            docs = tasks.no_code_documents(caps.where("type = 'document'"), query, "content")
            top = docs.withColumn("place", F.row_number().over(Window.orderBy("file_path", "start_line"))) if docs.limit(1).count() else caps.withColumn("place", F.lit(1)).limit(0)
            return render.compress(top, caps, max(budget, 800), task, query).first().context
        return render.compress(self.ranked(query, repo, task), caps, budget, task, query, fusion.directories(query)).first().context

    def retrieve(self, query: str, repo: str, depth: int = 2, budget: int = 40_000) -> str:
        """Dense seeds, expanded over the call graph, reranked to 15 and rendered."""
        caps = self.capsules(repo)
        seeds = fusion.ranked(self.dense(caps, query, 50), [F.desc("score"), "id"]).select(F.col("id").alias("seed"), F.col("rank").alias("place"))
        near = graph.expand(caps.select("id"), graph.call_edges(caps), seeds, depth)
        rows = caps.join(near.select("id"), "id", "left_semi").withColumn("score", vectors.rerank_score(query, F.concat_ws(" ", "signature", F.coalesce("docstring", F.lit("")))))
        best = rows.orderBy(F.desc("score"), "id").limit(15)
        return render.query(best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id"))), budget).first().context
