"""Packing: optimal length buckets by dynamic programming, and batches of a token budget inside each bucket.

1. Lengths: a text's words (white space separates), or the tokens of a tokenizer file given by path.
2. Global histogram of lengths, aggregated by Spark; only the distinct lengths and their counts come to the driver.
3. Dynamic programming over the histogram chooses at most `buckets` bucket lengths so that padding every text to its
   bucket's length costs the fewest tokens. The cost has the quadrangle inequality, so each layer is filled by
   divide and conquer over its optimal cuts: O(buckets * n log n) for n distinct lengths.
4. Batches: a bucket of length L takes floor(budget / L) texts in a batch, at least one. Rows get consecutive numbers
   per bucket without any bucket in one task: buckets are cut into shards by a hash of the id, shards are counted,
   and a row's number is its rank in its shard plus the counts of the shards before.

Defined results: null and empty texts have length 0 and are packed with the shortest bucket; a text longer than the budget is a
batch of its own; nothing is dropped or cut. Rows that repeat an id are packed each. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodeseek.llm import common as C

BUCKETS, BUDGET = 16, 16_384
#: Rows of a bucket that one shard of the numbering has, about.
SHARD_ROWS = 4096


def optimal_buckets(lengths: list[int], counts: list[int], buckets: int) -> tuple[list[int], int]:
    """Bucket lengths (ascending, the last is the longest length) with the least padding, and that padding."""
    order = np.argsort(np.asarray(lengths, np.int64))
    size, count = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    n = len(size)
    if not n:
        return [], 0
    docs = np.concatenate([[0], np.cumsum(count)])
    best = np.concatenate([[0], size * docs[1:]]).astype(np.float64)  # one bucket: tokens with padding for the first j lengths
    cuts = [np.zeros(n + 1, np.int64)]
    for _ in range(1, min(buckets, n)):
        new, cut = np.zeros(n + 1), np.zeros(n + 1, np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + size[j - 1] * (docs[j] - docs[i])
            k = int(cost.argmin())
            new[j], cut[j] = cost[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        best = new
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j <= 0:
            break
        out.append(int(size[j - 1]))
        j = int(cut[j])
    return sorted(set(out)), int(best[n] - (size * count).sum())


def lengths(docs: DataFrame, text_col: str, keep: list[str], tokenizer: str | None, result: str) -> DataFrame:
    """Columns `keep` and the struct column `result` with the length `n` of each text."""
    held: dict[str, object] = {}

    def work(batch: pa.RecordBatch, data: np.ndarray, offs: np.ndarray) -> dict[str, object]:
        if tokenizer:
            if "t" not in held:
                from tokenizers import Tokenizer

                held["t"] = Tokenizer.from_file(tokenizer)
                held["t"].encode_special_tokens = True
            texts = [x or "" for x in batch.column(batch.schema.get_field_index("t")).to_pylist()]
            return {"n": np.array([len(e.ids) for i in range(0, len(texts), 64) for e in held["t"].encode_batch(texts[i : i + 64], add_special_tokens=False)], np.int64)}
        parts = [np.diff(C.word_spans(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], C.SPACE)[2]) for i, j in C.slices(offs)]
        return {"n": np.concatenate(parts).astype(np.int64)}

    return C.map_text(docs, text_col, keep, work, [("n", "bigint")], result)


def packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, tokenizer: str | None = None) -> DataFrame:
    """One row per row of docs: id, n_tokens, bucket (number), bucket_tokens (padded length), batch_id, slot.

    batch_id counts from 0 within a bucket, slot within a batch.
    """
    rows = lengths(docs, text_col, [id_col], tokenizer, "r")
    rows = C.settle(rows.select(F.col(f"`{id_col}`").alias("id"), F.col("r").n.alias("n")), "lengths")
    hist = rows.groupBy("n").agg(F.count("*").alias("c")).collect()
    bounds, _ = optimal_buckets([r.n for r in hist], [r.c for r in hist], buckets)
    total = sum(r.c for r in hist)
    shards = max(64, -(-total // SHARD_ROWS))
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    rows = rows.withColumn("bucket", F.size(F.filter(edges, lambda b: b < F.col("n"))))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(11)), F.lit(shards)).cast("int"))
    sizes = rows.groupBy("bucket", "shard").agg(F.count("*").alias("c"))
    # One row for each bucket and shard; the sums run within a bucket.
    before = F.sum("c").over(Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("before", F.coalesce(before, F.lit(0))).drop("c")
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy(F.xxhash64("id"), "id", "n"))
    rows = rows.withColumn("rank", rank).join(sizes, ["bucket", "shard"]).withColumn("place", F.col("before") + F.col("rank") - 1)
    length = F.coalesce(F.try_element_at(edges, F.col("bucket") + 1), F.lit(0))
    rows = rows.withColumn("bucket_tokens", length)
    fit = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1)))).cast("long")
    return rows.withColumn("fit", fit).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_tokens"),
        "bucket",
        "bucket_tokens",
        F.floor(F.col("place") / F.col("fit")).cast("long").alias("batch_id"),
        (F.col("place") % F.col("fit")).cast("long").alias("slot"),
    )
