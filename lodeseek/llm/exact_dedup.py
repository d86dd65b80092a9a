"""Exact deduplication by progressive refinement, in DataFrame operations only.

Texts are equal when they are identical after deleting white space (space and the characters 0x09-0x0D). One scan of
the texts gives a narrow table (id, normalised length, hash of the first PREFIX characters, code points), which is
written once; three levels then look only at what the level before could not tell apart:

1. group by normalised length: a row goes on if its length occurs twice;
2. group by length and prefix hash;
3. SHA-256 of the whole normalised text. A second scan reads the texts of the rows that are left, and no others; where the
   caller wants the digest of every text anyway, the first scan takes it and there is no second.

What goes on is passed on as a bit set of bounded size (common.key_filter), so no text is ever shuffled and nothing
broadcast grows with the data. A row let through by chance costs a hash and ends up alone. Groups are formed by
aggregation with map-side combining; rows get their group by a join in which hot groups, a bounded number, are
broadcast (common.join_groups), so a group that holds a third of all rows is no task of its own.

Defined results: null text equals empty text, and all-blank texts are equal to it; of equal texts the one with the
most code points in the original stays, then the smallest id (a null id comes last); rows that repeat an id share
one decision, unless `row_col` tells them apart; an empty table gives no rows. Other columns are not looked at, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.llm import common as C

#: Characters that the second level hashes.
PREFIX = 256
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, most_bits: int = C.MOST_BITS, row_col: str | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size (long), kept; with digests also text_sha256 of every text.

    row_col: a column that tells rows apart; then exactly one row of a group is kept, and it is returned as well.
    most_bits: size of the bit sets between levels, at most; with far more distinct keys than bits they let all rows
    through, which costs hashing but changes no result.
    """
    text = F.col(f"`{text_col}`")
    own = [F.col(f"`{id_col}`").alias("id"), *([F.col(f"`{row_col}`").alias("row")] if row_col else [])]
    keys = ["id", "row"] if row_col else ["id"]
    whole = docs.select(*own, normalised(text).alias("norm"), F.char_length(F.coalesce(text, F.lit(""))).alias("cp"))
    narrow = whole.select(*keys, F.octet_length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix"), "cp", *([F.unhex(F.sha2("norm", 256)).alias("sha")] if digests else []))
    rows = C.settle(narrow, "narrow")
    total = rows.count()

    def refine(rows: DataFrame, key: list[str]) -> DataFrame:
        """rows with open: whether the key may occur twice among those that were open."""
        twice = rows.where("open").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
        bits = min(most_bits, C.filter_bits(total))
        return C.mark_by_filter(rows, F.struct(*key), C.key_filter(twice, F.struct(*key), bits), "seen", bits).withColumn("open", F.col("open") & F.col("seen")).drop("seen")

    rows = refine(rows.withColumn("open", F.lit(True)), ["len"])
    rows = refine(rows, ["len", "prefix"])
    if digests:
        rows = rows.withColumn("full", F.when(F.col("open"), F.col("sha")))
    else:
        # The second scan: texts of open rows, found by a bit set of their ids. Rows that this lets through by chance are open too.
        mark = F.struct(*keys)
        bits = min(most_bits, C.filter_bits(total))
        left = C.key_filter(rows.where("open"), mark, bits)
        again = docs.select(*own, text.alias("t"))
        again = C.mark_by_filter(again, mark, left, "open", bits).where("open")
        again = again.select(*keys, F.char_length(F.coalesce("t", F.lit(""))).alias("cp"), F.unhex(F.sha2(normalised(F.col("t")), 256)).alias("full"))
        alone = C.mark_by_filter(rows.drop("open"), mark, left, "open", bits).where("not open").select(*keys, "cp", F.lit(None).cast("binary").alias("full"))
        rows = again.unionByName(alone)
    rows = rows.select(*keys, "cp", "full", *(["sha"] if digests else []))
    if not digests:
        rows = C.settle(rows, "hashed")

    rank = [(-F.col("cp")).alias("a"), F.col("id").isNull().alias("b"), *[F.col(k).alias(k) for k in keys]]
    groups = rows.where("full is not null").groupBy(F.col("full").alias("g")).agg(F.min(F.struct(*rank)).alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = groups.select("g", F.col("first.id").alias("keep"), *([F.col("first.row").alias("keep_row")] if row_col else []), "n")
    joined = C.join_groups(rows.withColumnRenamed("full", "g"), groups, "g", "n", total)
    n = F.col("group.n")
    same = F.col("row").eqNullSafe(F.col("group.keep_row")) if row_col else F.col("id").eqNullSafe(F.col("group.keep"))
    return joined.select(
        F.col("id").alias(id_col),
        *([F.col("row").alias(row_col)] if row_col and row_col != id_col else []),
        F.when(n.isNull(), F.col("id")).otherwise(F.col("group.keep")).alias("keep_id"),
        F.coalesce(n, F.lit(1)).cast("long").alias("group_size"),
        F.when(n.isNull(), F.lit(True)).otherwise(same).alias("kept"),
        *([F.lower(F.hex("sha")).alias("text_sha256")] if digests else []),
    )
