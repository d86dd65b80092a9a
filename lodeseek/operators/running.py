"""Running totals over long tables, without one task that sorts them all."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of 2 ** SPAN_BITS places are summed first; only these sums are added up in one task.
SPAN_BITS = 12


def within(rows: DataFrame, place: str, cost: Column, budget: int, past: bool = False) -> DataFrame:
    """Rows in order of an integer place whose running cost, none of them negative, stays within the budget; past: also the rows that follow such a total.

    A null cost adds nothing; before the first cost there is no total, and no row.
    """
    rows = rows.withColumn("_cost", cost).withColumn("_span", F.shiftright(F.col(place).cast("long"), SPAN_BITS))
    sums = rows.groupBy("_span").agg(F.sum("_cost").alias("_sum"))
    before = sums.select("_span", F.sum("_sum").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    before = before.where(F.coalesce("_before", F.lit(0)) <= budget)
    own = F.sum("_cost").over(Window.partitionBy("_span").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    run = F.coalesce(F.col("_before") + F.col("_own"), F.col("_own"), F.col("_before"))
    if past:
        run = run - F.coalesce("_cost", F.lit(0))
    return rows.join(before, "_span").withColumn("_own", own).where(run <= budget).drop("_cost", "_span", "_before", "_own")
