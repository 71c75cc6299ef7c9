"""Weighted cuts without sorting: histograms over the leading bits of a 60-bit key, refined in the boundary bucket alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import saved

BITS, ROUNDS = 12, 5
TOP = 1 << (BITS * ROUNDS)


def cuts(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """g, threshold, below: for each g, the rows with key < threshold weigh as near to its budget as the keys allow.

    rows: g, key (0 <= key < 2^60), weight (long, >= 0), a saved table. budgets: g, budget. A g of null is a group too.
    Rows of one key are taken together. The first round sums weights by group and bucket over all rows, with partial sums
    before the shuffle; later rounds read the boundary bucket only, a 4096th of the rows each, and end once every boundary
    bucket holds one key.
    """
    zero = F.lit(0).cast("long")
    state = budgets.select("g", "budget", zero.alias("prefix"), zero.alias("below"))
    inside = rows
    for r in range(ROUNDS):
        shift = BITS * (ROUNDS - 1 - r)
        sums = inside.groupBy("g", F.shiftright("key", shift).alias("bucket")).agg(F.sum("weight").alias("weight"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        known = state.select(F.col("g").alias("sg"), "budget", "below")
        joined = sums.join(known, F.col("g").eqNullSafe(F.col("sg")))
        # at most 4096 buckets a group
        upto = F.sum("weight").over(Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        marked = joined.withColumn("upto", F.col("below") + upto)
        # the first bucket that reaches the budget, or the last one
        bucket = F.struct("bucket", "upto", "weight", "lo", "hi")
        picked = marked.groupBy("g").agg(F.min(F.when(F.col("upto") >= F.col("budget"), bucket)).alias("hit"), F.max(bucket).alias("end"))
        one = F.coalesce("hit", "end")
        state = saved(picked.select(F.col("g").alias("pg"), one["bucket"].alias("prefix"), (one["upto"] - one["weight"]).alias("below"), one["weight"].alias("at"), one["lo"].alias("lo"), one["hi"].alias("hi"))
                      .join(budgets, F.col("pg").eqNullSafe(F.col("g"))).select("g", "budget", "prefix", "below", "at", "lo", "hi"), f"cut{r}")
        if state.filter("lo < hi").isEmpty():
            break
        edge = state.select(F.col("g").alias("sg"), "prefix")
        inside = inside.withColumn("lead", F.shiftright("key", shift)).join(edge, F.col("g").eqNullSafe(F.col("sg")) & (F.col("lead") == F.col("prefix"))).select("g", "key", "weight")
        if r == 0:
            inside = saved(inside, "edge")
    over = F.abs(F.col("budget") - F.col("below") - F.col("at")) < F.abs(F.col("budget") - F.col("below"))
    return state.select("g", F.when(over, F.col("hi") + 1).otherwise(F.col("lo")).alias("threshold"), F.when(over, F.col("below") + F.col("at")).otherwise(F.col("below")).alias("below"))
