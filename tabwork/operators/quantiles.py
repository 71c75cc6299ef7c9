"""Exact quantiles of any number of groups and columns, spread over tasks.

A double becomes an integer of the same order (its bits). One histogram over the leading bits counts all groups and columns
at once, with partial sums before the shuffle; it tells which buckets hold the ranks that are asked for. Only the values in
these buckets are looked at again, by the next bits, until each holds one value. No task sees more than the buckets of one
group and column (2^16 at most), however many values there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.folders import saved

BITS, ROUNDS = 16, 4


def ordered_bits(x: Column) -> Column:
    """A long in the order of the doubles; -0.0 and 0.0 are one, NaN is above all, null stays null.

    It is the number's bit pattern, by arithmetic that is exact: division by a power of two, and a mantissa of 52 bits.
    """
    size = F.abs(x)
    tiny, huge = F.lit(2.0 ** -1022), F.lit(float("inf"))
    # the logarithm may be off by one next to a power of two
    rough = F.least(F.floor(F.log2(F.when((size >= tiny) & (size < huge), size).otherwise(1.0))), F.lit(1023))
    part = size / F.pow(F.lit(2.0), rough)
    shift = F.when(part >= 2, 1).when(part < 1, -1).otherwise(0)
    mantissa = ((part / F.pow(F.lit(2.0), shift) - 1) * 2.0 ** 52).cast("long")
    normal = F.shiftleft((rough + shift + 1023).cast("long"), 52) + mantissa
    # two steps, as 2^1074 is no double
    bits = F.when(size == huge, F.lit(2047 << 52)).when(size < tiny, (size * 2.0 ** 537 * 2.0 ** 537).cast("long")).otherwise(normal)
    return F.when(F.isnan(x), F.lit(2 ** 63 - 1)).when(x < 0, -bits).otherwise(bits)


def quantiles(df: DataFrame, columns: list[str], shares: tuple[float | Column, ...], group: list[str] | None = None) -> DataFrame:
    """The group's columns, column, n, q: the quantiles of each column's known values, in the order of shares.

    Values between two ranks are interpolated. NaN counts as the largest value. Groups of missing keys are groups; without known
    values there is no row. A share that is a Column is a rank from 0, a long by the group's columns as g0, g1, and so on. A row per group and column; two to four rounds of jobs, of which the first two read df.
    """
    group = group or []
    keys = [f"g{i}" for i in range(len(group))]
    place = [*keys, "c"]
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)]))
    # 0.0 for -0.0, so that a bucket of both holds one value
    rows = df.select(*[F.col(f"`{g}`").alias(k) for g, k in zip(group, keys)], cells).filter("v IS NOT NULL").withColumn("v", F.when(F.col("v") == 0, 0.0).otherwise(F.col("v")))
    rows = rows.withColumn("bits", ordered_bits(F.col("v")))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in place]
    place_of = lambda s: s if isinstance(s, Column) else F.lit(s) * (F.col("total") - 1)
    known, state = [], None
    for r in range(ROUNDS):
        bucket = F.shiftright("bits", 64 - BITS * (r + 1)).alias("bucket")
        inside = [*place, "above"] if r else place
        sums = rows.groupBy(*inside, bucket).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        # at most 2^16 buckets
        by = Window.partitionBy(*inside)
        before = F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.withColumn("before", F.coalesce(before, F.lit(0)))
        if r == 0:
            sums = sums.withColumn("total", F.sum("n").over(by))
            at = list(map(place_of, shares))
            ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)]))
            hit = F.filter(ranks, lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n")))
            state = sums.select(*place, "total", F.explode(hit).alias("rank"), "bucket", F.col("before").alias("below"), "lo", "hi")
        else:
            rank = F.col("o.rank") - F.col("o.below")
            state = state.alias("o").join(sums.alias("s"), [*same("o", "s"), F.col("o.bucket") == F.col("s.above"), rank >= F.col("s.before"), rank < F.col("s.before") + F.col("s.n")]).select(
                *[f"o.{k}" for k in place], "o.total", "o.rank", F.col("s.bucket").alias("bucket"), (F.col("o.below") + F.col("s.before")).alias("below"), "s.lo", "s.hi")
        state = saved(state, f"quantiles-{r}")
        known.append(state.filter("lo = hi"))
        state = state.filter("lo <> hi")
        if r + 1 == ROUNDS or state.isEmpty():
            break
        edges = state.select(*place, F.col("bucket").alias("above")).distinct()
        rows = rows.drop("above").alias("a").join(edges.alias("e"), [*same("a", "e"), F.shiftright("a.bits", 64 - BITS * (r + 1)) == F.col("e.above")]).select("a.*", "e.above")
        if r == 0:
            rows = saved(rows, "quantile-edges")
    found = known[0]
    for k in known[1:]:
        found = found.unionByName(k)
    found = found.groupBy(*place, "total").agg(F.map_from_entries(F.collect_list(F.struct("rank", "lo"))).alias("of"))

    def between(share: float | Column) -> Column:
        at = place_of(share)
        low, high = (F.try_element_at("of", f(at).cast("long")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    names = F.get(F.array(*map(F.lit, columns)), F.col("c"))
    return found.select(*[F.col(k).alias(g) for g, k in zip(group, keys)], names.alias("column"), F.col("total").alias("n"), F.array(*map(between, shares)).alias("q"))


def quantile_lists(df: DataFrame, columns: list[str], shares: tuple[float, ...]) -> dict[str, tuple[int, list[float | None]]]:
    """column -> (n, quantiles) over all rows, on the driver; columns without known values have n 0 and nulls."""
    found = {r["column"]: (r["n"], list(r["q"])) for r in quantiles(df, columns, shares).collect()}
    return {c: found.get(c, (0, [None] * len(shares))) for c in columns}
