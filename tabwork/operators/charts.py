"""The tables behind charts; drawing them is up to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.rules import numeric_columns
from .aggregate import aggregate
from .filters import top
from .quality import quartiles
from .quantiles import quantiles


def _series(df: DataFrame, x: str, y: list[str] | None) -> list[str]:
    return y or [c for c in numeric_columns(df) if c != x][:3]


def bar(df: DataFrame, x: str, y: list[str] | None = None, most: int = 15, order: str | None = None) -> DataFrame:
    y = _series(df, x, y)
    return top(df.select(x, *y, *([order] if order and order not in (x, *y) else [])), y[0], most, order=order or x).select(F.col(x).cast("string").alias(x), *y)


def line(df: DataFrame, x: str, y: list[str] | None = None, order: str | None = None) -> DataFrame:
    return df.orderBy(order or x).select(F.col(x).cast("string").alias(x), *_series(df, x, y))


def pie(df: DataFrame, x: str, y: str, most: int = 8, order: str | None = None) -> DataFrame:
    shown = top(df, y, most, order=order or x).select(F.col(x).cast("string").alias(x), y)
    total = F.sum(y).over(Window.partitionBy(F.lit(0)))  # at most `most` rows
    return shown.select(x, y, F.round(F.try_divide(F.col(y) * 100, total), 1).alias("percent"))


def scatter(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(x, y).na.drop("any")


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, slope, intercept and the end points of the line through the pairs; null for fewer than 3."""
    fit = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop("any").agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    known = lambda c: F.when(F.col("n") >= 3, c)
    return fit.select("n", known(F.col("a")).alias("slope"), known(F.col("b")).alias("intercept"), known(F.col("lo")).alias("x0"), known(F.col("a") * F.col("lo") + F.col("b")).alias("y0"), known(F.col("hi")).alias("x1"), known(F.col("a") * F.col("hi") + F.col("b")).alias("y1"))


def histogram(df: DataFrame, column: str, accuracy: int | None = None) -> DataFrame:
    """bin, start, end, count. The width is the smaller of 2 IQR / n^(1/3) and range / (log2 n + 1), the latter alone where the IQR is 0; the last bin is closed.

    The quartiles take jobs of their own.
    """
    c = F.col(column)
    _, (first, _, third) = quartiles(df, [column], accuracy)[column]
    whole = dict(df.dtypes)[column] in ("tinyint", "smallint", "int", "bigint")
    f = df.filter(c.isNotNull()).agg(F.count("*").alias("n"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"))
    f = f.withColumns({"range": F.col("hi") - F.col("lo"), "iqr": F.lit(None if first is None else third - first).cast("double")})
    sturges = F.col("range") / (F.log2("n") + 1)
    f = f.withColumn("w", F.when(F.col("iqr") > 0, F.least(2 * F.col("iqr") / F.pow(F.col("n"), F.lit(1 / 3)), sturges)).otherwise(sturges))
    if whole:
        f = f.withColumn("w", F.greatest("w", F.lit(1.0)))
    f = f.withColumn("bins", F.greatest(F.ceil(F.when(F.col("w") > 0, F.col("range") / F.col("w")).otherwise(1)), F.lit(1)).cast("long")).withColumn("step", F.col("range") / F.col("bins"))
    f = F.broadcast(f.select("lo", "bins", "step"))
    place = F.when(F.col("step") > 0, F.least(F.floor((c.cast("double") - F.col("lo")) / F.col("step")), F.col("bins") - 1)).otherwise(0).cast("long")
    counted = df.filter(c.isNotNull()).join(f).groupBy(place.alias("bin")).agg(F.count("*").alias("count"))
    every = f.select("lo", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)).alias("bin"))
    return every.join(counted, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("start"), (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("end"), F.coalesce("count", F.lit(0)).alias("count"))


def box(df: DataFrame, column: str, group: str | None = None, most_groups: int = 12, accuracy: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """group, n, q1, median, q3, low and high (the last values within 1.5 quartile distances), outliers: a box per group.

    More than most_groups groups make no picture: then, as for a chart without groups, there is a box for each of up to four
    numeric columns (`columns`, or the column itself and the others). One job counts the groups; quartiles take jobs of their own.
    """
    if group and df.filter(F.col(column).isNotNull()).select(group).distinct().limit(most_groups + 1).count() > most_groups:
        return box_columns(df, columns or list(dict.fromkeys([column, *[c for c in numeric_columns(df) if c != group]])), accuracy=accuracy)
    df = df.filter(F.col(column).isNotNull())
    return _boxes(df.select((F.col(group).cast("string") if group else F.lit("all")).alias("group"), F.col(column).cast("double").alias("v")), accuracy)


def _boxes(df: DataFrame, accuracy: int | None) -> DataFrame:
    """A box per group of the known values; df: group, v."""
    shares = (0.25, 0.5, 0.75)
    if accuracy:
        q = df.groupBy("group").agg(F.percentile_approx("v", list(shares), accuracy).alias("q"))
    else:
        q = quantiles(df, ["v"], shares, ["group"])
    # one row a group: Spark broadcasts it by its measured size, and joins by shuffle beyond the limit
    both = df.join(q.select(F.col("group").alias("_g"), "q"), F.col("group").eqNullSafe(F.col("_g")))
    spread = F.col("q")[2] - F.col("q")[0]
    inside = (F.col("v") >= F.col("q")[0] - 1.5 * spread) & (F.col("v") <= F.col("q")[2] + 1.5 * spread)
    return both.groupBy("group").agg(F.count("*").alias("n"), F.first("q")[0].alias("q1"), F.first("q")[1].alias("median"), F.first("q")[2].alias("q3"),
                                     F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"), F.count(F.when(~inside, 1)).alias("outliers"))


def box_columns(df: DataFrame, columns: list[str] | None = None, most: int = 4, accuracy: int | None = None) -> DataFrame:
    """As `box`, with a group for each of up to `most` numeric columns."""
    chosen = (columns or numeric_columns(df))[:most]
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("group"), F.col(c).cast("double").alias("v")) for c in chosen])))
    return _boxes(values.filter("v IS NOT NULL"), accuracy)


def category_totals(df: DataFrame, category: str, value: str) -> DataFrame:
    return aggregate(df, [category], [{"column": value, "func": "sum"}], largest_first=True)
