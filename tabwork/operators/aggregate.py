"""Aggregation. Rows whose key is missing form no group; a sum of nothing is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rules import numeric_columns, require
from .quantiles import quantile_lists, quantiles

#: an exact median is worked out beside the others (`quantiles`); the one named here serves streams and sketches' callers
FUNCS = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "mean": F.avg, "max": F.max, "min": F.min, "count": F.count,
    "median": F.median, "std": F.stddev_samp,
}
DEFAULT = ("sum", "mean", "max", "min")


def _one(column: str, func: str, accuracy: int | None = None) -> Column:
    if func not in FUNCS:
        raise ValueError(f"func must be one of {tuple(FUNCS)}")
    made = F.percentile_approx(column, 0.5, accuracy) if func == "median" and accuracy else FUNCS[func](column)
    return made.alias(f"{column}_{func}")


def _with_medians(df: DataFrame, keys: list[str], columns: list[str], made: list[Column]) -> DataFrame:
    """Aggregates, and exact medians beside them as {column}_median."""
    if not keys:
        found = quantile_lists(df, columns, (0.5,))
        return df.agg(F.count("*").alias("_rows"), *made).select("*", *[F.lit(found[c][1][0]).cast("double").alias(f"{c}_median") for c in columns]).drop("_rows")
    names = [f"_k{i}" for i in range(len(keys))]
    medians = quantiles(df, columns, (0.5,), keys).select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], F.col("column").alias("_c"), F.col("q")[0].alias("_q"))
    wide = medians.groupBy(*names).agg(*[F.max(F.when(F.col("_c") == c, F.col("_q"))).alias(f"{c}_median") for c in columns])
    groups = df.groupBy(*keys).agg(F.count("*").alias("_rows"), *made)
    same = [F.col(f"`{k}`").eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    return groups.join(wide, same, "left").drop("_rows", *names)


def aggregate(df: DataFrame, group_by: list[str] | None = None, metrics: list[dict] | None = None, value_columns: list[str] | None = None, func: str = "sum", largest_first: bool = False, accuracy: int | None = None) -> DataFrame:
    """metrics [{column, func}], or one func on the value columns (all numeric ones where none are named).

    Exact medians are worked out by jobs of their own (`quantiles`); with `accuracy` (as for percentile_approx) they are sketches.
    """
    keys = group_by or []
    wanted = [(m["column"], m.get("func") or m.get("agg")) for m in metrics] if metrics else [(c, func) for c in value_columns or [c for c in numeric_columns(df) if c not in keys]]
    wanted = list(dict.fromkeys(wanted))
    require(df, *keys, *[c for c, _ in wanted])
    df = df.na.drop(subset=keys) if keys else df
    exact = [c for c, f in wanted if f == "median" and not accuracy and not df.isStreaming]
    made = [_one(*w, accuracy) for w in wanted if w[1] != "median" or w[0] not in exact]
    if exact:
        out = _with_medians(df, keys, exact, made).select(*keys, *[f"{c}_{f}" for c, f in wanted])
    else:
        out = df.groupBy(*keys).agg(*made) if keys else df.agg(*made)
    return out.orderBy(F.col("{}_{}".format(*wanted[0])).desc_nulls_last()) if keys and largest_first else out


def totals(df: DataFrame, funcs: tuple[str, ...] = DEFAULT, columns: list[str] | None = None) -> DataFrame:
    """One row per numeric column, one column per function, rounded to 4."""
    columns = columns or numeric_columns(df)
    wide = aggregate(df, metrics=[{"column": c, "func": f} for c in columns for f in funcs])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.round(F.col(f"{c}_{f}").cast("double"), 4).alias(f) for f in funcs]) for c in columns])
    return wide.select(F.inline(rows))


def head_sum(df: DataFrame, source: str, order: str, n: int = 5, columns: list[str] | None = None, func: str = "sum") -> DataFrame:
    """One row per source over its first n rows."""
    columns = columns or [c for c in numeric_columns(df) if c not in (source, order)]
    first = F.row_number().over(Window.partitionBy(source).orderBy(order))
    return df.withColumn("_n", first).filter(F.col("_n") <= n).groupBy(source).agg(*[_one(c, func) for c in columns])


def top_sum(df: DataFrame, source: str, column: str, order: str, n: int = 5, func: str = "sum") -> DataFrame:
    """One row per source over its n rows of largest value."""
    best = F.row_number().over(Window.partitionBy(source).orderBy(F.col(column).desc_nulls_last(), order))
    return df.withColumn("_n", best).filter(F.col("_n") <= n).groupBy(source).agg(_one(column, func))


def row_count(df: DataFrame, source: str | None = None) -> DataFrame:
    n = F.count("*").alias("rows")
    return df.groupBy(source).agg(n) if source else df.agg(n)


def missing_cells(df: DataFrame) -> DataFrame:
    total = sum((F.count("*") - F.count(F.col(f"`{c}`")) for c in df.columns), F.lit(0))
    return df.agg(total.cast("long").alias("missing"))
