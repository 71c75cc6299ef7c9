"""Profiles and data-quality findings: one aggregation over all columns, then one row per column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rules import numeric_columns, text_columns, to_number
from .quantiles import quantile_lists

#: What the label of a summary row holds, in several languages; found anywhere in it, case ignored.
SUMMARY_ROW = (
    "(?iu)"
    "소계|합계|총계|^계$|합 계|소 계"
    "|合計|小計|総計|合 計|小 計"
    "|總計|總額|总计|总额|小計|合計"
    "|total|subtotal|grand.total|sum.total|grand.sum"
    "|gesamt|zwischensumme|gesamtsumme"
    "|sous.total|sous total|totale|totales|subtotal"
)


def _long(df: DataFrame, facts: dict[str, dict[str, Column]], whole: dict[str, Column] | None = None) -> DataFrame:
    """facts: column -> {name: aggregate}; one row per column."""
    whole = whole or {}
    wide = df.agg(*[e.alias(f"w_{n}") for n, e in whole.items()], *[e.alias(f"{i}_{n}") for i, f in enumerate(facts.values()) for n, e in f.items()])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"{i}_{n}").alias(n) for n in f]) for i, (c, f) in enumerate(facts.items())])
    return wide.select(*[F.col(f"w_{n}").alias(n) for n in whole], F.inline(rows))


def missing_report(df: DataFrame) -> DataFrame:
    counts = _long(df, {c: {"data_count": F.count(F.col(f"`{c}`"))} for c in df.columns}, {"n": F.count("*")})
    gone = F.col("n") - F.col("data_count")
    return counts.select("column", gone.alias("missing"), F.round(F.coalesce(F.try_divide(gone * 100, "n"), F.lit(0.0)), 2).alias("missing_percent"), "data_count").orderBy(F.desc("missing"), "column")


def missing_rates(df: DataFrame) -> DataFrame:
    return missing_report(df).select("column", F.round(F.col("missing") / F.nullif(F.col("missing") + F.col("data_count"), F.lit(0)), 3).alias("rate")).filter("rate > 0")


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """column, kind, data_count, missing, distinct, min and max as text of up to 20 characters."""
    kinds = dict(df.dtypes)
    text = lambda f, c: F.substring(f(c).cast("string"), 1, 20)
    facts = {c: {"data_count": F.count(c), "missing": F.count("*") - F.count(c), "min": text(F.min, c), "max": text(F.max, c)} for c in df.columns}
    if not exact:
        facts = {c: f | {"distinct": F.approx_count_distinct(c)} for c, f in facts.items()}
    out = _long(df, facts).withColumn("kind", F.try_element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), "column"))
    if exact:
        # values first, columns as rows: one pass instead of one expansion per column
        values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns])))
        out = out.join(values.groupBy("column").agg(F.count_distinct("v").alias("distinct")), "column")
    return out.select("column", "kind", "data_count", "missing", "distinct", "min", "max")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier one; missing equals missing."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def summary_rows(df: DataFrame, pattern: str = SUMMARY_ROW) -> DataFrame:
    """The largest number of rows of one text column that look like summary rows."""
    counts = [F.count(F.when(F.col(c).rlike(pattern), 1)) for c in text_columns(df)]
    return df.agg((F.greatest(*counts) if len(counts) > 1 else counts[0] if counts else F.lit(0)).cast("long").alias("summary_rows"))


def quartiles(df: DataFrame, columns: list[str], accuracy: int | None = None) -> dict[str, tuple[int, list[float | None]]]:
    """column -> (known values, [first quartile, median, third quartile]); exact over many tasks, or sketches with `accuracy`."""
    if not accuracy:
        return quantile_lists(df, columns, (0.25, 0.5, 0.75))
    found = df.agg(*[F.struct(F.count(f"`{c}`"), F.percentile_approx(f"`{c}`", [0.25, 0.5, 0.75], accuracy)).alias(str(i)) for i, c in enumerate(columns)]).first()
    return {c: (r[0], [None if x is None else float(x) for x in r[1] or [None] * 3]) for c, r in zip(columns, found)}


def fences(q: tuple[int, list[float | None]], factor: float) -> tuple[float | None, float | None, bool]:
    """(low, high, judged): the quartiles widened by factor times their distance; fewer than 4 values or no distance are not judged."""
    n, (a, _, b) = q
    if a is None:
        return None, None, False
    return a - factor * (b - a), b + factor * (b - a), n >= 4 and b - a > 0


def _beyond(column: str, low: float | None, high: float | None, judged: bool) -> Column:
    return F.count(F.when((F.col(f"`{column}`") < low) | (F.col(f"`{column}`") > high), 1)) if judged else F.count(F.lit(None))


def outliers(df: DataFrame, factor: float = 3.0, columns: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """column, low, high, outliers: values strictly outside the quartiles by factor times their distance; columns with fewer than 4 values or no distance have none.

    The quartiles take jobs of their own; their few numbers stand in the lazy plan that counts.
    """
    columns = columns or numeric_columns(df)
    found = {c: fences(q, factor) for c, q in quartiles(df, columns, accuracy).items()}
    return _long(df, {c: {"low": F.max(F.lit(low).cast("double")), "high": F.max(F.lit(high).cast("double")), "outliers": _beyond(c, low, high, ok)} for c, (low, high, ok) in found.items()})


def number_shares(df: DataFrame, most: int | None = 200, order: str | None = None) -> DataFrame:
    """column, n, share of values that say a number, over each text column's first `most` known values by `order` (all where most is None)."""
    texts = [c for c in text_columns(df) if c != order]
    values = df.select(*([F.col(order).alias("_o")] if order else [F.monotonically_increasing_id().alias("_o")]), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in texts]))).filter("v is not null")
    if most:
        values = values.withColumn("_n", F.row_number().over(Window.partitionBy("column").orderBy("_o"))).filter(F.col("_n") <= most)
    return values.groupBy("column").agg(F.count("*").alias("n"), F.avg(to_number(F.col("v")).isNotNull().cast("double")).alias("share"))


def mixed_types(df: DataFrame, order: str | None = None) -> DataFrame:
    return number_shares(df, 200, order).filter("n >= 4 and share > 0.3 and share < 0.7")


def number_like(df: DataFrame, order: str | None = None) -> DataFrame:
    return number_shares(df, 100, order).filter("share >= 0.7")


def constants(df: DataFrame) -> DataFrame:
    facts = {c: {"data_count": F.count(c), "same": F.min(c).eqNullSafe(F.max(c))} for c in df.columns}
    return _long(df, facts).filter("same and data_count > 0").select("column")


def numeric_stats(df: DataFrame, source: str) -> DataFrame:
    """source, column, min, mean, max (2 decimals)."""
    columns = [c for c in numeric_columns(df) if c != source]
    wide = df.groupBy(source).agg(*[f(c).alias(f"{i}_{n}") for i, c in enumerate(columns) for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), *[F.round(F.col(f"{i}_{n}").cast("double"), 2).alias(n) for n in ("min", "mean", "max")]) for i, c in enumerate(columns)])
    return wide.select(source, F.inline(rows))


def text_stats(df: DataFrame, columns: list[str] | None = None, most: int = 3) -> DataFrame:
    """column, distinct, value, count, rank of the most frequent values; ties by value."""
    columns = columns or text_columns(df)
    values = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns]))).filter("value is not null")
    counts = values.groupBy("column", "value").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    distinct = counts.groupBy("column").agg(F.count("*").alias("distinct"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= most).join(distinct, "column").select("column", "distinct", "value", "count", "rank")


def compare_sources(df: DataFrame, source: str) -> DataFrame:
    columns = [c for c in df.columns if c != source]
    gone = [F.count("*") - F.count(c) for c in columns]
    return df.groupBy(source).agg(
        F.count("*").alias("rows"), F.lit(len(columns)).cast("long").alias("columns"), sum((F.when(g > 0, 1).otherwise(0) for g in gone), F.lit(0)).cast("long").alias("columns_with_missing"),
        F.lit(len([c for c in numeric_columns(df) if c != source])).cast("long").alias("numeric_columns"), sum(gone, F.lit(0)).cast("long").alias("missing"))


def overview(df: DataFrame) -> DataFrame:
    one = compare_sources(df.withColumn("_all", F.lit(1)), "_all").select("rows", "columns", "columns_with_missing", "numeric_columns")
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).alias("value")) for c in one.columns])))


def distribution(df: DataFrame, columns: list[str] | None = None, accuracy: int | None = None) -> DataFrame:
    """column, mean, median (1 decimal), outliers by 1.5 quartile distances; quartiles and medians by the same jobs."""
    columns = columns or numeric_columns(df)
    found = quartiles(df, columns, accuracy)
    return _long(df, {c: {"mean": F.round(F.avg(c), 1), "median": F.round(F.max(F.lit(found[c][1][1]).cast("double")), 1), "outliers": _beyond(c, *fences(found[c], 1.5))} for c in columns})


def structure(df: DataFrame) -> DataFrame:
    """Blank and repeated column names, the five columns that miss most, and all missing cells: item, column, value."""
    names = [c.strip().lower() for c in df.columns]
    rows = [("blank_name", c, 1) for c in df.columns if not c.strip() or c.lower().startswith(("unnamed", "_c"))] + [("repeated_name", n, names.count(n)) for n in dict.fromkeys(names) if names.count(n) > 1]
    report = missing_report(df)
    out = report.filter("missing > 0").orderBy(F.desc("missing"), "column").limit(5).select(F.lit("missing").alias("item"), "column", F.col("missing").alias("value"))
    out = out.unionByName(report.agg(F.sum("missing").alias("value")).select(F.lit("missing_total").alias("item"), F.lit(None).cast("string").alias("column"), "value"))
    return out.unionByName(df.sparkSession.createDataFrame(rows, "item string, column string, value long")) if rows else out
