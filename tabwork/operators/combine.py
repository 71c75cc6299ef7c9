"""Joins on given or found keys, and stacking of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.rules import first_known, numeric_columns, require, text_columns
from .aggregate import FUNCS
from .grid import drop_subtotals, whole_to_long
from .labels import match_labels  # noqa: F401


def left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join; a missing key meets a missing key, and columns that both have get _x and _y."""
    require(left, key)
    require(right, key)
    both = [c for c in left.columns if c in right.columns and c != key]
    l = left.select(*[F.col(c).alias(f"{c}_x" if c in both else c) for c in left.columns])
    r = right.select(*[F.col(c).alias("_key" if c == key else f"{c}_y" if c in both else c) for c in right.columns])
    return l.join(r, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


#: relative standard error of the sketches that narrow the choice of a key, and how many of these count as certain
SKETCH_ERROR, CERTAIN = 0.02, 6


def auto_key(left: DataFrame, right: DataFrame, exact: bool = True) -> str:
    """The common column, a non-numeric one if there is any, with most distinct values per row of the left table; ties by its column order.

    One job sketches all candidates. Those whose range of error reaches that of the best are counted exactly by a second one,
    as rows of (column, value); exact=False takes the sketches alone.
    """
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("no common column to join on; stack the tables instead")
    numbers = set(numeric_columns(left))
    candidates = [c for c in common if c not in numbers] or common
    if len(candidates) == 1:
        return candidates[0]
    found = left.agg(*[F.approx_count_distinct(F.col(f"`{c}`"), SKETCH_ERROR).alias(str(i)) for i, c in enumerate(candidates)]).first()
    sketch = dict(zip(candidates, found))
    if exact:
        wide = CERTAIN * SKETCH_ERROR
        least = max(sketch.values()) * (1 - wide) / (1 + wide)
        candidates = [c for c in candidates if sketch[c] >= least]
        if len(candidates) > 1:
            values = left.select(F.inline(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(candidates)])))
            counts = {r["c"]: r["n"] for r in values.groupBy("c").agg(F.count_distinct("v").alias("n")).collect()}
            sketch = {c: counts.get(i, 0) for i, c in enumerate(candidates)}
    return max(candidates, key=lambda c: sketch[c])


def auto_join(left: DataFrame, right: DataFrame) -> DataFrame:
    return left_join(left, right, auto_key(left, right))


def join_all(tables: list[DataFrame], key: str) -> DataFrame:
    return reduce(lambda a, b: left_join(a, b, key), tables)


def overlap(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table after the first: common columns, share of the first one's, only here, only there."""
    (first, base), *rest = tables.items()
    rows = [(first, name, [c for c in base.columns if c in t.columns], len([c for c in base.columns if c in t.columns]) / max(len(base.columns), 1),
             [c for c in base.columns if c not in t.columns], [c for c in t.columns if c not in base.columns]) for name, t in rest]
    return base.sparkSession.createDataFrame(rows, "first string, other string, common array<string>, ratio double, only_first array<string>, only_other array<string>")


def combine(tables: list[DataFrame], keys: list[str] | None = None) -> DataFrame:
    """Tables of the same layout (80 % of the first one's columns) are merged by rows, others joined on a found key."""
    base = tables[0]
    shared = [len([c for c in base.columns if c in t.columns]) / len(base.columns) for t in tables[1:]]
    if all(s >= 0.8 for s in shared):
        return merge_same_layout(tables, keys)
    return reduce(auto_join, tables)


def stack(tables: list[DataFrame], common_only: bool = False) -> DataFrame:
    if common_only:
        columns = [c for c in tables[0].columns if all(c in t.columns for t in tables)]
        return reduce(DataFrame.unionByName, [t.select(*columns) for t in tables])
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def placed(df: DataFrame, number: int) -> DataFrame:
    """df with _at: where a row stands, first by the number of its table, then by its place in its file.

    The place is _row_id (and source), where readers have put it, or the file and the row's index in it, which Spark knows of
    Parquet tables and of selections from them; it is the same however the table is cut into tasks. Other tables have the order
    of this run.
    """
    table = F.lit(number).alias("table")
    if "_row_id" in df.columns:
        return df.withColumn("_at", F.struct(table, *[F.col(c) for c in ("source", "_row_id") if c in df.columns]))
    try:
        return df.withColumn("_at", F.struct(table, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    except AnalysisException:
        return df.withColumn("_at", F.struct(table, F.monotonically_increasing_id().alias("row")))


def merge_same_layout(tables: list[DataFrame], keys: list[str] | None = None, labels: tuple[str, ...] | None = None) -> DataFrame:
    """Stack the common columns, drop subtotal rows, and bring rows of equal keys together: numbers by mean, but those that
    never differ within a group (codes) and other text by their first value, in the order of the tables and their rows
    (`placed`). Missing keys are a group. Two small jobs look at the data: which columns are codes, and which averages are whole.
    """
    own = ("_row_id", "source") if all("_row_id" in t.columns for t in tables) else ()
    common = [c for c in tables[0].columns if c not in own and all(c in t.columns for t in tables)]
    ordered = [placed(t, i) for i, t in enumerate(tables)]
    # rows are ordered within a table by what it has; the kinds of places may differ from table to table
    at = lambda t: F.struct(F.col("_at.table").alias("table"), *[(F.col(f"_at.{c}") if c in t.schema["_at"].dataType.names else F.lit(None)).cast(kind).alias(c) for c, kind in (("source", "string"), ("_row_id", "long"), ("file", "string"), ("row", "long"))])
    rows = drop_subtotals(stack([t.select(*common, at(t).alias("_at")) for t in ordered]), labels)
    numbers = [c for c in numeric_columns(rows) if c in common]
    keys = keys or [c for c in text_columns(rows) if c in common]
    values = [c for c in common if c not in keys]
    if not values:
        return rows.select(*common).dropDuplicates(keys)
    numeric = [c for c in values if c in numbers]
    spread = rows.groupBy(*keys).agg(*[F.min(c).eqNullSafe(F.max(c)).alias(c) for c in numeric])
    same = spread.agg(*[F.coalesce(F.bool_and(c), F.lit(True)).alias(c) for c in numeric]).first() if numeric else {}
    made = [F.avg(c).alias(c) if c in numeric and not same[c] else first_known(c, "_at").alias(c) for c in values]
    merged = rows.groupBy(*keys).agg(*made).select(*common)
    return whole_to_long(merged)


def stack_by(tables: list[DataFrame], keys: list[str], func: str = "sum") -> DataFrame:
    """Stack, then one function over the numeric columns by keys; without keys a plain stack, without numbers distinct rows by keys."""
    rows = stack(tables)
    if not keys:
        return rows
    numbers = [c for c in numeric_columns(rows) if c not in keys]
    return rows.na.drop(subset=keys).groupBy(*keys).agg(*[FUNCS[func](c).alias(c) for c in numbers]) if numbers else rows.dropDuplicates(keys)


def first_of(df: DataFrame, subset: list[str], order: str | Column) -> DataFrame:
    """Without repeats by a subset of columns; the first row in order stays."""
    n = F.row_number().over(Window.partitionBy(*subset).orderBy(order))
    return df.withColumn("_n", n).filter("_n = 1").drop("_n")
