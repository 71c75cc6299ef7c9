"""Profiles that are kept and merged: a state per file, of sketches and counts, from one scan.

The state of a table is one row: rows, and for each column a struct of its known values, least and largest value, and sketches of
distinct values and quantiles. States of several files are merged without reading the files again.

Frequent values have states of their own, of several rows a file: its most frequent values with their counts, and the largest count
among those left out. From these follow, for all files together, a least and a largest count of each value, and what a value kept
nowhere can have at most; a second scan counts only the values that these bounds leave in doubt.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.folders import saved
from ..functions.rules import text_columns
from .quality import SUMMARY_ROW, text_stats

#: sketches: 2^HLL registers (relative standard error 0.8 %), KLL of this size (rank error 0.7 % or so)
HLL, KLL = 14, 400


def _facts(field: T.StructField, pattern: str) -> Column:
    c, kind = F.col(f"`{field.name}`"), field.dataType
    plain = isinstance(kind, T.AtomicType) and not isinstance(kind, T.BinaryType)
    text = c.cast("string")
    numbers = F.kll_sketch_agg_double(c.cast("double"), KLL) if isinstance(kind, T.NumericType) else F.lit(None).cast("binary")
    summary = F.count(F.when(c.rlike(pattern), 1)) if isinstance(kind, T.StringType) else F.count(F.lit(None))
    return F.struct(F.count(c).alias("known"), F.min(c if plain else text).alias("low"), F.max(c if plain else text).alias("high"), F.hll_sketch_agg(text, HLL).alias("distinct"), numbers.alias("numbers"), summary.alias("summary")).alias(field.name)


def states(df: DataFrame, part: Column | None = None, pattern: str = SUMMARY_ROW) -> DataFrame:
    """part, rows and a struct per column of df: a row per value of part (one row without it), by one aggregation over one scan."""
    facts = [F.count("*").alias("rows"), *[_facts(f, pattern) for f in df.schema]]
    return df.groupBy(part.alias("part")).agg(*facts) if part is not None else df.agg(*facts).select(F.lit(None).cast("string").alias("part"), "*")


def merged(some: DataFrame) -> DataFrame:
    """One state of all: what the rows together would give, up to the errors of the sketches. Columns that a part lacks are missing there."""
    def both(c: str) -> Column:
        f = lambda name: F.col(f"`{c}`.{name}")
        total = lambda name: F.coalesce(F.sum(f(name)), F.lit(0)).alias(name)
        return F.struct(total("known"), F.min(f("low")).alias("low"), F.max(f("high")).alias("high"), F.hll_union_agg(f("distinct")).alias("distinct"), F.kll_merge_agg_double(f("numbers")).alias("numbers"), total("summary")).alias(c)

    return some.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *[both(c) for c in some.columns if c not in ("part", "rows")]).select(F.lit(None).cast("string").alias("part"), "*")


def report(some: DataFrame, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """part, column, kind, data_count, missing, min and max as text of up to 20 characters, distinct, quantiles and summary rows.

    Distinct values and quantiles are estimates: quantiles are values that occur (NaN takes no part), and null for columns without numbers.
    """
    def of(c: str) -> Column:
        s, kind = f"`{c}`", some.schema[c].dataType
        f = lambda name: F.col(f"{s}.{name}")
        at = F.when(F.coalesce(F.kll_sketch_get_n_double(f("numbers")), F.lit(0)) > 0, F.kll_sketch_get_quantile_double(f("numbers"), F.array(*map(F.lit, shares))))
        known = F.coalesce(f("known"), F.lit(0))
        cut = lambda name: F.substring(f(name).cast("string"), 1, 20).alias(name)
        return F.struct(
            F.lit(c).alias("column"), F.lit(kind["low"].dataType.simpleString()).alias("kind"), known.alias("data_count"), (F.col("rows") - known).alias("missing"), cut("low").alias("min"), cut("high").alias("max"),
            F.coalesce(F.hll_sketch_estimate(f("distinct")), F.lit(0)).alias("distinct"), at.alias("quantiles"), F.coalesce(f("summary"), F.lit(0)).alias("summary_rows"))

    return some.select("part", F.inline(F.array(*[of(c) for c in some.columns if c not in ("part", "rows")])))


def _values(df: DataFrame, part: Column | None, columns: list[str]) -> DataFrame:
    each = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    return df.select((F.lit(None).cast("string") if part is None else part).alias("part"), F.inline(F.array(*each)))


def frequent(df: DataFrame, part: Column | None = None, columns: list[str] | None = None, keep: int = 1000) -> DataFrame:
    """part, column, value (as text), count, missed: the `keep` most frequent values of each part, ties by value, and the largest count
    among its other values. A row of value null counts what is missing. Text columns by default."""
    counts = _values(df, part, columns or text_columns(df)).groupBy("part", "column", "value").agg(F.count("*").alias("count"))
    rank = F.row_number().over(Window.partitionBy("part", "column", F.col("value").isNull()).orderBy(F.desc("count"), "value"))
    # one more than is kept, so the second window has a bounded number of rows
    top = counts.withColumn("_rank", rank).filter(F.col("_rank") <= keep + 1)
    missed = F.max(F.when(F.col("_rank") > keep, F.col("count"))).over(Window.partitionBy("part", "column"))
    return top.withColumn("missed", F.coalesce(missed, F.lit(0))).filter(F.col("_rank") <= keep).drop("_rank")


def frequent_bounds(some: DataFrame) -> DataFrame:
    """column, value, at_least, at_most, unseen from states of `frequent`: how often each value kept anywhere occurs in all parts, and
    what a value kept nowhere can have at most."""
    unseen = some.groupBy("part", "column").agg(F.max("missed").alias("missed")).groupBy("column").agg(F.sum("missed").alias("unseen"))
    seen = some.filter("value is not null").groupBy("column", "value").agg(F.sum("count").alias("at_least"), F.sum("missed").alias("_own"))
    return seen.join(unseen, "column").select("column", "value", "at_least", (F.col("at_least") + F.col("unseen") - F.col("_own")).alias("at_most"), "unseen")


def most_frequent(some: DataFrame, most: int = 3) -> DataFrame:
    """column, rank, value, at_least, at_most, certain: the values of largest sure count, from states alone. `certain`: no other value,
    kept or not, can occur more often than this one surely does, but for those that are in the result."""
    bounds = frequent_bounds(some)
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("at_least"), "value"))
    top = bounds.withColumn("rank", rank).filter(F.col("rank") <= most)
    rest = bounds.join(top.select("column", "value"), ["column", "value"], "left_anti").groupBy("column").agg(F.max("at_most").alias("_rest"))
    rival = F.greatest(F.coalesce("_rest", F.lit(0)), "unseen")
    return top.join(rest, "column", "left").select("column", "rank", "value", "at_least", "at_most", (F.col("at_least") >= rival).alias("certain"))


def most_frequent_exact(some: DataFrame, df: DataFrame, most: int = 3) -> DataFrame:
    """column, rank, value, count: exactly the most frequent values of df, whose states `some` are; ties by value.

    A scan of df counts the values that the bounds leave in doubt. Columns of which a value kept nowhere might be among the first are
    counted whole. Jobs: one saves the bounds, two small ones tell which columns these are, one saves the values in doubt.
    """
    bounds = saved(frequent_bounds(some), "frequent-bounds")
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("at_least"), "value"))
    last = bounds.withColumn("_n", rank).filter(F.col("_n") <= most).groupBy("column").agg(F.min("at_least").alias("_last"), F.max("_n").alias("_n"), F.max("unseen").alias("unseen"))
    # with fewer values than asked for, any value may be among the first
    cut = F.when(F.col("_n") == most, F.col("_last")).otherwise(0)
    columns = [r["column"] for r in bounds.select("column").distinct().collect()]
    doubt = [r["column"] for r in last.filter((F.col("unseen") > 0) & (F.col("unseen") >= cut)).select("column").collect()]
    sure = [c for c in columns if c not in doubt]
    counts = []
    if sure:
        wanted = saved(bounds.join(last.select("column", cut.alias("_cut")), "column").filter(F.col("at_most") >= F.col("_cut")).select("column", "value"), "frequent-doubt")
        # counted first, so that rows of one value never meet in a task; Spark broadcasts few wanted values and looks them up before
        counted = _values(df, None, sure).drop("part").groupBy("column", "value").agg(F.count("*").alias("count")).join(wanted, ["column", "value"], "left_semi")
        again = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
        counts.append(counted.withColumn("rank", again).filter(F.col("rank") <= most).select("column", "rank", "value", "count"))
    if doubt:
        counts.append(text_stats(df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in doubt]), doubt, most).select("column", "rank", "value", "count"))
    if not counts:
        return df.sparkSession.createDataFrame([], "column string, rank int, value string, count long")
    return reduce(DataFrame.unionByName, counts)


def refreshed(spark: SparkSession, paths: list[str], kept: DataFrame | None = None, read: Callable[[list[str]], DataFrame] | None = None,
              make: Callable[[DataFrame, Column], DataFrame] = states) -> DataFrame:
    """States by file of all files at paths as they are now; of these, only files that `kept` does not know are read.

    A file is known by path, length and time of change, so one that was written again is read again, and states of files that are gone
    go. Files may differ in columns. The driver sees the names of new files. `read` makes a table of a list of files (Parquet by default),
    `make` the states of a table by part (`states`, or `frequent` for frequent values).
    """
    name = lambda path, size, changed: F.concat_ws("|", path, size, F.unix_millis(changed))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", name(F.col("path"), F.col("length"), F.col("modificationTime")).alias("part"))
    fresh = files if kept is None else files.join(kept.select("part"), "part", "left_anti")
    found = [r["path"] for r in fresh.select("path").collect()]
    out = [] if kept is None else [kept.join(files.select("part"), "part", "left_semi")]
    if found:
        df = (read or (lambda names: spark.read.option("mergeSchema", "true").parquet(*names)))(found)
        m = lambda field: F.col(f"_metadata.{field}")
        out.append(make(df, name(m("file_path"), m("file_size"), m("file_modification_time"))))
    if not out:
        raise ValueError(f"no files at {paths}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)
