"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.folders import saved  # noqa: F401  the operators of this subpackage take it from here

#: A word is a run of characters other than space, tab, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def text_of(column: str | Column = "text") -> Column:
    """The text with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words of a non-null text, as long."""
    trimmed = F.regexp_replace(text, "^" + BLANK, "")
    pieces = F.size(F.split(trimmed, BLANK, -1))
    return (pieces - F.when(trimmed.rlike(r"[\x20\x09-\x0D]\z"), 1).when(trimmed == "", 1).otherwise(0)).cast("long")


def words_of(text: Column) -> Column:
    """The words of a non-null text in order; an empty array where it has none."""
    return F.filter(F.split(text, BLANK, -1), lambda w: w != "")


def quoted(name: str) -> Column:
    """A column of any name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores in front until no column of df begins like that (case ignored, as Spark does).

    So it may be used as a name and as the beginning of names.
    """
    while any(c.lower().startswith(wanted.lower()) for c in df.columns):
        wanted = "_" + wanted
    return wanted


def settled(df: DataFrame, columns: dict[str, Column], keep: list[str]) -> DataFrame:
    """The columns `keep` of df and then these, each worked out once a row, whatever is done with the result.

    They come out of a generator, so the optimizer does not put their steps into later filters, where each use of a step inside
    another would work it out again.
    """
    made = F.inline_outer(F.array(F.struct(*[c.alias(k) for k, c in columns.items()])))
    return df.select(*[quoted(c) for c in keep], made)


def ranked(values: DataFrame, column: str) -> DataFrame:
    """column, position (from 0) of the distinct values of a column in order, null last; a saved table.

    Values are spread by range and sorted within the ranges; what stands before a range follows from the counts of ranges.
    """
    ordered = values.select(column).distinct().repartitionByRange(F.col(column).asc_nulls_last()).sortWithinPartitions(F.col(column).asc_nulls_last())
    placed = saved(ordered.select(column, F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "ranked")
    # one row per range
    ranges = placed.groupBy("range").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranges.select("range", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return placed.join(F.broadcast(starts), "range").select(column, (F.col("before") + F.col("at") - F.col("first")).alias("position"))
