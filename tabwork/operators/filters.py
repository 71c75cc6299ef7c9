"""Filters, sorts and top-n. Comparisons with a missing value are false; what is negated keeps missing values."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.rules import require, stripped, text_columns

COMPARE = {"gte": Column.__ge__, "lte": Column.__le__, "gt": Column.__gt__, "lt": Column.__lt__, "eq": Column.__eq__}
BETWEEN_COLUMNS = {"col_gt": Column.__gt__, "col_lt": Column.__lt__, "col_eq": Column.__eq__}
OPERATORS = (*COMPARE, *BETWEEN_COLUMNS, "neq", "contains", "not_contains", "isna", "notna", "in_range", "isin", "top_n", "bottom_n")


def condition(column: str, operator: str, value=None, value_max=None, compare_column: str | None = None) -> Column:
    c = F.col(column)
    if operator in COMPARE:
        return COMPARE[operator](c, value)
    if operator in BETWEEN_COLUMNS:
        return BETWEEN_COLUMNS[operator](c, F.col(compare_column))
    if operator == "neq":
        return ~c.eqNullSafe(value)
    if operator == "contains":
        return c.cast("string").contains(str(value))
    if operator == "not_contains":
        return F.coalesce(~c.cast("string").contains(str(value)), F.lit(True))
    if operator == "isna":
        return c.isNull()
    if operator == "notna":
        return c.isNotNull()
    if operator == "isin":
        return c.isin(list(value))
    if operator == "in_range":
        if value_max is None:
            raise ValueError("in_range needs value_max")
        return c.between(value, value_max)
    raise ValueError(f"operator must be one of {OPERATORS}")


def filter_rows(df: DataFrame, column: str, operator: str, value=None, value_max=None, compare_column: str | None = None, n: int | None = None, order: str | None = None) -> DataFrame:
    """Rows by one condition; several filters in a row mean "and". top_n and bottom_n break ties by `order`."""
    require(df, column, *[c for c in (compare_column, order) if c])
    if operator in ("top_n", "bottom_n"):
        return top(df, column, n or 10, operator == "bottom_n", order)
    return df.filter(condition(column, operator, value, value_max, compare_column))


def top(df: DataFrame, column: str, n: int, smallest: bool = False, order: str | None = None) -> DataFrame:
    by = F.col(column).asc_nulls_last() if smallest else F.col(column).desc_nulls_last()
    return df.orderBy(by, *([order] if order else [])).limit(n)


def drop_missing(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def blank(df: DataFrame, column: str) -> DataFrame:
    """Rows in which a column is missing or holds only what stands for missing."""
    c = F.col(column)
    return df.filter(c.isNull() | stripped(c.cast("string")).isin("", "nan", "None"))


def equal_or_like(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows equal to the text if there are any, else rows that contain it if there are any, else all rows."""
    require(df, column)
    c = F.col(column).cast("string")
    facts = df.agg(F.coalesce(F.max(c == text), F.lit(False)).alias("_equal"), F.coalesce(F.max(c.contains(text)), F.lit(False)).alias("_like"))
    keep = F.when(F.col("_equal"), c == text).when(F.col("_like"), c.contains(text)).otherwise(True)
    return df.join(F.broadcast(facts)).filter(keep).drop("_equal", "_like")


def date_range(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """start <= column < end; an end that is None is open."""
    out = df
    for bound, test in ((start, Column.__ge__), (end, Column.__lt__)):
        out = out if bound is None else out.filter(test(F.col(column), F.lit(bound).cast("timestamp")))
    return out


def months(first: tuple[int, int] | None = None, last: tuple[int, int] | None = None) -> tuple[dt.date | None, dt.date | None]:
    """Bounds from one month to the end of another, either open."""
    after = last and (last[0] + last[1] // 12, last[1] % 12 + 1)
    return (dt.date(*first, 1) if first else None), (dt.date(*after, 1) if after else None)


def days(first: str | None = None, last: str | None = None) -> tuple[dt.date | None, dt.date | None]:
    """Bounds from one ISO day up to and with another, either open."""
    return (dt.date.fromisoformat(first) if first else None), (dt.date.fromisoformat(last) + dt.timedelta(1) if last else None)


def relative(name: str, as_of: dt.date, quarter: int | None = None) -> tuple[dt.date, dt.date]:
    """this_year, last_year, this_month, last_month, or quarter (1 to 4 of as_of's year)."""
    y, m = as_of.year, as_of.month
    back = (y, m - 1) if m > 1 else (y - 1, 12)
    spans = {"this_year": ((y, 1), (y, 12)), "last_year": ((y - 1, 1), (y - 1, 12)), "this_month": ((y, m), (y, m)), "last_month": (back, back)}
    if name == "quarter":
        return months((y, 3 * quarter - 2), (y, 3 * quarter))
    return months(*spans[name])


#: What the name of a date column holds.
DATE_HINTS = ("일자", "날짜", "date", "기간", "month", "time", "년도", "연도", "월")


def date_column(df: DataFrame, hints: tuple[str, ...] = DATE_HINTS) -> str | None:
    """The column to search dates in: a native one, else the first text column of which half parses as dates; those whose name says so are tried first. Runs one job."""
    native = [f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    texts = text_columns(df)
    if native or not texts:
        return native[0] if native else None
    texts.sort(key=lambda c: not any(h in c.lower() for h in hints))
    rates = df.agg(*[F.avg(F.try_to_timestamp(f"`{c}`").isNotNull().cast("double")).alias(c) for c in texts]).first()
    return next((c for c in texts if (rates[c] or 0) >= 0.5), None)


def sort(df: DataFrame, by: list[tuple[str, str]] | str, direction: str = "asc") -> DataFrame:
    """By one column or several with their own directions; missing values come last either way."""
    pairs = [(by, direction)] if isinstance(by, str) else by
    require(df, *[c for c, _ in pairs])
    return df.orderBy(*[F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in pairs])
