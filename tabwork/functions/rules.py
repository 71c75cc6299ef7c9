"""Rules that every operator follows: one kind of missing, what is numeric, how text becomes a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: what a text is stripped of at its ends: every blank character
BLANKS = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def stripped(c) -> Column:
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of a numeric type; booleans are not numeric."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}; there are {df.columns}")


def one_missing(df: DataFrame) -> DataFrame:
    """NaN becomes null, so that comparisons and sums treat both alike."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def to_number(c: Column) -> Column:
    """The number that a text says, thousands separators removed; else null."""
    plain = F.replace(c, F.lit(","), F.lit(""))
    return F.when(plain.rlike(NUMBER), plain.try_cast("double"))


def first_known(column: str, order: str) -> Column:
    """Aggregate: the first value that is not missing, by order."""
    return F.min_by(column, F.when(F.col(column).isNotNull(), F.col(order)))
