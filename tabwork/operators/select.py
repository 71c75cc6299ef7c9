"""Columns: selection and derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import numeric_columns, require

OPERATORS = ("add", "subtract", "multiply", "divide", "abs_diff", "percent")


def select(df: DataFrame, columns: list[str]) -> DataFrame:
    require(df, *columns)
    return df.select(*columns)


def calculate(df: DataFrame, left, operator: str, right, name: str) -> DataFrame:
    """A column of two numeric operands, each a column name or a constant; division by zero gives null."""
    if operator not in OPERATORS:
        raise ValueError(f"operator must be one of {OPERATORS}")

    def operand(x) -> Column:
        if not isinstance(x, str):
            return F.lit(x)
        require(df, x)
        if x not in numeric_columns(df):
            raise ValueError(f"{x} is not numeric")
        return F.col(x)

    l, r = operand(left), operand(right)
    made = {"add": l + r, "subtract": l - r, "multiply": l * r, "divide": F.try_divide(l, r), "abs_diff": F.abs(l - r), "percent": F.try_divide(l, r) * 100}
    return df.withColumn(name, made[operator])


def split_date(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.withColumns({f"{column}_year": F.year(column), f"{column}_month": F.month(column)})
