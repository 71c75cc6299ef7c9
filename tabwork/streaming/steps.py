"""Row-wise steps on streams: the same functions as for tables, on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.filters import OPERATORS, filter_rows
from ..operators.select import calculate, select


def follow(spark: SparkSession, path: str, schema, format: str = "parquet") -> DataFrame:
    """A stream of the files that arrive at a path."""
    return spark.readStream.format(format).schema(schema).load(path)


def row_steps(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Filters (all but top_n and bottom_n), derived columns and selections, in order."""
    for step in steps:
        op, args = step["op"], {k: v for k, v in step.items() if k != "op"}
        if op == "filter" and args["operator"] in OPERATORS and args["operator"] not in ("top_n", "bottom_n"):
            df = filter_rows(df, **args)
        elif op == "calculate":
            df = calculate(df, **args)
        elif op == "select":
            df = select(df, args["columns"])
        else:
            raise ValueError(f"{op} is not a row-wise step")
    return df
