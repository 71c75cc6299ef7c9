"""Pipelines: lists of steps, checked against the schema and run as one lazy DataFrame."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame, Observation, functions as F

from ..operators import aggregate as agg, charts, filters, select as cols
from ..sources import tables as src

REQUIRED = {"load": (), "filter": ("column", "operator"), "sort": ("column",), "select": ("columns",), "aggregate": (), "calculate": ("left", "operator", "right", "name"), "chart": (), "save": ("path",)}
CHARTS = {"bar": charts.bar, "line": charts.line, "pie": charts.pie, "scatter": charts.scatter, "histogram": charts.histogram, "box": charts.box}


def _step(df: DataFrame | None, step: dict, tables: dict[str, DataFrame]) -> DataFrame:
    op, args = step["op"], {k: v for k, v in step.items() if k != "op"}
    if op == "load":
        loaded = src.load(tables, args.get("files"), args.get("concat", False))
        return loaded if args.get("keep_source") else loaded.drop("source")
    if op == "filter":
        return filters.filter_rows(df, **args)
    if op == "sort":
        return filters.sort(df, args["column"], args.get("direction", "asc"))
    if op == "select":
        return cols.select(df, args["columns"])
    if op == "aggregate":
        return agg.aggregate(df, **args)
    if op == "calculate":
        return cols.calculate(df, args["left"], args["operator"], args["right"], args["name"])
    if op == "chart":
        x, y = args.get("x_column") or df.columns[0], args.get("y_columns")
        kind = args.get("chart_type", "bar")
        if kind in ("bar", "line"):
            return CHARTS[kind](df, x, y)
        if kind in ("pie", "scatter"):
            return CHARTS[kind](df, x, y[0])
        return CHARTS[kind](df, y[0])
    return df  # save is done once, at the end


def problems(steps: list, tables: dict[str, DataFrame]) -> list[str]:
    """What is wrong with a pipeline; an empty list if nothing. Looks at schemas only and starts no job."""
    found, df = [], None
    if not steps or not (isinstance(steps[0], dict) and steps[0].get("op") == "load"):
        return ["the first step must be load"]
    for i, step in enumerate(steps):
        if callable(step):
            df = step(df)
            continue
        op = step.get("op")
        at = f"step {i + 1} ({op})"
        if op not in REQUIRED:
            found.append(f"{at}: op must be one of {tuple(REQUIRED)}")
            break
        gone = [a for a in REQUIRED[op] if step.get(a) is None]
        if gone:
            found.append(f"{at}: {gone} missing")
        if op in ("chart", "save") and any(isinstance(s, dict) and s.get("op") not in ("chart", "save") for s in steps[i + 1:]):
            found.append(f"{at}: must come last")
        if op == "filter" and step.get("operator") not in filters.OPERATORS:
            found.append(f"{at}: operator must be one of {filters.OPERATORS}")
        if op == "calculate" and step.get("operator") not in cols.OPERATORS:
            found.append(f"{at}: operator must be one of {cols.OPERATORS}")
        if op == "chart" and step.get("chart_type", "bar") not in CHARTS:
            found.append(f"{at}: chart_type must be one of {tuple(CHARTS)}")
        if step.get("n") is not None and step["n"] < 1:
            found.append(f"{at}: n must be 1 or more")
        if df is not None:
            named = [step.get(k) for k in ("column", "compare_column", "x_column", "order")] + [*(step.get("columns") or []), *(step.get("group_by") or []), *(step.get("y_columns") or []), *(m.get("column") for m in step.get("metrics") or [])]
            named += [step.get(k) for k in ("left", "right") if isinstance(step.get(k), str)]
            for name in dict.fromkeys(n for n in named if n and n not in df.columns):
                found.append(f"{at}: no column {name}; similar: {difflib.get_close_matches(name, df.columns, 3, 0.4)}")
        if found:
            break
        try:
            df = _step(df, step, tables)
        except ValueError as error:
            found.append(f"{at}: {error}")
            break
    return found


def run(steps: list, tables: dict[str, DataFrame], counted: bool = False) -> tuple[DataFrame, list[dict]]:
    """(result, log): the steps as one lazy DataFrame, and name and columns after each. A step is a dict or a function of a DataFrame.

    With `counted` the rows after each step are counted while the result is worked out, by no job of their own: `row_counts`
    gives them after the first action. Filters are not pushed below such a count, so it is left to the caller to ask for it.
    """
    wrong = problems(steps, tables)
    if wrong:
        raise ValueError("; ".join(wrong))
    df, log = None, []
    for i, step in enumerate(steps):
        df = step(df) if callable(step) else _step(df, step, tables)
        log.append({"step": getattr(step, "__name__", "function") if callable(step) else step["op"], "columns": df.columns})
        if counted:
            seen = Observation(f"step-{i}")
            df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            log[-1]["observed"] = seen
        if isinstance(step, dict) and step["op"] == "save":
            log[-1]["path"] = src.save(df, step["path"], step.get("format", "csv"), step.get("mode", "errorifexists"), step.get("filename"))
    return df, log


def row_counts(log: list[dict]) -> list[int]:
    """Rows after each step of a counted run, once its result (or its save) has been worked out."""
    return [entry["observed"].get["rows"] for entry in log]
