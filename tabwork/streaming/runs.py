"""Run logs as they arrive: chains, success rates and stage durations as keyed state, with timers and late rows.

Each session has a state of bounded size (its last runs, or a row per stage) that new rows update, in whatever order they come.
With a time column, rows older than the watermark are late: Spark leaves them out (and counts them in the query's progress),
as their session may be closed. A session without news for `keep_ms` behind the watermark is closed: its last row has `closed`
set and its state is dropped. Use output mode update; the row of a session with the largest `seen` holds its newest figures.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.rules import require


def _keyed(rows: DataFrame, key: str, time: str | None, late: str, keep_ms: int, fresh: dict, take: Callable[[dict, pd.DataFrame], None], show: Callable[[dict], list[tuple]], schema: str) -> DataFrame:
    """A state per key: `take` brings rows into it, `show` gives its rows; rows hold key, _ms (null without a time column) and what take needs."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(at: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {**json.loads(json.dumps(fresh)), "seen": 0, "latest": 0}
        if state.hasTimedOut:
            state.remove()
            closed = True
        else:
            closed, mark = False, state.getCurrentWatermarkMs() if time else 0
            for part in parts:
                if len(part):
                    held["seen"] += len(part)
                    held["latest"] = max(held["latest"], int(part["_ms"].max())) if time else 0
                    take(held, part)
            state.update((json.dumps(held),))
            if time:
                state.setTimeoutTimestamp(max(held["latest"] + keep_ms, mark + 1))
        yield pd.DataFrame([(at[0], *r, held["seen"], closed) for r in show(held)], columns=[key, *names, "seen", "closed"])

    if time:
        rows = rows.withWatermark(time, late)
    kind = rows.schema[key].dataType.simpleString()
    wait = GroupStateTimeout.EventTimeTimeout if time else GroupStateTimeout.NoTimeout
    rows = rows.withColumn("_ms", F.unix_millis(time) if time else F.lit(None).cast("long"))
    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {schema}, seen long, closed boolean", "body string", "update", wait)


def _number(rows: DataFrame, column: str):
    c = F.col(column)
    return F.unix_micros(c.cast("timestamp")) if isinstance(rows.schema[column].dataType, (T.TimestampType, T.TimestampNTZType)) else c.cast("long")


def chains(runs: DataFrame, session: str, order: str, label: str, success: str, last: int = 6, arrow: str = " → ", time: str | None = None, late: str = "10 minutes", keep_ms: int = 3_600_000) -> DataFrame:
    """session, chain (labels of the successful ones of the last runs, in order), runs, success_rate, seen, closed."""
    require(runs, session, order, label, success)

    def take(held: dict, part: pd.DataFrame) -> None:
        ok = part["_ok"].fillna(False).astype(bool)
        held["runs"] += len(part)
        held["good"] += int(ok.sum())
        new = [[int(o), None if pd.isna(x) else x, bool(g)] for o, x, g in zip(part["_order"], part["_label"], ok)]
        held["last"] = sorted([*held["last"], *new], key=lambda r: r[0])[-last:]

    def show(held: dict) -> list[tuple]:
        return [(arrow.join(x for _, x, ok in held["last"] if ok and x is not None), held["runs"], held["good"] / held["runs"] if held["runs"] else 0.0)]

    columns = [session, *([time] if time else []), _number(runs, order).alias("_order"), F.col(label).cast("string").alias("_label"), F.col(success).cast("boolean").alias("_ok")]
    return _keyed(runs.select(*columns), session, time, late, keep_ms, {"last": [], "runs": 0, "good": 0}, take, show, "chain string, runs long, success_rate double")


def stage_durations(stages: DataFrame, time: str | None = None, late: str = "10 minutes", keep_ms: int = 3_600_000) -> DataFrame:
    """run, stage, duration_ms (of its first entry so far), total_ms (of the run so far), seen, closed; stages: run, stage, started_at, duration_ms."""
    require(stages, "run", "stage", "started_at", "duration_ms")

    def take(held: dict, part: pd.DataFrame) -> None:
        for stage, started, took in zip(part["_stage"], part["_started"], part["_took"]):
            held["total"] += int(took)
            known = held["first"].get(stage)
            if known is None or started < known[0]:
                held["first"][stage] = [int(started), int(took)]

    def show(held: dict) -> list[tuple]:
        return [(stage, took, held["total"]) for stage, (_, took) in held["first"].items()]

    columns = ["run", *([time] if time else []), F.col("stage").cast("string").alias("_stage"), _number(stages, "started_at").alias("_started"), F.col("duration_ms").cast("long").alias("_took")]
    return _keyed(stages.select(*columns), "run", time, late, keep_ms, {"first": {}, "total": 0}, take, show, "stage string, duration_ms long, total_ms long")
