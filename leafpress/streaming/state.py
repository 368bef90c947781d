"""Stateful stream operators, each with a batch twin that folds the ordered rows of a key the same way.

A fold is a function (state, row) -> (state, keep). In batch it runs over the sorted rows of a key; in a stream
the state lives in Spark's state store between micro-batches, with a timeout after the last row of a key.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

Fold = Callable[[Any, dict], tuple[Any, bool]]


@dataclass(frozen=True)
class RateLimit:
    """At most limit accepted rows in a period; refused rows don't count. A row whose refund is true gives the latest accepted
    place back (and isn't accepted itself): its time no longer counts."""

    limit: int
    period_ms: int

    def __call__(self, state: list | None, row: dict) -> tuple[list, bool]:
        recent = [t for t in state or [] if t + self.period_ms > row["ms"]]
        if row.get("refund"):
            return recent[:-1], False
        return (recent + [row["ms"]], True) if len(recent) < self.limit else (recent, False)


@dataclass(frozen=True)
class Throttle:
    """A row is kept if the last kept one is old enough or its size differs enough."""

    gap_ms: int = 1200
    change: float = 0.05

    def __call__(self, state: list | None, row: dict) -> tuple[list, bool]:
        size = float(row["size"])
        if state and row["ms"] - state[0] < self.gap_ms and abs(size - state[1]) / (abs(state[1]) + 1e-16) < self.change:
            return state, False
        return [row["ms"], size], True


@dataclass(frozen=True)
class ErrorRun:
    """A row is kept (as an alarm) while more than threshold failures stand in a row, none older than retain_ms."""

    threshold: int = 10
    retain_ms: int = 3_600_000

    def __call__(self, state: list | None, row: dict) -> tuple[list | None, bool]:
        if not row["failed"]:
            return None, False
        n, last = state or [0, row["ms"]]
        n = 1 if row["ms"] - last >= self.retain_ms else n + 1
        return [n, row["ms"]], n > self.threshold


@dataclass(frozen=True)
class Watchdog:
    """A row is kept (as an alarm) at the last strike: with more than one request under way, nothing has worked for longer than
    delay_ms times one more than the strikes so far. Rows tell what happened: start, done, worked or tick."""

    delay_ms: int = 30_000
    strikes: int = 3

    def __call__(self, state: dict | None, row: dict) -> tuple[dict, bool]:
        s = dict(state or {"open": 0, "worked": None, "asked": None, "strikes": 0})
        if row["what"] == "start":
            s |= {"open": s["open"] + 1, "asked": row["ms"], "worked": row["ms"] if s["worked"] is None else s["worked"]}
        elif row["what"] == "done":
            s["open"] = max(0, s["open"] - 1)
        elif row["what"] == "worked":
            s |= {"worked": row["ms"], "strikes": 0}
        elif s["worked"] is not None and s["open"] > 1 and s["asked"] >= s["worked"] and row["ms"] - s["worked"] > self.delay_ms * (s["strikes"] + 1):
            s["strikes"] += 1
        return s, s["strikes"] >= self.strikes and row["what"] == "tick"


def batch(rows: DataFrame, key: str, order: list[str], fold: Fold, at: str = "ts") -> DataFrame:
    """rows and keep, by the fold of each key's rows in order. Keys are dealt to tasks and sorted there by Spark; the fold passes
    over the sorted rows batch by batch and holds one key's state alone, however many rows a key has."""
    work = rows.withColumn("__ms", F.unix_millis(F.col(at).cast("timestamp"))).repartition(F.col(key)).sortWithinPartitions(key, *order)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, begun = None, None, False
        for part in batches:
            keeps = []
            for row in part.rename_columns(["ms" if c == "__ms" else c for c in part.schema.names]).to_pylist():
                if not begun or row[key] != last:
                    last, state, begun = row[key], None, True
                state, keep = fold(state, row)
                keeps.append(keep)
            yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(keeps, pa.bool_())], names=[*names, "keep"])

    return work.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("keep", T.BooleanType())]))


def error_alarms(rows: DataFrame, key: str, order: list[str], failed: Column, rule: ErrorRun, at: str = "ts") -> DataFrame:
    """rows and keep, as batch() gives them for an ErrorRun, by windows alone: a run ends with a success or a long gap."""
    by = Window.partitionBy(key).orderBy(*order)
    ms = F.unix_millis(F.col(at).cast("timestamp"))
    work = rows.withColumns({"__failed": F.coalesce(failed, F.lit(False)), "__gap": F.coalesce(ms - F.lag(ms).over(by) >= rule.retain_ms, F.lit(True))})
    work = work.withColumn("__run", F.sum((~F.col("__failed") | F.col("__gap") | ~F.lag("__failed").over(by)).cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.row_number().over(Window.partitionBy(key, "__run").orderBy(*order))
    return work.withColumn("keep", F.col("__failed") & (n > rule.threshold)).drop("__failed", "__gap", "__run")


def stream(rows: DataFrame, key: str, order: list[str], fold: Fold, at: str = "ts", idle: str | None = "1 hour") -> DataFrame:
    """The same over a stream: rows that arrive in one micro-batch are put in order first. State goes when a key has been idle.
    A run over what is available needs idle=None: with a timeout there is always one more batch to come."""
    work = rows.withColumn("ms", F.unix_millis(F.col(at).cast("timestamp")))
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def run(_key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = json.loads(held.get[0]) if held.exists else None
        frame = pd.concat(list(frames)).sort_values(order)
        keeps = []
        for row in frame.to_dict("records"):
            state, keep = fold(state, row)
            keeps.append(keep)
        held.update((json.dumps(state),))
        if idle_ms:
            held.setTimeoutDuration(idle_ms)
        yield frame.drop(columns="ms").assign(keep=keeps)

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", keep boolean"
    return work.groupBy(key).applyInPandasWithState(run, out, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def latest_snapshot(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """The most complete state of each key so far: the row of the largest seq. For a stream, an update-mode query."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("s")).select(key, "s.*")


def once_within(rows: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """A stream's rows without repeats that come within the lateness."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def activity(rows: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """A stream's stretches of activity that a gap ends: key, start, n."""
    return rows.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")
