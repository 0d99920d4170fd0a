"""When a key may start again: backoff after failures and a cap on starts in the trailing hour, as keyed state with event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

HOUR = 3600.0
#: A log is live if written within this many seconds; its clocks are moved on by at most the slack.
LIVE_AGE, CLOCK_SLACK = 60.0, 90.0
RESULT = "key string, ord long, ts timestamp, allowed boolean, reason string, failures int, starts int"


class Gate:
    """The rules for one key, on seconds. ``starts`` holds at most as many times as the cap allows."""

    def __init__(self, base: float, top: float, cap: int, failures: int = 0, until: float = 0.0, starts: list[float] | None = None) -> None:
        self.base, self.top, self.cap, self.failures, self.until, self.starts = base, top, cap, failures, until, starts or []

    def take(self, now: float, outcome: str) -> tuple[bool | None, str | None]:
        """(allowed, reason) of a request to start; (None, None) of an outcome."""
        self.starts = [t for t in self.starts if t >= now - HOUR]
        if outcome == "ok":
            self.failures, self.until = 0, 0.0
        elif outcome == "fail":
            self.failures += 1
            self.until = now + min(self.top, self.base * 2.0 ** min(self.failures - 1, 60))
        elif now < self.until:
            return False, "backoff"
        elif 0 <= self.cap <= len(self.starts):
            return False, "max_starts_per_hour"
        else:
            self.starts.append(now)
            return True, None
        return None, None


class StartGate(StatefulProcessor):
    """State: failures and the end of the backoff, and the starts of the last hour. A timer an hour after the last start empties those, so idle keys keep two numbers."""

    def __init__(self, base: float, top: float, cap: int) -> None:
        self.base, self.top, self.cap = base, top, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.wait = handle.getValueState("wait", "failures int, until double")
        self.starts = handle.getListState("starts", "at double")

    def _gate(self) -> Gate:
        failures, until = self.wait.get() if self.wait.exists() else (0, 0.0)
        return Gate(self.base, self.top, self.cap, int(failures), float(until), [float(r[0]) for r in self.starts.get()] if self.starts.exists() else [])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        gate, out = self._gate(), []
        for ts, at, outcome in pd.concat(rows).sort_values(["ts", "ord"])[["ts", "ord", "outcome"]].itertuples(index=False):
            allowed, reason = gate.take(ts.timestamp(), outcome)
            if allowed is not None:
                out.append((key[0], at, ts, allowed, reason, gate.failures, len(gate.starts)))
        self.wait.update((gate.failures, gate.until))
        if gate.starts:
            self.starts.put([(t,) for t in gate.starts])
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(int((gate.starts[-1] + HOUR) * 1000) + 1)
        yield pd.DataFrame(out, columns=["key", "ord", "ts", "allowed", "reason", "failures", "starts"]).astype({"failures": "int32", "starts": "int32", "allowed": "bool"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        self.starts.clear()
        yield pd.DataFrame({"key": [], "ord": [], "ts": [], "allowed": [], "reason": [], "failures": [], "starts": []}).astype({"key": "object", "ord": "int64", "ts": "datetime64[ns]", "allowed": "bool", "reason": "object", "failures": "int32", "starts": "int32"})

    def close(self) -> None:
        pass


def allowed_starts(events: DataFrame, base: float = 300.0, top: float = 3600.0, cap: int = 2, late: str = "0 seconds") -> DataFrame:
    """Of a stream (key, ord, ts, outcome) the requests to start, each with whether it was allowed, why not, and the state after it.

    Outcomes are ``start``, ``ok`` and ``fail``. ``late`` is how far out of order events may come over batches; those of one batch are ordered.
    """
    keyed = events.select(F.col("key").cast("string").alias("key"), F.col("ord").cast("long").alias("ord"), F.col("ts").cast("timestamp").alias("ts"), "outcome").withWatermark("ts", late)
    return keyed.groupBy("key").transformWithStateInPandas(StartGate(base, top, cap), StructType.fromDDL(RESULT), "Append", "EventTime")


def allowed_starts_batch(events: DataFrame, base: float = 300.0, top: float = 3600.0, cap: int = 2) -> DataFrame:
    """The same over a table. A key's events come sorted, in bounded batches, and its gate is kept between them."""
    rows = events.select(F.col("key").cast("string").alias("key"), F.col("ord").cast("long").alias("ord"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "outcome").filter("key is not null")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, gate = None, None
        for frame in frames:
            out = []
            for key, at, ts, us, outcome in frame[["key", "ord", "ts", "us", "outcome"]].itertuples(index=False):
                if key != of:
                    of, gate = key, Gate(base, top, cap)
                allowed, reason = gate.take(us / 1e6, outcome)
                if allowed is not None:
                    out.append((key, at, ts, allowed, reason, gate.failures, len(gate.starts)))
            yield pd.DataFrame(out, columns=["key", "ord", "ts", "allowed", "reason", "failures", "starts"]).astype({"ord": "int64", "failures": "int32", "starts": "int32", "allowed": "bool", "ts": frame["ts"].dtype})

    return rows.repartition("key").sortWithinPartitions("key", "us", "ord").mapInPandas(walk, RESULT)
