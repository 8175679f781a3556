"""Delay machines over a stream of fetches: one small state per domain, no list of what came.

The same machines as ``throttle`` folds over a whole log.  A domain's rows of one micro-batch
are put in order of seq; what came in earlier batches is before them.  With ``idle``, a timer
forgets a domain that long after its last row (processing time), and it starts anew.  State
needs the RocksDB provider: ``state_store`` sets it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .throttle import LONGEST

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """Set the provider that keeps state on disk, with checkpoints of what changed."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def step_async(delay: float, status: int | None, retry_after: float | None) -> float:
    """Success halves; 429 doubles or takes Retry-After, 403 adds half, 5xx a quarter; 0 starts from 1."""
    if status is None:
        return delay
    if status < 400:
        return delay / 2
    up = {429: retry_after if retry_after is not None else (delay or 1.0) * 2, 403: (delay or 1.0) * 1.5}.get(status, (delay or 1.0) * 1.25 if status >= 500 else None)
    return delay if up is None else min(up, LONGEST)


def step_sync(delay: float, status: int | None, retry_after: float | None, base: float = 1.0, longest: float = 60.0) -> float:
    """Success takes a quarter off, down to ``base``; 429 trebles, 401 and 403 double, 5xx add half, up to ``longest``."""
    if status is None:
        return delay
    if status < 400:
        return max(base, delay * 0.75)
    factor = {429: 3, 401: 2, 403: 2}.get(status, 1.5 if status >= 500 else None)
    return delay if factor is None else min((delay or base) * factor, longest)


def _given(x: object) -> object:
    return None if pd.isna(x) else x


class DelayMachine(StatefulProcessor):
    """(domain, delay, n): the delay after each micro-batch, and how many rows led to it."""

    def __init__(self, step: Callable[[float, int | None, float | None], float], start: float, idle: int | None = None) -> None:
        self.step, self.start, self.idle = step, start, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "delay double, n long, timer long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        delay, n, timer = self.now.get() if self.now.exists() else (self.start, 0, -1)
        came = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for status, retry_after in zip(came["status"], came["retry_after"], strict=True):
            delay, n = self.step(delay, _given(status), _given(retry_after)), n + 1
        if self.idle is not None:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle
            self.handle.registerTimer(timer)
        self.now.update((delay, n, timer))
        yield pd.DataFrame({"domain": [key[0]], "delay": [delay], "n": [n]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.now.clear()
        yield pd.DataFrame({"domain": [key[0]], "delay": [self.start], "n": [0]})

    def close(self) -> None:
        pass


def stream_delays(log: DataFrame, machine: str = "async", idle: int | None = None) -> DataFrame:
    """(domain, delay, n), a row for each domain that a micro-batch of ``log`` (domain, seq, status, retry_after) touches; ``idle`` is in milliseconds."""
    step, start = {"async": (step_async, 0.0), "sync": (step_sync, 1.0)}[machine]
    return log.groupBy("domain").transformWithStateInPandas(
        statefulProcessor=DelayMachine(step, start, idle), outputStructType="domain string, delay double, n long",
        outputMode="Update", timeMode="None" if idle is None else "ProcessingTime",
    )


class CooldownMachine(StatefulProcessor):
    """(key, seq, cooldown): the wait before each search, by the limits since results last came."""

    def __init__(self, step: int, longest: int) -> None:
        self.step, self.longest = step, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.limits = handle.getValueState("limits", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n = self.limits.get()[0] if self.limits.exists() else 0
        came = pd.concat(list(rows)).sort_values("seq", kind="stable")
        waits = []
        for limited, results in zip(came["limited"], came["results"], strict=True):
            waits.append(min(n * self.step, self.longest))
            n = n + 1 if limited else 0 if results > 0 else n
        self.limits.update((n,))
        yield pd.DataFrame({"key": key[0], "seq": came["seq"].to_numpy(), "cooldown": waits})

    def close(self) -> None:
        pass


def stream_cooldowns(searches: DataFrame, step: int = 15, longest: int = 120) -> DataFrame:
    """(key, seq, cooldown) of a stream of searches (key, seq, limited, results)."""
    return searches.groupBy("key").transformWithStateInPandas(
        statefulProcessor=CooldownMachine(step, longest), outputStructType="key string, seq long, cooldown long", outputMode="Append", timeMode="None",
    )
