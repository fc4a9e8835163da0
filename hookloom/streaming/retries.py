"""Retry decisions on a stream of failures, and redelivery when a retry is due."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from hookloom.operators.dedupe import DAY
from hookloom.operators.retries import MAX_RETRIES, effective_limit

DECISIONS = (
    "message_id string, source string, error string, attempt int, action string, "
    "delay_seconds double, failed_at timestamp, due_at timestamp"
)
REDELIVERIES = f"{DECISIONS}, payload string"


class AttemptCounter(StatefulProcessor):
    """Counts failures of a message and decides after each.

    The counter expires one window after its first failure and is cleared when the
    message is dead-lettered. It is one state with a time to live, so a message that
    succeeds after some failures leaves nothing behind. Failures of a message in one
    micro-batch are taken an Arrow batch at a time, in order of time within each.
    """

    def __init__(self, limit: int, base_seconds: float, window_seconds: float) -> None:
        self.limit, self.base, self.window_ms = limit, base_seconds, int(window_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counter = handle.getValueState("counter", "attempts int, ends long", ttlDurationMs=self.window_ms)

    def decisions(self, key, batches: Iterator[pd.DataFrame], now: int) -> Iterator[pd.DataFrame]:
        before, ends = self.counter.get() if self.counter.exists() else (0, 0)
        # The time to live counts from the last write, the window from the first failure.
        if not before or now >= ends:
            before, ends = 0, now + self.window_ms
        for batch in batches:
            failures = batch.sort_values("failed_at", kind="stable", ignore_index=True)
            numbers = before + np.arange(len(failures))
            attempt = numbers % self.limit + 1
            again = attempt < self.limit
            delay = np.where(again, self.base * 2.0 ** attempt, np.nan)
            yield failures.assign(
                message_id=key[0], attempt=attempt.astype("int32"), action=np.where(again, "retry", "dead_letter"),
                delay_seconds=pd.Series(delay).astype(object).where(again, None),
                due_at=failures["failed_at"] + pd.to_timedelta(pd.Series(delay), unit="s"),
            )
            if before + len(failures) >= self.limit:  # started anew after a dead letter
                ends = now + self.window_ms
            before = int(before + len(failures)) % self.limit
        if before:
            self.counter.update((before, int(ends)))
        else:
            self.counter.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in DECISIONS.split(", ")]
        for decided in self.decisions(key, rows, timer_values.getCurrentProcessingTimeInMs()):
            yield decided[names]

    def close(self) -> None:
        pass


class Redelivery(AttemptCounter):
    """Holds a failed message until its retry is due, then hands it on again.

    Waiting messages lie in state by due time, with a timer each; a timer that fires takes out
    those due by then. What is overdue on arrival, and dead letters, come out at once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.waiting = handle.getMapState(
            "waiting", "due_ms long, place long",
            "source string, error string, attempt int, delay_seconds double, failed_us long, due_us long, payload string",
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in REDELIVERIES.split(", ")]
        now, timers = timer_values.getCurrentProcessingTimeInMs(), set()
        place = None
        for decided in self.decisions(key, rows, now):
            due_us = decided["due_at"].astype("datetime64[us]").astype("int64")
            due_ms = -(-due_us // 1000)  # never early
            held = (decided["action"] == "retry") & (due_ms > now)
            if held.any() and place is None:
                place = 1 + max((taken[1] for taken in self.waiting.keys()), default=-1)
            for at in np.flatnonzero(held):
                row = decided.iloc[at]
                self.waiting.updateValue(
                    (int(due_ms[at]), place),
                    (row["source"], row["error"], int(row["attempt"]), float(row["delay_seconds"]),
                     int(row["failed_at"].value // 1000), int(due_us[at]), row["payload"]),
                )
                place += 1
                timers.add(int(due_ms[at]))
            ready = decided[~held]
            if len(ready):
                yield ready.assign(action=ready["action"].replace("retry", "redeliver"))[names]
        for due in timers:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        ready = sorted((taken, value) for taken, value in self.waiting.iterator() if taken[0] <= due)
        for taken, _ in ready:
            self.waiting.removeKey(taken)
        if ready:
            source, error, attempt, delay, failed_us, due_us, payload = zip(*(value for _, value in ready))
            yield pd.DataFrame({
                "message_id": key[0], "source": source, "error": error, "attempt": np.array(attempt, dtype="int32"),
                "action": "redeliver", "delay_seconds": delay, "failed_at": pd.to_datetime(failed_us, unit="us"),
                "due_at": pd.to_datetime(due_us, unit="us"), "payload": payload,
            })


def retry_stream(
    failures: DataFrame, max_retries: int = MAX_RETRIES, base_seconds: float = 1.0,
    window_seconds: float = DAY,
) -> DataFrame:
    """One decision per failure, at once: retry with a due time, or dead-letter."""
    return failures.groupBy("message_id").transformWithStateInPandas(
        statefulProcessor=AttemptCounter(effective_limit(max_retries), base_seconds, window_seconds),
        outputStructType=DECISIONS,
        outputMode="Append",
        timeMode="ProcessingTime",
    )


def redelivery_stream(
    failures: DataFrame, max_retries: int = MAX_RETRIES, base_seconds: float = 1.0,
    window_seconds: float = DAY,
) -> DataFrame:
    """Failed messages to deliver again, each not before its retry is due, and dead letters at once.

    ``failures`` are ``message_id, source, error, failed_at`` and, where there is one, ``payload``, which a
    redelivery carries; ``action`` is ``redeliver`` or ``dead_letter``. A retry is due ``base_seconds`` * 2^attempt after
    its failure, by the processing clock. Timers are looked at in every micro-batch, also in
    one without rows unless those are switched off.
    """
    payload = F.col("payload") if "payload" in failures.columns else F.lit(None)
    slim = failures.select("message_id", "source", "error", "failed_at", payload.cast("string").alias("payload"))
    return slim.groupBy("message_id").transformWithStateInPandas(
        statefulProcessor=Redelivery(effective_limit(max_retries), base_seconds, window_seconds),
        outputStructType=REDELIVERIES,
        outputMode="Append",
        timeMode="ProcessingTime",
    )
