"""The circuit breaker: one state machine, run over a table per key or over a stream with state.

Closed opens after `failures` failures in a row; open lets an event pass once `timeout` has gone by since the last
failure and is then half-open; half-open closes after `successes` successes and opens again on a failure.  Events that
meet an open breaker are refused and change nothing.  Events are taken in the order of time and id; ties by id.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# The worker that prepares a stateful operator on the driver is not given the shipped package; it gets the code itself.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLOSED, OPEN, HALF_OPEN = "closed", "open", "half_open"


@dataclass
class Breaker:
    failures: int = 5
    successes: int = 2
    timeout: float = 60.0
    state: str = CLOSED
    failed: int = 0
    passed: int = 0
    last_failure: float | None = None

    def step(self, at: float, ok: bool) -> tuple[bool, str]:
        """(whether the event was let through, the state after it)."""
        if self.state == OPEN:
            if self.last_failure is None or at - self.last_failure < self.timeout:
                return False, self.state
            self.state, self.passed = HALF_OPEN, 0
        if ok:
            if self.state == HALF_OPEN:
                self.passed += 1
                if self.passed >= self.successes:
                    self.state, self.failed, self.passed = CLOSED, 0, 0
            else:
                self.failed = 0
        else:
            self.last_failure = at
            if self.state == HALF_OPEN:
                self.state, self.failed, self.passed = OPEN, 0, 0
            else:
                self.failed += 1
                if self.failed >= self.failures:
                    self.state = OPEN
        return True, self.state


SCHEMA = "key {kind}, event_id long, seconds double, ok boolean, admitted boolean, state string"


def over_table(events: DataFrame, failures: int = 5, successes: int = 2, timeout: float = 60.0) -> DataFrame:
    """`events`: key, event_id, seconds, ok.  Keys are sorted within partitions and streamed through one breaker at a time,
    so a key of any length needs the memory of one batch."""
    rows = events.select("key", "event_id", "seconds", "ok").repartition("key").sortWithinPartitions("key", "seconds", "event_id")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, breaker = object(), Breaker()
        for batch in batches:
            told = []
            for key, at, ok in zip(batch["key"], batch["seconds"], batch["ok"]):
                if key != now:
                    now, breaker = key, Breaker(failures, successes, timeout)
                told.append(breaker.step(float(at), bool(ok)))
            yield batch.assign(admitted=[t[0] for t in told], state=[t[1] for t in told])

    return rows.mapInPandas(work, SCHEMA.format(kind=dict(events.dtypes)["key"]))


class BreakerProcessor(StatefulProcessor):
    """The same machine with its state kept by the stream.  Rows of a micro-batch are ordered before they are applied."""

    def __init__(self, failures: int = 5, successes: int = 2, timeout: float = 60.0):
        self.limits = (failures, successes, timeout)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("breaker", "state string, failed int, passed int, last_failure double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        breaker = Breaker(*self.limits)
        if self.held.exists():
            breaker.state, breaker.failed, breaker.passed, breaker.last_failure = self.held.get()
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["seconds", "event_id"], ignore_index=True)
        told = [breaker.step(float(at), bool(ok)) for at, ok in zip(frame["seconds"], frame["ok"])]
        self.held.update((breaker.state, breaker.failed, breaker.passed, breaker.last_failure))
        yield frame.assign(admitted=[t[0] for t in told], state=[t[1] for t in told])[["key", "event_id", "seconds", "ok", "admitted", "state"]]

    def close(self) -> None:
        pass


def over_stream(events: DataFrame, failures: int = 5, successes: int = 2, timeout: float = 60.0) -> DataFrame:
    """A streaming `events` with the same columns; needs the RocksDB state store."""
    kind = dict(events.dtypes)["key"]
    return events.groupBy("key").transformWithStateInPandas(BreakerProcessor(failures, successes, timeout), outputStructType=SCHEMA.format(kind=kind), outputMode="Append", timeMode="None")


def windowed_failures(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window start, event_type, events, total) of a stream or table with ``ts``: an extension beyond the breaker, with a
    watermark that drops what comes later than `late`."""
    got = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return got.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "events", "total")
