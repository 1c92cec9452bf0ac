"""Run states kept by a stream of events, the same as run_states() gives for a table of them.

Events wait in the run's state until the watermark has passed their time, then
they are applied in the order of time and tie, so events that come late but
within the watermark land where they belong; later ones are dropped.  The
state of every run that changed goes out with each batch, with the number of
events applied so far.  State lives in the checkpoint, so a stream that is
started again goes on where it stopped.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.runs import FAILED, STAGES

FIELDS = ("status", "stage", "error_stage", "error_message", "success_kind", "attempts", "refused", "applied")
STATE = "status string, stage string, error_stage string, error_message string, success_kind string, attempts long, refused long, applied long"
EVENT = "at long, tie long, stage string, message string"
NEW = ("new", None, None, None, None, 0, 0, 0)

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def applied(state: tuple, stage: str, message: str | None) -> tuple:
    """The state after one more event."""
    status, at, *_, attempts, refused, n = state
    n += 1
    if stage == STAGES[0]:
        return "running", STAGES[0], None, None, None, attempts + 1, refused, n
    if status == "running" and stage == FAILED:
        return "failed", at, at, message, None, attempts, refused, n
    if status == "running" and stage in STAGES:
        here, there = STAGES.index(at), STAGES.index(stage)
        if there == len(STAGES) - 1 and here in (0, there - 1):
            return "success", stage, None, None, "metadata_only" if here == 0 else "full", attempts, refused, n
        if there == here + 1:
            return "running", stage, None, None, None, attempts, refused, n
    return *state[:5], attempts, refused + 1, n



class Runs(StatefulProcessor):
    """Events that wait, and the state of the run."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)
        self.waiting = handle.getListState("waiting", EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            micros = part["at"].astype("datetime64[us]").astype("int64")
            for at, tie, stage, message in zip(micros, part["tie"], part["stage"], part["message"], strict=True):
                self.waiting.appendValue((int(at), int(tie), stage or "", message))
                self.handle.registerTimer(int(at) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(w) for w in self.waiting.get()]
        ready = sorted(w for w in waiting if w[0] <= passed)
        if not ready:
            return
        state = tuple(self.state.get()) if self.state.exists() else NEW
        for _, _, stage, message in ready:
            state = applied(state, stage, message)
        self.state.update(state)
        self.waiting.clear()
        for w in waiting:
            if w[0] > passed:
                self.waiting.appendValue(w)
        yield pd.DataFrame([(key[0], *state)], columns=["run", *FIELDS])

    def close(self) -> None:
        pass


def follow(events: DataFrame, late: str = "1 day") -> DataFrame:
    """A stream of (run, at, tie, stage, message) as a stream of changed states; runs are longs.

    The session needs the state store STORE.
    """
    own = events.where("run is not null and at is not null").select(F.col("run").cast("long"), "at", F.col("tie").cast("long"), "stage", "message").withWatermark("at", late)
    return own.groupBy("run").transformWithStateInPandas(Runs(), f"run long, {STATE}", "Update", "EventTime")


def keep(states: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run what is there now; each batch is a folder of its own, so a batch that runs twice is there once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return states.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(updates: DataFrame) -> DataFrame:
    """Of each run the state after most events."""
    return updates.groupBy("run").agg(F.max_by(F.struct(*FIELDS), "applied").alias("s")).select("run", "s.*")


# Functions travel inside the tasks, so workers need not import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
