"""The state of ingestion runs from their events, by composing what stretches of events do.

A run goes acquire, store, parse, chunk, done; each event moves it one stage
on.  done after acquire alone is a success with metadata only.  failed keeps
the stage that the run was in and the message.  acquire starts a new attempt
whatever came before; any other event that doesn't fit is refused and counted.

What a stretch of events does depends on little: whether the run is new, at
one of the four stages, or over.  So every run's events of a day become one
row that says, for each of these ways in, how the run comes out, and the rows
of a run's days are composed in order.  A run with a great many events meets
in one task as a row a day only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

STAGES = ("acquire", "store", "parse", "chunk", "done")
FAILED = "failed"

#: Ways into a stretch: new, at each stage but the last, over.
WAYS_IN = ("new", *STAGES[:-1], "over")


def _state(status: Column, stage: Column, error_stage: Column, message: Column, kind: Column, attempts: Column, refused: Column) -> Column:
    none = lambda c: F.lit(None).cast("string") if c is None else c
    return F.struct(status.alias("status"), stage.cast("int").alias("stage"), none(error_stage).alias("error_stage"), none(message).alias("error_message"), none(kind).alias("success_kind"), attempts.alias("attempts"), refused.alias("refused"))


def stage_name(stage: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(s) for s in STAGES]), stage + 1)


def moved(s: Column, stage: Column, message: Column) -> Column:
    """State s after one event."""
    number = F.array_position(F.array(*[F.lit(x) for x in STAGES]), stage) - 1
    running, last = s["status"] == "running", len(STAGES) - 1
    start = _state(F.lit("running"), F.lit(0), None, None, None, s["attempts"] + 1, s["refused"])
    failed = _state(F.lit("failed"), s["stage"], stage_name(s["stage"]), message, None, s["attempts"], s["refused"])
    done = _state(F.lit("success"), F.lit(last), None, None, F.when(s["stage"] == 0, "metadata_only").otherwise("full"), s["attempts"], s["refused"])
    on = _state(F.lit("running"), number, None, None, None, s["attempts"], s["refused"])
    refused = s.withField("refused", s["refused"] + 1)
    fits = running & ((number == s["stage"] + 1) | ((number == last) & (s["stage"] == 0)))
    return F.when(stage == STAGES[0], start).when(running & (stage == FAILED), failed).when(fits & (number == last), done).when(fits, on).otherwise(refused)


def _ways_in() -> Column:
    zero = F.lit(0).cast("long")
    stage = lambda i: F.lit(i - 1) if 0 < i < len(WAYS_IN) - 1 else F.lit(None)
    status = lambda i: F.lit("new" if i == 0 else "over" if i == len(WAYS_IN) - 1 else "running")
    return F.array(*[_state(status(i), stage(i), None, None, None, zero, zero) for i in range(len(WAYS_IN))])


def days(events: DataFrame, run: str, at: str, tie: str, stage: str, message: str) -> DataFrame:
    """(run, day, ways): what each day's events of a run do to it, for every way in."""
    rows = events.where(F.col(run).isNotNull() & F.col(at).isNotNull()).select(F.col(run).alias("run"), F.to_date(at).alias("day"), F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.coalesce(F.col(stage), F.lit("")).alias("stage"), F.col(message).alias("message")).alias("e"))
    lists = rows.groupBy("run", "day").agg(F.sort_array(F.collect_list("e")).alias("events"))
    step = lambda ways, e: F.transform(ways, lambda s: moved(s, e["stage"], e["message"]))
    return lists.select("run", "day", F.aggregate("events", _ways_in(), step).alias("ways"))


def composed(before: Column, ways: Column) -> Column:
    """The state after a day, given the one before it."""
    way = F.when(before["status"] == "new", 0).when(before["status"] == "running", before["stage"] + 1).otherwise(len(WAYS_IN) - 1)

    def after(s: Column) -> Column:
        counted = lambda x: x.withField("attempts", before["attempts"] + s["attempts"]).withField("refused", before["refused"] + s["refused"])
        # A run that was over, and is still, is as it was.
        return F.when(s["status"] == "over", counted(before)).otherwise(counted(s))

    return let(F.get(ways, way), after)


def run_states(events: DataFrame, run: str = "run", at: str = "at", tie: str = "event_id", stage: str = "stage", message: str = "message") -> DataFrame:
    """(run, status, stage, error_stage, error_message, success_kind, attempts, refused) of each run.

    Events without a run or a time are left out; equal times are ordered by tie.
    """
    zero = F.lit(0).cast("long")
    new = _state(F.lit("new"), F.lit(None), None, None, None, zero, zero)
    own = days(events, run, at, tie, stage, message).groupBy("run").agg(F.sort_array(F.collect_list(F.struct("day", "ways"))).alias("days"))
    state = own.select("run", F.aggregate("days", new, lambda s, d: composed(s, d["ways"])).alias("s")).select("run", "s.*")
    return state.withColumn("stage", stage_name(F.col("stage")))
