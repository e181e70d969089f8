"""The retry ledger and the delay of forms as stateful streams.

State is kept by Spark per answer and per form, in the query's checkpoint, so a restart goes on where the last
trigger ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..params import DEFAULTS


def retry_ledger_stream(attempts: DataFrame, max_attempts: int = DEFAULTS.max_attempts, ttl_days: int | None = None) -> DataFrame:
    """A row for each answer that a trigger's attempts touch: ``answer_id, failures, action, attempts``.

    The stream form of :func:`.ingest.retry_ledger`: the row with the most ``attempts`` of an answer is its present
    state (see :func:`latest`). ``attempts`` has answer_id, at, outcome; attempts may come late or out of order: the state holds
    the times of the failures after the last success. Rows with a null id, time or outcome are left out. With ``ttl_days`` the
    state of an answer is dropped when nothing was heard of it for so long (processing time); an answer heard of again
    then starts anew.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        ok, at, seen, failed = state.get if state.exists else (None, None, 0, [])
        failed = list(failed)
        for batch in batches:
            good, bad = (batch.loc[batch["outcome"] == o, "at"].tolist() for o in ("ok", "failed"))
            failed += bad
            ok = max([x for x in (ok, *good) if x is not None], default=None)
            at = max([x for x in (at, *batch["at"].tolist()) if x is not None])
            seen += len(batch)
        if ok is not None:
            failed = [x for x in failed if x > ok]
        state.update((None if ok is None else int(ok), int(at), int(seen), [int(x) for x in failed]))
        if ttl_days is not None:
            state.setTimeoutDuration(ttl_days * 86_400_000)
        action = "keep_whole" if len(failed) >= max_attempts else "done" if ok == at else "retry"
        yield pd.DataFrame({"answer_id": [key[0]], "failures": [len(failed)], "action": [action], "attempts": [seen]})

    rows = attempts.where("answer_id is not null and at is not null and outcome is not null").select(F.col("answer_id").cast("long").alias("answer_id"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "outcome")
    timeout = GroupStateTimeout.NoTimeout if ttl_days is None else GroupStateTimeout.ProcessingTimeTimeout
    return rows.groupBy("answer_id").applyInPandasWithState(step, "answer_id long, failures long, action string, attempts long", "ok long, at long, seen long, failed array<long>", "update", timeout)


def latest(updates: DataFrame) -> DataFrame:
    """The present ledger from all rows that the stream has written."""
    place = F.row_number().over(Window.partitionBy("answer_id").orderBy(F.desc("attempts")))
    return updates.withColumn("__p", place).where("__p = 1").select("answer_id", "failures", "action")


def due_retries_stream(passes: DataFrame, first: int = 30, longest: int = 1200, late: str = "10 minutes") -> DataFrame:
    """``form_id, failures, due``: a form whose last passes failed, once its delay (30 s doubled a failure, 1200 s at most) is over.

    ``passes`` has form_id, at, outcome, one row a pass; a form that succeeds, or fails again, before its time is not emitted
    for it. Times are event times: a timer fires when the watermark, ``late`` behind the newest pass, goes by. Passes older than the
    form's newest one are ignored.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, last, due = state.get if state.exists else (0, None, None)
        if state.hasTimedOut:
            state.update((failures, last, None))
            yield pd.DataFrame({"form_id": [key[0]], "failures": [failures], "due": [pd.Timestamp(due, unit="ms")]})
            return
        events = pd.concat(list(batches)).sort_values("at", kind="stable")
        for at, outcome in zip(events["at"].tolist(), events["outcome"].tolist(), strict=True):
            at = int(at.timestamp() * 1000)
            if last is None or at >= last:  # else the form has moved on
                failures, last = (0 if outcome == "ok" else failures + 1), at
        due = max(last + 1000 * min(first * 2 ** min(failures, 30), longest), state.getCurrentWatermarkMs() + 1) if failures else None
        state.update((failures, last, due))
        if due is not None:
            state.setTimeoutTimestamp(due)

    rows = passes.where("form_id is not null and at is not null").select(F.col("form_id").cast("long").alias("form_id"), F.col("at").cast("timestamp").alias("at"), "outcome").withWatermark("at", late)
    return rows.groupBy("form_id").applyInPandasWithState(step, "form_id long, failures long, due timestamp", "failures long, last long, due long", "append", GroupStateTimeout.EventTimeTimeout)
