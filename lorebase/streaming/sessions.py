"""Sessions as a stream: keyed state that outlives batches, with a time to live; and an append-only log.

A turn's effect is that of the batch windows, so that both give the same rows. timed_sessions works by the turns' own
times: turns wait in state until the watermark has passed them and are then folded in order, whatever order they came in;
turns behind the watermark are given out as late and change nothing; a gap beyond the time to live begins a new session.
session_stream works by arrival: turns are put in order within a batch only.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.dialog import SESSION, TTL_SECONDS, Session


def session_stream(turns: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Turns with what dialog.looked_at adds, as a stream; one row for each turn.

    A session without turns for longer than ttl_seconds of processing time is dropped and begins anew.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        session = Session(state.get[0] if state.exists else None)
        out = session.rows(pd.concat(list(batches)).sort_values(["turn", "question"]))
        state.update((session.held(),))
        state.setTimeoutDuration(ttl_seconds * 1000)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in SESSION.split(", ")])

    return turns.groupBy("conv_id").applyInPandasWithState(run, SESSION, "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


TIMED = f"{SESSION}, at long, is_late boolean, is_expired boolean"


class Turns(StatefulProcessor):
    """One session: what was folded up to the watermark, the time of its last turn, and the turns that still wait.

    A timer stands at the first waiting turn, or at the end of the session's time to live where none waits. A turn that
    comes twice while it waits counts once.
    """

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "held string, last long")
        self.waiting = handle.getListState("waiting", "at long, row string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, late, new = timerValues.getCurrentWatermarkInMs(), [], []
        for r in pd.concat(list(rows), ignore_index=True).itertuples(index=False):
            row = {k: list(v) if hasattr(v, "__len__") and not isinstance(v, str) else v.item() if hasattr(v, "item") else v for k, v in r._asdict().items()}
            if r.at < passed:
                late.append((row["conv_id"], row["turn"], row["question"], False, False, False, False, "", "", 0, "", row["at"], True, False))
            else:
                new.append((row["at"], json.dumps(row, ensure_ascii=False, sort_keys=True)))
        held = [tuple(x) for x in self.waiting.get()]
        every = list(dict.fromkeys([*held, *new]))
        if len(every) > len(held):
            self.waiting.put(every)
            self._timer(min(at for at, _ in every))
        yield _frame(late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        state = self.session.get() if self.session.exists() else None
        fold, last, out, left = Session(state[0] if state else None), state[1] if state else None, [], []
        every = [(at, SimpleNamespace(**json.loads(row)), row) for at, row in self.waiting.get()]
        for at, r, row in sorted(every, key=lambda x: (x[0], x[1].turn, x[1].question)):
            if at >= passed:
                left.append((at, row))
                continue
            ended = last is not None and at - last > self.ttl
            if ended:
                fold.clear()
            out.append((*fold.turn(r), at, False, ended))
            last = at
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        if out:
            self.session.update((fold.held(), last))
        if left:
            self._timer(left[0][0])
        elif last is not None and last + self.ttl < passed:
            self.session.clear()
        elif last is not None:
            self._timer(last + self.ttl)
        yield _frame(out)

    def _timer(self, at: int) -> None:
        """The only timer that stands."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in TIMED.split(", ")])


def timed_sessions(turns: DataFrame, ts: str = "ts", late: str = "10 minutes", ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Z1, Z2, Z5 in event time: turns with what dialog.looked_at adds and their time, as a stream; one row for each turn.

    at is the turn's time in milliseconds; is_late: behind the watermark, folded into nothing; is_expired: the first turn
    after a gap beyond the time to live. A turn comes out once the watermark has passed it. Rows without a time, or
    without a session, are passed over.
    """
    timed = turns.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).where(F.col("conv_id").isNotNull() & F.col(ts).isNotNull())
    # As a number the time carries no watermark of its own, so that late turns reach the state and are told apart there.
    rows = timed.withColumn("at", F.unix_millis(ts)).drop(ts)
    return rows.groupBy("conv_id").transformWithStateInPandas(Turns(ttl_seconds * 1000), TIMED, "append", "eventTime")


def split_late(path: str):
    """For foreachBatch: folded turns and late ones into tables of their own; a batch that runs again replaces its rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.where("not is_late").drop("is_late").write.mode("overwrite").parquet(f"{path}/turns/batch={number}")
        batch.where("is_late").select("conv_id", "turn", "resolved", "at").write.mode("overwrite").parquet(f"{path}/late/batch={number}")

    return write


def append_log(stream: DataFrame, path: str, checkpoint: str):
    """Every row once, as JSON lines; the checkpoint makes that hold over restarts."""
    return stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts of events by window and type; rows later than the watermark allows are dropped."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
