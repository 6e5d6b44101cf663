"""State of sessions that ends: by event-time timers or by a time to live, and random numbers that depend on session and step alone.

A session is idle once `idle` seconds have passed since its last row. On the event clock a row after such a gap begins anew whatever the watermark has seen, so results do not depend on how rows
fall into batches; a timer frees the state once the watermark is past the gap. On the processing clock the state store drops the state by itself, `idle` seconds
after it was last written; such a stream is never at its end, so it needs a processing-time trigger. Rows of one session that arrive in one batch are taken in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from trajecta.operators import sampling

CLOCKS = ("event", "processing")


class Session(StatefulProcessor):
    """What is common to processors of sessions. A subclass names the state's `fields` and the `columns` that it puts out besides the key, and gives `fresh` and `step`."""

    fields: str
    columns: tuple[str, ...]

    def __init__(self, idle: float | None = None, clock: str = "event", ts: str = "ts", order: str = "t"):
        if clock not in CLOCKS:
            raise ValueError(f"clock is one of {CLOCKS}")
        if idle is not None and idle <= 0:
            raise ValueError("a session is idle after some time")
        self.idle_ms = None if idle is None else round(idle * 1000)
        self.timed, self.ts, self.order = idle is not None and clock == "event", ts, order
        self.ttl_ms = self.idle_ms if clock == "processing" else None
        self.mode = "None" if idle is None else "EventTime" if self.timed else "ProcessingTime"

    def fresh(self) -> tuple:
        """The state of a new session."""
        raise NotImplementedError

    def step(self, key: tuple, state: tuple, row) -> tuple[tuple, tuple | None]:
        """The state after a row, and what is put out for it."""
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = f"{self.fields}, last long"
        self.state = handle.getValueState("state", schema, self.ttl_ms) if self.ttl_ms else handle.getValueState("state", schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, last = None, None
        held = self.state.get()
        if held is not None:
            *state, last = held
        before, out = last, []
        for row in pd.concat(list(rows)).sort_values([self.ts, self.order] if self.timed else self.order).itertuples():
            now = getattr(row, self.ts).value // 1_000_000 if self.timed else None
            if state is None or self.timed and last is not None and now - last >= self.idle_ms:
                state = self.fresh()
            state, result = self.step(key, tuple(state), row)
            last = now if last is None or now is None else max(last, now)
            if result is not None:
                out.append((key[0], *result))
        self.state.update((*state, last))
        if self.timed:
            # Each call goes to the state store: the old timer is known from the state.
            if before is not None:
                self.handle.deleteTimer(before + self.idle_ms)
            self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def run(rows: DataFrame, key: str, processor: Session, schema: str) -> DataFrame:
    """A stream's rows by session through a processor. On the event clock the stream needs a watermark on the processor's `ts`."""
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", processor.mode)


class Noise(Session):
    """Numbers the steps of a session and gives each `width` numbers in [0, 1), a function of seed, session and step."""

    fields = "steps long"

    def __init__(self, width: int, seed: int, columns: tuple[str, ...], **session):
        super().__init__(**session)
        self.width, self.seed, self.columns = width, seed, columns

    def fresh(self) -> tuple:
        return (0,)

    def step(self, key: tuple, state: tuple, row) -> tuple[tuple, tuple]:
        (steps,) = state
        return (steps + 1,), (getattr(row, self.order), steps, noise_values(key[0], steps, self.width, self.seed))


def noise_values(session: int, step: int, width: int, seed: int) -> list[float]:
    """The numbers of one step. `noise` is the same as a column."""
    first = sampling.scrambled_value(session, seed)
    return [sampling.scrambled_value(first + step * width + k, seed + 1) / sampling.MODULUS for k in range(width)]


def noise(session, step, width: int, seed: int = 0):
    """The numbers of a step as a column, for sessions that are tables: seeded by session and step, in any order and on any task."""
    first = sampling.scrambled(session, seed) + step * width
    return F.array(*(sampling.unit(first + k, seed + 1) for k in range(width)))


def session_noise(rows: DataFrame, session: str, width: int, seed: int = 0, idle: float | None = None, clock: str = "event", ts: str = "ts", order: str = "t") -> DataFrame:
    """session (an integer), the order column, step (from 0, anew after an idle gap) and noise of each row of a stream."""
    kind = rows.schema[order].dataType.simpleString()
    processor = Noise(width, seed, (session, order, "step", "noise"), idle=idle, clock=clock, ts=ts, order=order)
    return run(rows, session, processor, f"`{session}` long, `{order}` {kind}, step long, noise array<double>")


def numbered(rows: DataFrame, session: str, idle: float, ts: str = "ts", order: str = "t") -> DataFrame:
    """The same numbering of a table: rows with step, which begins anew after a gap of `idle` seconds. One shuffle, by session."""
    by = Window.partitionBy(session).orderBy(ts, order)
    gap = F.unix_millis(ts) - F.unix_millis(F.lag(ts).over(by)) >= round(idle * 1000)
    runs = rows.withColumn("_new", F.coalesce(gap, F.lit(False)).cast("int")).withColumn("_run", F.sum("_new").over(by))
    return runs.withColumn("step", F.row_number().over(Window.partitionBy(session, "_run").orderBy(ts, order)).cast("long") - 1).drop("_new", "_run")
