"""Streams whose results are due at a time: batches of a node that close a while after they open, and refreshes of what is known.

Both keep a few numbers a key and event-time timers. Results come when the watermark has passed their time, so the same events give the
same results in whatever micro-batches they arrive, as long as they arrive in order or within ``late``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import BATCH

#: Between refreshes without a signal; from a signal to the refresh it causes.
TICK, SETTLE = "30 seconds", "2 seconds"


def _micros(span: str) -> int:
    return int(pd.Timedelta(span) / pd.Timedelta("1us"))


def _at(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


class _Due(StatefulProcessor):
    """Keeps events (in microseconds) until the watermark has passed them, and works them off in order.

    ``step`` gets what is held, the events that are new and the time up to which all are known; it gives the results due, what is held then, and when
    something is due without a further event.
    """

    def __init__(self, held: str, start: tuple, names: list[str]):
        self.held, self.start, self.names = held, start, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "times array<long>")
        self.state = handle.getValueState("held", self.held)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = list(self.waiting.get()[0]) if self.waiting.exists() else []
        for part in rows:
            waiting += (part["ts"].astype("datetime64[us]").astype("int64")).tolist()
        yield from self.settle(key, sorted(waiting), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = list(self.waiting.get()[0]) if self.waiting.exists() else []
        yield from self.settle(key, sorted(waiting), timerValues)

    def settle(self, key, waiting: list[int], timerValues) -> Iterator[pd.DataFrame]:
        known = timerValues.getCurrentWatermarkInMs() * 1000
        ripe = [t for t in waiting if t < known]
        waiting = waiting[len(ripe) :]
        state = self.state.get() if self.state.exists() else self.start
        out, state, due = self.step(key, tuple(state), ripe, known)
        self.state.update(state)
        self.waiting.update((waiting,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        soonest = min([*waiting[:1], *([due] if due is not None else [])], default=None)
        if soonest is not None:
            self.handle.registerTimer(max(soonest // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


class Batches(_Due):
    """(key, opened, n): a batch opens with an event and is flushed ``width`` later."""

    def __init__(self, by: str, width: str):
        super().__init__("opened long, n long", (-1, 0), [by, "opened", "n"])
        self.width = _micros(width)

    def step(self, key, state, ripe, known):
        (opened, n), out = state, []
        for t in ripe:
            if n and t >= opened + self.width:
                out.append((key[0], _at(opened), n))
                n = 0
            opened, n = (t, 1) if not n else (opened, n + 1)
        if n and opened + self.width <= known:
            out.append((key[0], _at(opened), n))
            n = 0
        return out, (opened, n), opened + self.width if n else None


class Refreshes(_Due):
    """(key, refreshed, cause): ``settle`` after a signal, which swallows signals meanwhile, and every ``tick`` since the first event.

    A tick that falls due between a signal and its refresh waits for that refresh and follows it.
    """

    def __init__(self, by: str, tick: str, settle: str):
        super().__init__("tick long, busy long", (-1, -1), [by, "refreshed", "cause"])
        self.tick, self.wait = _micros(tick), _micros(settle)

    def step(self, key, state, ripe, known):
        (tick, busy), out = state, []

        def ticks(until: int) -> None:
            nonlocal tick
            while 0 <= tick <= until:
                out.append((key[0], _at(tick), "tick"))
                tick += self.tick

        for t in ripe:
            tick = t + self.tick if tick < 0 else tick
            ticks(t)
            if t < busy:
                continue
            busy = t + self.wait
            out.append((key[0], _at(busy), "signal"))
            if tick < busy:
                out.append((key[0], _at(busy), "tick"))
                tick += -(-(busy - tick) // self.tick) * self.tick
        ticks(known - 1)
        return out, (tick, busy), tick if tick >= 0 else None


def flushed(events: DataFrame, by: str, width: str = BATCH, late: str = "0 seconds") -> DataFrame:
    """The stream form of ``events.micro_batches``: (by, opened, n) of (by, ts), each batch once its time has passed."""
    kind = dict(events.dtypes)[by]
    own = events.select(by, "ts").withWatermark("ts", late)
    return own.groupBy(by).transformWithStateInPandas(Batches(by, width), f"{by} {kind}, opened timestamp, n long", "Append", "EventTime")


def refreshes(events: DataFrame, by: str, tick: str = TICK, settle: str = SETTLE, late: str = "0 seconds") -> DataFrame:
    """(by, refreshed, cause): when what is known of each key is refreshed, by signals (by, ts) and by the clock.

    On a stream, ticks come as the watermark passes them; of a table, up to the last signal of a key. A key's signals pass one task in order,
    which holds two numbers.
    """
    kind = dict(events.dtypes)[by]
    machine, schema = Refreshes(by, tick, settle), f"{by} {kind}, refreshed timestamp, cause string"
    if events.isStreaming:
        return events.select(by, "ts").withWatermark("ts", late).groupBy(by).transformWithStateInPandas(machine, schema, "Append", "EventTime")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, machine.start
        for part in parts:
            out = []
            for name, t in zip(part[by], part["ts"].astype("datetime64[us]").astype("int64").tolist()):
                if name != key:
                    key, state = name, machine.start
                made, state, _ = machine.step((name,), state, [t], t)
                out += made
            yield pd.DataFrame(out, columns=machine.names)

    return events.select(by, "ts").where(F.col(by).isNotNull() & F.col("ts").isNotNull()).repartition(by).sortWithinPartitions(by, "ts").mapInPandas(fold, schema)
