"""Stateful operators: a sliding-window limiter and a debounce, in batch and as streams.

A gap as long as the window ends all that a limiter remembers, so a key's events fall into sessions that
are independent of each other. In batch, sessions are sorted within partitions and folded row by row; a
task holds one batch of rows and one session's state, a bounded list of times, whatever a key's size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues


def admitted(times: list[float], at: float, most: int, window_s: float) -> tuple[list[float], bool, int]:
    """The accepted times still in the window, whether an event at a time is accepted, and else how
    many whole seconds to wait. Rejected events do not count."""
    live = [t for t in times if t > at - window_s]
    if len(live) >= most:
        return live, False, int(window_s - (at - live[0])) + 1
    return [*live, at], True, 0


def emitted(last: list[float], at: float, interval_s: float) -> tuple[list[float], bool]:
    """The last emitted time, as a list of at most one, and whether an event at a time is emitted."""
    ok = not last or at - last[0] >= interval_s
    return ([at] if ok else last), ok


RESULT = "event_id long, user_id long, ts timestamp, accepted boolean, wait_s int"
EMITTED = "event_id long, user_id long, ts timestamp, emitted boolean"

#: Folds one event into a state: (state, time) -> state and the values of the result's further columns.
Fold = Callable[[list[float], float], tuple[list[float], tuple]]


def _throttle(most: int, window_s: float) -> Fold:
    def fold(times: list[float], at: float) -> tuple[list[float], tuple]:
        times, ok, wait = admitted(times, at, most, window_s)
        return times, (ok, wait)

    return fold


def _debounce(interval_s: float) -> Fold:
    def fold(last: list[float], at: float) -> tuple[list[float], tuple]:
        last, ok = emitted(last, at, interval_s)
        return last, (ok,)

    return fold


def _seconds(events: DataFrame) -> Column:
    """ts, with or without a time zone, as seconds since 1970."""
    if events.schema["ts"].dataType.typeName() == "timestamp":
        return F.unix_micros("ts") / 1e6
    since = F.col("ts") - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    parts = [F.extract(F.lit(unit), since).cast("double") * size for unit, size in (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1))]
    return parts[0] + parts[1] + parts[2] + parts[3]


def _by_session(events: DataFrame, gap_s: float, fold: Fold, columns: list[str], schema: str) -> DataFrame:
    """Events (event_id, user_id, ts) folded in order of ts and event_id. A gap of gap_s starts a new session."""
    rows = events.select("event_id", "user_id", "ts", _seconds(events).alias("at"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    apart = F.col("at") - F.lag("at").over(order) >= gap_s
    rows = rows.withColumn("starts", F.coalesce(apart, F.lit(True)).cast("long"))
    rows = rows.withColumn("session", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")
    spread = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, []
        for batch in batches:
            made = []
            users = batch["user_id"].astype(object).where(batch["user_id"].notna(), None)
            for key, seconds in zip(zip(users, batch["session"]), batch["at"].tolist()):
                if key != at:
                    at, state = key, []
                state, values = fold(state, seconds)
                made.append(values)
            yield batch[["event_id", "user_id", "ts"]].assign(**{c: [v[i] for v in made] for i, c in enumerate(columns)})

    sorted_rows = rows.repartition(spread, "user_id", "session").sortWithinPartitions("user_id", "session", "ts", "event_id")
    return sorted_rows.mapInPandas(run, schema)


def throttled(events: DataFrame, most: int = 5, window_s: float = 60) -> DataFrame:
    """Each event (event_id, user_id, ts) with whether the limiter accepts it, and else the seconds to wait.
    Null users are one user; every event has a time."""
    return _by_session(events, window_s, _throttle(most, window_s), ["accepted", "wait_s"], RESULT)


def debounced(events: DataFrame, interval_s: float) -> DataFrame:
    """Each event with whether it is emitted: a key's first one, then those at least interval_s after
    the last emitted one."""
    return _by_session(events, interval_s, _debounce(interval_s), ["emitted"], EMITTED)


class _Folding(StatefulProcessor):
    """Folds a key's events and holds its times; a timer drops them once keep_s have passed since its last event, when they
    can't tell anything any more."""

    def __init__(self, fold: Fold, columns: list[str], keep_s: float):
        self.fold, self.columns, self.keep_s = fold, columns, keep_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "at double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.times.get()]
        events = pd.concat(list(rows)).sort_values(["at", "event_id"])
        made = []
        for at in events["at"].tolist():
            held, values = self.fold(held, at)
            made.append(values)
        if held:
            self.times.put([(at,) for at in held])
        else:
            self.times.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(math.ceil((events["at"].iloc[-1] + self.keep_s) * 1000))
        yield events[["event_id", "user_id", "ts"]].assign(**{c: [v[i] for v in made] for i, c in enumerate(self.columns)})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter([])

    def close(self) -> None:
        pass


#: The state store that lists and timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _stream(events: DataFrame, fold: Fold, columns: list[str], schema: str, keep_s: float, delay: str) -> DataFrame:
    """The same on a stream; a key's state lives on between batches until keep_s after its last event. Sets the
    session's state store to PROVIDER."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    picked = events.select("event_id", "user_id", "ts", _seconds(events).alias("at")).withColumn("seen", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")))
    return picked.withWatermark("seen", delay).groupBy("user_id").transformWithStateInPandas(_Folding(fold, columns, keep_s), schema, "Append", "EventTime")


def throttled_stream(events: DataFrame, most: int = 5, window_s: float = 60, delay: str = "10 minutes") -> DataFrame:
    """throttled() on a stream of events in order of time; a batch's events of one key must fit a task. Events that come later than
    delay after the latest one are left out, and a key is forgotten when that is certain to be over for its last window."""
    return _stream(events, _throttle(most, window_s), ["accepted", "wait_s"], RESULT, window_s, delay)


def debounced_stream(events: DataFrame, interval_s: float, delay: str = "10 minutes") -> DataFrame:
    """debounced() on a stream, likewise."""
    return _stream(events, _debounce(interval_s), ["emitted"], EMITTED, interval_s, delay)
