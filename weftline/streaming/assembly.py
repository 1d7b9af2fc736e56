"""Answers put together from a stream of their tokens, which may come late, twice or out of order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from weftline.streaming.limits import PROVIDER

RESULT = "answer_id string, text string, n_tokens int, complete boolean"


class _Assembly(StatefulProcessor):
    """Holds an answer's tokens by their place until all are there, or until wait_s have passed since the latest one."""

    def __init__(self, wait_s: float):
        self.wait_s = wait_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tokens = handle.getMapState("tokens", "seq long", "token string")
        self.end = handle.getValueState("end", "seq long")

    def _made(self, key: tuple, complete: bool) -> pd.DataFrame:
        parts = sorted((k[0], v[0]) for k, v in self.tokens.iterator())
        row = pd.DataFrame({"answer_id": [key[0]], "text": ["".join(t or "" for _, t in parts)], "n_tokens": [len(parts)], "complete": [complete]})
        self.tokens.clear()
        self.end.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        return row

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        latest = 0.0
        for batch in rows:
            for seq, token, last, at in zip(batch["seq"].tolist(), batch["token"].tolist(), batch["last"].tolist(), batch["at"].tolist()):
                if not self.tokens.containsKey((seq,)):
                    self.tokens.updateValue((seq,), (token,))
                if last:
                    self.end.update((seq,))
                latest = max(latest, at)
        n = sum(1 for _ in self.tokens.keys())
        if self.end.exists() and n == self.end.get()[0] + 1:
            yield self._made(key, True)
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(math.ceil((latest + self.wait_s) * 1000))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._made(key, False)

    def close(self) -> None:
        pass


def assembled_stream(tokens: DataFrame, wait_s: float = 60, delay: str = "10 seconds") -> DataFrame:
    """(answer_id, text, n_tokens, complete) from a stream of (answer_id, seq, token, last, ts), seq from 0, last on the last token.

    An answer comes out once: when all of its tokens are there, or as far as it came (complete is false) when its latest token is
    wait_s and delay behind the stream's latest one. A token that comes twice counts once, the first time. A token that comes after its answer has
    come out would begin it anew, and so is a row with complete false in the end.
    """
    tokens.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    picked = tokens.select(F.col("answer_id").cast("string").alias("answer_id"), F.col("seq").cast("long").alias("seq"), "token", F.coalesce("last", F.lit(False)).alias("last"), at.alias("at"), F.col("ts").cast("timestamp").alias("seen"))
    return picked.withWatermark("seen", delay).groupBy("answer_id").transformWithStateInPandas(_Assembly(wait_s), RESULT, "Append", "EventTime")
