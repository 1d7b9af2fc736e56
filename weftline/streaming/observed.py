"""Side outputs of batches and streams: counts that are taken along, and an audit log that never fails the work."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

COUNTS = "weftline_counts"


def counted(rows: DataFrame, **more: Column) -> DataFrame:
    """rows, whose number (and further aggregates) is observed on the way, without a pass of its own."""
    return rows.observe(COUNTS, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in more.items()])


class BatchCounts(StreamingQueryListener):
    """Hands what counted() observed to on_batch(query name, batch number, counts) after each batch of a stream. A failure
    there is logged and changes nothing."""

    def __init__(self, on_batch: Callable[[str | None, int, dict], None]):
        self.on_batch = on_batch

    def onQueryStarted(self, event) -> None:
        """Nothing to tell."""

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(COUNTS)
        if found is not None:
            try:
                self.on_batch(event.progress.name, event.progress.batchId, found.asDict())
            except Exception:  # what listens is not part of the work
                logging.getLogger(__name__).exception("a listener of batches failed")

    def onQueryIdle(self, event) -> None:
        """Nothing to tell."""

    def onQueryTerminated(self, event) -> None:
        """Nothing to tell."""


def at_best(write: Callable[[DataFrame], None]) -> Callable[[DataFrame], bool]:
    """A sink for what may be lost, such as an audit log: tells whether it wrote, and logs a failure instead of raising it."""

    def attempt(rows: DataFrame) -> bool:
        try:
            write(rows)
            return True
        except Exception:  # any failure of a side output
            logging.getLogger(__name__).exception("a side output failed")
            return False

    return attempt


def answered_and_logged(answer: Callable[[DataFrame, int], None], log: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: answers a batch, and then logs it at best; a batch whose log fails is done all the same."""
    safely = at_best(log)

    def run(batch: DataFrame, number: int) -> None:
        answer(batch, number)
        safely(batch)

    return run
