"""Results delivered in batches, with status, cancellation and expiry."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession

from .windows import batches


@dataclass
class Delivery:
    df: DataFrame
    tag: str
    began: float
    status: str = "waiting"
    rows: int = 0
    batches: int = 0


class Deliveries:
    """Results under way, by id. One that runs longer than `most_seconds` expires.

    States: waiting, running, completed, cancelled, failed, expired. A cancelled or expired delivery ends at its next batch
    at the latest, and the jobs that run for it are stopped.
    """

    def __init__(self, spark: SparkSession, size: int = 100, most_seconds: float = 300, clock: Callable[[], float] = time.monotonic):
        self.context, self.size, self.most, self.clock = spark.sparkContext, size, most_seconds, clock
        self.held: dict[str, Delivery] = {}
        self.lock = threading.Lock()

    def add(self, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        with self.lock:
            self.held[name] = Delivery(df, f"delivery-{name}", self.clock())
        return name

    def _end(self, d: Delivery, status: str) -> bool:
        with self.lock:
            if d.status not in ("waiting", "running"):
                return False
            d.status = status
        if status in ("cancelled", "expired"):
            self.context.cancelJobsWithTag(d.tag)
        return True

    def fetch(self, name: str) -> Iterator[list[Row]]:
        """The rows in lists of `size`; ends early without an error if the delivery is cancelled or expires."""
        d = self.held[name]
        with self.lock:
            if d.status != "waiting":
                return
            d.status = "running"
        rows = batches(d.df, self.size)
        while True:
            self.context.addJobTag(d.tag)
            try:
                batch = next(rows, None)
            except Exception:
                if self._end(d, "failed"):
                    raise
                return
            finally:
                self.context.removeJobTag(d.tag)
            if self.clock() - d.began > self.most:
                self._end(d, "expired")
            if d.status != "running":
                return
            if batch is None:
                self._end(d, "completed")
                return
            d.rows, d.batches = d.rows + len(batch), d.batches + 1
            yield batch

    def cancel(self, name: str) -> bool:
        """Whether there was something left to cancel."""
        return self._end(self.held[name], "cancelled")

    def status(self, name: str) -> dict:
        d = self.held[name]
        return {"status": d.status, "rows": d.rows, "batches": d.batches, "seconds": self.clock() - d.began}

    def expire(self) -> int:
        """End what runs too long and forget what has ended; the number of those that expired."""
        late = [d for d in list(self.held.values()) if self.clock() - d.began > self.most and self._end(d, "expired")]
        with self.lock:
            self.held = {k: d for k, d in self.held.items() if d.status in ("waiting", "running")}
        return len(late)
