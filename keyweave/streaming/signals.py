"""Waiting for a stream's progress, and calling back on it."""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


class Signal(StreamingQueryListener):
    """Wakes waiters whenever a query of the session has processed rows or ended; ``name`` restricts
    it to the query of that name. ``on_rows`` is called with the name and the number of rows."""

    def __init__(self, name: str | None = None, on_rows: Callable[[str | None, int], None] | None = None) -> None:
        self._name, self._on_rows = name, on_rows
        self._changed, self._count = threading.Condition(), 0
        self._ids: set[str] = set()

    def attach(self, spark: SparkSession) -> Signal:
        spark.streams.addListener(self)
        return self

    def detach(self, spark: SparkSession) -> None:
        spark.streams.removeListener(self)

    def _send(self) -> None:
        with self._changed:
            self._count += 1
            self._changed.notify_all()

    def wait(self, timeout: float, seen: int = 0) -> bool:
        """Until there were more than ``seen`` signals; False after the timeout."""
        with self._changed:
            return self._changed.wait_for(lambda: self._count > seen, timeout)

    def onQueryStarted(self, event) -> None:
        if self._name in (None, event.name):
            self._ids.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self._name in (None, p.name) and p.numInputRows:
            if self._on_rows is not None:
                self._on_rows(p.name, p.numInputRows)
            self._send()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) in self._ids:
            self._send()


class KeySignal:
    """Waiting for changes of single keys: ``log`` of a table wakes the waiters of the keys it changes."""

    def __init__(self) -> None:
        self._changed, self._counts, self._waiting = threading.Condition(), Counter(), Counter()

    def send(self, key) -> bool:
        """Wake the waiters of a key; whether there were any."""
        with self._changed:
            if not self._waiting[key]:
                return False
            self._counts[key] += 1
            self._changed.notify_all()
            return True

    def wait(self, key, timeout: float) -> bool:
        """Until the key is sent; False after the timeout."""
        with self._changed:
            self._waiting[key] += 1
            seen = self._counts[key]
            try:
                return self._changed.wait_for(lambda: self._counts[key] > seen, timeout)
            finally:
                self._waiting[key] -= 1
                if not self._waiting[key]:
                    del self._waiting[key], self._counts[key]

    def __call__(self, changes: DataFrame) -> None:
        """As the logger of a table: only keys waited for are looked up among the changes."""
        with self._changed:
            asked = [k for k, n in self._waiting.items() if n]
        if asked:
            for row in changes.filter(F.col("key").isin(asked)).select("key").distinct().collect():
                self.send(row["key"])
