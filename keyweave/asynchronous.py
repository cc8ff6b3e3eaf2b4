"""Table operations as futures: tasks of one table run in the order they were given."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from keyweave.table import KVTable


class AsyncTable:
    """Every method of a table, returning a future of its result.

    ``on_done(name, outcome)`` is called after each task with its result or exception. One worker keeps
    the order of changes; more workers only make sense for reading.
    """

    def __init__(self, table: KVTable, workers: int = 1, on_done: Callable[[str, object], None] | None = None) -> None:
        self._table, self._pool, self._on_done = table, ThreadPoolExecutor(workers), on_done

    def submit(self, name: str, *args, **kwargs) -> Future:
        future = self._pool.submit(getattr(self._table, name), *args, **kwargs)
        if self._on_done is not None:
            future.add_done_callback(lambda f: self._on_done(name, f.exception() or f.result()))
        return future

    def __getattr__(self, name: str) -> Callable[..., Future]:
        if name.startswith("_") or not callable(getattr(KVTable, name, None)):
            raise AttributeError(name)
        return lambda *args, **kwargs: self.submit(name, *args, **kwargs)

    def close(self) -> None:
        self._pool.shutdown()

    def __enter__(self) -> AsyncTable:
        return self

    def __exit__(self, *_) -> None:
        self.close()
