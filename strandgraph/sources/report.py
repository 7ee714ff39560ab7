"""Sinks for the measures of runs."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Add a run's rows to a table of JSON lines."""
    metrics.coalesce(1).write.mode("append").json(path)


class Timer:
    """Named spans in seconds."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def span(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def clear(self) -> None:
        self.seconds.clear()
