"""Where a query's time goes: named spans on the driver, added up."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Profiler:
    """Spans may nest and repeat; each name has its number of runs and its seconds."""

    def __init__(self):
        self.seconds: dict[str, float] = defaultdict(float)
        self.runs: dict[str, int] = defaultdict(int)

    @contextmanager
    def span(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] += time.perf_counter() - began
            self.runs[name] += 1

    def reset(self) -> None:
        self.seconds.clear()
        self.runs.clear()

    def table(self, spark: SparkSession) -> DataFrame:
        """(name, runs, seconds), the slowest first."""
        rows = sorted(((n, self.runs[n], s) for n, s in self.seconds.items()), key=lambda r: (-r[2], r[0]))
        return spark.createDataFrame(rows, "name string, runs int, seconds double")
