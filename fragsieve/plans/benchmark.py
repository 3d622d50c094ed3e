"""Timings, work and recall of searches over data sets: one record for each method and data set."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .matcher import Matcher, Preprocessor

COLUMNS = ["Query Sequence", "Matched Sequence", "Protein ID", "Index start"]
#: Seed lengths that data sets prescribe, and those that a best match of 15 letters goes through (fixed values).
PRESCRIBED = {"coronavirus": 2, "neoepitopes": 3}
DEEPENING = [15, 7, 3, 2]


class Benchmarker:
    """A search as the harness runs it; ``max_mismatches`` of -1 asks for the best match."""

    def __init__(self, spark: SparkSession, benchmark: str, query: str, proteome: str, lengths: list[int], max_mismatches: int, folder: str = "."):
        self.spark, self.query, self.proteome, self.folder = spark, query, proteome, folder
        self.best, self.mismatches = max_mismatches == -1, max(max_mismatches, 0)
        shortest = min(lengths)
        seed = shortest if not self.mismatches else PRESCRIBED.get(benchmark, max(2, shortest // (self.mismatches + 1)))
        self.k = 0 if self.best else seed

    def preprocess_proteome(self) -> None:
        made = Preprocessor(self.spark, self.proteome, preprocessed_files_path=self.folder)
        for k in DEEPENING if self.best else [self.k]:
            made.preprocess(k)

    def preprocess_query(self) -> None:
        raise TypeError("queries are searched as they are")

    def search(self) -> DataFrame:
        found = Matcher(self.spark, self.query, self.proteome, self.mismatches, k=self.k, preprocessed_files_path=self.folder, best_match=self.best, sequence_version=False)
        return found.match().select(*COLUMNS)


def recall(found: DataFrame, expected: DataFrame) -> float:
    """Share of the expected rows that were found, in percent, on distinct rows; missing places count as 0. Without expected rows 100."""
    plain = lambda df: df.select(*COLUMNS[:3], F.coalesce(F.col("Index start").cast("long"), F.lit(0)).alias("Index start")).distinct()
    wanted = plain(expected)
    both = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in COLUMNS]
    n, total = wanted.alias("a").join(plain(found).alias("b"), both, "left_semi").count(), wanted.count()
    return min(100.0, 100.0 * n / total) if total else 100.0


class Work:
    """What Spark's executors did between two moments, from its status store, and the peak of the heap."""

    def __init__(self, spark: SparkSession):
        self.context = spark.sparkContext
        self._pools = [p for p in self.context._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans() if p.getType().toString() == "Heap memory"]
        for p in self._pools:
            p.resetPeakUsage()
        self._before = self._sums()

    def _sums(self) -> dict[str, float]:
        store = self.context._jsc.sc()
        store.listenerBus().waitUntilEmpty(10_000)
        every = store.statusStore().executorList(False)
        rows = [every.apply(i) for i in range(every.size())]
        return {"task_s": sum(e.totalDuration() for e in rows) / 1000, "gc_s": sum(e.totalGCTime() for e in rows) / 1000, "input_mb": sum(e.totalInputBytes() for e in rows) / 1e6, "shuffle_mb": sum(e.totalShuffleWrite() for e in rows) / 1e6}

    def done(self) -> dict[str, float]:
        after = self._sums()
        every = self.context._jsc.sc().statusStore().executorList(False)
        peaks = [e.peakMemoryMetrics().get().getMetricValue("JVMHeapMemory") for e in (every.apply(i) for i in range(every.size())) if e.peakMemoryMetrics().isDefined()]
        driver = sum(p.getPeakUsage().getUsed() for p in self._pools)
        return {k: round(v - self._before[k], 3) for k, v in after.items()} | {"driver_heap_mb": round(driver / 1e6, 1), "executor_heap_mb": round(max(peaks, default=0) / 1e6, 1)}


def measured(spark: SparkSession, step: Callable[[], Any]) -> tuple[dict[str, float] | None, Any]:
    """Seconds and work of a step, and what it gives; a step that a method hasn't (``TypeError``) has no figures."""
    work, began = Work(spark), time.perf_counter()
    try:
        result = step()
    except TypeError:
        return None, None
    return {"seconds": round(time.perf_counter() - began, 3)} | work.done(), result


def run(spark: SparkSession, method: Benchmarker, expected: DataFrame) -> dict[str, Any]:
    """The three steps of a method, its rows and its recall."""
    found: dict[str, Any] = {}
    for name, step in (("preprocess_proteome", method.preprocess_proteome), ("preprocess_query", method.preprocess_query)):
        found[name], _ = measured(spark, step)

    def search() -> DataFrame:
        rows = method.search().persist()
        rows.count()
        return rows

    found["search"], rows = measured(spark, search)
    return found | {"k": method.k, "rows": rows.count(), "recall": recall(rows, expected), "total_s": round(sum(x["seconds"] for x in found.values() if x), 3)}
