"""Scenario by strategy by run: load a graph, measure, record."""

from __future__ import annotations

import os
import threading
import time
from typing import TYPE_CHECKING

from pyspark.sql import functions as F

from arcweave import schema
from arcweave.operators import coloring, schedule
from arcweave.session import materialize

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

    from arcweave.operators.graph import GraphStore
    from arcweave.plans.config import Strategy


class CoreMonitor:
    """Mean number of busy cores of the driver's machine between ``start`` and ``stop``; ``stop`` before ``start`` gives 0."""

    def __init__(self, every: float = 0.5):
        self.every, self.samples = every, []
        self._end, self._thread = threading.Event(), None

    def start(self) -> CoreMonitor:
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()
        return self

    def _run(self) -> None:
        try:
            import psutil
        except ImportError:
            return
        psutil.cpu_percent(percpu=True)
        while not self._end.wait(self.every):
            self.samples.append(sum(psutil.cpu_percent(percpu=True)) / 100)

    def stop(self) -> float:
        self._end.set()
        if self._thread:
            self._thread.join()
        return sum(self.samples) / len(self.samples) if self.samples else 0.0


def rates(rows: int, failed: int, total: float, overhead: float = 0.0) -> tuple[float, float]:
    """Rows a second without the overhead, and percent of rows that were loaded; 0 for no time or no rows."""
    work = total - overhead
    return (rows / work if work > 0 else 0.0), (100.0 * (rows - failed) / rows if rows else 0.0)


def plan(strategy: Strategy, edges: DataFrame) -> DataFrame:
    """The strategy's schedule of the edges; color batches are colored first."""
    source = coloring.color_edges(edges) if strategy.kind == "color_batch" else edges
    return schedule.STRATEGIES[strategy.kind](source, strategy.batch_size, **strategy.options)


MOST_LOADS = 8   # merges of one run; waves beyond that are loaded several at once, in order


def execute(store: GraphStore, planned: DataFrame, strategy: Strategy, clock: int) -> tuple[int, float]:
    """Load a schedule wave by wave; (rows that failed, seconds of failed attempts).

    The lanes, steps and batches of a wave are the tasks and rows of one merge, whose
    single writer a key replaces locks. A merge that fails is tried ``max_retries``
    times more; then its rows count as failed and the next wave goes on.
    """
    last = planned.agg(F.max("wave")).first()[0]
    if last is None:
        return 0, 0.0
    loads = min(MOST_LOADS, last + 1)
    failed, waited = 0, 0.0
    for k in range(loads):
        lo, hi = (last + 1) * k // loads, (last + 1) * (k + 1) // loads
        part = planned.where(F.col("wave").between(lo, hi - 1)).select("edge_id", "src", "dst")
        for attempt in range(strategy.max_retries + 1):
            begin = time.monotonic()
            try:
                store.merge(part, clock)
                break
            except Exception:  # noqa: BLE001  a wave that fails must not stop the run
                waited += time.monotonic() - begin
                if attempt == strategy.max_retries:
                    failed += part.count()
    return failed, waited


def run_once(store: GraphStore, strategy: Strategy, scenario: str, edges: DataFrame, run: int, clock: int) -> tuple:
    """Reset the store, schedule and load the edges, and return one metrics record.

    ``conflicts`` counts the (entity, wave) pairs that a lock-based store would contend
    for; the waiting time is that of failed attempts.
    """
    store.reset()
    monitor, begin = CoreMonitor().start(), time.monotonic()
    planned = materialize(plan(strategy, edges))
    rows, conflicts = planned.count(), schedule.contention(planned).count()
    prepared = time.monotonic()
    failed, waited = execute(store, planned, strategy, clock)
    end = time.monotonic()
    cores = monitor.stop()
    overhead = prepared - begin if strategy.kind in ("mix_and_batch", "color_batch") else 0.0
    throughput, success = rates(rows, failed, end - begin, overhead)
    return (
        strategy.name, scenario, run, strategy.thread_count, strategy.batch_size, end - begin, throughput, success,
        overhead, conflicts, cores, end - prepared, waited,
    )


def evaluate(store: GraphStore, scenarios: dict[str, DataFrame], strategies: tuple[Strategy, ...], runs: int = 3) -> DataFrame:
    """Metrics of every scenario, strategy and run; strategies see the same immutable edges."""
    out = []
    for name, edges in scenarios.items():
        for strategy in strategies:
            out += [run_once(store, strategy, name, edges, k + 1, int(time.time() * 1000)) for k in range(runs)]
    return store.spark.createDataFrame(out, schema.METRICS)


def save(metrics: DataFrame, folder: str) -> str:
    """Write the records as JSON lines under a name with the time; returns the path."""
    path = os.path.join(folder, "raw_results_" + time.strftime("%Y%m%d_%H%M%S"))
    metrics.coalesce(1).write.json(path)
    return path


def summary(metrics: DataFrame) -> DataFrame:
    """Means over the runs of each scenario and strategy."""
    means = [F.avg(c).alias(c) for c in ("total_time", "throughput", "success_rate", "processing_overhead", "system_cores_avg")]
    return metrics.groupBy("scenario", "algorithm_name").agg(F.count(F.lit(1)).alias("runs"), F.sum("conflicts").alias("conflicts"), *means)
