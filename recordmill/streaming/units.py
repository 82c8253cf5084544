"""Units of work side by side: a bound on how many run, one flight for each, failures held apart."""

from __future__ import annotations

import threading
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import SparkSession


class Flights:
    """Runs units in threads, each with a scheduler pool and a job group of its own.

    With spark.scheduler.mode FAIR the jobs of one unit wait for no others; with FIFO earlier ones are served first. What a
    unit raises is in its Future and touches no other unit.
    """

    def __init__(self, spark: SparkSession, bound: int = 4):
        if bound < 1:
            raise ValueError("the bound is at least 1")
        self.spark, self.flying, self.lock = spark, {}, threading.Lock()
        self.threads = ThreadPoolExecutor(bound, thread_name_prefix="unit")

    def submit(self, name: str, act: Callable, *args: object) -> tuple[Future, bool]:
        """The unit's flight, and whether it is a new one; a unit that is waiting or running isn't begun again."""
        with self.lock:
            if name in self.flying:
                return self.flying[name], False
            flight = self.flying[name] = self.threads.submit(self._run, name, act, args)
            return flight, True

    def _run(self, name: str, act: Callable, args: tuple) -> object:
        context = self.spark.sparkContext
        context.setLocalProperty("spark.scheduler.pool", name)
        context.setJobGroup(self.group(name), name, interruptOnCancel=True)
        try:
            return act(*args)
        finally:
            for key in ("spark.scheduler.pool", "spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                context.setLocalProperty(key, None)
            with self.lock:
                del self.flying[name]

    def group(self, name: str) -> str:
        return f"unit-{id(self)}-{name}"

    def names(self) -> list[str]:
        """Units that wait or run."""
        with self.lock:
            return sorted(self.flying)

    def stop(self, name: str) -> None:
        """Cancel the jobs of a unit, or its flight if it only waits."""
        with self.lock:
            flight = self.flying.get(name)
            if flight is not None and flight.cancel():
                del self.flying[name]
                return
        if flight is not None:
            self.spark.sparkContext.cancelJobGroup(self.group(name))

    def __enter__(self) -> Flights:
        return self

    def __exit__(self, *error: object) -> None:
        self.threads.shutdown(wait=True)
