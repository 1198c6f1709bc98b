"""How far the running jobs are, from Spark's own status."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from fitloom.functions.scalars import clock


@dataclass(frozen=True)
class Progress:
    """Tasks of all running stages."""

    done: int
    failed: int
    total: int
    seconds: float

    @property
    def left(self) -> float | None:
        """Seconds to go at the pace so far; None before a task has ended."""
        return self.seconds * (self.total - self.done) / self.done if self.done else None

    def __str__(self) -> str:
        to_go = "" if self.left is None else f", {clock(self.left)} to go"
        return f"{self.done} of {self.total} tasks, {self.failed} failed, {clock(self.seconds)}{to_go}"


def progress(spark: SparkSession, began: float) -> Progress:
    status = spark.sparkContext.statusTracker()
    stages = [s for s in map(status.getStageInfo, status.getActiveStageIds()) if s is not None]
    return Progress(sum(s.numCompletedTasks for s in stages), sum(s.numFailedTasks for s in stages), sum(s.numTasks for s in stages), time.time() - began)


class Reporter:
    """``with Reporter(spark, print): ...`` says how far it is every ``seconds``, from a thread that ends with the block."""

    def __init__(self, spark: SparkSession, say: Callable[[str], object], seconds: float = 10.0):
        self.spark, self.say, self.seconds, self.ended = spark, say, seconds, threading.Event()

    def __enter__(self) -> Reporter:
        self.began = time.time()
        self.thread = threading.Thread(target=self.run, daemon=True)
        self.thread.start()
        return self

    def run(self) -> None:
        while not self.ended.wait(self.seconds):
            self.say(str(progress(self.spark, self.began)))

    def __exit__(self, *_: object) -> None:
        self.ended.set()
        self.thread.join()
