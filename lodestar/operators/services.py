"""What surrounds queries: metrics, a cache of results, queues and topics on shared folders, retries.

Counters and gauges are observed while a query runs, so they cost no pass of their own.  Queues and topics are folders of Parquet
files: publishing appends, and a subscriber is a stream over the folder, so messages outlive drivers and executors.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lodestar.session import shared_dir


class Metrics:
    """Named numbers: counters add up, gauges keep the last value, observed ones come with a query's run."""

    def __init__(self) -> None:
        self.counters: dict[str, float] = {}
        self.gauges: dict[str, float] = {}
        self._watched: list[tuple[Observation, dict[str, str]]] = []

    def count(self, name: str, by: float = 1) -> float:
        self.counters[name] = self.counters.get(name, 0) + by
        return self.counters[name]

    def gauge(self, name: str, value: float) -> None:
        self.gauges[name] = value

    def watch(self, df: DataFrame, **aggregates: Column) -> DataFrame:
        """df; once it has run, its aggregates are added to the counters of their names."""
        seen = Observation(f"m{uuid.uuid4().hex}")
        self._watched.append((seen, {k: k for k in aggregates}))
        return df.observe(seen, *(a.alias(k) for k, a in aggregates.items()))

    def get(self, name: str) -> float:
        for seen, names in self._watched:
            for k in names:
                self.count(k, seen.get[k] or 0)
        self._watched = []
        return self.counters[name] if name in self.counters else self.gauges[name]


class Cache:
    """Results under names, for a time; kept as tables in the shared folder, so a lost executor costs nothing."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.held = spark, f"{shared_dir(spark)}/lodestar/cache-{uuid.uuid4().hex}", {}

    def set(self, name: str, df: DataFrame, seconds: float | None = None) -> DataFrame:
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.held[name] = (self.spark.read.schema(df.schema).parquet(path), None if seconds is None else time.monotonic() + seconds)
        return self.held[name][0]

    def has(self, name: str) -> bool:
        if name in self.held and (end := self.held[name][1]) is not None and end <= time.monotonic():
            del self.held[name]
        return name in self.held

    def get(self, name: str) -> DataFrame | None:
        return self.held[name][0] if self.has(name) else None

    def delete(self, name: str) -> bool:
        return self.held.pop(name, None) is not None

    def clear(self) -> None:
        self.held = {}

    def keys(self) -> list[str]:
        return sorted(n for n in list(self.held) if self.has(n))


class Topic:
    """A folder that publishers append to; every subscriber reads all of it once, from its own place."""

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark, self.schema = spark, schema
        self.path = f"{shared_dir(spark)}/lodestar/topics/{name}-{uuid.uuid4().hex}"
        spark.createDataFrame([], schema).write.parquet(self.path)

    def publish(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def subscribe(self) -> DataFrame:
        """The messages as a stream."""
        return self.spark.readStream.schema(self.schema).parquet(self.path)

    def size(self) -> int:
        return self.spark.read.schema(self.schema).parquet(self.path).count()


class Queue:
    """First in, first out, by a column that orders the messages; taken ones are told by the last order value taken."""

    def __init__(self, topic: Topic, order: str):
        self.topic, self.order, self.last = topic, order, None

    def _rest(self) -> DataFrame:
        rows = self.topic.spark.read.schema(self.topic.schema).parquet(self.topic.path)
        return rows if self.last is None else rows.where(F.col(self.order) > F.lit(self.last))

    def push(self, rows: DataFrame) -> None:
        self.topic.publish(rows)

    def peek(self, n: int = 1) -> list:
        return self._rest().orderBy(self.order).limit(n).collect()

    def pop(self, n: int = 1) -> list:
        taken = self.peek(n)
        if taken:
            self.last = taken[-1][self.order]
        return taken

    def size(self) -> int:
        return self._rest().count()


def in_parallel(*actions: Callable[[], object], workers: int = 4) -> list:
    """Driver-side actions (each a Spark job, say) at the same time; results in order."""
    with ThreadPoolExecutor(workers) as pool:
        return [f.result() for f in [pool.submit(a) for a in actions]]


def retry(action: Callable[[], object], times: int = 3, wait: float = 0.1) -> object:
    """The first result of at most `times` tries, waiting twice as long after each failure."""
    for turn in range(times):
        try:
            return action()
        except Exception:
            if turn == times - 1:
                raise
            time.sleep(wait * 2**turn)
    raise ValueError("times has to be 1 at least")


def within(action: Callable[[], object], seconds: float) -> object:
    """The result, or a TimeoutError; the action itself goes on until it ends."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(action).result(timeout=seconds)
    finally:
        pool.shutdown(wait=False)
