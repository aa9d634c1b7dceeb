"""Event-time operators, the same for batch and streaming DataFrames, and stateful ones."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import shared_dir


def with_event_time(df: DataFrame, time: str, late: str | None = None) -> DataFrame:
    """Event time as a timestamp; on a stream with a watermark, after which late rows are dropped."""
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, late) if late and df.isStreaming else df


def windowed(df: DataFrame, time: str, width: str, slide: str | None, keys: list[str], *aggregates: Column) -> DataFrame:
    """Tumbling (no slide) or sliding windows: window_start, window_end, keys, aggregates."""
    grouped = df.groupBy(F.window(time, width, slide) if slide else F.window(time, width), *keys).agg(*aggregates)
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in grouped.columns if c != "window"])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], *aggregates: Column) -> DataFrame:
    grouped = df.groupBy(F.session_window(time, gap).alias("window"), *keys).agg(*aggregates)
    return grouped.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in grouped.columns if c != "window"])


def deduplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def rate_limited(df: DataFrame, time: str, key: str, width: str, most: int) -> DataFrame:
    """Fixed-window rate limiting: the count of each key and window, and whether it is over the limit."""
    return windowed(df, time, width, None, [key], F.count("*").alias("n")).withColumn("over", F.col("n") > most)


def token_bucket(df: DataFrame, key: str, time: str, order: str, capacity: float, per_second: float) -> DataFrame:
    """Token buckets per key over time: key, order, allowed.  Works on a stream, with the level and last time as state; in a
    batch, rows stream past sorted by key and time, so a task holds one Arrow batch, however long a key's history."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, allowed boolean"

    def spend(level: float, last: float | None, rows: pd.DataFrame) -> tuple[float, float | None, list[bool]]:
        out = []
        for at in rows[time].astype("int64") / 1e9 if rows[time].dtype.kind != "M" else rows[time].astype("datetime64[ns]").astype("int64") / 1e9:
            level = capacity if last is None else min(capacity, level + max(0.0, at - last) * per_second)
            last = at
            out.append(level >= 1)
            level -= level >= 1
        return level, last, out

    if not df.isStreaming:

        def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            now, level, last = object(), capacity, None
            for rows in frames:
                allowed: list[bool] = []
                for k, part in rows.groupby(key, sort=False, dropna=False):
                    if k != now:
                        now, level, last = k, capacity, None
                    level, last, own = spend(level, last, part)
                    allowed += own
                yield rows[[key, order]].assign(allowed=allowed)

        return df.select(key, order, time).repartition(key).sortWithinPartitions(key, time, order).mapInPandas(batch, schema)

    def stream(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(frames)).sort_values([time, order])
        level, last, allowed = spend(level, last, rows)
        state.update((level, last))
        yield rows[[key, order]].assign(allowed=allowed)

    return df.select(key, order, time).groupBy(key).applyInPandasWithState(stream, schema, "level double, last double", "append", "NoTimeout")


def run_available(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there and return its result: written by foreachBatch, so also on clusters."""
    spark: SparkSession = stream.sparkSession
    base = checkpoint or shared_dir(spark)
    path = f"{base}/streams/{uuid.uuid4().hex}"

    def keep(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/out/epoch={epoch}" if mode != "complete" else f"{path}/out/epoch=0")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out/*")


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files (or one file) as a stream."""
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else reader.parquet(path)
