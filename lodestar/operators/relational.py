"""Set operations, ordering, and recursion over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import checkpoints


def set_operation(left: DataFrame, right: DataFrame, kind: str, all_rows: bool = False) -> DataFrame:
    """UNION, INTERSECT or EXCEPT by position; names from the left side.  NULLs compare equal."""
    if len(left.columns) != len(right.columns):
        raise ValueError(f"{kind} needs as many columns on both sides: {len(left.columns)} and {len(right.columns)}")
    right = right.toDF(*left.columns)
    if kind.upper() == "UNION":
        return left.union(right) if all_rows else left.union(right).distinct()
    if kind.upper() == "INTERSECT":
        return left.intersectAll(right) if all_rows else left.intersect(right)
    if kind.upper() == "EXCEPT":
        return left.exceptAll(right) if all_rows else left.subtract(right)
    raise ValueError(kind)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int, rank: str = "rn") -> DataFrame:
    """The first n rows of each group; Spark limits each group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """LIMIT n OFFSET m of an ordered relation (a bounded top-k, not a full sort)."""
    return df.orderBy(*order).offset(offset).limit(limit) if offset else df.orderBy(*order).limit(limit)


def natural_order(column: str):
    """Sort keys that compare runs of digits as numbers."""
    return F.regexp_replace(F.regexp_replace(column, r"(\d+)", "00000000000000000000$1"), r"0*(\d{20})(?!\d)", "$1")


def fixpoint(base: DataFrame, step: Callable[[DataFrame], DataFrame], distinct: bool = True, most: int = 10_000) -> DataFrame:
    """WITH RECURSIVE by iteration: step(new rows) until none is new.  `distinct` gives UNION, which also ends cycles.

    Each round is checkpointed, so plans stay short and lost executors re-read files.
    """
    checkpoints(base.sparkSession)
    new = (base.distinct() if distinct else base).checkpoint()
    seen = new
    for _ in range(most):
        found = step(new).toDF(*base.columns)
        new = (found.distinct().join(seen, base.columns, "left_anti") if distinct else found).checkpoint()
        if new.isEmpty():
            return seen
        seen = seen.union(new)
    raise RuntimeError(f"recursion did not end in {most} rounds")


def percentiles(df: DataFrame, by: list[str], value: str, **wanted: float) -> DataFrame:
    """Exact interpolated percentiles, name=p, of each group; nulls don't count.

    A percentile aggregate gathers all distinct values of a group in one task.  Here equal values are counted, a thousand even
    bins between a group's extremes say in which bin a rank lies, and ranks are counted on within bins; so a task sorts a bin.
    """
    rows = df.select(F.struct(*by).alias("pc_key"), F.col(value).cast("double").alias("pc_v"))  # equal nulls are one group
    groups = rows.groupBy("pc_key").agg(F.count("pc_v").alias("pc_total"), F.min("pc_v").alias("pc_low"), (F.max("pc_v") - F.min("pc_v")).alias("pc_width"))
    counts = rows.where("pc_v IS NOT NULL").groupBy("pc_key", "pc_v").agg(F.count("*").alias("pc_n")).join(groups, "pc_key")
    even = (F.col("pc_width") > 0) & (F.col("pc_width") < float("inf"))  # other groups are one bin
    binned = counts.withColumn("pc_bin", F.when(even, F.floor((F.col("pc_v") - F.col("pc_low")) / F.col("pc_width") * 1000)).otherwise(F.lit(0).cast("bigint")))
    before = Window.partitionBy("pc_key").orderBy("pc_bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = binned.groupBy("pc_key", "pc_bin").agg(F.sum("pc_n").alias("pc_n")).select("pc_key", "pc_bin", F.coalesce(F.sum("pc_n").over(before), F.lit(0)).alias("pc_start"))
    within = Window.partitionBy("pc_key", "pc_bin").orderBy("pc_v").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("pc_start") + F.sum("pc_n").over(within)
    placed = binned.join(starts, ["pc_key", "pc_bin"]).withColumn("pc_end", end)
    at = lambda rank: F.max(F.when((rank < F.col("pc_end")) & (rank >= F.col("pc_end") - F.col("pc_n")), F.col("pc_v")))
    place = {name: (F.col("pc_total") - 1) * F.lit(p) for name, p in wanted.items()}
    found = placed.groupBy("pc_key").agg(*(at(f(x)).alias(f"{name}_{side}") for name, x in place.items() for side, f in (("lo", F.floor), ("hi", F.ceil))))

    def between(name: str) -> Column:
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        return F.when(low == high, low).otherwise(low + (high - low) * (place[name] - F.floor(place[name]))).alias(name)

    return groups.join(found, "pc_key", "left").select(*(F.col(f"pc_key.{c}").alias(c) for c in by), *map(between, wanted))
