"""Sessions and table access."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name no shared one (tests).
_LOCAL: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def create(app: str = "lodestar", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on: UTC, adaptive execution, Arrow transfer.

    Sizes (shuffle partitions, split bytes, memory) are the cluster's to set; adaptive execution coalesces and splits.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one in the warehouse.  Only a session whose
    tasks run in the driver's own process may fall back to a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if context.master.split("[")[0] == "local":
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="lodestar-")
        return _LOCAL[context.applicationId]
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_lodestar"


def checkpoints(spark: SparkSession) -> None:
    """Let checkpoint() write to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{shared_dir(spark)}/lodestar/checkpoints")


class Tables:
    """The tables of a directory as attributes, each read (lazily) with its own schema and nothing cached."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def views(self, *names: str) -> SparkSession:
        """Register temporary views (all tables without names) and return the session."""
        for name in names or TABLES:
            getattr(self, name).createOrReplaceTempView(name)
        return self.spark

    def sql(self, text: str, *names: str) -> DataFrame:
        return self.views(*names).sql(text)
