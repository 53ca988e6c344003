"""Session defaults and staging of intermediate tables on shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def build_session(master: str = "local[*]", app: str = "demandscope", **conf: str) -> SparkSession:
    """A session with the settings the jobs assume (UTC, adaptive execution)."""
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # split hot keys even where that costs another shuffle
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    app = context.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="spark-")
    return _LOCAL_DIRS[app]


class Staged:
    """A DataFrame written to shared storage, so its lineage is one file scan."""

    def __init__(self, df: DataFrame, label: str, **metrics: Column):
        """Write ``df``; aggregate ``metrics`` on the way, without another job."""
        spark = df.sparkSession
        self.path = f"{staging_root(spark)}/demandscope/{label}-{uuid.uuid4().hex}"
        schema = df.schema
        if metrics:
            seen = Observation()
            df = df.observe(seen, *[column.alias(name) for name, column in metrics.items()])
        df.write.parquet(self.path)
        self.df = spark.read.schema(schema).parquet(self.path)
        self.metrics = seen.get if metrics else {}

    def drop(self) -> None:
        context = self.df.sparkSession.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    return Staged(df, label).df
