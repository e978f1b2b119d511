"""Session helpers shared by the library, its tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "loomdoc", cores: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the bench; on a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, or in tests below a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir() and not context.getConf().get("spark.checkpoint.dir", None):
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='loomdoc')}")
    root = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to a new folder of the shared one and read again: computed once, safe when executors are lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table `name` below `root`; any path that Spark can read."""
    return spark.read.parquet(f"{root}/{name}.parquet")
