"""What the operators share: the shared folder, written intermediate tables, word rules and row keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of every helper column, so that no column of the input clashes with one.
OWN = "__loom_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, as a full URI.

    A path without a scheme belongs to the cluster's default file system, as it does for Spark. Where it is unset, a local master (tests) gets a temporary folder; a cluster gets an error, as a
    machine-local folder there would lose what executors write.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return qualified(spark, found)
    master = conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='loomdoc')}")
    return spark.sparkContext.getCheckpointDir()


def _store(spark: SparkSession, path: str):
    """The path for Hadoop, and its file system."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with scheme and host, those of the default file system where it has none."""
    hadoop, store = _store(spark, path)
    out = store.makeQualified(hadoop).toString()
    return out.replace("file:/", "file:///", 1) if out.startswith("file:/") and not out.startswith("file://") else out


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/loomdoc/{name}-{uuid.uuid4().hex}"
    hadoop, store = _store(spark, path)
    store.deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: computed once, safe when executors are lost."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.loom_folder = path
    return out


def released(*tables: DataFrame) -> None:
    """Delete the folders of written tables that nothing reads any more, so that they don't pile up during a run."""
    for made in tables:
        hadoop, store = _store(made.sparkSession, made.loom_folder)
        store.delete(hadoop, True)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once per row, though the body uses it again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def code_points(data: bytes) -> bytes:
    """`data` (UTF-8) in lower case A-Z, with every ASCII character that isn't a letter or a digit as a space."""
    return data.translate(_WORDS)


_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text in lower case A-Z, as UTF-8; null: none."""
    return code_points((text or "").encode("utf-8", "surrogatepass")).split()
