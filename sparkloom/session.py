"""Making the package importable on executors, and tables staged in the folder that all of them share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: dict[str, bool] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package's source to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        at = Path(tempfile.mkdtemp(prefix="spark-sparkloom-")) / "sparkloom_source.zip"
        with zipfile.ZipFile(at, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, os.path.join(root.name, path.relative_to(root)))
        spark.sparkContext.addPyFile(str(at))
        _shipped[app] = True
    return spark


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent a local session gets a temporary folder; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-sparkloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def stage(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{workspace(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def spread(df: DataFrame, bytes_a_core: int = 4 << 20) -> DataFrame:
    """``df`` dealt out over all cores if it is small: a file with a single row group is read by one task.

    Tables of more than ``bytes_a_core`` for each core have tasks enough and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * bytes_a_core else df


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = df._staged_at
    jvm = df.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
