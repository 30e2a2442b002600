"""Sessions, table loading and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tideline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the cluster sets it.

    Where it is unset, a local master gets a temporary folder and any other
    master a folder in the warehouse, never a machine-local one.
    """
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        return found
    if (chosen := spark.sparkContext.getCheckpointDir()) is not None:  # by setCheckpointDir
        return chosen
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        root = os.path.join(tempfile.gettempdir(), "tideline-checkpoints")
        return f"file://{root}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tideline_checkpoints"


_cleaned: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone by now; the folder is scratch space
        pass


def scratch(spark: SparkSession) -> str:
    """A new path in the application's part of the shared folder, which is removed
    when the driver exits."""
    top = f"{shared_dir(spark).rstrip('/')}/tideline-{spark.sparkContext.applicationId}"
    if top not in _cleaned:
        _cleaned.add(top)
        atexit.register(_remove, spark, top)
    return f"{top}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back.

    Cuts the lineage, survives lost executors, and gives the planner real sizes
    for the joins that follow.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class cuts_of:
    """A block whose intermediate tables are removed at its end: for a long-lived
    application that runs many queries. What the block returns must be written
    or collected inside it."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = set(self._names())

    def _names(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        self.top = jvm.org.apache.hadoop.fs.Path(scratch(self.spark)).getParent()
        fs = self.top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [x.getPath().toString() for x in fs.listStatus(self.top)] if fs.exists(self.top) else []

    def __exit__(self, *_) -> None:
        for name in set(self._names()) - self.before:
            _remove(self.spark, name)
