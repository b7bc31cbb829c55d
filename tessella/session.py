"""Session factory and the two cluster services operators rely on: durable cuts of lineage and shared scratch folders."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tessella", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings tests and the bench use; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TESSELLA_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session; a temporary local one where it is unset,
    but only in a local session: on a cluster that raises ValueError."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext.getCheckpointDir()
        if held:
            return held
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tessella-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table in the shared folder; the application's folder goes when its JVM ends."""
    sc = spark.sparkContext
    root = f"{shared_dir(spark).rstrip('/')}/tessella-{sc.applicationId}"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{root}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries of the session that run inside remove their shuffle files as they end, not when the driver happens to
    collect its garbage. For steps whose results are written or collected: what follows doesn't read their shuffles."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, held)


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Cut the lineage: write the rows as a table in the shared folder and read them from there.

    All executors share the folder, so a lost executor loses no rows, and columnar files take a fraction of the
    room that checkpointed row objects do.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
