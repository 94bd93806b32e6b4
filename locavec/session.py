"""Session helpers: a local test session, the shared scratch folder and size checks."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sides above this many bytes are never hinted for broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "locavec") -> SparkSession:
    """A local session for tests and the benchmark. On a cluster, bring your own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOCAVEC_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per context.

    Needed wherever the package is not installed on the executors; a no-op after the first call.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_locavec_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")  # driver side only; Spark distributes the file
        sc.addPyFile(shutil.make_archive(f"{folder}/locavec", "zip", os.path.dirname(package), os.path.basename(package)))
        sc._locavec_shipped = True
    return spark


class scratch:
    """``with scratch(spark):`` removes, at its end, what ``shared_dir`` and ``cut_lineage`` wrote inside it.

    Take results out (write, collect) before the end. Nested blocks remove their own paths. Without a block nothing is removed.
    """

    _open: list[list[str]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> list[str]:
        self.paths: list[str] = []
        scratch._open.append(self.paths)
        return self.paths

    def __exit__(self, *exc) -> None:
        scratch._open.remove(self.paths)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that every executor can reach.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local session may
    fall back to a temporary folder, since its executors share the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if scratch._open:
        scratch._open[-1].append(path)
    return path


def cut_lineage(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives executor loss."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions by ``keys`` in the session's full shuffle width.

    Adaptive execution merges partitions by bytes. Groups that are small in bytes but heavy in
    Python work must not be merged into one task, and an explicit number prevents that.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def broadcast_if_bounded(df: DataFrame, max_rows: int, row_bytes: int = 64) -> DataFrame:
    """Hint a broadcast only when the caller's proven row bound fits the byte limit.

    Otherwise the planner decides, and adaptive execution splits skewed join partitions.
    """
    return F.broadcast(df) if max_rows * row_bytes <= BROADCAST_BYTES else df
