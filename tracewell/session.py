"""Session helpers: table access, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import os
import pathlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a side may be broadcast by :func:`bounded_broadcast`.
BROADCAST_ROWS = 20_000
#: Tables that :func:`checkpoint` wrote and nothing has removed.
WRITTEN: set[str] = set()


def local_session(cores: str = "8", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tracewell")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; only the columns that are used are read."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder shared by all executors: the one the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine, as in tests, a temporary one is made.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(spark.sparkContext, "_tracewell_folder"):
        folder = tempfile.mkdtemp(prefix="tracewell-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext._tracewell_folder = f"file://{folder}"
    return spark.sparkContext._tracewell_folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` written as a table in the shared folder, and read from there.

    The table survives the loss of executors, is compressed, and tells the planner its size.
    """
    path = f"{shared_folder(df.sparkSession)}/tracewell-{uuid.uuid4().hex}"
    WRITTEN.add(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tracewell_path = path
    return out


def checkpoint_counting(df: DataFrame, what: Column) -> tuple[DataFrame, int]:
    """:func:`checkpoint`, and in how many rows ``what`` is true, counted while they are written."""
    seen = Observation()
    out = checkpoint(df.observe(seen, F.count_if(what).alias("n")))
    return out, seen.get["n"]


def release(df: DataFrame) -> None:
    """Remove the table behind :func:`checkpoint` once nothing that is still to run reads it."""
    path = getattr(df, "_tracewell_path", None)
    if path:
        _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Remove all tables of :func:`checkpoint` that are left; for the end of a job, when its results are written."""
    for path in list(WRITTEN):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
    WRITTEN.discard(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, also where it isn't installed there.

    The archive is made on the driver, which serves it to the executors.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_tracewell_shipped", False):
        root = pathlib.Path(__file__).resolve().parent
        if root.suffix != ".zip" and root.is_dir():
            folder = tempfile.mkdtemp(prefix="tracewell-code-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            sc.addPyFile(shutil.make_archive(f"{folder}/tracewell", "zip", root.parent, root.name))
        sc._tracewell_shipped = True


def bounded_broadcast(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else ``df`` as it is.

    The count reads no further than ``most + 1`` rows, so a side that outgrew the bound is joined by shuffle.
    """
    return F.broadcast(df) if df.select(F.lit(1)).limit(most + 1).count() <= most else df


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def data_root() -> str:
    return os.environ.get("TRACEWELL_DATA", "/root/testdata")
