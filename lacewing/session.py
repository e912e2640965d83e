"""Sessions, and the one place that decides where intermediate tables live.

Iterative operators and multi-pass operators cut their lineage with tables in the
folder named by ``spark.checkpoint.dir``. That folder is shared by the driver and
all executors, so a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lacewing", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and skew-join handling switched on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        b.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, as the cluster names it.

    ``spark.checkpoint.dir`` decides. Where it is unset, a folder given to
    ``setCheckpointDir`` is used, and in local mode, as in tests, a temporary one
    is made. On a cluster without the setting this raises: a machine-local folder
    would be invisible to the other machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if (given := context.getCheckpointDir()) is not None:
        return given
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="lacewing-"))
    return context.getCheckpointDir()


def table_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/lacewing-{uuid.uuid4().hex}/{tag}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path.rsplit("/", 1)[0])
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


_recorders: list[list[str]] = []


@contextmanager
def recording() -> Iterator[list[str]]:
    """The paths of tables that ``written`` makes meanwhile, for whoever can tell when they are done with."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders.remove(paths)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table made by ``written`` before the application ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, tag: str, path: str | None = None, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: lineage ends here."""
    spark = df.sparkSession
    if path is None:
        path = table_path(spark, tag)
        for paths in _recorders:
            paths.append(path)
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more.

    Spark does so when the driver's JVM collects its garbage, which it seldom does by
    itself; operators of several passes call this between them.
    """
    gc.collect()
    spark._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for states between rounds."""
    return written(df, "state")
