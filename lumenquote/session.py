"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "lumenquote", cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings the queries expect; on a cluster use the cluster's own session."""
    n = cpus or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # small tables still use all cores
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    """Whether all tasks run in the driver's own process, so that its folders are everybody's."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the cluster in spark.checkpoint.dir. Where it is unset: a temporary one on a local master, else an error.

    A folder of one machine is never used on a cluster, as executors could not read there what others wrote.
    """
    place = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not place:
        if not is_local(spark):
            raise RuntimeError(f"{CHECKPOINT_KEY} is not set; name a folder that all executors can reach")
        place = "file://" + tempfile.mkdtemp(prefix="lumenquote-")
        _delete_at_end(spark, place)
        spark.conf.set(CHECKPOINT_KEY, place)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(place)
    return place


def _file_system(spark: SparkSession, place: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _delete_at_end(spark: SparkSession, place: str) -> None:
    """Has the driver's JVM delete the folder, which must exist, when it ends."""
    system, path = _file_system(spark, place)
    system.deleteOnExit(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read again: the lineage is cut and the copy survives lost executors.

    The driver owns the table and deletes it when it ends, or before that by `clear_written`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _tables(spark).append(path)
    df.write.parquet(path)
    _delete_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _tables(spark: SparkSession) -> list[str]:
    context = spark.sparkContext
    if not hasattr(context, "_lumenquote_tables"):
        context._lumenquote_tables = []
    return context._lumenquote_tables


def clear_written(spark: SparkSession) -> int:
    """Deletes the tables of `written` so far and says how many; results that still depend on them must have been written before."""
    tables = _tables(spark)
    for place in tables:
        system, path = _file_system(spark, place)
        system.delete(path, True)
    n = len(tables)
    tables.clear()
    return n


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow, on workers that have this package's code."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def ship_package(spark: SparkSession) -> None:
    """Sends this package's code to the Python workers, once per context, for clusters where it is not installed."""
    context = spark.sparkContext
    if getattr(context, "_lumenquote_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="lumenquote-code-")  # on the driver, which serves it
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "lumenquote_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    context.addPyFile(str(target))
    context._lumenquote_shipped = True
