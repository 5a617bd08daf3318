"""Where plans read their tables and where they park intermediate tables.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``: every executor can read it, so a lost executor costs
a re-read and not a recomputation.  Where the setting is absent, a temporary
folder is set up on a master that is one machine (tests, a laptop); on a
cluster that is an error, since each executor would write to its own disk.

What a session parked is removed when the session ends (``clear_parked``
removes it before), or by the operator itself once nothing reads it any more.
"""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_parked: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a scale directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_machine(master: str) -> bool:
    """Whether a master runs driver and tasks in one process."""
    return re.fullmatch(r"local(\[[^\]]*\])?", master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from the session where it is set."""
    found = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(_CHECKPOINT_KEY)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = current.get() if current.isDefined() else None
    if not found:
        if not one_machine(spark.sparkContext.master):
            raise RuntimeError(f"{_CHECKPOINT_KEY} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="newsloom-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set(_CHECKPOINT_KEY, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses; removed with the session."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not _parked:
        atexit.register(clear_parked)
    _parked.add(path)
    return path


def park(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    return park_at(df, label)[0]


def park_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``park`` with the path, for operators that remove the table themselves."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def clear_parked(spark: SparkSession | None = None) -> None:
    """Remove everything that was parked; results that still read it must be written before."""
    spark = spark or SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in list(_parked):
            try:
                drop_path(spark, path)
            except Exception:  # noqa: BLE001  (the session may be ending)
                return


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a parked table once no plan reads it any more."""
    system, target = _file_system(spark, path)
    system.delete(target, True)
    _parked.discard(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any Hadoop file system exists."""
    system, target = _file_system(spark, path)
    return system.exists(target)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, in order; nothing where there is no folder."""
    system, target = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in system.listStatus(target)) if system.exists(target) else []


def tree_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    system, target = _file_system(spark, path)
    return system.getContentSummary(target).getLength() if system.exists(target) else 0


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: readers see all of it or nothing."""
    system, target = _file_system(spark, path)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    out = system.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    system.delete(target, False)
    system.rename(draft, target)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    system, target = _file_system(spark, path)
    source = system.open(target)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def local_session(app: str = "newsloom", cores: str | None = None) -> SparkSession:
    """A session for tests and benches on one machine."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEM", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
