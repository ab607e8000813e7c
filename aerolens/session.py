"""Session settings, the shared working folder and written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Folders made for sessions that name none (tests, local runs), by application.
_local_dirs: dict[str, str] = {}

# Lets Spark remove a job's shuffle files at its end instead of when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Paths written inside the open ``recorded`` blocks of this thread.
_scratch = threading.local()


def build_session(app: str = "aerolens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew joins and UTC timestamps."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder they start in.

    Workers on machines that have it installed elsewhere ignore a folder that is not there.
    """
    root = str(Path(__file__).resolve().parents[1])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach, as named by ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder. On a cluster a
    missing setting is an error: a machine-local folder would not survive the loss
    of the machine that wrote it.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="aerolens-")
    return _local_dirs[app]


def work_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts the lineage before a frame is used several times, and survives executor loss. The shuffle files
    of the write go at its end: nothing reads them again.
    """
    path = work_path(df.sparkSession, label)
    for paths in getattr(_scratch, "open", [])[-1:]:
        paths.append(path)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_written(*tables: DataFrame) -> None:
    """Remove tables that ``written`` made, once nothing reads them again."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, path)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(where) if s.isDirectory()) if files.exists(where) else []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Collects the paths of the tables ``written`` inside, for whoever knows when they are no longer read."""
    if not hasattr(_scratch, "open"):
        _scratch.open = []
    _scratch.open.append(paths := [])
    try:
        yield paths
    finally:
        _scratch.open.pop()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables ``written`` inside: for jobs that leave their result elsewhere."""
    with recorded() as paths:
        try:
            yield
        finally:
            for path in paths:
                remove(spark, path)
