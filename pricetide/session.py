"""Session settings and lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "pricetide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; partition counts and memory stay with the cluster."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Joins on (product, date) reuse the partitioning by product that the windows made; a product
        # has at most one row per calendar day there.
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        # Call sites of single Column calls are not recorded: plans here have hundreds of them.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: With it, a job's shuffle files go when its write has ended; nothing reads them again. Unknown to Spark before 4.1.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Share of the driver's heap bound above which `materialize` has the heap collected.
HEAP_SHARE = 0.5

#: What `materialize` and `shared_folder` have made in this process and `release` has not removed yet: (session, table
#: or None for a folder, path or None).
_MADE: list[tuple[SparkSession, DataFrame | None, str | None]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and give a table that reads the stored rows.

    With a shared folder named in ``spark.checkpoint.dir`` the rows are written there as parquet and read back:
    unlike ``checkpoint()`` that keeps column pruning, filter pushdown and file splits for the passes that
    follow, cuts the lineage and survives the loss of any executor. Without one the rows stay on the executors'
    disks (``persist``) with their lineage, so a lost part is computed again. `release` removes both kinds; the
    files also go when the driver's JVM ends. With executors apart from the driver its heap is trimmed (`trim`).
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        stored = df.persist(StorageLevel.DISK_ONLY)
        _MADE.append((spark, stored, None))
        return stored
    path = f"{folder.rstrip('/')}/pricetide/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    files, where = _files(spark, path)
    files.deleteOnExit(where)
    stored = spark.read.schema(df.schema).parquet(path)
    _MADE.append((spark, stored, path))
    if _apart(spark):
        trim(spark)
    return stored


def _apart(spark: SparkSession) -> bool:
    """Whether the executors have JVMs of their own."""
    return not re.match(r"local(\[|$)", spark.sparkContext.master)


def trim(spark: SparkSession) -> None:
    """Collect the driver's heap if it takes more than `HEAP_SHARE` of its bound.

    A chain of many short jobs leaves plans, broadcasts and task events behind; between full collections the heap grows
    up to its bound over these, and what Spark's cleaner frees only once they are collected stays as well.
    """
    jvm = spark.sparkContext._jvm
    heap = jvm.Runtime.getRuntime()
    if heap.totalMemory() > HEAP_SHARE * heap.maxMemory():
        jvm.System.gc()


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove the given ones, or all, of the tables that `materialize` has stored for ``spark``.

    Call it once results that read them have been written or read.
    """
    for made in [m for m in _MADE if m[0] is spark and (not tables or any(m[1] is t for t in tables))]:
        _MADE.remove(made)
        _, stored, path = made
        if path is None:
            stored.unpersist()
        else:
            files, where = _files(spark, path)
            files.delete(where, True)


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """Releases at its end the tables that `materialize` has stored for ``spark`` within it."""
    before = {id(table) for _, table, _ in _MADE}
    yield
    made = [table for session, table, _ in _MADE if session is spark and table is not None and id(table) not in before]
    if made:
        release(spark, *made)


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application, so that tasks can import it anywhere."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="code-")  # the driver serves it from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "pricetide_core.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for where, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(where, name)
                archive.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all tasks reach, in ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine takes a temporary folder; one on a cluster is told to set it. A
    `release` of all tables removes the folder; it also goes when the driver's JVM ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        folder = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    files, where = _files(spark, f"{folder.rstrip('/')}/pricetide/{uuid.uuid4().hex}")
    where = files.makeQualified(where)
    files.mkdirs(where)
    files.deleteOnExit(where)
    _MADE.append((spark, None, where.toString()))
    return where.toString()


def _files(spark: SparkSession, path: str):
    """The store that holds ``path`` and the path as that store's API takes it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where
