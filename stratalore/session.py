"""Session-level plumbing: shared folders, lineage cuts and code shipping.

Folders are always taken from ``spark.checkpoint.dir`` (visible to the driver and
to every executor); a private temporary folder is used only where that setting is
missing on a local master, as in tests. On a cluster its absence is an error.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_lock = threading.Lock()
_shipped: set[str] = set()
_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Base folder that the driver and all executors can reach, as a URI or path."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    with _lock:
        if app not in _fallback:
            _fallback[app] = tempfile.mkdtemp(prefix="stratalore-")
    return _fallback[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call returns."""
    return f"{shared_dir(spark)}/stratalore/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage (a lost executor costs a re-read of files, not a
    recomputation of the plan) and keeps a result that several consumers share
    from being computed once for each of them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parquet_scan(df: DataFrame) -> bool:
    """Whether ``df`` is nothing but a scan of Parquet files, each named once, so files and rows in them name its rows."""
    plan = df._jdf.queryExecution().analyzed()
    return plan.getClass().getSimpleName() == "LogicalRelation" and "parquet" in plan.relation().toString().lower() and len(set(files := df.inputFiles())) == len(files)


def scan_roots(df: DataFrame) -> tuple[str, ...]:
    """The paths that a scan of files was asked for."""
    roots = df._jdf.queryExecution().analyzed().relation().location().rootPaths()
    return tuple(sorted(roots.apply(k).toString() for k in range(roots.size())))


def files_state(df: DataFrame) -> int:
    """A number that changes with the names, sizes or times of the files of a scan; no column is read."""
    meta = df.metadataColumn("_metadata")
    files = df.select(meta["file_path"].alias("p"), meta["file_size"].alias("s"), meta["file_modification_time"].alias("t")).distinct()
    return files.agg(F.coalesce(F.sum(F.xxhash64("p", "s", "t").cast("decimal(38,0)")), F.lit(0))).first()[0].__hash__()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Workers started from another directory than the repository would not find
    the package by themselves; a zip of it (a few hundred kB) goes through
    Spark's own file server.
    """
    app = spark.sparkContext.applicationId
    with _lock:
        if app in _shipped:
            return
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="stratalore-pkg-"), "stratalore.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)


def give_back() -> None:
    """Return freed memory of a Python worker to the machine: workers live on and are used by later stages."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Bound what one Arrow batch to a Python worker can hold, by rows and by bytes.

    Spark has these bounds for whole sessions only, so they stay in force for
    whatever the session runs next, until it sets others.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    except Exception as e:  # the setting is absent in older 4.x releases
        if "CONFIG" not in str(e).upper():
            raise
