"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
import weakref
import zipfile
from contextlib import contextmanager, suppress
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markspark.session import checkpoint_dir

_WRITTEN: list[tuple[weakref.ref, str]] = []
#: Folders of sent code, kept until the driver ends.
_SENT: list[tempfile.TemporaryDirectory] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the shared checkpoint folder and
    read back: cuts lineage, so lost executors re-read instead of recomputing.
    The files are deleted when the driver ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder; what is written there is deleted when the driver ends."""
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_delete_all)
    _WRITTEN.append((weakref.ref(spark), path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared checkpoint folder that no result reads any more."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def delete_stored() -> None:
    """Delete every table :func:`stored` wrote so far (results that still read them must be saved before)."""
    while _WRITTEN:
        ref, path = _WRITTEN.pop()
        spark = ref()
        if spark is not None:
            delete_path(spark, path)


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Within it Spark deletes a query's shuffle files as soon as the query ends, not when the driver next collects garbage."""
    if not spark.conf.isModifiable(_CLEANUP):  # an older Spark
        yield
        return
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def _delete_all() -> None:
    with suppress(Exception):  # the JVM may be gone already
        delete_stored()


def ship_code(spark: SparkSession) -> None:
    """Make this package importable in the Python workers where PYTHONPATH does not already do so."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_markspark_sent", False):
        return
    folder = tempfile.TemporaryDirectory(prefix="markspark-code-")  # only the driver reads it; Spark sends the file on
    _SENT.append(folder)
    name = Path(folder.name, f"markspark_code_{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted((root / "markspark").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(name))
    spark.sparkContext._markspark_sent = True


def give_back() -> None:
    """Return the memory that a task has freed to the system: workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run):
    """``run``, a function of a task's batches, that also returns the memory freed when the task ends."""
    def out(batches):
        yield from run(batches)
        give_back()

    return out


def ascii_lower(col):
    """A-Z to a-z; other letters stay (Spark's lower() changes all scripts)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hashed_blocks(n: int, per_block: int) -> int:
    """How many hash blocks keep each near ``per_block`` rows."""
    return max(1, -(-n // per_block))
