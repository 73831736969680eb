"""Session construction and the few session-level settings every job relies on.

The cluster owns most knobs (executor sizes, shuffle partitions at 100 TB);
this module only fills in what is unset, so a job submitted to a cluster keeps
the cluster's values.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings a job needs for correct answers; applied only when unset.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, app: str = "markspark",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Return the active session, or build one (local tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None and master is None:
        configure(active)
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = b.config("spark.driver.memory", os.environ.get("MARKSPARK_DRIVER_MEM", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Make sure a checkpoint folder is set; the caller's session settings stay as they are.

    Joins are planned with the session's own broadcast threshold; explicit
    hints are given only for sides whose size is bounded or measured.
    """
    checkpoint_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is a shared file system path set by the cluster; we
    only create a private one when it is unset (local tests).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder: the global-order operators and "
                               "model inputs are checkpointed there so lost executors can recover")
        conf_dir = tempfile.mkdtemp(prefix="markspark-ckpt-")  # local mode only (tests)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and cut its lineage.

    Used before iterative work (model training, repeated passes): every
    pass then reads the stored rows, and a lost executor re-reads them
    instead of recomputing the whole upstream plan.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_rows(df):
    """``df`` written once as Parquet below the shared checkpoint folder and read back: for large rows that are read more
    than once, smaller than :func:`materialize` writes them."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/markspark-rows/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
