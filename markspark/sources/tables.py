"""Scans and sinks.

Every reader takes an explicit schema or a column list so the scan is pruned
at the file; nothing infers a schema by reading the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, path: str, schema: StructType,
               columns: list[str] | None = None, fmt: str = "csv") -> DataFrame:
    """CSV (or other text format) scan with a fixed schema and a column subset.

    The header is checked against the schema by name, so a reordered file
    still maps to the right columns; CSV column pruning happens in the reader.
    """
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
    df = reader.format(fmt).load(path)
    return df.select(*columns) if columns else df


def ingest_years(spark: SparkSession, src: str, dst: str, schema: StructType, col: str, lo: int, hi: int,
                 src_fmt: str = "csv", dst_fmt: str = "csv") -> None:
    """One lazy read -> year-range filter -> write (CSV with one header per
    part file). The chunked loop of a single-process reader disappears: the
    scan is split by the engine and the range predicate reaches the reader."""
    from markspark.operators.clean import year_between
    reader = spark.read.schema(schema).format(src_fmt)
    if src_fmt == "csv":
        reader = reader.option("header", True)
    out = year_between(reader.load(src), col, lo, hi).write.mode("overwrite").format(dst_fmt)
    if dst_fmt == "csv":
        out = out.option("header", True)
    out.save(dst)


def read_stage(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Stage table read with projection (reaches the Parquet ReadSchema)."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_stage(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a stage table."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_report(df: DataFrame, path: str, single_file: bool = True) -> None:
    """CSV report sink. ``single_file`` is for small report tables only."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read back a CSV report written by :func:`write_report`."""
    return read_table(spark, path, schema)


def write_by_class(df: DataFrame, path: str, col: str = "class") -> None:
    """One output directory per class value; later reads prune on it."""
    df.write.mode("overwrite").partitionBy(col).parquet(path)


def read_classes(spark: SparkSession, path: str, classes: list, col: str = "class") -> DataFrame:
    """Read only the chosen classes (partition pruning, no full scan)."""
    return spark.read.parquet(path).filter(F.col(col).isin(list(classes)))


def read_runs(spark: SparkSession, path: str, pattern: str | None = None,
              expect_n: int | None = None, run_col: str = "run", level: int = -1) -> DataFrame:
    """Load every run file under ``path`` (a folder or a glob) whose file
    name matches ``pattern``, as one table.

    ``run_col`` names the run: the file name (``level=-1``) or its folder
    (``level=-2``). ``expect_n`` checks the row count (one aggregate, Q1)
    and raises on a mismatch.
    """
    reader = spark.read
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    df = reader.option("recursiveFileLookup", True).parquet(path)
    df = df.withColumn(run_col, F.element_at(F.split(F.input_file_name(), "/"), level))
    if expect_n is not None:
        n = df.count()
        if n != expect_n:
            raise ValueError(f"expected {expect_n} rows from {path}, found {n}")
    return df


def read_lookup(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv") -> DataFrame:
    """Small description lookup; the join side is broadcast behind a size check."""
    return read_table(spark, path, schema, fmt=fmt)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver test table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
