"""Writers (K1-K5).

Outputs go to the folder the caller names; ``output_path`` derives one
under the shared checkpoint folder (``spark.checkpoint.dir``) for scratch
outputs, never a machine-local temp folder on a cluster.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from clientele.session import ensure_checkpoint_dir


def output_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for ``name`` under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "outputs", f"{name}-{uuid.uuid4().hex[:12]}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """K1: overwrite one output table (no index column exists in Spark)."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        # values as they are: the writer would strip them
        w = w.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    w.save(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """K2: CSV with a header row."""
    return write_table(df, path, "csv")


def write_ordered_csv(df: DataFrame, path: str, order: str, files: int = 4) -> str:
    """K2 for a table whose line order matters: files in the order of ``order``, sorted within."""
    return write_csv(df.repartitionByRange(files, order).sortWithinPartitions(order), path)


def export_filtered(df: DataFrame, base: str, stem: str, fmt: str = "parquet") -> str | None:
    """K3: write ``<base>/<stem>_filtered`` unless the frame is empty
    (``isEmpty`` reads at most one row); returns the path or None."""
    if df.isEmpty():
        return None
    return write_table(df, os.path.join(base, f"{stem}_filtered"), fmt)


def write_split(df: DataFrame, path: str, flag_col: str) -> str:
    """K4: one input, two outputs by a predicate column — a single
    ``partitionBy`` write instead of two filtered writes."""
    return write_table(df, path, "parquet", [flag_col])
