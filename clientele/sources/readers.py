"""Readers (S1-S5, S9, S11): Parquet/CSV/JSON with declared schemas.

A reader never infers a schema on large input and never reads columns a
later ``select`` does not need (Catalyst prunes the Parquet scan).
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table_path(d: str, name: str) -> str:
    return os.path.join(d, f"{name}.parquet")


def read_table(spark: SparkSession, d: str, name: str, schema: StructType | None = None) -> DataFrame:
    """One whole table from the test folder (Parquet)."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(table_path(d, name))


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """CSV with header and a declared schema (no inference pass)."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


#: The table of splits is broadcast up to so many rows (about 100 bytes each).
BROADCAST_SPLITS = 100_000


def read_numbered(spark: SparkSession, path: str | list[str], schema: StructType | str, fmt: str = "csv",
                  row_id: str = "row_id", **options) -> DataFrame:
    """A text table with ``row_id``, the place of each row in the order of
    the files (by path) and of the lines in them, from 0 without gaps.

    A split is read by one task from its first row to its last, so a row is
    known by its file, the start of its split and its place in the task.  The
    rows are checkpointed once with these, which keeps them the same for the
    count of each split and for the numbering.  Only the splits are put in
    order, and a row's number is the sum of the splits before it plus its place.
    """
    from clientele.operators.ranking import ordered_offsets
    from clientele.session import checkpoint_once
    reader = spark.read.schema(schema)
    for k, v in (({"header": True} if fmt == "csv" else {}) | options).items():
        reader = reader.option(k, v)
    placed = reader.format(fmt).load(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_place"))
    rows = checkpoint_once(placed)
    splits = rows.groupBy("_file", "_start").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    splits = ordered_offsets(splits, ["_file", "_start"], "_n").select("_file", "_start", "_first", "_before")
    few = splits.count() <= BROADCAST_SPLITS
    return (rows.join(F.broadcast(splits) if few else splits, ["_file", "_start"])
            .withColumn(row_id, F.col("_before") + F.col("_place") - F.col("_first"))
            .drop("_file", "_start", "_place", "_first", "_before"))


def read_any(spark: SparkSession, path: str, schema: StructType | str | None = None,
             json_multiline: bool = False) -> DataFrame:
    """Choose the reader by file extension; a path without one is a Parquet
    folder (on any file system Spark reads); other extensions are rejected.
    JSON is read as JSON lines unless ``json_multiline`` (one document)."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext in (".parquet", ""):
        r = spark.read if schema is None else spark.read.schema(schema)
        return r.parquet(path)
    if ext == ".csv":
        if schema is None:
            raise ValueError("CSV input needs a declared schema")
        return read_csv(spark, path, schema)
    if ext == ".json":
        r = spark.read.option("multiLine", json_multiline)
        return (r if schema is None else r.schema(schema)).json(path)
    raise ValueError(f"Unsupported file format: {path}")


def read_partitions(spark: SparkSession, root: str, tag: str = "Month", suffix: str = "24",
                    schema: StructType | str | None = None) -> DataFrame:
    """S3: many same-shaped parts stored as ``<root>/<tag>=<name>/``: keep
    the parts whose stripped name ends in ``suffix``; each row carries its
    part name in ``tag``.  The filter is on the partition column, so Spark
    prunes whole folders before reading any file."""
    r = spark.read if schema is None else spark.read.schema(schema)
    df = r.parquet(root)
    return df.where(F.trim(F.col(tag)).endswith(suffix))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Union all, columns aligned by name, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_area_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ``features[].properties.NAME_3`` of a GeoJSON file."""
    schema = "features ARRAY<STRUCT<properties: STRUCT<NAME_3: STRING>>>"
    g = spark.read.option("multiLine", True).schema(schema).json(path)
    return (g.select(F.explode("features").alias("f"))
             .select(F.col("f.properties.NAME_3").alias("area"))
             .where(F.col("area").isNotNull()).distinct())


def date_range(df: DataFrame, date_col: Column | str) -> DataFrame:
    """Min and max of the parseable dates (one aggregate, no collect)."""
    c = F.col(date_col) if isinstance(date_col, str) else date_col
    return df.select(c.alias("_d")).where(F.col("_d").isNotNull()).agg(
        F.min("_d").alias("min_date"), F.max("_d").alias("max_date"))
