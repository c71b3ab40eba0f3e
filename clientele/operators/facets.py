"""Filters, facet metadata, KPI rows, value counts and lookups
(F2, F4-F9, F12-F14, A8-A13, A17, A22, A23, T10).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_filters(df: DataFrame, members: dict | None = None, ranges: dict | None = None) -> DataFrame:
    """F5 + F6 (C2): ``members={col: [values]}`` — an empty list means no
    filter; ``ranges={col: (lo, hi)}`` inclusive, a None bound is open.  A
    bounded range drops rows whose value is null.  One ``where`` with the
    conjunction, so Catalyst pushes every part to the scan it can reach."""
    conds: list[Column] = []
    for c, vals in (members or {}).items():
        if vals:
            conds.append(F.col(c).isin(list(vals)))
    for c, (lo, hi) in (ranges or {}).items():
        if lo is not None:
            conds.append(F.col(c) >= F.lit(lo))
        if hi is not None:
            conds.append(F.col(c) <= F.lit(hi))
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def facet_values(df: DataFrame, col: str) -> DataFrame:
    """sorted distinct non-null values of a column (a few, for a selection list)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)


def facet_ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """integer-truncated min and max of numeric columns, one row."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("double").cast("long").alias(f"{c}_min"),
                 F.max(c).cast("double").cast("long").alias(f"{c}_max")]
    return df.agg(*aggs)


def value_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """Counts per value, nulls dropped."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))


def kpi_row(df: DataFrame, key="cust_norm", spend="total_spent", recency="recency_days",
            frequency="frequency") -> DataFrame:
    """Distinct customers, total spend and the three averages in one
    aggregate.  Averages skip nulls (null where no value is there) and are
    exact sums divided once, so they do not depend on the order partial sums
    arrive in."""
    return df.agg(
        F.countDistinct(key).alias("n_customers"),
        F.sum(spend).cast("decimal(38,2)").alias("total_spent"),
        (F.sum(recency).cast("double") / F.count(recency)).alias("avg_recency"),
        (F.sum(frequency).cast("double") / F.count(frequency)).alias("avg_frequency"),
        (F.sum(spend).cast("double") / F.count(spend)).alias("avg_monetary"))


def group_stats(df: DataFrame, by: list[str], spend="total_spent", key="cust_norm") -> DataFrame:
    """Count, sum, mean (nulls skipped) and distinct count per group in one pass."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(spend).cast("decimal(38,2)").alias("sum_spent"),
        (F.sum(spend).cast("double") / F.count(spend)).alias("avg_spent"),
        F.countDistinct(key).alias("n_distinct"))


def lookup_label(df: DataFrame, label: Column, value: str, order_col: str) -> DataFrame:
    """the row whose display label equals ``value``; when labels repeat the
    last one (by ``order_col``, equal ones by a hash of the row) wins.  One
    aggregate over one scan."""
    row = F.struct(*df.columns)
    last = (df.where(label == value).withColumn("_row", row)
            .agg(F.max_by("_row", F.struct(F.col(order_col).isNotNull().alias("there"), F.col(order_col), F.xxhash64(*df.columns))).alias("r")))
    return last.where(F.col("r").isNotNull()).select("r.*")


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Min / max / non-null count / null count of columns in one
    aggregate, unpivoted to one row per column (values as text)."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).cast("string").alias(f"{c}__min"), F.max(c).cast("string").alias(f"{c}__max"),
                 F.count(c).alias(f"{c}__count"), F.count(F.when(F.col(c).isNull(), 1)).alias(f"{c}__nulls")]
    wide = df.agg(*aggs)
    parts = ", ".join(f"'{c}', `{c}__min`, `{c}__max`, `{c}__count`, `{c}__nulls`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {parts}) AS (column_name, min_value, max_value, n_values, n_nulls)")


def rows_per_year(df: DataFrame, date_col: str) -> DataFrame:
    """Rows per calendar year."""
    return (df.where(F.col(date_col).isNotNull()).groupBy(F.year(date_col).alias("year"))
              .agg(F.count(F.lit(1)).alias("n_rows")))
