"""Cohort retention.

Counts and retention first reduce the transactions to distinct (customer,
month) cells, map-side before the shuffle, and take the cohort month over a
customer's cells: a customer holding a third of the rows meets the window with
at most one row for each month of the calendar, and the transactions are read
once.  Only ``cohort_rows``, which returns every transaction, joins the cohort
month back to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.functions.dates import month_display, month_key
from clientele.functions.text import name_key_nan
from clientele.operators.skew import join_counted
from clientele.session import checkpoint_once


def _dated(tx: DataFrame, customer: str, date_col: str) -> DataFrame:
    return (tx.where(F.col(date_col).isNotNull())
              .select(name_key_nan(customer).alias("cust"), F.trunc(F.col(date_col), "month").alias("month")))


def _cohort_index() -> Column:
    idx = (F.year("month") - F.year("cohort")) * 12 + (F.month("month") - F.month("cohort"))
    return idx.cast("int").alias("cohort_index")


def cohort_rows(tx: DataFrame, customer: str = "customer", date_col: str = "tx_date") -> DataFrame:
    """W1 + W2: each row with its customer's cohort month and the whole
    months since it (cohort index)."""
    t = _dated(tx, customer, date_col)
    first = checkpoint_once(t.groupBy("cust").agg(F.min("month").alias("cohort"), F.count(F.lit(1)).alias("n_rows")))
    return join_counted(t, first, "cust").select("cust", "month", "cohort", _cohort_index())


def cohort_months(tx: DataFrame, customer: str = "customer", date_col: str = "tx_date") -> DataFrame:
    """The distinct rows of ``cohort_rows``: one for each month in which a customer bought."""
    cells = _dated(tx, customer, date_col).distinct()
    cohort = F.min("month").over(Window.partitionBy("cust"))
    return cells.withColumn("cohort", cohort).select("cust", "month", "cohort", _cohort_index())


def cohort_counts(rows: DataFrame, materialized: bool = False) -> DataFrame:
    """Distinct customers per (cohort month, index); month as 'yyyy-MM'.
    ``rows``: ``cohort_months`` (or ``cohort_rows``, with the same result).

    ``materialized``: checkpoint the result (at most months x months rows) when
    several actions read it, so the transactions are aggregated once."""
    out = (rows.groupBy("cohort", "cohort_index")
               .agg(F.countDistinct("cust").alias("n_customers"))
               .select(month_key("cohort").alias("cohort_month"), "cohort_index", "n_customers"))
    if materialized:
        out = checkpoint_once(out)
    return out


def cohort_dense(counts: DataFrame) -> DataFrame:
    """A19 in long form: every cohort x every index present anywhere, absent
    cells 0 — the cells of the pivot table.  The index list is bounded by
    the calendar span (months) and built per cohort with ``explode``."""
    indices = sorted(r[0] for r in counts.select("cohort_index").distinct().collect())
    cohorts = counts.select("cohort_month").distinct()
    grid = cohorts.select("cohort_month",
                          F.explode(F.array(*[F.lit(i) for i in indices])).alias("cohort_index"))
    return (grid.join(counts, ["cohort_month", "cohort_index"], "left")
                .withColumn("n_customers", F.coalesce("n_customers", F.lit(0)).cast("long")))


def cohort_matrix(counts: DataFrame) -> DataFrame:
    """A19 for presentation: one row per cohort, a column per index (0 fill)."""
    indices = sorted(r[0] for r in counts.select("cohort_index").distinct().collect())
    return (counts.groupBy("cohort_month").pivot("cohort_index", indices)
                  .agg(F.first("n_customers")).fillna(0))


def retention(counts: DataFrame) -> DataFrame:
    """W6 + P14: each cell divided by its cohort's index-0 size, plus the
    'Mon yyyy (N=size)' cohort label.  The size is joined from the index-0
    rows (one per cohort), not taken with a window."""
    dense = cohort_dense(counts)
    size = (dense.where(F.col("cohort_index") == 0)
                 .select("cohort_month", F.col("n_customers").alias("cohort_size")))
    j = dense.join(size, "cohort_month")
    label = F.concat(month_display(F.to_date(F.concat(F.col("cohort_month"), F.lit("-01")))),
                     F.lit(" (N="), F.col("cohort_size").cast("string"), F.lit(")"))
    return j.select("cohort_month", "cohort_index", "n_customers", "cohort_size",
                    F.when(F.col("cohort_size") > 0, F.col("n_customers") / F.col("cohort_size"))
                     .otherwise(F.lit(0.0)).alias("retention"),
                    label.alias("cohort_label"))
