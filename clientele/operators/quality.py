"""Data-quality reports (Q1, Q2, Q4, Q5, Q6).

Each report is one aggregate over the data it checks; stage row counts
come from ``Observation`` metrics collected by the stage's own write, so
checking never costs a second pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from clientele.functions.dates import parse_date_steps

# The reference's expected data range for its alerts.
EXPECTED_MAX_DATE = "2025-05-31"
RECENT_YEAR_THRESHOLD = 2023


#: Sample texts of a step at most.
SAMPLES = 16


def date_parse_report(df: DataFrame, text_col: str, truth: str | None = None, month_first: bool = False,
                      samples: bool = False) -> DataFrame:
    """Q1: how many rows each parsing rule took, and failures ('failed').

    With ``samples`` each step also has up to 16 of its texts, as an array: the
    one with the smallest md5 for each first digit of it, so the sample is the
    same in every run.  It is gathered with the counts, in partial aggregates of
    at most 16 rows a step."""
    st = parse_date_steps(text_col, month_first=month_first)
    text = F.col(text_col).cast("string")
    hashed = F.md5(text)
    t = df.select(st["date"].alias("parsed"), st["step"].alias("step"), F.substring(hashed, 1, 1).alias("_part"),
                  F.struct(hashed.alias("h"), text.alias("text")).alias("_one"),
                  *([F.col(truth).alias("_truth")] if truth else []))
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if truth:
        aggs.append(F.count(F.when(F.col("parsed") == F.col("_truth"), 1)).alias("n_correct"))
    if not samples:
        return t.groupBy("step").agg(*aggs)
    shown = F.min(F.when(F.col("_one.text").isNotNull(), F.col("_one"))).alias("_one")
    parts = t.groupBy("step", "_part").agg(*aggs, shown)
    sums = [F.sum(c).alias(c) for c in ("n_rows", "n_correct") if c in parts.columns]
    return parts.groupBy("step").agg(*sums, F.transform(F.array_sort(F.collect_list("_one")), lambda x: x["text"])
                                     .alias("samples"))


def range_alerts(df: DataFrame, date_col: str, expected_max: str = EXPECTED_MAX_DATE,
                 min_year: int = RECENT_YEAR_THRESHOLD) -> DataFrame:
    """Q2: rows dated after the expected maximum or before ``min_year``."""
    d = F.col(date_col)
    return df.agg(F.min(d).alias("min_date"), F.max(d).alias("max_date"),
                  F.count(F.when(d > F.lit(expected_max).cast("date"), 1)).alias("n_after_max"),
                  F.count(F.when(F.year(d) < min_year, 1)).alias("n_before_min_year"))


def observed_write(df: DataFrame, path: str, fmt: str = "parquet", name: str = "stage") -> dict:
    """Q5: write a stage and return its row count from the same job."""
    obs = Observation(name)
    df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").format(fmt).save(path)
    return obs.get


def stage_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Q5 as a frame: rows before and after a stage (one row)."""
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(F.count(F.lit(1)).alias("rows_after"))
    one = F.lit(1).alias("_k")
    return b.select("*", one).join(a.select("*", one), "_k").drop("_k")


def scatter_rows(df: DataFrame, key: str = "cust_norm", x: str = "recency_days", y: str = "frequency") -> DataFrame:
    """Q6: the rows of a scatter plot, all of them; how many a screen can
    show is the caller's concern."""
    return df.select(key, x, y)
