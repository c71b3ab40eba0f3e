"""Monthly series, seasonal decomposition, purchase gaps, histograms
(A14, A15, W3, W4, W14, F10, A24).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientele.functions.dates import month_key
from clientele.functions.text import name_key_nan
from clientele.session import checkpoint_once

MONEY = "decimal(38,2)"


def monthly_revenue(tx: DataFrame, date_col: str = "tx_date", money: str = "total_price") -> DataFrame:
    """Revenue per 'yyyy-MM' month (exact decimal sum)."""
    return (tx.where(F.col(date_col).isNotNull())
              .groupBy(month_key(date_col).alias("month"))
              .agg(F.sum(money).cast(MONEY).alias("revenue")))


def monthly_visits(tx: DataFrame, customer: str = "customer", date_col: str = "tx_date") -> DataFrame:
    """Distinct (date, customer) visits counted per month."""
    v = (tx.where(F.col(date_col).isNotNull())
           .select(F.col(date_col).alias("d"), name_key_nan(customer).alias("cust")).distinct())
    return v.groupBy(month_key("d").alias("month")).agg(F.count(F.lit(1)).alias("visits"))


def decomposition_period(n: int) -> int:
    """12 for >= 24 points, n//2 (at least 2) for >= 4, else 0; needs n >= 2·period."""
    p = 12 if n >= 24 else (max(2, n // 2) if n >= 4 else 0)
    return p if p > 1 and n >= 2 * p else 0


def decompose(series: DataFrame, order_col: str, value_col: str, period: int | None = None) -> DataFrame:
    """W14 (C10): additive decomposition of a short ordered series.

    trend: centred moving average (even period: weights ½,1,…,1,½ over
    period+1 points; odd: plain mean), null at the ends; seasonal: mean of
    the detrended values by position mod period, minus the mean of those
    means; residual = observed - trend - seasonal.  Every value is an exact
    integer of hundredths until its one division, so none depends on the order
    of a sum.  The input is one row per month (bounded by the calendar), so the
    unpartitioned window is small by construction.
    """
    w = Window.orderBy(order_col)
    # the series is materialised once (one row per month): counting it and
    # decomposing it then read the same small table, not the transactions twice
    s = checkpoint_once(series.withColumn("_t", (F.row_number().over(w) - 1).cast("int")))
    n = s.count()
    p = period or decomposition_period(n)
    cents = (F.col(value_col).cast(MONEY) * 100).cast("decimal(38,0)")
    observed = F.col(value_col).cast("double").alias("observed")
    if not p:
        return s.select(order_col, observed,
                        *[F.lit(None).cast("double").alias(c) for c in ("trend", "seasonal", "resid")])
    h = p // 2
    div = 2 * p if p % 2 == 0 else p
    s = s.withColumn("_x", cents)
    wt = Window.orderBy("_t")
    around = F.sum("_x").over(wt.rowsBetween(-h, h))
    if p % 2 == 0:
        around = around * 2 - F.lag("_x", h).over(wt) - F.lead("_x", h).over(wt)
    ok = (F.col("_t") >= h) & (F.col("_t") < n - h)
    s = s.withColumn("_around", F.when(ok, around)).withColumn("_pos", F.col("_t") % p)
    s = s.withColumn("_off", F.col("_x") * div - F.col("_around"))  # div times the detrended value
    # phases hold k or k + 1 detrended values: with `common` the means of all of them are integers over one number
    counts = {sum(1 for t in range(h, n - h) if t % p == q) for q in range(p)}
    common = math.lcm(*(c for c in counts if c))
    phase = s.groupBy("_pos").agg((F.sum("_off") * F.floor(F.lit(common) / F.count("_off"))).cast("decimal(38,0)").alias("_mean"))
    phase = phase.withColumn("_season", F.col("_mean") * p - F.sum("_mean").over(Window.partitionBy()))  # p rows
    s = s.join(phase.select("_pos", "_season"), "_pos")
    whole = 100 * div * common * p
    rest = F.col("_off") * (common * p) - F.col("_season")
    return s.select(order_col, observed, (F.col("_around").cast("double") / (100 * div)).alias("trend"),
                    (F.col("_season").cast("double") / whole).alias("seasonal"),
                    (rest.cast("double") / whole).alias("resid"))


def purchase_gaps(tx: DataFrame, customer: str = "customer", date_col: str = "tx_date") -> DataFrame:
    """W3 + W4: the multiset of days between consecutive purchases per
    customer, as (gap_days, n_rows).

    Rows are first reduced to (customer, day, count): the k rows of one day
    contribute k-1 zero gaps and one gap to the previous purchase day.  The
    ``lag`` window then sorts at most one row per calendar day of a customer,
    so a customer with a third of all rows is bounded by the day span.
    """
    days = (tx.where(F.col(date_col).isNotNull())
              .groupBy(name_key_nan(customer).alias("cust"), F.to_date(date_col).alias("d"))
              .agg(F.count(F.lit(1)).alias("k")))
    prev = F.lag("d").over(Window.partitionBy("cust").orderBy("d"))
    days = days.withColumn("gap", F.datediff("d", prev).cast("long"))
    zeros = days.where(F.col("k") > 1).select(F.lit(0).cast("long").alias("gap_days"),
                                              (F.col("k") - 1).alias("n"))
    steps = days.where(F.col("gap").isNotNull()).select(F.col("gap").alias("gap_days"), F.lit(1).cast("long").alias("n"))
    return (zeros.unionByName(steps).groupBy("gap_days").agg(F.sum("n").cast("long").alias("n_rows")))


def gap_filter(gaps: DataFrame, lo: int = 0, hi: int = 1000) -> DataFrame:
    """keep gaps with lo <= days < hi."""
    return gaps.where((F.col("gap_days") >= lo) & (F.col("gap_days") < hi))


def weighted_mean(df: DataFrame, value: str, weight: str, out: str = "mean") -> DataFrame:
    """Mean of a value given with multiplicities (exact integer sums)."""
    return df.agg((F.sum(F.col(value) * F.col(weight)).cast("double") /
                   F.sum(weight).cast("double")).alias(out))


def histogram(df: DataFrame, value: str, bins: int = 50, weight: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max]; the maximum lands in the last
    bin.  Integer values use exact integer arithmetic for the bin index.
    (Edges are ours; a plotting library's automatic bins may differ.)"""
    # the edges come from the data, so its two columns are kept for the second look
    df = checkpoint_once(df.select(value, *([] if weight is None else [weight])))
    st = df.agg(F.min(value).alias("mn"), F.max(value).alias("mx")).first()
    mn, mx = st["mn"], st["mx"]
    if mn is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    span = (mx - mn) or 1
    v = F.col(value)
    b = F.least(F.floor((v - F.lit(mn)) * bins / F.lit(span)), F.lit(bins - 1)).cast("int")
    w = F.lit(1) if weight is None else F.col(weight)
    width = span / bins
    return (df.where(v.isNotNull()).groupBy(b.alias("bin")).agg(F.sum(w).cast("long").alias("n"))
              .withColumn("lower", F.lit(float(mn)) + F.col("bin") * F.lit(float(width)))
              .withColumn("upper", F.lit(float(mn)) + (F.col("bin") + 1) * F.lit(float(width)))
              .select("bin", "lower", "upper", "n"))
