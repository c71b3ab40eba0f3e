"""Checked queries: cohorts, monthly series, decomposition, purchase gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele.operators import cohort as C
from clientele.operators import series as T
from clientele.plans.registry import name_key_nan_sql, register
from clientele.sources import views as V

COHORT_SQL = V.with_views("tx").rstrip() + f""",
t AS (SELECT {name_key_nan_sql('customer')} AS cust, year(tx_date) * 12 + month(tx_date) - 1 AS mi
  FROM tx WHERE tx_date IS NOT NULL),
f AS (SELECT cust, min(mi) AS ci FROM t GROUP BY 1),
r AS (SELECT t.cust, t.mi, f.ci, CAST(t.mi - f.ci AS INTEGER) AS cohort_index FROM t JOIN f USING (cust)),
counts AS (SELECT printf('%04d-%02d', ci // 12, ci % 12 + 1) AS cohort_month, cohort_index,
    count(DISTINCT cust) AS n_customers FROM r GROUP BY ci, cohort_index),
grid AS (SELECT c.cohort_month, i.cohort_index FROM (SELECT DISTINCT cohort_month FROM counts) c,
    (SELECT DISTINCT cohort_index FROM counts) i),
dense AS (SELECT g.cohort_month, g.cohort_index, CAST(coalesce(n_customers, 0) AS BIGINT) AS n_customers
  FROM grid g LEFT JOIN counts USING (cohort_month, cohort_index))
"""


@register("w01_cohort_rows", COHORT_SQL + """SELECT printf('%04d-%02d', ci // 12, ci % 12 + 1) AS cohort_month,
    cohort_index, count(*) AS n_rows FROM r GROUP BY ALL""")
def w01_cohort_rows(spark, d):
    """W1 + W2: per row cohort month and index, summarised per cell."""
    rows = C.cohort_rows(V.tx(spark, d))
    return (rows.groupBy(F.date_format("cohort", "yyyy-MM").alias("cohort_month"), "cohort_index")
            .agg(F.count(F.lit(1)).alias("n_rows")))


@register("w01_hot_customer", COHORT_SQL.replace("FROM tx", "FROM hot_tx").replace(V.with_views("tx").rstrip(), V.with_views("hot_tx").rstrip())
          + """SELECT printf('%04d-%02d', ci // 12, ci % 12 + 1) AS cohort_month,
    cohort_index, count(*) AS n_rows FROM r GROUP BY ALL""")
def w01_hot_customer(spark, d):
    """W1 + W2 where one customer holds a third of the rows: they are dealt to parts."""
    rows = C.cohort_rows(V.hot_tx(spark, d))
    return (rows.groupBy(F.date_format("cohort", "yyyy-MM").alias("cohort_month"), "cohort_index")
            .agg(F.count(F.lit(1)).alias("n_rows")))


@register("a19_cohort_matrix", COHORT_SQL + "SELECT * FROM dense")
def a19_cohort_matrix(spark, d):
    """A19 in its wide form, read back cell by cell."""
    wide = C.cohort_matrix(C.cohort_counts(C.cohort_months(V.tx(spark, d)), materialized=True))
    return (wide.unpivot("cohort_month", [c for c in wide.columns if c != "cohort_month"], "i", "n_customers")
            .select("cohort_month", F.col("i").cast("int").alias("cohort_index"), "n_customers"))


@register("a18_cohort_counts", COHORT_SQL + "SELECT * FROM counts")
def a18_cohort_counts(spark, d):
    return C.cohort_counts(C.cohort_months(V.tx(spark, d)))


@register("a19_cohort_pivot_cells", COHORT_SQL + "SELECT * FROM dense")
def a19_cohort_pivot_cells(spark, d):
    """The cells of the cohort x index pivot, absent cells 0."""
    return C.cohort_dense(C.cohort_counts(C.cohort_months(V.tx(spark, d)), materialized=True))


@register("w06_retention", COHORT_SQL + """, size AS (SELECT cohort_month, n_customers AS cohort_size
    FROM dense WHERE cohort_index = 0)
SELECT cohort_month, cohort_index, n_customers, cohort_size,
    CASE WHEN cohort_size > 0 THEN n_customers / cohort_size ELSE 0.0 END AS retention,
    strftime(CAST(cohort_month || '-01' AS DATE), '%b %Y') || ' (N=' || CAST(cohort_size AS VARCHAR) || ')' AS cohort_label
  FROM dense JOIN size USING (cohort_month)""")
def w06_retention(spark, d):
    return C.retention(C.cohort_counts(C.cohort_months(V.tx(spark, d)), materialized=True))


@register("a14_monthly_revenue", V.with_views("tx") + """SELECT strftime(tx_date, '%Y-%m') AS month,
    CAST(sum(total_price) AS DECIMAL(38,2)) AS revenue FROM tx WHERE tx_date IS NOT NULL GROUP BY 1""")
def a14_monthly_revenue(spark, d):
    return T.monthly_revenue(V.tx(spark, d))


@register("a15_monthly_visits", V.with_views("tx") + f"""SELECT strftime(d, '%Y-%m') AS month, count(*) AS visits
  FROM (SELECT DISTINCT tx_date AS d, {name_key_nan_sql('customer')} AS cust FROM tx WHERE tx_date IS NOT NULL)
  GROUP BY 1""")
def a15_monthly_visits(spark, d):
    return T.monthly_visits(V.tx(spark, d))


@register("w14_decomposition", V.with_views("tx") + """, mr AS (SELECT strftime(tx_date, '%Y-%m') AS month,
    CAST(sum(total_price) AS DECIMAL(38,2)) AS revenue FROM tx WHERE tx_date IS NOT NULL GROUP BY 1),
s AS (SELECT month, revenue, CAST(revenue * 100 AS HUGEINT) AS x, CAST(row_number() OVER (ORDER BY month) - 1 AS INTEGER) AS t,
    count(*) OVER () AS n FROM mr),
tr AS (SELECT *, t % 12 AS pos, CASE WHEN t >= 6 AND t < n - 6 THEN
    CAST(sum(x) OVER (ORDER BY t ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) * 2
         - lag(x, 6) OVER (ORDER BY t) - lead(x, 6) OVER (ORDER BY t) AS HUGEINT) END AS around FROM s),
dt AS (SELECT *, x * 24 - around AS off FROM tr),
c AS (SELECT pos, CAST(sum(off) AS HUGEINT) AS total, count(off) AS k FROM dt GROUP BY 1),
l AS (SELECT CASE WHEN min(k) = max(k) THEN min(k) ELSE min(k) * max(k) END AS common FROM c),
ph AS (SELECT pos, common, total * (common // k) AS mean FROM c, l),
pc AS (SELECT pos, common, mean * 12 - CAST(sum(mean) OVER () AS HUGEINT) AS season FROM ph)
SELECT month, CAST(revenue AS DOUBLE) AS observed, CAST(around AS DOUBLE) / 2400 AS trend,
    CAST(season AS DOUBLE) / (CAST(100 * 24 * 12 AS BIGINT) * common) AS seasonal,
    CAST(off * (common * 12) - season AS DOUBLE) / (CAST(100 * 24 * 12 AS BIGINT) * common) AS resid
  FROM dt JOIN pc USING (pos)""")
def w14_decomposition(spark, d):
    """W14 on the monthly revenue series (period 12 for >= 24 months)."""
    return T.decompose(T.monthly_revenue(V.tx(spark, d)), "month", "revenue")


GAPS_SQL = V.with_views("tx").rstrip() + f""",
days AS (SELECT {name_key_nan_sql('customer')} AS cust, tx_date AS d, count(*) AS k FROM tx
  WHERE tx_date IS NOT NULL GROUP BY 1, 2),
g AS (SELECT *, CAST(d - lag(d) OVER (PARTITION BY cust ORDER BY d) AS BIGINT) AS gap FROM days),
u AS (SELECT CAST(0 AS BIGINT) AS gap_days, k - 1 AS n FROM g WHERE k > 1
      UNION ALL SELECT gap, 1 FROM g WHERE gap IS NOT NULL),
gaps AS (SELECT gap_days, CAST(sum(n) AS BIGINT) AS n_rows FROM u GROUP BY 1),
kept AS (SELECT * FROM gaps WHERE gap_days >= 0 AND gap_days < 1000)
"""


@register("w03_purchase_gaps", GAPS_SQL + "SELECT * FROM gaps")
def w03_purchase_gaps(spark, d):
    """W3 + W4: days between consecutive purchases per customer (multiset)."""
    return T.purchase_gaps(V.tx(spark, d))


@register("f10_gap_filter_mean", GAPS_SQL + """SELECT CAST(sum(gap_days * n_rows) AS DOUBLE) / CAST(sum(n_rows) AS DOUBLE)
    AS mean_gap_days, CAST(sum(n_rows) AS BIGINT) AS n_gaps FROM kept""")
def f10_gap_filter_mean(spark, d):
    kept = T.gap_filter(T.purchase_gaps(V.tx(spark, d)))
    return kept.agg((F.sum(F.col("gap_days") * F.col("n_rows")).cast("double") /
                     F.sum("n_rows").cast("double")).alias("mean_gap_days"),
                    F.sum("n_rows").cast("long").alias("n_gaps"))


@register("a24_gap_histogram", GAPS_SQL + """, st AS (SELECT min(gap_days) AS mn, max(gap_days) AS mx FROM kept)
SELECT CAST(least(floor((gap_days - mn) * 50 / (CASE WHEN mx > mn THEN mx - mn ELSE 1 END)), 49) AS INTEGER) AS bin,
    CAST(mn AS DOUBLE) + least(floor((gap_days - mn) * 50 / (CASE WHEN mx > mn THEN mx - mn ELSE 1 END)), 49)
        * (CAST(CASE WHEN mx > mn THEN mx - mn ELSE 1 END AS DOUBLE) / 50) AS lower,
    CAST(mn AS DOUBLE) + (least(floor((gap_days - mn) * 50 / (CASE WHEN mx > mn THEN mx - mn ELSE 1 END)), 49) + 1)
        * (CAST(CASE WHEN mx > mn THEN mx - mn ELSE 1 END AS DOUBLE) / 50) AS upper,
    CAST(sum(n_rows) AS BIGINT) AS n
  FROM kept, st GROUP BY 1, 2, 3""")
def a24_gap_histogram(spark, d):
    """50 equal-width bins of the filtered purchase gaps (weighted)."""
    kept = T.gap_filter(T.purchase_gaps(V.tx(spark, d)))
    return T.histogram(kept, "gap_days", 50, weight="n_rows")
