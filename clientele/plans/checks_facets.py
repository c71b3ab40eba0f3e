"""Checked queries: filters, facets, KPI rows, group stats, profiles, unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele.operators import facets as A
from clientele.operators import rfm as R
from clientele.plans.checks_rfm import rfm_sql
from clientele.plans.registry import register
from clientele.sources import readers as IO
from clientele.sources import views as V

SNAP = V.SNAPSHOT_AFTER
SEGS = ["Champion", "Loyal", "At risk", "Cant lose them"]


def _rfm(spark, d):
    return R.rfm(V.visits(spark, d), SNAP, V.members(spark, d))


@register("f05_member_filters", rfm_sql() + """SELECT cust_norm, status, rfm_class, monetary_value FROM rfm
  WHERE status IN ('Member') AND rfm_class IN ('Champion', 'Loyal', 'At risk', 'Cant lose them')""")
def f05_member_filters(spark, d):
    """membership filters from a spec; an empty list means no filter."""
    f = A.apply_filters(_rfm(spark, d), members={"status": ["Member"], "rfm_class": SEGS, "r_score": []})
    return f.select("cust_norm", "status", "rfm_class", "monetary_value")


@register("f06_range_filters", rfm_sql() + """SELECT cust_norm, recency_days, frequency, monetary_value FROM rfm
  WHERE recency_days >= 0 AND recency_days <= 365 AND frequency >= 2 AND frequency <= 10
    AND monetary_value >= 1000000""")
def f06_range_filters(spark, d):
    """F6 (C2): inclusive ranges; an open bound is no filter; nulls drop."""
    f = A.apply_filters(_rfm(spark, d), ranges={"recency_days": (0, 365), "frequency": (2, 10),
                                                  "monetary_value": (1000000, None)})
    return f.select("cust_norm", "recency_days", "frequency", "monetary_value")


@register("f14_facet_values", rfm_sql() + "SELECT DISTINCT rfm_class FROM rfm WHERE rfm_class IS NOT NULL")
def f14_facet_values(spark, d):
    return A.facet_values(_rfm(spark, d), "rfm_class")


@register("f14_facet_ranges", rfm_sql() + """SELECT CAST(trunc(min(monetary_value)) AS BIGINT) AS monetary_value_min,
    CAST(trunc(max(monetary_value)) AS BIGINT) AS monetary_value_max,
    CAST(min(recency_days) AS BIGINT) AS recency_days_min, CAST(max(recency_days) AS BIGINT) AS recency_days_max,
    CAST(min(frequency) AS BIGINT) AS frequency_min, CAST(max(frequency) AS BIGINT) AS frequency_max FROM rfm""")
def f14_facet_ranges(spark, d):
    """integer-truncated slider bounds."""
    return A.facet_ranges(_rfm(spark, d), ["monetary_value", "recency_days", "frequency"])


@register("a13_kpi_row", rfm_sql() + """SELECT count(DISTINCT cust_norm) AS n_customers,
    CAST(sum(monetary_value) AS DECIMAL(38,2)) AS total_spent,
    CAST(sum(recency_days) AS DOUBLE) / count(recency_days) AS avg_recency,
    CAST(sum(frequency) AS DOUBLE) / count(frequency) AS avg_frequency,
    CAST(sum(monetary_value) AS DOUBLE) / count(monetary_value) AS avg_monetary
  FROM rfm WHERE status = 'Member'""")
def a13_kpi_row(spark, d):
    """The KPI row of the filtered customers."""
    f = A.apply_filters(_rfm(spark, d), members={"status": ["Member"]})
    return A.kpi_row(f, spend="monetary_value")


@register("a09_group_stats", rfm_sql() + """SELECT rfm_class, status, count(*) AS n_rows,
    CAST(sum(monetary_value) AS DECIMAL(38,2)) AS sum_spent,
    CAST(sum(monetary_value) AS DOUBLE) / count(monetary_value) AS avg_spent,
    count(DISTINCT cust_norm) AS n_distinct FROM rfm GROUP BY 1, 2""")
def a09_group_stats(spark, d):
    """Count, sum, mean and distinct count per (segment, status)."""
    return A.group_stats(_rfm(spark, d), ["rfm_class", "status"], spend="monetary_value")


@register("a11_avg_spend_by_segment", rfm_sql() + """SELECT rfm_class,
    CAST(sum(monetary_value) AS DOUBLE) / count(monetary_value) AS avg_spent FROM rfm GROUP BY 1""")
def a11_avg_spend_by_segment(spark, d):
    g = A.group_stats(_rfm(spark, d), ["rfm_class"], spend="monetary_value")
    return g.select("rfm_class", "avg_spent")


@register("a10_spend_by_status", rfm_sql() + """SELECT status, CAST(sum(monetary_value) AS DECIMAL(38,2)) AS sum_spent
  FROM rfm GROUP BY 1""")
def a10_spend_by_status(spark, d):
    g = A.group_stats(_rfm(spark, d), ["status"], spend="monetary_value")
    return g.select("status", "sum_spent")


@register("a12_distinct_per_month", V.with_views("tx") + """SELECT strftime(tx_date, '%Y') AS year,
    count(DISTINCT customer) AS n_customers FROM tx GROUP BY 1""")
def a12_distinct_per_month(spark, d):
    """Exact distinct customers per year."""
    t = V.tx(spark, d)
    return t.groupBy(F.date_format("tx_date", "yyyy").alias("year")).agg(
        F.countDistinct("customer").alias("n_customers"))


@register("f12_customer_lookup", V.with_views("member_profile") + """SELECT * FROM member_profile
  WHERE name || ' (' || CAST(member_no AS VARCHAR) || ')' = 'Customer#000000007 (7)'""")
def f12_customer_lookup(spark, d):
    """detail record by display label 'name (code)'; last row wins."""
    p = V.member_profile(spark, d)
    label = F.concat(F.col("name"), F.lit(" ("), F.col("member_no").cast("string"), F.lit(")"))
    return A.lookup_label(p, label, "Customer#000000007 (7)", "member_no")


@register("a22_column_profile", V.with_views("tx") + """SELECT * FROM (
  SELECT 'tx_date' AS column_name, CAST(min(tx_date) AS VARCHAR) AS min_value, CAST(max(tx_date) AS VARCHAR) AS max_value,
    count(tx_date) AS n_values, count(*) FILTER (WHERE tx_date IS NULL) AS n_nulls FROM tx
  UNION ALL SELECT 'total_price', CAST(min(total_price) AS VARCHAR), CAST(max(total_price) AS VARCHAR),
    count(total_price), count(*) FILTER (WHERE total_price IS NULL) FROM tx
  UNION ALL SELECT 'item', min(item), max(item), count(item), count(*) FILTER (WHERE item IS NULL) FROM tx)""")
def a22_column_profile(spark, d):
    """Min / max / count / null count of several columns in one pass."""
    return A.profile(V.tx(spark, d), ["tx_date", "total_price", "item"])


@register("a23_rows_per_year", V.with_views("tx") + """SELECT CAST(year(tx_date) AS INTEGER) AS year, count(*) AS n_rows FROM tx
  WHERE tx_date IS NOT NULL GROUP BY 1""")
def a23_rows_per_year(spark, d):
    return A.rows_per_year(V.tx(spark, d), "tx_date")


@register("q02_range_alerts", V.with_views("tx") + """SELECT min(tx_date) AS min_date, max(tx_date) AS max_date,
    count(*) FILTER (WHERE tx_date > DATE '2000-12-31') AS n_after_max,
    count(*) FILTER (WHERE year(tx_date) < 1996) AS n_before_min_year FROM tx""")
def q02_range_alerts(spark, d):
    """Q2: rows after an expected last date / before a first year (parameters)."""
    from clientele.operators.quality import range_alerts
    return range_alerts(V.tx(spark, d), "tx_date", expected_max="2000-12-31", min_year=1996)


@register("t10_head_rows", V.with_views("visits") + "SELECT row_id, customer, tx_date FROM visits ORDER BY row_id LIMIT 5")
def t10_head_rows(spark, d):
    """First rows in file order (a head sample: the limit is the feature)."""
    return V.visits(spark, d).orderBy("row_id").limit(5).select("row_id", "customer", "tx_date")


@register("a17_distinct_rows", V.with_views("tx") + "SELECT DISTINCT customer, item FROM tx")
def a17_distinct_rows(spark, d):
    return V.tx(spark, d).select("customer", "item").distinct()


@register("f02_dropna", V.with_views("member_records") + """SELECT no, address FROM member_records
  WHERE address IS NOT NULL AND delivery IS NOT NULL""")
def f02_dropna(spark, d):
    r = V.member_records(spark, d).dropna(subset=["address", "delivery"])
    return r.select("no", "address")


@register("f04_date_between", V.with_views("visits") + """SELECT row_id, tx_date FROM visits
  WHERE tx_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'""")
def f04_date_between(spark, d):
    v = V.visits(spark, d)
    return v.where(F.col("tx_date").between(F.lit("1999-01-01").cast("date"),
                                            F.lit("1999-12-31").cast("date"))).select("row_id", "tx_date")


@register("f09_positive_values", V.with_views("events_tx") + """SELECT row_id, total_price FROM events_tx
  WHERE total_price > 0""")
def f09_positive_values(spark, d):
    return V.events_tx(spark, d).where(F.col("total_price") > 0).select("row_id", "total_price")


@register("p01_select_rename_drop", rfm_sql() + """SELECT customer AS "NAMA CUSTOMER", monetary_value AS total_spent,
    status, recency_days, frequency FROM rfm""")
def p01_select_rename_drop(spark, d):
    """Column selection and order, renames (names with spaces), drops."""
    r = _rfm(spark, d).drop("item_summary", "no_such_column")
    r = r.withColumnRenamed("customer", "NAMA CUSTOMER").withColumnRenamed("monetary_value", "total_spent")
    return r.select("NAMA CUSTOMER", "total_spent", "status", "recency_days", "frequency")


@register("p04_insert_after", V.with_views("bracket_names") + """SELECT member_no, name,
    regexp_extract(coalesce(name, 'nan'), '\\(VIP\\s*(\\d+)\\)', 1, 'i') AS vip FROM bracket_names""")
def p04_insert_after(spark, d):
    """A derived column placed right after ``name``."""
    from clientele.functions.text import vip_level
    from clientele.sources.schemas import insert_after
    b = V.bracket_names(spark, d).withColumn("vip", vip_level("name"))
    return insert_after(b.select("vip", "member_no", "name"), "name", ["vip"])


@register("p15_casts", V.with_views("member_profile") + """SELECT member_no, CAST(vip AS INTEGER) AS vip_level,
    CAST(member_no AS VARCHAR) AS code FROM member_profile""")
def p15_casts(spark, d):
    p = V.member_profile(spark, d)
    return p.select("member_no", F.col("vip").try_cast("int").alias("vip_level"),
                    F.col("member_no").cast("string").alias("code"))


@register("u01_union_by_name", V.with_views("tx", "visits") + """SELECT 'lines' AS src, count(*) AS n_rows,
    count(qty) AS n_qty FROM tx UNION ALL SELECT 'orders', count(*), 0 FROM visits""")
def u01_union_by_name(spark, d):
    """Union all aligned by name; a column absent on one side is null."""
    a = V.tx(spark, d).select("customer", "tx_date", "qty").withColumn("src", F.lit("lines"))
    b = V.visits(spark, d).select("tx_date", "customer").withColumn("src", F.lit("orders"))
    u = IO.union_by_name([a, b])
    return u.groupBy("src").agg(F.count(F.lit(1)).alias("n_rows"), F.count("qty").alias("n_qty"))


@register("u03_single_pass_split", V.with_views("visits") + """SELECT CASE WHEN total_price > 200000 THEN 'large'
    ELSE 'small' END AS part, count(*) AS n_rows FROM visits GROUP BY 1""")
def u03_single_pass_split(spark, d):
    """The split-enrich-union of two halves as one pass with ``when``."""
    v = V.visits(spark, d)
    part = F.when(F.col("total_price") > 200000, "large").otherwise("small")
    return v.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("s11_date_range", V.with_views("text_dates") + """SELECT min(true_date) AS min_date, max(true_date) AS max_date
  FROM text_dates""")
def s11_date_range(spark, d):
    """Date range of the parseable dates of a table (text dates parsed)."""
    from clientele.functions.dates import parse_any_date
    return IO.date_range(V.text_dates(spark, d), parse_any_date("date_text"))


@register("s04_pruned_read", """SELECT min(o_orderdate)::DATE AS min_date, max(o_orderdate)::DATE AS max_date
  FROM orders""")
def s04_pruned_read(spark, d):
    """A one-column read; the Parquet scan reads only that column."""
    o = IO.read_table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d"))
    return o.agg(F.min("d").alias("min_date"), F.max("d").alias("max_date"))


@register("s10_segment_table_join", rfm_sql() + """SELECT rfm_class AS classification, count(*) AS n_customers
  FROM rfm GROUP BY 1""")
def s10_segment_table_join(spark, d):
    """S10 + J2: the 27-row constant segment table joined (broadcast, fixed
    size) to the scored customers on (R, F, M)."""
    from clientele.functions.scores import segment_table_df
    seg = F.broadcast(segment_table_df(spark))
    r = _rfm(spark, d)
    j = r.join(seg, (r.r_score == seg.R) & (r.f_score == seg.F) & (r.m_score == seg.M), "left")
    return j.groupBy(F.coalesce(F.col("Classification"), F.lit("Undefined")).alias("classification")).agg(
        F.count(F.lit(1)).alias("n_customers"))


@register("p08_null_fill", V.with_views("members", "visits").rstrip() + ",\n" + __import__(
    "clientele.plans.checks_rfm", fromlist=["rfm_ctes"]).rfm_ctes("visits", V.SNAPSHOT_BEFORE) + """,
mem AS (SELECT member_no, name, """ + __import__("clientele.plans.registry", fromlist=["name_key_sql"]).name_key_sql("name") + """ AS cust_norm FROM members)
SELECT member_no, name, CAST(coalesce(monetary_value, 0) AS DECIMAL(38,2)) AS monetary_value,
    CAST(coalesce(recency_days, 0) AS BIGINT) AS recency_days, coalesce(rfm_class, 'Undefined') AS rfm_class
  FROM mem LEFT JOIN rfm USING (cust_norm)""")
def p08_null_fill(spark, d):
    """P8 + J3: every member with the earlier snapshot's metrics; members
    without purchases by then get 0 / 'Undefined'."""
    from clientele.functions.text import name_key
    mem = V.members(spark, d).withColumn("cust_norm", name_key("name"))
    r = R.rfm(V.visits(spark, d), V.SNAPSHOT_BEFORE, V.members(spark, d))
    j = mem.join(r.select("cust_norm", "monetary_value", "recency_days", "rfm_class"), "cust_norm", "left")
    return j.select("member_no", "name",
                    F.coalesce("monetary_value", F.lit(0).cast("decimal(38,2)")).cast("decimal(38,2)").alias("monetary_value"),
                    F.coalesce("recency_days", F.lit(0)).cast("long").alias("recency_days"),
                    F.coalesce("rfm_class", F.lit("Undefined")).alias("rfm_class"))


@register("p08_max_fill", V.with_views("members", "visits").rstrip() + ",\n" + __import__(
    "clientele.plans.checks_rfm", fromlist=["rfm_ctes"]).rfm_ctes("visits", "1995-06-30") + """,
mem AS (SELECT member_no, """ + __import__("clientele.plans.registry", fromlist=["name_key_sql"]).name_key_sql("name") + """ AS cust_norm FROM members),
j AS (SELECT member_no, monetary_value, frequency, recency_days FROM mem LEFT JOIN rfm USING (cust_norm))
SELECT member_no, CAST(coalesce(monetary_value, 0) AS DECIMAL(38,2)) AS monetary_value, CAST(coalesce(frequency, 0) AS BIGINT) AS frequency,
    CAST(coalesce(recency_days, (SELECT max(recency_days) FROM j), 0) AS BIGINT) AS recency_days FROM j""")
def p08_max_fill(spark, d):
    """Members at an early snapshot; those without purchases get the largest recency."""
    from clientele.functions.text import name_key
    mem = V.members(spark, d).select("member_no", name_key("name").alias("cust_norm"))
    r = R.rfm(V.visits(spark, d), "1995-06-30").select("cust_norm", "monetary_value", "frequency", "recency_days")
    return R.fill_metrics(mem.join(r, "cust_norm", "left").drop("cust_norm"))


@register("j08_scores_to_profile", rfm_sql() + """, sc AS (SELECT cust_norm,
    CASE WHEN frequency > 1 THEN CAST(1 AS DOUBLE) / frequency ELSE CAST(1 AS DOUBLE) END AS score FROM rfm
    WHERE status = 'Member')
SELECT r.cust_norm, r.rfm_class, coalesce(sc.score, CAST(0 AS DOUBLE)) AS score
  FROM rfm r LEFT JOIN sc USING (cust_norm)""")
def j08_scores_to_profile(spark, d):
    """Per-customer predictions left-joined to the profile, a
    customer without one gets 0 (scores here: 1 / visits, members only)."""
    r = _rfm(spark, d)
    sc = (r.where(F.col("status") == "Member")
           .select("cust_norm", F.when(F.col("frequency") > 1, 1.0 / F.col("frequency")).otherwise(1.0).alias("score")))
    return r.select("cust_norm", "rfm_class").join(sc, "cust_norm", "left").fillna(0.0, subset=["score"])


@register("t01_sorted_report", rfm_sql() + """SELECT cust_norm, monetary_value, recency_days FROM rfm
  ORDER BY monetary_value DESC, recency_days, cust_norm""")
def t01_sorted_report(spark, d):
    """The report sorted by several keys (a global sort: range-partitioned
    by Spark, not gathered into one task)."""
    r = _rfm(spark, d)
    return r.orderBy(F.col("monetary_value").desc(), "recency_days", "cust_norm").select(
        "cust_norm", "monetary_value", "recency_days")


@register("t02_restore_order", V.with_views("visits") + """SELECT row_id, customer,
    CASE WHEN total_price > 200000 THEN 'large' ELSE 'small' END AS part
  FROM (SELECT row_id, customer, CASE WHEN row_id % 9 <> 0 THEN total_price END AS total_price FROM visits) ORDER BY row_id""")
def t02_restore_order(spark, d):
    """Two enriched halves put back in input order (by row_id)."""
    v = V.visits(spark, d).withColumn("total_price", F.when(F.col("row_id") % 9 != 0, F.col("total_price")))  # some are null
    big = v.where(F.col("total_price") > 200000).withColumn("part", F.lit("large"))
    small = v.where(~F.coalesce(F.col("total_price") > 200000, F.lit(False))).withColumn("part", F.lit("small"))  # a null price too
    return big.unionByName(small).orderBy("row_id").select("row_id", "customer", "part")


@register("x23_score_order", rfm_sql() + """SELECT r_score,
    CASE r_score WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 END AS r_rank,
    count(*) AS n_customers FROM rfm GROUP BY 1, 2""")
def x23_score_order(spark, d):
    """Low < Medium < High as 1, 2, 3."""
    from clientele.functions.scores import score_rank
    r = _rfm(spark, d)
    return r.groupBy("r_score", score_rank("r_score").alias("r_rank")).agg(F.count(F.lit(1)).alias("n_customers"))


@register("x29_rounding", rfm_sql() + """SELECT cust_norm,
    CAST(round(monetary_value, 1) AS DECIMAL(38,1)) AS spent_1dp,
    CAST(round(monetary_value, -3) AS DECIMAL(38,0)) AS spent_thousands FROM rfm""")
def x29_rounding(spark, d):
    """Decimal rounding of money (half up on exact decimals)."""
    r = _rfm(spark, d)
    return r.select("cust_norm", F.round("monetary_value", 1).cast("decimal(38,1)").alias("spent_1dp"),
                    F.round("monetary_value", -3).cast("decimal(38,0)").alias("spent_thousands"))


@register("q04_all_null_columns", V.with_views("member_records") + """SELECT count(birth_date) = 0 AS birth_date_all_null,
    count(address) = 0 AS address_all_null, count(delivery) = 0 AS delivery_all_null FROM member_records""")
def q04_all_null_columns(spark, d):
    """Q4: required columns present (raises otherwise) and all-null flags."""
    from clientele.sources.schemas import all_null_columns, require_columns
    r = V.member_records(spark, d)
    require_columns(r, ["no", "name", "birth_date", "address"])
    return all_null_columns(r, ["birth_date", "address", "delivery"])


@register("q06_scatter_rows", rfm_sql() + """SELECT cust_norm, recency_days, frequency FROM rfm
  WHERE status = 'Member'""")
def q06_scatter_rows(spark, d):
    """Q6: every row of the scatter table, whatever their number."""
    from clientele.operators.quality import scatter_rows
    r = _rfm(spark, d).where(F.col("status") == "Member")
    return scatter_rows(r)
