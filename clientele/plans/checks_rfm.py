"""Checked queries: snapshot RFM, rule scores, segments, member flag."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele.functions import scores as S
from clientele.operators import rfm as R
from clientele.plans.registry import name_key_sql, register
from clientele.sources import views as V

SNAP = V.SNAPSHOT_AFTER


# ------------------------------------------------------------- SQL helpers
def segment_case_sql(r="r_score", f="f_score", m="m_score", missing="'Undefined'") -> str:
    whens = " ".join(f"WHEN '{a}|{b}|{c}' THEN '{seg}'" for a, b, c, seg in S.SEGMENT_TABLE)
    return f"CASE {r} || '|' || {f} || '|' || {m} {whens} ELSE {missing} END"


def rules_sql(k: S.RuleCutoffs = S.DEFAULT_CUTOFFS) -> dict[str, str]:
    return {
        "r": f"CASE WHEN recency_days < {k.r_high} THEN 'High' WHEN recency_days <= {k.r_medium} "
             f"THEN 'Medium' ELSE 'Low' END",
        "f": f"CASE WHEN total_items > {k.f_high} THEN 'High' WHEN total_items >= {k.f_medium} "
             f"THEN 'Medium' ELSE 'Low' END",
        "m": f"CASE WHEN monetary_value > {int(k.m_high)} THEN 'High' WHEN monetary_value >= "
             f"{int(k.m_medium)} THEN 'Medium' ELSE 'Low' END",
    }


def rfm_ctes(view: str = "visits", snapshot: str = SNAP, next_day: bool = True, offset: int = 2,
             members: bool = True, prefix: str = "") -> str:
    """CTE chain (no leading WITH) ending in ``{prefix}rfm`` with ``rfm()``'s columns."""
    p = prefix
    cut = f"DATE '{snapshot}' + {1 if next_day else 0}"
    ref = f"DATE '{snapshot}' + {offset}"
    rules = rules_sql()
    member_join = (f"LEFT JOIN (SELECT DISTINCT {name_key_sql('name')} AS cust_norm, TRUE AS _m "
                   f"FROM members) mk USING (cust_norm)") if members else ""
    status = "CASE WHEN _m THEN 'Member' ELSE 'Non-Member' END" if members else "'Non-Member'"
    return f"""{p}cut AS (SELECT * FROM {view} WHERE tx_date <= {cut}),
{p}base AS (SELECT {name_key_sql('customer')} AS cust_norm,
    CAST({ref} - max(tx_date) AS BIGINT) AS recency_days,
    count(DISTINCT tx_date) AS frequency,
    CAST(sum(coalesce(TRY_CAST(total_price AS DECIMAL(38,2)), 0)) AS DECIMAL(38,2)) AS monetary_value,
    arg_min(customer, row_id) FILTER (WHERE customer IS NOT NULL) AS customer
  FROM {p}cut GROUP BY 1),
{p}per_item AS (SELECT cust_norm, item_norm, count(*) AS n FROM (
    SELECT {name_key_sql('customer')} AS cust_norm, {name_key_sql('item')} AS item_norm FROM {p}cut)
  WHERE item_norm <> '' GROUP BY 1, 2),
{p}items AS (SELECT cust_norm, CAST(sum(n) AS BIGINT) AS total_items,
    string_agg(item_norm || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY item_norm) AS item_summary
  FROM {p}per_item GROUP BY 1),
{p}scored AS (SELECT b.cust_norm, b.customer, b.monetary_value, b.recency_days, b.frequency,
    coalesce(i.total_items, 0) AS total_items, coalesce(i.item_summary, '') AS item_summary
  FROM {p}base b LEFT JOIN {p}items i USING (cust_norm)),
{p}scored2 AS (SELECT *, {rules['r']} AS r_score, {rules['f']} AS f_score, {rules['m']} AS m_score
  FROM {p}scored),
{p}rfm AS (SELECT cust_norm, customer, monetary_value, {status} AS status, recency_days,
    frequency, total_items, r_score, f_score, m_score,
    {segment_case_sql()} AS rfm_class, item_summary
  FROM {p}scored2 {member_join})
"""


def rfm_sql(view="visits", snapshot=SNAP, members=True, **kw) -> str:
    views = [view, "members"] if members else [view]
    return V.with_views(*views).rstrip() + ",\n" + rfm_ctes(view, snapshot, members=members, **kw)


def _visits_rfm(spark, d, snapshot=SNAP):
    return R.rfm(V.visits(spark, d), snapshot, V.members(spark, d))


# ------------------------------------------------------------- queries
@register("x22_rule_scores", rfm_sql() + "SELECT * FROM rfm")
def x22_rule_scores(spark, d):
    """Full snapshot RFM on the visits view: rule scores, segment, status, items."""
    return _visits_rfm(spark, d)


@register("a01_rfm_base", V.with_views("visits") + f"""SELECT {name_key_sql('customer')} AS cust_norm,
    CAST(DATE '{SNAP}' + 2 - max(tx_date) AS BIGINT) AS recency_days,
    count(DISTINCT tx_date) AS frequency,
    CAST(sum(total_price) AS DECIMAL(38,2)) AS monetary_value,
    arg_min(customer, row_id) FILTER (WHERE customer IS NOT NULL) AS customer
  FROM visits WHERE tx_date <= DATE '{SNAP}' + 1 GROUP BY 1""")
def a01_rfm_base(spark, d):
    cut = R.as_of(V.visits(spark, d), SNAP)
    return R.rfm_base(cut, F.date_add(F.lit(SNAP).cast("date"), 2))


@register("a01_rfm_base_timestamps", V.with_views("events_tx") + f"""SELECT {name_key_sql('customer')} AS cust_norm,
    CAST(floor(epoch(TIMESTAMP '2024-01-22 00:00:00' - max(tx_ts)) / 86400) AS BIGINT) AS recency_days,
    count(DISTINCT tx_ts) AS frequency,
    CAST(sum(total_price) AS DECIMAL(38,2)) AS monetary_value,
    arg_min(customer, row_id) FILTER (WHERE customer IS NOT NULL) AS customer
  FROM events_tx WHERE tx_ts <= TIMESTAMP '2024-01-21 00:00:00' GROUP BY 1""")
def a01_rfm_base_timestamps(spark, d):
    """A1 + X20 on real times: frequency counts distinct timestamps; recency
    floors the time between the last purchase and the reference midnight."""
    cut = R.as_of(V.events_tx(spark, d), "2024-01-20", date_col="tx_ts")
    return R.rfm_base(cut, F.date_add(F.lit("2024-01-20").cast("date"), 2), date_col="tx_ts")


@register("a02_item_count", rfm_sql("tx") + "SELECT cust_norm, total_items FROM rfm")
def a02_item_count(spark, d):
    return R.rfm(V.tx(spark, d), SNAP, V.members(spark, d)).select("cust_norm", "total_items")


@register("a03_item_summary", rfm_sql("tx") + "SELECT cust_norm, total_items, item_summary FROM rfm")
def a03_item_summary(spark, d):
    return R.item_summary(R.as_of(V.tx(spark, d), SNAP)).select("cust_norm", "total_items", "item_summary")


@register("a04_first_name", V.with_views("dirty_tx") + f"""SELECT {name_key_sql('customer')} AS cust_norm,
    arg_min(customer, row_id) FILTER (WHERE customer IS NOT NULL) AS customer FROM dirty_tx GROUP BY 1""")
def a04_first_name(spark, d):
    """A4 on messy names: first non-null display name in row order per key."""
    base = R.rfm_base(V.dirty_tx(spark, d), F.lit(SNAP).cast("date"))
    return base.select("cust_norm", "customer")


@register("f03_as_of_cut", V.with_views("tx") + """SELECT count(*) AS n_rows,
    CAST(sum(total_price) AS DECIMAL(38,2)) AS total FROM tx WHERE tx_date <= DATE '1998-06-30' + 1""")
def f03_as_of_cut(spark, d):
    cut = R.as_of(V.tx(spark, d), V.SNAPSHOT_BEFORE)
    return cut.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("total_price").cast("decimal(38,2)").alias("total"))


@register("j02_segment_lookup", rfm_sql() + """SELECT r_score, f_score, m_score, rfm_class,
    count(*) AS n_customers FROM rfm GROUP BY ALL""")
def j02_segment_lookup(spark, d):
    return (_visits_rfm(spark, d).groupBy("r_score", "f_score", "m_score", "rfm_class")
            .agg(F.count(F.lit(1)).alias("n_customers")))


@register("a08_segment_counts", rfm_sql() + """SELECT rfm_class, count(*) AS n_customers,
    count(*) * 100.0 / sum(count(*)) OVER () AS percent FROM rfm GROUP BY 1""")
def a08_segment_counts(spark, d):
    return R.segment_counts(_visits_rfm(spark, d))


@register("p13_segment_share_members", rfm_sql() + """SELECT rfm_class, count(*) AS n_customers,
    count(*) * 100.0 / sum(count(*)) OVER () AS percent FROM rfm
    WHERE status = 'Member' GROUP BY 1""")
def p13_segment_share_members(spark, d):
    """P13 + F13: segment share among members only (status filter first)."""
    return R.segment_counts(_visits_rfm(spark, d).where(F.col("status") == "Member"))


@register("j10_member_flag", rfm_sql() + """SELECT status, count(*) AS n_customers,
    CAST(sum(monetary_value) AS DECIMAL(38,2)) AS total_spent FROM rfm GROUP BY 1""")
def j10_member_flag(spark, d):
    return (_visits_rfm(spark, d).groupBy("status")
            .agg(F.count(F.lit(1)).alias("n_customers"),
                 F.sum("monetary_value").cast("decimal(38,2)").alias("total_spent")))


@register("x01_name_key", V.with_views("dirty_tx") + f"""SELECT {name_key_sql('customer')} AS cust_norm,
    count(*) AS n_rows FROM dirty_tx GROUP BY 1""")
def x01_name_key(spark, d):
    from clientele.functions.text import name_key
    return (V.dirty_tx(spark, d).groupBy(name_key("customer").alias("cust_norm"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


@register("c01_rfm_dirty_before", rfm_sql("dirty_tx", V.SNAPSHOT_BEFORE) + "SELECT * FROM rfm")
def c01_rfm_dirty_before(spark, d):
    """Full RFM over messy names at the earlier snapshot: names collapse to one key."""
    return R.rfm(V.dirty_tx(spark, d), V.SNAPSHOT_BEFORE, V.members(spark, d))
