"""Checked queries: segment flow, stage movement, stage x recency mix."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele.operators import flows as W
from clientele.operators import rfm as R
from clientele.plans.checks_rfm import rfm_ctes
from clientele.plans.registry import register
from clientele.sources import views as V

B, A = V.SNAPSHOT_BEFORE, V.SNAPSHOT_AFTER


def two_snapshots_sql(view: str = "visits") -> str:
    return (V.with_views(view, "members").rstrip() + ",\n" + rfm_ctes(view, B, prefix="b_").rstrip()
            + ",\n" + rfm_ctes(view, A, prefix="a_").rstrip() + ",\n")


def pct_label_sql(n: str, total: str) -> str:
    t = f"CAST(floor(({n} * 2000 + {total}) / ({total} * 2)) AS BIGINT)"
    return (f"CAST({n} AS VARCHAR) || ' (' || CAST({t} // 10 AS VARCHAR) || '.' || "
            f"CAST({t} % 10 AS VARCHAR) || '%)'")


EDGES = """edges AS (SELECT a.cust_norm, coalesce(b.rfm_class, 'New Customer') AS old_category,
    a.rfm_class AS new_category FROM b_rfm b RIGHT JOIN a_rfm a ON a.cust_norm = b.cust_norm)
"""


def _both(spark, d):
    """Both snapshots from one scan of the transactions."""
    return R.rfm_snapshots(V.visits(spark, d), [B, A], V.members(spark, d))


def _edges(spark, d):
    return W.flow_edges_one_pass(_both(spark, d), B, A)


def _after(spark, d):
    return R.rfm(V.visits(spark, d), A, V.members(spark, d))


@register("j06_segment_flow", two_snapshots_sql() + EDGES + """SELECT cust_norm, old_category, new_category FROM edges""")
def j06_segment_flow(spark, d):
    return _edges(spark, d)


@register("x25_flow_links", two_snapshots_sql() + EDGES + f""", l AS (SELECT old_category, new_category,
    count(*) AS n_customers FROM edges GROUP BY 1, 2)
SELECT old_category, new_category, n_customers,
    n_customers * 100.0 / sum(n_customers) OVER (PARTITION BY old_category) AS pct_of_old,
    n_customers * 100.0 / sum(n_customers) OVER (PARTITION BY new_category) AS pct_of_new,
    {pct_label_sql('n_customers', 'sum(n_customers) OVER (PARTITION BY old_category)')} AS label
  FROM l""")
def x25_flow_links(spark, d):
    """X25 + P14: link shares and the 'n (p%)' label."""
    return W.flow_links(_edges(spark, d))


@register("x25_flow_nodes", two_snapshots_sql() + EDGES + """, o AS (SELECT old_category AS category,
    count(*) AS total_out FROM edges GROUP BY 1),
i AS (SELECT new_category AS category, count(*) AS total_in FROM edges GROUP BY 1)
SELECT coalesce(o.category, i.category) AS category, CAST(coalesce(total_out, 0) AS BIGINT) AS total_out,
    CAST(coalesce(total_in, 0) AS BIGINT) AS total_in,
    CASE WHEN coalesce(total_out, 0) > 0
         THEN (coalesce(total_in, 0) - coalesce(total_out, 0)) * 100.0 / coalesce(total_out, 0) END AS growth_pct
  FROM o FULL OUTER JOIN i ON o.category = i.category""")
def x25_flow_nodes(spark, d):
    return W.flow_nodes(_edges(spark, d))


_HUNDREDTHS = "CAST(floor(((total_in - total_out) * 20000 + total_out) / (total_out * 2)) AS BIGINT)"


@register("p14_node_text", two_snapshots_sql() + EDGES + f""", p AS (SELECT old_category, new_category, count(*) AS n FROM edges GROUP BY 1, 2),
o AS (SELECT old_category AS category, CAST(sum(n) AS BIGINT) AS total_out FROM p GROUP BY 1),
i AS (SELECT new_category AS category, CAST(sum(n) AS BIGINT) AS total_in FROM p GROUP BY 1),
f AS (SELECT new_category AS category, string_agg('from ' || old_category || ': ' || {pct_label_sql('n', 'total_in')}, '<br>' ORDER BY old_category) AS lines
  FROM p JOIN i ON new_category = i.category GROUP BY 1)
SELECT category, 'old' AS side, 'Old Category: ' || category || '<br>Total Out: ' || CAST(total_out AS VARCHAR) AS text FROM o
UNION ALL SELECT i.category, 'new', 'New Category: ' || i.category || '<br>Total In: ' || CAST(total_in AS VARCHAR) || '<br>Increase: '
    || CASE WHEN coalesce(total_out, 0) > 0 THEN CASE WHEN {_HUNDREDTHS} < 0 THEN '-' ELSE '' END || CAST(abs({_HUNDREDTHS}) // 100 AS VARCHAR)
       || '.' || lpad(CAST(abs({_HUNDREDTHS}) % 100 AS VARCHAR), 2, '0') || '%' ELSE 'N/A' END || '<br>Flows:<br>' || lines
  FROM i LEFT JOIN o ON i.category = o.category JOIN f ON f.category = i.category""")
def p14_node_text(spark, d):
    """The summary texts of the flow's nodes."""
    return W.node_text(_edges(spark, d))


MOVES = """sb AS (SELECT cust_norm, least(total_items, 24) AS fstage_before, r_score AS r_score_before FROM b_rfm),
sa AS (SELECT cust_norm, least(total_items, 24) AS fstage_after, r_score AS r_score_after FROM a_rfm),
mv AS (SELECT coalesce(sb.cust_norm, sa.cust_norm) AS cust_norm, fstage_before, r_score_before,
    fstage_after, r_score_after,
    CASE WHEN sa.cust_norm IS NOT NULL AND sb.cust_norm IS NOT NULL THEN 'both'
         WHEN sa.cust_norm IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS merge,
    CASE WHEN sa.cust_norm IS NOT NULL AND sb.cust_norm IS NULL THEN 'New'
         WHEN sa.cust_norm IS NOT NULL AND sb.cust_norm IS NOT NULL THEN (CASE
           WHEN fstage_after = fstage_before AND r_score_after = r_score_before THEN 'Stay'
           WHEN fstage_after = fstage_before AND (CASE r_score_before WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 END)
                > (CASE r_score_after WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 END) THEN 'Downgrade'
           WHEN fstage_after > fstage_before OR (fstage_after = fstage_before AND
                (CASE r_score_after WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 END)
                > (CASE r_score_before WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 END)) THEN 'Upgrade'
         END) END AS movement
  FROM sb FULL OUTER JOIN sa ON sb.cust_norm = sa.cust_norm)
"""


@register("j07_snapshot_compare", two_snapshots_sql() + MOVES + "SELECT * FROM mv")
def j07_snapshot_compare(spark, d):
    return W.movement_one_pass(_both(spark, d), B, A)


@register("x24_movement_counts", two_snapshots_sql() + MOVES + """SELECT m AS movement,
    (SELECT count(*) FROM mv WHERE movement = m) AS n_customers
  FROM (VALUES ('New'), ('Stay'), ('Downgrade'), ('Upgrade')) v(m)""")
def x24_movement_counts(spark, d):
    return W.movement_counts(W.movement_one_pass(_both(spark, d), B, A))


@register("w05_stage_mix", two_snapshots_sql() + f"""s AS (SELECT least(total_items, 24) AS fstage, r_score,
    count(*) AS n_customers FROM a_rfm GROUP BY 1, 2)
SELECT fstage, r_score, n_customers,
    n_customers * 100.0 / sum(n_customers) OVER (PARTITION BY fstage) AS percent,
    {pct_label_sql('n_customers', 'sum(n_customers) OVER (PARTITION BY fstage)')} AS label FROM s""")
def w05_stage_mix(spark, d):
    return W.stage_mix(_after(spark, d))


@register("p12_stage_cap", two_snapshots_sql() + """SELECT cust_norm, total_items,
    least(total_items, 24) AS fstage FROM a_rfm""")
def p12_stage_cap(spark, d):
    return W.with_stage(_after(spark, d)).select("cust_norm", "total_items", "fstage")


@register("f13_flow_drilldown", two_snapshots_sql() + EDGES + """SELECT old_category, new_category,
    count(*) AS n_customers FROM edges WHERE old_category = 'New Customer' GROUP BY 1, 2""")
def f13_flow_drilldown(spark, d):
    """flow table filtered to one origin ('All' would be no filter)."""
    links = W.flow_links(_edges(spark, d))
    return links.where(F.col("old_category") == W.NEW_CUSTOMER).select("old_category", "new_category", "n_customers")


def _two(spark, d):
    tx, mem = V.visits(spark, d), V.members(spark, d)
    return R.rfm(tx, B, mem), R.rfm(tx, A, mem)


@register("j06_two_reports", two_snapshots_sql() + EDGES + "SELECT cust_norm, old_category, new_category FROM edges")
def j06_two_reports(spark, d):
    """J6 from two finished reports, joined on the customer."""
    return W.flow_edges(*_two(spark, d))


@register("j07_two_reports", two_snapshots_sql() + MOVES + "SELECT * FROM mv")
def j07_two_reports(spark, d):
    """J7 + X24 from two finished reports."""
    return W.movement(*_two(spark, d))


@register("j06_segment_flow_one_pass", two_snapshots_sql() + EDGES + "SELECT cust_norm, old_category, new_category FROM edges")
def j06_segment_flow_one_pass(spark, d):
    """J6 from ``rfm_snapshots``: both snapshots from one scan (rows tagged by
    explode, fan-out bounded by the snapshot count), then one groupBy."""
    return W.flow_edges_one_pass(_both(spark, d), B, A)


@register("j07_snapshot_compare_one_pass", two_snapshots_sql() + MOVES + "SELECT * FROM mv")
def j07_snapshot_compare_one_pass(spark, d):
    """J7 + X24 from ``rfm_snapshots`` (one scan, one groupBy per customer)."""
    return W.movement_one_pass(_both(spark, d), B, A)
