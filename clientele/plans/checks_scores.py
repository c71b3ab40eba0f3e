"""Checked queries: data-driven scores, global rank, the summary report."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele.operators import ranking as K
from clientele.operators import report as P
from clientele.operators import tertiles as T
from clientele.plans.checks_rfm import rules_sql, segment_case_sql
from clientele.plans.registry import name_key_sql, register
from clientele.sources import views as V


def cust_sql(view: str = "visits") -> str:
    """CTE ``cust``: the report's customer table (recency to max(date)+1)."""
    return V.with_views(view, "members").rstrip() + f""",
t AS (SELECT * FROM {view} WHERE tx_date IS NOT NULL),
base AS (SELECT {name_key_sql('customer')} AS cust_norm,
    CAST((SELECT max(tx_date) FROM t) + 1 - max(tx_date) AS BIGINT) AS recency_days,
    count(DISTINCT tx_date) AS frequency,
    CAST(sum(coalesce(TRY_CAST(total_price AS DECIMAL(38,2)), 0)) AS DECIMAL(38,2)) AS total_spent,
    arg_min(customer, row_id) FILTER (WHERE customer IS NOT NULL) AS customer
  FROM t GROUP BY 1),
per_item AS (SELECT cust_norm, item_norm, count(*) AS n FROM (
    SELECT {name_key_sql('customer')} AS cust_norm, {name_key_sql('item')} AS item_norm FROM t)
  WHERE item_norm <> '' GROUP BY 1, 2),
items AS (SELECT cust_norm, CAST(sum(n) AS BIGINT) AS total_items,
    string_agg(item_norm || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY item_norm) AS item_summary
  FROM per_item GROUP BY 1),
cust AS (SELECT b.*, coalesce(i.total_items, 0) AS total_items, coalesce(i.item_summary, '') AS item_summary
  FROM base b LEFT JOIN items i USING (cust_norm))
"""


def value_tertile_sql(col: str, labels=("High", "Medium", "Low"), src: str = "cust") -> str:
    """CTE-free expression pieces for W8 with the W11 fallback: returns
    (cte_text, label_case) where cte_text defines ``{col}_edges``."""
    e = f"{col}_edges"
    cte = f""",
{e}_s AS (SELECT min({col})::DOUBLE AS mn, max({col})::DOUBLE AS mx, count(DISTINCT {col}) AS nd,
    quantile_cont({col}, 1/3) AS q1, quantile_cont({col}, 2/3) AS q2 FROM {src}),
{e} AS (SELECT nd,
    CASE WHEN mn = q1 OR q1 = q2 OR q2 = mx THEN 1 * ((mx - mn) / 3) + mn ELSE q1 END AS e1,
    CASE WHEN mn = q1 OR q1 = q2 OR q2 = mx THEN 2 * ((mx - mn) / 3) + mn ELSE q2 END AS e2 FROM {e}_s)"""
    case = (f"CASE WHEN (SELECT nd FROM {e}) <= 1 THEN '{labels[1]}' "
            f"WHEN {col} <= (SELECT e1 FROM {e}) THEN '{labels[0]}' "
            f"WHEN {col} <= (SELECT e2 FROM {e}) THEN '{labels[1]}' ELSE '{labels[2]}' END")
    return cte, case


def fair_sql(table: str, col: str) -> str:
    """CTEs ``fair``: the edges of thirds of the distinct values, as pd.qcut has them."""
    at = lambda h, k: f"CAST(vs[least(CAST(floor({h}) AS BIGINT) + {k}, d)] AS DOUBLE)"
    edge = lambda h: (f"CASE WHEN {h} - floor({h}) >= 0.5 THEN {at(h, 2)} - ({at(h, 2)} - {at(h, 1)}) * (1 - ({h} - floor({h}))) "  # noqa: E731
                      f"ELSE {at(h, 1)} + ({at(h, 2)} - {at(h, 1)}) * ({h} - floor({h})) END")
    return f""", fv AS (SELECT list_sort(list(DISTINCT {col})) AS vs, count(DISTINCT {col}) AS d FROM {table}),
fh AS (SELECT vs, d, (d - 1) * (CAST(1 AS DOUBLE) / 3 * 100 / 100) AS h1, (d - 1) * (CAST(2 AS DOUBLE) / 3 * 100 / 100) AS h2 FROM fv),
fair AS (SELECT d, vs[1] AS low, {edge('h1')} AS e1, {edge('h2')} AS e2 FROM fh)
"""


def fair_label(col: str) -> str:
    return (f"CASE WHEN {col} IS NULL THEN 'Medium' WHEN d = 1 THEN 'Low' WHEN d = 2 THEN (CASE WHEN {col} = low THEN 'Low' ELSE 'Medium' END) "
            f"WHEN {col} <= e1 THEN 'Low' WHEN {col} <= e2 THEN 'Medium' ELSE 'High' END")


def report_sql(view: str = "visits") -> str:
    rcte, rcase = value_tertile_sql("recency_days")
    return cust_sql(view).rstrip() + rcte + fair_sql("cust", "frequency") + f""",
mk AS (SELECT DISTINCT {name_key_sql('name')} AS cust_norm, TRUE AS _m FROM members),
ranked AS (SELECT *, row_number() OVER (ORDER BY total_spent, cust_norm) - 1 AS k1,
    count(*) OVER () AS n, count(DISTINCT total_spent) OVER () AS nd_m FROM cust),
scored AS (SELECT r.*, {rcase} AS r_score,
    CASE WHEN nd_m <= 1 THEN 'Medium' WHEN 3 * k1 < n - 1 THEN 'Low'
         WHEN 3 * k1 < 2 * (n - 1) THEN 'Medium' ELSE 'High' END AS m_score,
    {fair_label('frequency')} AS f_score
  FROM ranked r, fair),
report AS (SELECT cust_norm, customer, total_spent,
    CASE WHEN _m THEN 'Member' ELSE 'Non-Member' END AS status, recency_days, frequency,
    total_items, r_score, f_score, m_score, {segment_case_sql()} AS rfm_class, item_summary
  FROM scored LEFT JOIN mk USING (cust_norm))
"""


def _cust(spark, d, view=V.visits):
    return P.customer_table(view(spark, d))


@register("w07_global_rank", cust_sql() + """SELECT cust_norm, total_spent,
    row_number() OVER (ORDER BY total_spent, cust_norm) AS rank FROM cust""")
def w07_global_rank(spark, d):
    """Rank by money, ties in key order."""
    cust = _cust(spark, d).select("cust_norm", "total_spent")
    return K.global_rank(cust, ["total_spent", "cust_norm"])


@register("a21_quantile_cuts", cust_sql() + """SELECT quantile_cont(recency_days, 1/3) AS q1,
    quantile_cont(recency_days, 2/3) AS q2, median(recency_days)::DOUBLE AS median FROM cust""")
def a21_quantile_cuts(spark, d):
    cust = _cust(spark, d)
    q1, q2, med = K.exact_quantiles(cust, "recency_days", [1 / 3, 2 / 3, 0.5])
    return cust.agg(F.lit(q1).alias("q1"), F.lit(q2).alias("q2"), F.lit(med).alias("median"))


_R_CTE, _R_CASE = value_tertile_sql("recency_days")


@register("w08_value_tertiles", cust_sql().rstrip() + _R_CTE + f"""
SELECT cust_norm, recency_days, {_R_CASE} AS r_score FROM cust""")
def w08_value_tertiles(spark, d):
    cust = _cust(spark, d).select("cust_norm", "recency_days")
    return T.value_tertiles(cust, "recency_days", "r_score", T.HIGH_MED_LOW)


@register("w09_rank_tertiles", cust_sql() + """SELECT cust_norm, total_spent,
    CASE WHEN 3 * k1 < n - 1 THEN 'Low' WHEN 3 * k1 < 2 * (n - 1) THEN 'Medium' ELSE 'High' END AS m_score
  FROM (SELECT *, row_number() OVER (ORDER BY total_spent, cust_norm) - 1 AS k1, count(*) OVER () AS n FROM cust)""")
def w09_rank_tertiles(spark, d):
    cust = _cust(spark, d).select("cust_norm", "total_spent")
    return T.rank_tertiles(cust, "total_spent", ["cust_norm"], "m_score")


@register("w10_fair_tertiles", cust_sql() + fair_sql("cust", "frequency") + f"""SELECT cust_norm, frequency,
    {fair_label('frequency')} AS f_score FROM cust, fair""")
def w10_fair_tertiles(spark, d):
    cust = _cust(spark, d).select("cust_norm", "frequency")
    return T.fair_tertiles(cust, "frequency", "f_score")


@register("w11_equal_width", cust_sql() + """, s AS (SELECT min(total_spent)::DOUBLE AS mn,
    max(total_spent)::DOUBLE AS mx FROM cust)
SELECT cust_norm, total_spent,
    CASE WHEN total_spent::DOUBLE <= 1 * ((mx - mn) / 3) + mn THEN 'Low'
         WHEN total_spent::DOUBLE <= 2 * ((mx - mn) / 3) + mn THEN 'Medium' ELSE 'High' END AS m_band
  FROM cust, s""")
def w11_equal_width(spark, d):
    cust = _cust(spark, d).select("cust_norm", "total_spent")
    return T.equal_width_labels(cust, "total_spent", "m_band")


@register("w12_index_split", cust_sql() + """, fv AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i,
    count(*) OVER () AS d FROM (SELECT DISTINCT frequency AS v FROM cust))
SELECT cust_norm, frequency, ['Low', 'Medium', 'High'][least(floor(i * 3 / d), 2)::INT + 1] AS f_band
  FROM cust JOIN fv ON frequency = v""")
def w12_index_split(spark, d):
    cust = _cust(spark, d).select("cust_norm", "frequency")
    return T.index_split_labels(cust, "frequency", "f_band")


@register("j03_rfm_report", report_sql() + "SELECT * FROM report")
def j03_rfm_report(spark, d):
    """The summary report: quantile / rank / fair scores, segment, status, items."""
    return P.rfm_report(V.visits(spark, d), V.members(spark, d))


@register("j03_rfm_report_lines", report_sql("tx") + "SELECT * FROM report")
def j03_rfm_report_lines(spark, d):
    """The summary report over line-level transactions (item = part name)."""
    return P.rfm_report(V.tx(spark, d), V.members(spark, d))


_RULES = rules_sql()


def rescore_sql(view: str = "visits") -> str:
    return report_sql(view) + f"""SELECT cust_norm, customer, total_spent, status,
    recency_days, frequency, total_items, r_score, f_score, m_score,
    {segment_case_sql(missing='NULL')} AS rfm_class, item_summary
  FROM (SELECT * EXCLUDE (r_score, f_score, m_score, rfm_class),
      {_RULES['r']} AS r_score, {_RULES['f']} AS f_score,
      {_RULES['m'].replace('monetary_value', 'total_spent')} AS m_score FROM report)"""


@register("x22_rescore_report", rescore_sql())
def x22_rescore_report(spark, d):
    """Rule re-score of the finished report (the manual re-classification)."""
    rep = P.rfm_report(V.visits(spark, d), V.members(spark, d))
    return P.rescore_rules(rep).select(*P.REPORT_COLUMNS)


@register("t09_top_recency", cust_sql() + """SELECT cust_norm, recency_days FROM cust
  ORDER BY recency_days DESC, cust_norm LIMIT 5""")
def t09_top_recency(spark, d):
    return P.largest(_cust(spark, d), "recency_days", 5).select("cust_norm", "recency_days")


@register("q03_recency_sanity", cust_sql() + """SELECT max(recency_days) AS max_recency,
    (SELECT CAST(max(tx_date) - min(tx_date) + 1 AS BIGINT) FROM t) AS span_days,
    max(recency_days) > (SELECT CAST(max(tx_date) - min(tx_date) + 1 AS BIGINT) FROM t) + 30 AS too_high
  FROM cust""")
def q03_recency_sanity(spark, d):
    t = V.visits(spark, d)
    return P.recency_sanity(_cust(spark, d), t)
