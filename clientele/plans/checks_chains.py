"""Checked queries: the whole pipelines over raw input."""

from __future__ import annotations


from clientele.operators import chains as H
from clientele.plans.checks_clean import _valid_sql, pair_sql, person_ctes
from clientele.plans.checks_scores import report_sql, rescore_sql
from clientele.plans.checks_text import DATA_YEARS, month_label_sql, service_key_sql, shape_steps_sql
from clientele.plans.registry import name_key_sql, register, strip_sql
from clientele.sources import readers as IO
from clientele.sources import sinks as K
from clientele.sources import views as V

_SPACED, _MONTH = month_label_sql("Month")
# the priced transactions as a view, so that the report's SQL can be written over it
V.SQL["priced_sheets"] = f"""SELECT row_id, customer, item, qty, {_MONTH} AS month, {shape_steps_sql('date_text')[0]} AS tx_date,
    CAST(coalesce(TRY_CAST(price AS DECIMAL(18,2)), 0) * qty AS DECIMAL(38,2)) AS total_price
  FROM (SELECT *, {_SPACED} AS lbl FROM raw_sheets WHERE held) r LEFT JOIN (SELECT svc, price FROM (
    SELECT {service_key_sql('service')} AS svc, price, row_number() OVER (PARTITION BY {service_key_sql('service')} ORDER BY row_id) AS rn
    FROM pricelist) WHERE rn = 1) pl ON {service_key_sql('item')} = pl.svc"""
V._DEPENDS["priced_sheets"] = ["raw_sheets", "pricelist"]


def _chain(spark, d):
    return H.sales_chain(V.raw_sheets(spark, d), V.pricelist(spark, d), V.members(spark, d), years=DATA_YEARS)


@register("chain_priced_sales", V.with_views("priced_sheets") + "SELECT row_id, month, customer, item, qty, tx_date, total_price FROM priced_sheets")
def chain_priced_sales(spark, d):
    """Raw sheets to priced transactions: F1, X4, X17, J1 and NaN as null."""
    return H.priced_sales(V.raw_sheets(spark, d), V.pricelist(spark, d), DATA_YEARS).select(
        "row_id", "month", "customer", "item", "qty", "tx_date", "total_price")


@register("chain_sales_report", report_sql("priced_sheets") + "SELECT * FROM report")
def chain_sales_report(spark, d):
    """Raw sheets to the summary report."""
    return _chain(spark, d).report


@register("chain_sales_rescored", rescore_sql("priced_sheets"))
def chain_sales_rescored(spark, d):
    """Raw sheets to the re-scored report."""
    return _chain(spark, d).rescored


MEMBER_SQL = pair_sql("raw_members", ", skin_type").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""",
district_lookup AS ({V.SQL['district_lookup']}),
split AS (SELECT line_no, TRY_CAST(no AS BIGINT) AS no, {strip_sql("regexp_replace(coalesce(name, 'nan'), '\\s*\\(.*?\\)', '', 'g')")} AS name,
    regexp_extract(coalesce(name, 'nan'), '\\(VIP\\s*(\\d+)\\)', 1, 'i') AS vip,
    array_to_string(list_filter(regexp_extract_all(coalesce(name, 'nan'), '\\((.*?)\\)', 1),
        lambda p: NOT regexp_matches(p, '^VIP\\s*\\d+', 'i')), '; ') AS detail, birthplace,
    strftime(try_strptime(birth_date, '%d-%m-%Y'), '%d-%m-%Y') AS birth_date, {strip_sql("coalesce(address, '')")} AS address, skin_type FROM paired),
lk AS (SELECT {name_key_sql('address')} AS ak, min(district) AS district FROM district_lookup GROUP BY 1),
placed AS (SELECT s.*, regexp_replace(lk.district, '^Kecamatan\\s+', '') AS district, line_no AS row_id
  FROM split s JOIN lk ON {name_key_sql('s.address')} = lk.ak WHERE address <> '' AND lk.district <> 'Not Found')
""" + person_ctes("placed") + "SELECT * FROM (SELECT person_id, " + ", ".join(map(_valid_sql, [
    "line_no", "no", "name", "vip", "detail", "birthplace", "birth_date", "address", "skin_type", "district"])) + f""" FROM persons GROUP BY 1)
  WHERE coalesce({strip_sql('skin_type')} <> '', false)"""


def _members(spark, d, raw):
    columns = ["person_id", "line_no", "no", "name", "vip", "detail", "birthplace", "birth_date", "address", "skin_type", "district"]
    return H.member_chain(raw, V.district_lookup(spark, d)).select(*columns)


@register("chain_members", MEMBER_SQL)
def chain_members(spark, d):
    """Raw member export to the merged members with a skin type."""
    return _members(spark, d, V.raw_members(spark, d))


@register("chain_members_from_files", MEMBER_SQL)
def chain_members_from_files(spark, d):
    """The same from CSV files, whose lines are numbered at ingest."""
    raw = V.raw_members(spark, d)
    path = K.write_ordered_csv(raw, K.output_path(spark, "member_lines"), "line_no")
    rows = IO.read_numbered(spark, path, raw.schema).drop("line_no").withColumnRenamed("row_id", "line_no")
    return _members(spark, d, rows)
