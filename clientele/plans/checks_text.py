"""Checked queries: text keys, month labels, brackets, dates, title case."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele.functions import dates as D
from clientele.functions import text as X
from clientele.plans.registry import name_key_nan_sql, register, strip_sql
from clientele.sources import views as V

AS_OF = "2026-01-01"
DATA_YEARS = ("95", "96", "97", "98", "99", "00", "01")


def service_key_sql(x: str) -> str:
    words = "|".join(X.SERVICE_STOP_WORDS)
    s = f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9\\s]', ' ', 'g')"
    s = f"regexp_replace({s}, '\\b({words})\\b', '', 'g')"
    s = f"regexp_replace({s}, '\\s+', ' ', 'g')"
    return strip_sql(s)


def month_label_sql(x: str, years=DATA_YEARS) -> str:
    sp = f"regexp_replace(lower({strip_sql(x)}), '^(|.*\\S)({'|'.join(years)})$', '\\1 \\2')"
    pat = "'^([a-z]+)\\s*(\\d{2})?$'"
    abbr = f"regexp_extract(lbl, {pat}, 1)"
    yr = f"regexp_extract(lbl, {pat}, 2)"
    full = "CASE " + abbr + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.MONTH_ABBREVIATIONS.items()) \
        + f" ELSE {abbr} END"
    expanded = f"CASE WHEN {yr} <> '' THEN {full} || ' ' || {yr} ELSE {full} END"
    return sp, f"CASE WHEN regexp_matches(lbl, {pat}) THEN {expanded} ELSE lbl END"


@register("x02_name_key_nan", V.with_views("dirty_tx") + f"""SELECT {name_key_nan_sql('customer')} AS cust,
    count(*) AS n_rows FROM dirty_tx GROUP BY 1""")
def x02_name_key_nan(spark, d):
    return V.dirty_tx(spark, d).groupBy(X.name_key_nan("customer").alias("cust")).agg(
        F.count(F.lit(1)).alias("n_rows"))


@register("x03_service_key", V.with_views("dirty_tx", "pricelist") + f"""SELECT item, {service_key_sql('item')} AS svc,
    count(*) AS n_rows FROM (SELECT item FROM dirty_tx UNION ALL SELECT service AS item FROM pricelist) GROUP BY 1, 2""")
def x03_service_key(spark, d):
    items = V.dirty_tx(spark, d).select("item").unionByName(V.pricelist(spark, d).select(F.col("service").alias("item")))
    return items.groupBy("item", X.service_key("item").alias("svc")).agg(F.count(F.lit(1)).alias("n_rows"))


_SP, _EXP = month_label_sql("sheet")


@register("x04_month_label", V.with_views("sheets") + f"""SELECT sheet, lbl AS spaced, {_EXP} AS month_label,
    count(*) AS n_rows FROM (SELECT sheet, {_SP} AS lbl FROM sheets) GROUP BY ALL""")
def x04_month_label(spark, d):
    """X4 + X5 on sheet names.  The data's year suffixes (95..01) are passed
    as the label years (the reference's own are 24 and 25)."""
    s = V.sheets(spark, d).select("sheet").withColumn("spaced", X.month_label_spacing("sheet", DATA_YEARS))
    s = s.withColumn("month_label", X.expand_month("spaced"))
    return s.groupBy("sheet", "spaced", "month_label").agg(F.count(F.lit(1)).alias("n_rows"))


BRACKETS_SQL = V.with_views("bracket_names") + f"""SELECT member_no, name AS raw_name,
    regexp_extract(coalesce(name, 'nan'), '\\(VIP\\s*(\\d+)\\)', 1, 'i') AS vip,
    array_to_string(list_filter(regexp_extract_all(coalesce(name, 'nan'), '\\((.*?)\\)', 1),
        lambda p: NOT regexp_matches(p, '^VIP\\s*\\d+', 'i')), '; ') AS detail,
    {strip_sql("regexp_replace(coalesce(name, 'nan'), '\\s*\\(.*?\\)', '', 'g')")} AS name
  FROM bracket_names"""


@register("x06_vip_detail_name", BRACKETS_SQL)
def x06_vip_detail_name(spark, d):
    """X6 + X7 + X8: VIP level, other notes and the bare name."""
    b = V.bracket_names(spark, d)
    return b.select("member_no", F.col("name").alias("raw_name"), X.vip_level("name").alias("vip"),
                    X.bracket_details("name").alias("detail"), X.strip_brackets("name").alias("name"))


@register("x09_admin_prefix", V.with_views("district_lookup") + """SELECT address, district,
    regexp_replace(district, '^Kecamatan\\s+', '') AS district_name FROM district_lookup""")
def x09_admin_prefix(spark, d):
    lk = V.district_lookup(spark, d)
    return lk.withColumn("district_name", X.strip_admin_prefix("district"))


@register("x11_blank_to_null", V.with_views("member_records") + """SELECT no,
    CASE WHEN regexp_matches(birth_date, '^\\s*$') THEN NULL ELSE birth_date END AS birth_date
  FROM member_records""")
def x11_blank_to_null(spark, d):
    r = V.member_records(spark, d)
    return r.select("no", X.blank_to_null("birth_date").alias("birth_date"))


@register("x13_title_case", V.with_views("tx") + """SELECT DISTINCT item,
    array_to_string(list_transform(regexp_extract_all(item, '([A-Za-z]+|[^A-Za-z]+)'),
        lambda x: upper(x[1]) || lower(x[2:])), '') AS title FROM tx""")
def x13_title_case(spark, d):
    return V.tx(spark, d).select("item", X.title_case("item").alias("title")).distinct()


def _dmy_sql(x: str) -> str:
    parts = f"string_split_regex({strip_sql(x)}, '[-/]')"
    z = lambda p: f"CASE WHEN length({p}) < 2 THEN lpad({p}, 2, '0') ELSE {p} END"
    y = f"{parts}[3]"
    y2 = (f"CASE WHEN length({y}) = 2 AND regexp_matches({y}, '^\\d+$') THEN CAST(CASE WHEN CAST({y} AS INTEGER) > 30 "
          f"THEN 1900 + CAST({y} AS INTEGER) ELSE 2000 + CAST({y} AS INTEGER) END AS VARCHAR) ELSE {y} END")
    out = f"concat_ws('-', {z(parts + '[1]')}, {z(parts + '[2]')}, {y2})"
    return f"CASE WHEN {x} IS NULL THEN '' WHEN len({parts}) = 3 THEN {out} ELSE '' END"


@register("x14_normalize_dmy", V.with_views("member_raw") + f"""SELECT line_no, birth_date,
    {_dmy_sql('birth_date')} AS dmy,
    strftime(try_strptime({_dmy_sql('birth_date')}, '%d-%m-%Y'), '%d-%m-%Y') AS dmy_strict
  FROM member_raw""")
def x14_normalize_dmy(spark, d):
    """X14 + X15: normalised 'DD-MM-YYYY' text, then the strict reformat."""
    r = V.member_raw(spark, d).select("line_no", "birth_date", D.normalize_dmy("birth_date").alias("dmy"))
    return r.withColumn("dmy_strict", D.reformat_dmy("dmy"))


def _birth_sql(x: str) -> str:
    p = f"string_split({x}, '-')"
    yp = f"{p}[3]"
    suf = f"TRY_CAST(substr({yp}, 2, 2) AS INTEGER)"
    three = (f"CASE substr({yp}, 1, 1) WHEN '1' THEN {suf} + 1900 WHEN '2' THEN {suf} + 2000 "
             f"WHEN '0' THEN {suf} + 2000 END")
    three = f"CASE WHEN ({three}) < 1950 AND starts_with({yp}, '1') THEN ({three}) + 90 ELSE ({three}) END"
    yy = f"TRY_CAST({yp} AS INTEGER)"
    year = (f"CASE length({yp}) WHEN 2 THEN (CASE WHEN {yy} < 30 THEN {yy} + 2000 ELSE {yy} + 1900 END) "
            f"WHEN 3 THEN {three} WHEN 4 THEN {yy} END")
    d, m = f"TRY_CAST({p}[1] AS INTEGER)", f"TRY_CAST({p}[2] AS INTEGER)"
    return (f"CASE WHEN len({p}) = 3 AND ({year}) IS NOT NULL AND {d} IS NOT NULL AND {m} IS NOT NULL "
            f"AND ({year}) > 0 THEN TRY_CAST(printf('%04d-%02d-%02d', {year}, {m}, {d}) AS DATE) END")


@register("x16_birth_date_age", V.with_views("birth_text") + f"""SELECT member_no, birth_text, bd AS birth_date,
    CAST(floor((DATE '{AS_OF}' - bd) / 365) AS BIGINT) AS age
  FROM (SELECT *, {_birth_sql('birth_text')} AS bd FROM birth_text)""")
def x16_birth_date_age(spark, d):
    """X16 + X18: birth date with 2/3/4-digit year repair, age at a fixed date."""
    from clientele.operators.clean import with_age
    b = V.birth_text(spark, d).select("member_no", "birth_text")
    return with_age(b, "birth_text", AS_OF)


ISO = "'^(\\d{4})-(\\d{1,2})-(\\d{1,2})([ T]\\d{1,2}:\\d{2}(:\\d{2}(\\.\\d+)?)?)?$'"
DF = "'^(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{4})$'"
YY = "'^(\\d{1,2})[/-](\\d{1,2})[/-](\\d{2})$'"


def _ymd_sql(y, m, d) -> str:
    return (f"CASE WHEN TRY_CAST({y} AS INTEGER) > 0 THEN TRY_CAST(printf('%04d-%02d-%02d', TRY_CAST({y} AS INTEGER), "
            f"TRY_CAST({m} AS INTEGER), TRY_CAST({d} AS INTEGER)) AS DATE) END")


def parse_steps_sql(x: str) -> tuple[str, str]:
    s = strip_sql(f"CAST({x} AS VARCHAR)")
    iso = f"CASE WHEN regexp_matches({s}, {ISO}) THEN {_ymd_sql(*[f'regexp_extract({s}, {ISO}, {i})' for i in (1, 2, 3)])} END"
    dfs = f"CASE WHEN regexp_matches({s}, {DF}) THEN {_ymd_sql(*[f'regexp_extract({s}, {DF}, {i})' for i in (3, 2, 1)])} END"
    y2 = f"TRY_CAST(regexp_extract({s}, {YY}, 3) AS INTEGER)"
    yfull = f"(CASE WHEN {y2} < 30 THEN {y2} + 2000 ELSE {y2} + 1900 END)"
    yys = (f"CASE WHEN regexp_matches({s}, {YY}) THEN "
           f"{_ymd_sql(yfull, f'regexp_extract({s}, {YY}, 2)', f'regexp_extract({s}, {YY}, 1)')} END")
    date = f"coalesce({iso}, {dfs}, {yys})"
    step = (f"CASE WHEN ({iso}) IS NOT NULL THEN 'iso' WHEN ({dfs}) IS NOT NULL THEN 'day_first' "
            f"WHEN ({yys}) IS NOT NULL THEN 'two_digit_year' ELSE 'failed' END")
    return date, step


_PD, _PS = parse_steps_sql("date_text")


@register("x17_parse_any_date", V.with_views("text_dates") + f"""SELECT row_id, date_text, true_date,
    {_PD} AS parsed, {_PS} AS step FROM text_dates""")
def x17_parse_any_date(spark, d):
    t = V.text_dates(spark, d)
    st = D.parse_date_steps("date_text")
    return t.select("row_id", "date_text", "true_date", st["date"].alias("parsed"), st["step"].alias("step"))


_MON = "(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
_TIME = r"(?:[t ]\s*\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:am|pm)?\s*(?:z|[+-]\d{2}:?\d{2})?)?$"


def shape_steps_sql(x: str, month_first: bool = False) -> tuple[str, str]:
    """SQL twin of ``dates.parse_date_steps``: (date, step)."""
    s = f"lower({strip_sql(f'CAST({x} AS VARCHAR)')})"
    sep = "[ /.,-]+"
    numbers = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{%s})" + _TIME
    orders = [("day_first", (3, 2, 1)), ("month_first", (3, 1, 2))][::-1 if month_first else 1]
    shapes = [("iso", r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME, (1, 2, 3)),
              ("compact", r"^(\d{4})(\d{2})(\d{2})" + _TIME, (1, 2, 3)),
              ("month_name", rf"^(\d{{1,2}}){sep}{_MON}{sep}(\d{{4}}|\d{{2}})" + _TIME, (3, 2, 1)),
              ("month_name", rf"^{_MON}{sep}(\d{{1,2}}){sep}(\d{{4}})" + _TIME, (3, 1, 2)),
              ("month_name", rf"^(\d{{4}}){sep}{_MON}{sep}(\d{{1,2}})" + _TIME, (1, 2, 3))]
    shapes += [(step, numbers % "4", g) for step, g in orders] + [("two_digit_year", numbers % "2", g) for _, g in orders]
    dates = []
    for step, pattern, groups in shapes:
        y, m, d = (f"regexp_extract({s}, '{pattern}', {g})" for g in groups)
        y = f"(CASE WHEN length({y}) = 2 THEN TRY_CAST({y} AS INTEGER) + CASE WHEN TRY_CAST({y} AS INTEGER) < 30 THEN 2000 ELSE 1900 END ELSE TRY_CAST({y} AS INTEGER) END)"
        m = (f"coalesce(TRY_CAST({m} AS INTEGER), list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], "
             f"substr({m}, 1, 3)))")
        dates.append((step, f"CASE WHEN regexp_matches({s}, '{pattern}') THEN {_ymd_sql(y, m, d)} END"))
    return ("coalesce(" + ", ".join(d for _, d in dates) + ")",
            "CASE " + " ".join(f"WHEN ({d}) IS NOT NULL THEN '{step}'" for step, d in dates) + " ELSE 'failed' END")


_SD, _SS = shape_steps_sql("date_text")


@register("x17_date_shapes", V.with_views("mixed_dates") + f"""SELECT row_id, date_text, true_date, {_SD} AS parsed,
    {_SS} AS step FROM mixed_dates""")
def x17_date_shapes(spark, d):
    """X17 + C16: twelve text forms, each parsed by the rule of its shape."""
    t = V.mixed_dates(spark, d)
    st = D.parse_date_steps("date_text")
    return t.select("row_id", "date_text", "true_date", st["date"].alias("parsed"), st["step"].alias("step"))


_MD, _MS = shape_steps_sql("date_text", month_first=True)


@register("x17_voted_order", V.with_views("mixed_dates").rstrip() + f""",
m AS (SELECT * FROM mixed_dates WHERE row_id % 12 IN (1, 6)),
p AS (SELECT regexp_extract_all(date_text, '\\d+') AS p FROM m WHERE regexp_matches(date_text, '/')),
v AS (SELECT count(*) FILTER (WHERE CAST(p[1] AS INTEGER) > 12 AND CAST(p[2] AS INTEGER) BETWEEN 1 AND 12) AS n_day_first,
    count(*) FILTER (WHERE CAST(p[2] AS INTEGER) > 12 AND CAST(p[1] AS INTEGER) BETWEEN 1 AND 12) AS n_month_first FROM p)
SELECT step, n_day_first, n_month_first, count(*) AS n_rows, count(*) FILTER (WHERE parsed = true_date) AS n_correct
  FROM (SELECT {_MD} AS parsed, {_MS} AS step, true_date FROM m), v GROUP BY 1, 2, 3""")
def x17_voted_order(spark, d):
    """A column written month first is read so, by its own votes."""
    t = V.mixed_dates(spark, d).where((F.col("row_id") % 12).isin(1, 6))
    votes = D.day_month_votes(t, "date_text").first()
    st = D.parse_date_steps("date_text", month_first=votes["n_month_first"] > votes["n_day_first"])
    return (t.select(st["date"].alias("parsed"), st["step"].alias("step"), "true_date").groupBy("step")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("parsed") == F.col("true_date"), 1)).alias("n_correct"))
            .select("step", F.lit(votes["n_day_first"]).cast("long").alias("n_day_first"),
                    F.lit(votes["n_month_first"]).cast("long").alias("n_month_first"), "n_rows", "n_correct"))


@register("q01_date_failures", V.with_views("mixed_dates").rstrip() + f""",
t AS (SELECT {_SD} AS parsed, {_SS} AS step, true_date, date_text, md5(date_text) AS h FROM mixed_dates),
s AS (SELECT step, min((h, date_text)) AS one FROM (SELECT step, h, date_text FROM t) GROUP BY step, substr(h, 1, 1)),
l AS (SELECT step, array_to_string(list(one[2] ORDER BY one[1]), '|') AS samples FROM s GROUP BY 1)
SELECT step, count(*) AS n_rows, count(*) FILTER (WHERE parsed = true_date) AS n_correct, any_value(samples) AS samples
  FROM t JOIN l USING (step) GROUP BY 1""")
def q01_date_failures(spark, d):
    """Q1: the report with a sample of the texts of each step, failures among them, from one scan."""
    from clientele.operators.quality import date_parse_report
    r = date_parse_report(V.mixed_dates(spark, d), "date_text", truth="true_date", samples=True)
    return r.withColumn("samples", F.array_join("samples", "|"))


@register("x19_dates_only", """SELECT CAST(ts AS DATE) AS ts, count(*) AS n_events FROM events GROUP BY 1""")
def x19_dates_only(spark, d):
    from clientele.sources.readers import read_table
    e = D.dates_only(read_table(spark, d, "events").select("event_id", "ts"))
    return e.groupBy("ts").agg(F.count(F.lit(1)).alias("n_events"))


@register("x20_day_shift", V.with_views("events_tx") + """SELECT CAST(tx_ts AS DATE) + 1 AS next_day,
    count(*) AS n_rows FROM events_tx GROUP BY 1""")
def x20_day_shift(spark, d):
    e = V.events_tx(spark, d)
    return e.groupBy(D.day_shift("tx_ts", 1).alias("next_day")).agg(F.count(F.lit(1)).alias("n_rows"))


@register("x21_month_labels", V.with_views("tx") + """SELECT DISTINCT strftime(tx_date, '%Y-%m') AS month,
    strftime(tx_date, '%b %Y') AS month_name FROM tx""")
def x21_month_labels(spark, d):
    t = V.tx(spark, d)
    return t.select(D.month_key("tx_date").alias("month"), D.month_display("tx_date").alias("month_name")).distinct()


@register("q01_date_parse_report", V.with_views("text_dates") + f"""SELECT step, count(*) AS n_rows,
    count(*) FILTER (WHERE parsed = true_date) AS n_correct
  FROM (SELECT {_PD} AS parsed, {_PS} AS step, true_date FROM text_dates) GROUP BY 1""")
def q01_date_parse_report(spark, d):
    """Q1: rows parsed by each rule (and how many agree with the true date)."""
    from clientele.operators.quality import date_parse_report
    return date_parse_report(V.text_dates(spark, d), "date_text", truth="true_date")


@register("p07_numeric_coercion", V.with_views("money_text") + """SELECT
    CAST(sum(coalesce(TRY_CAST(amount_text AS DECIMAL(18,2)), 0)) AS DECIMAL(38,2)) AS total,
    count(*) FILTER (WHERE TRY_CAST(amount_text AS DECIMAL(18,2)) IS NULL) AS n_bad FROM money_text""")
def p07_numeric_coercion(spark, d):
    """Text money to a number, unparseable -> 0 (counted)."""
    m = V.money_text(spark, d).withColumn("v", F.col("amount_text").try_cast("decimal(18,2)"))
    return m.agg(F.sum(F.coalesce("v", F.lit(0).cast("decimal(18,2)"))).cast("decimal(38,2)").alias("total"),
                 F.count(F.when(F.col("v").isNull(), 1)).alias("n_bad"))
