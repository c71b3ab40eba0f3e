"""Views of the reference's tables over the driver's Parquet test tables.

Each view exists twice: as a Spark DataFrame (``tx(spark, d)``) and as the
SQL text of a CTE over the pre-registered DuckDB views (``SQL['tx']``), so an
oracle query can be written as ``with_views('tx', ...) + 'SELECT ...'``.
These only *rename and cast* test columns into the schemas the operators
expect; no operator logic lives here.

Column contract of a transaction view (FIXTURES.md ``transactions``):
  row_id BIGINT (file order), customer STRING, tx_date DATE, item STRING,
  qty DECIMAL(18,2), ticket BIGINT, total_price DECIMAL(18,2)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.sources.readers import read_table

# Fixed snapshot dates and churn cut used by the checks.
SNAPSHOT_BEFORE = "1998-06-30"
SNAPSHOT_AFTER = "2001-08-01"
CHURN_OBSERVATION_END = "2000-12-31"
CHURN_WINDOW_START = "2001-01-01"
MEMBER_SEGMENTS = ("BUILDING", "HOUSEHOLD")


def tx(spark: SparkSession, d: str) -> DataFrame:
    """Line-level transactions: lineitem ⋈ orders ⋈ customer ⋈ part."""
    li = read_table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber",
                                                  "l_quantity", "l_extendedprice")
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = read_table(spark, d, "customer").select("c_custkey", "c_name")
    p = read_table(spark, d, "part").select("p_partkey", "p_name")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
           .join(c, o.o_custkey == c.c_custkey)
           .join(p, li.l_partkey == p.p_partkey))
    return j.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_id"),
        F.col("c_name").alias("customer"),
        F.to_date("o_orderdate").alias("tx_date"),
        F.col("p_name").alias("item"),
        F.col("l_quantity").cast("decimal(18,2)").alias("qty"),
        F.col("l_orderkey").alias("ticket"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("total_price"),
    )


def visits(spark: SparkSession, d: str) -> DataFrame:
    """One row per order: orders ⋈ customer; the item is the order priority."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate",
                                              "o_totalprice", "o_orderpriority")
    c = read_table(spark, d, "customer").select("c_custkey", "c_name")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        F.col("o_orderkey").alias("row_id"),
        F.col("c_name").alias("customer"),
        F.to_date("o_orderdate").alias("tx_date"),
        F.col("o_orderpriority").alias("item"),
        F.lit(1).cast("decimal(18,2)").alias("qty"),
        F.col("o_orderkey").alias("ticket"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("total_price"),
    )


def dirty_tx(spark: SparkSession, d: str) -> DataFrame:
    """``tx`` with messy names (upper / padded / as is by ticket mod 3) and
    items written as 'Package <name>'."""
    t = tx(spark, d)
    k = F.col("ticket") % 3
    name = (F.when(k == 0, F.upper("customer"))
             .when(k == 1, F.concat(F.lit("  "), F.col("customer"), F.lit(" ")))
             .otherwise(F.col("customer")))
    return t.withColumn("customer", name).withColumn("item", F.concat(F.lit("Package "), F.col("item")))


def hot_tx(spark: SparkSession, d: str) -> DataFrame:
    """``tx`` with a third of the rows in one basket of one customer, some null
    customers and some null items."""
    t = tx(spark, d)
    hot = F.col("ticket") % 3 == 0
    return (t.withColumn("customer", F.when(hot, F.lit("Walk-in")).when(F.col("ticket") % 17 == 1, F.lit(None)).otherwise(F.col("customer")))
             .withColumn("item", F.when(F.col("row_id") % 13 == 0, F.lit(None)).otherwise(F.col("item")))
             .withColumn("tx_date", F.when(hot & (F.col("ticket") % 4 != 0), F.lit("1998-01-01").cast("date")).otherwise(F.col("tx_date")))
             .withColumn("ticket", F.when(hot, F.lit(0).cast("long")).otherwise(F.col("ticket"))))


def raw_sheets(spark: SparkSession, d: str) -> DataFrame:
    """The sheets as exported: headers of the workbook, dates as text in several
    forms, messy and missing names, NaN quantities, rows that hold a label only."""
    s = sheets(spark, d)
    k = F.col("row_id") % 16
    text = (F.when(k % 4 == 0, F.date_format("tx_date", "yyyy-MM-dd")).when(k % 4 == 1, F.date_format("tx_date", "dd/MM/yyyy HH:mm"))
             .when(k % 4 == 2, F.date_format("tx_date", "d MMM yyyy")).when(k == 3, F.lit("n/a")).otherwise(F.date_format("tx_date", "dd.MM.yyyy")))
    name = (F.when(F.col("row_id") % 29 == 0, F.lit(None)).when(k % 3 == 0, F.upper("customer"))
             .when(k % 3 == 1, F.concat(F.lit("  "), F.col("customer"), F.lit(" "))).otherwise(F.col("customer")))
    qty = F.when(F.col("row_id") % 41 == 0, F.lit(float("nan"))).otherwise(F.col("qty").cast("double"))
    held = F.col("ticket") % 50 != 0
    return s.select("row_id", F.col("sheet").alias("Month"), F.when(held, text).alias("Date"), F.when(held, name).alias(" NAMA CUSTOMER "),
                    F.when(held, F.concat(F.lit("Package "), F.col("item"))).alias("NAMA TREATMENT"), F.when(held, qty).alias("QTY"))


def raw_members(spark: SparkSession, d: str) -> DataFrame:
    """``member_raw`` with bracketed and repeated names, addresses that a lookup
    may know, and a skin type."""
    r = member_raw(spark, d)
    top = F.col("line_no") % 2 == 0
    k = F.floor(F.col("line_no") / 2)
    name = (F.when(top & (k % 4 == 0), F.concat(F.col("name"), F.lit(" (VIP "), (k % 5).cast("string"), F.lit(")")))
             .when(top & (k % 4 == 1), F.concat(F.lit("Walk-in (from "), F.col("birthplace"), F.lit(")"))).otherwise(F.col("name")))
    return (r.withColumn("name", name)
             .withColumn("address", F.when(top & (F.col("address") != ""), F.col("birthplace")).otherwise(F.col("address")))
             .withColumn("skin_type", F.when(top & (k % 3 == 1), F.lit(" ")).when(top & (k % 3 == 2), F.lit("Oily"))))


def events_tx(spark: SparkSession, d: str) -> DataFrame:
    """``events`` as a second transaction table with real times (tx_ts)."""
    e = read_table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return e.select(
        F.col("event_id").alias("row_id"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("customer"),
        F.col("ts").alias("tx_ts"),
        F.to_date("ts").alias("tx_date"),
        F.col("event_type").alias("item"),
        F.col("value").cast("decimal(18,2)").alias("total_price"),
    )


def members(spark: SparkSession, d: str) -> DataFrame:
    """Member list: customers of two market segments; ``Name`` is the join text."""
    c = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return c.filter(F.col("c_mktsegment").isin(*MEMBER_SEGMENTS)).select(
        F.col("c_custkey").alias("member_no"), F.col("c_name").alias("name"))


def member_profile(spark: SparkSession, d: str) -> DataFrame:
    """Member profile: customer ⋈ nation ⋈ region (city, district, profession, vip)."""
    c = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey",
                                                "c_acctbal", "c_mktsegment")
    n = read_table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, d, "region").select("r_regionkey", "r_name")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.select(
        F.col("c_custkey").alias("member_no"),
        F.col("c_name").alias("name"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("district"),
        F.col("c_mktsegment").alias("profession"),
        (F.col("c_custkey") % 5).cast("string").alias("vip"),
        F.col("c_acctbal").alias("acctbal"),
    )


def pricelist(spark: SparkSession, d: str) -> DataFrame:
    """Price list: one row per part; service = p_name (about 31 rows per name)."""
    p = read_table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    return p.select(
        F.col("p_partkey").alias("row_id"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("service"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("price"),
    )


def area_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Area names known to the map: regions minus the last one."""
    r = read_table(spark, d, "region").select("r_regionkey", "r_name")
    return r.filter(F.col("r_regionkey") < 4).select(F.col("r_name").alias("area"))


def text_dates(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the date written in one of five text forms (by key mod 5)."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    k = F.col("o_orderkey") % 5
    txt = (F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
            .when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy"))
            .when(k == 2, F.date_format("o_orderdate", "d-M-yyyy"))
            .when(k == 3, F.date_format("o_orderdate", "dd/MM/yy"))
            .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")))
    return o.select(F.col("o_orderkey").alias("row_id"), txt.alias("date_text"),
                    F.to_date("o_orderdate").alias("true_date"))


def mixed_dates(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the date in one of twelve text forms (by key mod 12), two of them no date."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    forms = ["yyyy/MM/dd", "yyyyMMdd", "d MMM yyyy", "yyyy-MM-dd'T'HH:mm:ss'Z'", "dd/MM/yyyy HH:mm", "MMM d, yyyy",
             "MM/dd/yyyy", "d-MMM-yy", "MMMM d yyyy", " dd.MM.yyyy "]
    k = F.col("o_orderkey") % 12
    txt = F.when(k == 10, F.lit("n/a")).when(k == 11, F.lit("31/02/2024"))
    for i, form in enumerate(forms):
        txt = txt.when(k == i, F.date_format("o_orderdate", form))
    return o.select(F.col("o_orderkey").alias("row_id"), txt.alias("date_text"), F.to_date("o_orderdate").alias("true_date"))


def sheets(spark: SparkSession, d: str) -> DataFrame:
    """Monthly sheets: ``tx`` rows tagged with a sheet name such as 'jan98' /
    'Okt 99' / 'may24' style labels (month abbreviation by month number)."""
    t = tx(spark, d)
    abbr = F.element_at(F.array(*[F.lit(x) for x in
                                  ["jan", "feb", "mar", "apr", "may", "jun", "jul",
                                   "agst", "sept", "Okt", "nov", "des"]]),
                        F.month("tx_date"))
    yy = F.date_format("tx_date", "yy")
    glued = (F.col("ticket") % 2) == 0
    sheet = F.when(glued, F.concat(abbr, yy)).otherwise(F.concat(abbr, F.lit(" "), yy))
    return t.withColumn("sheet", sheet)


def _customer_geo(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    n = read_table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, d, "region").select("r_regionkey", "r_name")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)


def _birth(k):
    return F.date_add(F.lit("1950-01-01").cast("date"), (k * 37 % 20000).cast("int"))


def member_raw(spark: SparkSession, d: str) -> DataFrame:
    """Raw member export: two lines per member (line order in ``line_no``).
    The second line may carry a birthplace and, in the first column, an
    ``*address: ...`` continuation of the address."""
    g = _customer_geo(spark, d)
    k = F.col("c_custkey")
    bdate = _birth(k)
    top = g.select((k * 2).alias("line_no"), k.cast("string").alias("no"),
                   F.col("c_name").alias("name"),
                   F.col("n_name").alias("birthplace"),
                   F.when(k % 2 == 0, F.date_format(bdate, "d/M/yyyy"))
                    .otherwise(F.date_format(bdate, "d-M-yy")).alias("birth_date"),
                   F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Jl. "), F.col("c_name"))).alias("address"))
    bot = g.select((k * 2 + 1).alias("line_no"),
                   F.when(k % 2 == 0, F.concat(F.lit(" *Address: "), F.col("r_name"), F.lit(" : ok")))
                    .when(k % 5 == 1, F.lit("*address"))
                    .alias("no"),
                   F.lit(None).cast("string").alias("name"),
                   F.when(k % 4 != 0, F.concat(F.lit("City "), F.col("r_name"))).alias("birthplace"),
                   F.lit(None).cast("string").alias("birth_date"),
                   F.lit(None).cast("string").alias("address"))
    return top.unionByName(bot)


def bracket_names(spark: SparkSession, d: str) -> DataFrame:
    """Member names carrying '(VIP n)' and other bracketed notes."""
    c = read_table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    name = (F.when(k % 4 == 0, F.concat(F.col("c_name"), F.lit(" (VIP "), (k % 5).cast("string"), F.lit(")")))
             .when(k % 4 == 1, F.concat(F.col("c_name"), F.lit(" (vip"), (k % 3).cast("string"),
                                        F.lit(") (note "), F.col("c_mktsegment"), F.lit(")")))
             .when(k % 4 == 2, F.concat(F.col("c_name"), F.lit(" (") , F.col("c_mktsegment"), F.lit(")")))
             .otherwise(F.col("c_name")))
    return c.select(k.alias("member_no"), name.alias("name"))


def birth_text(spark: SparkSession, d: str) -> DataFrame:
    """Birth dates written in several text forms (2-, 3- and 4-digit years, junk)."""
    c = read_table(spark, d, "customer").select("c_custkey")
    k = F.col("c_custkey")
    b = _birth(k)
    txt = (F.when(k % 5 == 0, F.date_format(b, "d/M/yyyy"))
            .when(k % 5 == 1, F.date_format(b, "d-M-yy"))
            .when(k % 5 == 2, F.date_format(b, "dd-MM-yyyy"))
            .when(k % 5 == 3, F.concat(F.date_format(b, "d-M-"), F.lit("1"), F.date_format(b, "yy")))
            .otherwise(F.lit("n/a")))
    return c.select(k.alias("member_no"), txt.alias("birth_text"), b.alias("true_date"))


def member_records(spark: SparkSession, d: str) -> DataFrame:
    """Member records with repeated names: one per order, birth date and
    address sometimes missing, sometimes conflicting; yes/no flags."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    c = read_table(spark, d, "customer").select("c_custkey", "c_name")
    k = F.col("o_orderkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select(
        k.alias("no"), F.col("c_name").alias("name"),
        F.when(k % 4 == 0, F.lit(None)).when(k % 4 == 1, F.lit("01-01-1970"))
         .when(k % 4 == 2, F.lit("   ")).otherwise(F.lit("02-02-1980")).alias("birth_date"),
        F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, F.concat(F.col("o_orderpriority"), F.lit(" ")))
         .otherwise(F.upper("o_orderpriority")).alias("address"),
        F.when(F.col("o_orderstatus") == "F", "YES").when(F.col("o_orderstatus") == "O", "no").alias("delivery"),
        F.when(k % 7 == 0, F.lit("nan")).otherwise(F.col("o_orderpriority")).alias("hobby"),
    )


def messy_members(spark: SparkSession, d: str) -> DataFrame:
    """``member_records`` with a row id, some of them without number or name,
    and a third of them under one name with varied dates and addresses."""
    r = member_records(spark, d)
    k = F.col("no")
    odd = (k % 13 < 4).cast("int")
    return (r.withColumn("row_id", k)
             .withColumn("name", F.when(k % 11 == 5, F.lit(None)).when(k % 3 == 1, F.lit("-")).otherwise(F.col("name")))
             .withColumn("birth_date", F.when(k % 3 == 1, F.when(odd == 1, F.lit(None)).otherwise((k % 40).cast("string")))
                         .otherwise(F.col("birth_date")))
             .withColumn("address", F.when(k % 3 == 1, F.when(k % 5 == 0, F.lit(None)).otherwise((k % 37).cast("string")))
                         .otherwise(F.col("address")))
             .withColumn("no", F.when(k % 10 == 7, F.lit(None)).otherwise(k)))


def district_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Address -> district table (replaces the web geocoder)."""
    g = _customer_geo(spark, d).select("n_nationkey", "n_name", "r_name").distinct()
    return g.where(F.col("n_nationkey") % 6 != 5).select(
        F.lower(F.col("n_name")).alias("address"), F.concat(F.lit("Kecamatan "), F.col("r_name")).alias("district"))


def geocode_replies(spark: SparkSession, d: str) -> DataFrame:
    """Stored geocoder replies (JSON text) per address."""
    n = read_table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, d, "region").select("r_regionkey", "r_name")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    k = F.col("n_nationkey")
    ok = F.concat(F.lit('{"status":"OK","results":[{"address_components":['
                        '{"long_name":"'), F.col("n_name"), F.lit('","types":["locality","political"]},'
                        '{"long_name":"'), F.col("r_name"), F.lit('","types":["'),
                  F.when(k % 4 == 3, F.lit("administrative_area_level_2")).otherwise(F.lit("administrative_area_level_3")),
                  F.lit('","political"]}]}]}'))
    reply = F.when(k % 5 == 4, F.lit('{"status":"ZERO_RESULTS","results":[]}')).otherwise(ok)
    return j.select(F.col("n_name").alias("address"), reply.alias("reply"))


def money_text(spark: SparkSession, d: str) -> DataFrame:
    """Order totals as text, some of them unparseable."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    k = F.col("o_orderkey")
    txt = F.when(k % 7 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return o.select(k.alias("row_id"), txt.alias("amount_text"))


VIEWS = {
    "tx": tx, "visits": visits, "dirty_tx": dirty_tx, "hot_tx": hot_tx, "raw_sheets": raw_sheets, "raw_members": raw_members, "events_tx": events_tx,
    "members": members, "member_profile": member_profile, "pricelist": pricelist,
    "area_dictionary": area_dictionary, "text_dates": text_dates, "mixed_dates": mixed_dates, "sheets": sheets,
    "member_raw": member_raw, "bracket_names": bracket_names, "birth_text": birth_text,
    "member_records": member_records, "messy_members": messy_members, "district_lookup": district_lookup,
    "geocode_replies": geocode_replies, "money_text": money_text,
}

# ---------------------------------------------------------------- SQL side
SQL = {
    "tx": """SELECT l_orderkey * 100 + l_linenumber AS row_id, c_name AS customer,
        CAST(o_orderdate AS DATE) AS tx_date, p_name AS item,
        CAST(l_quantity AS DECIMAL(18,2)) AS qty, l_orderkey AS ticket,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS total_price
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey""",
    "visits": """SELECT o_orderkey AS row_id, c_name AS customer,
        CAST(o_orderdate AS DATE) AS tx_date, o_orderpriority AS item,
        CAST(1 AS DECIMAL(18,2)) AS qty, o_orderkey AS ticket,
        CAST(o_totalprice AS DECIMAL(18,2)) AS total_price
      FROM orders JOIN customer ON o_custkey = c_custkey""",
    "dirty_tx": """SELECT row_id,
        CASE ticket % 3 WHEN 0 THEN upper(customer) WHEN 1 THEN '  ' || customer || ' '
             ELSE customer END AS customer,
        tx_date, 'Package ' || item AS item, qty, ticket, total_price FROM tx""",
    "hot_tx": """SELECT row_id, CASE WHEN ticket % 3 = 0 THEN 'Walk-in' WHEN ticket % 17 = 1 THEN NULL ELSE customer END AS customer,
        CASE WHEN ticket % 3 = 0 AND ticket % 4 <> 0 THEN DATE '1998-01-01' ELSE tx_date END AS tx_date,
        CASE WHEN row_id % 13 = 0 THEN NULL ELSE item END AS item, qty,
        CASE WHEN ticket % 3 = 0 THEN 0 ELSE ticket END AS ticket, total_price FROM tx""",
    "raw_sheets": """SELECT row_id, sheet AS Month, CASE WHEN ticket % 50 <> 0 THEN
        CASE WHEN row_id % 4 = 0 THEN strftime(tx_date, '%Y-%m-%d') WHEN row_id % 4 = 1 THEN strftime(tx_date, '%d/%m/%Y %H:%M')
             WHEN row_id % 4 = 2 THEN strftime(tx_date, '%-d %b %Y') WHEN row_id % 16 = 3 THEN 'n/a' ELSE strftime(tx_date, '%d.%m.%Y') END END AS date_text,
        CASE WHEN ticket % 50 <> 0 THEN CASE WHEN row_id % 29 = 0 THEN NULL WHEN row_id % 16 % 3 = 0 THEN upper(customer)
             WHEN row_id % 16 % 3 = 1 THEN '  ' || customer || ' ' ELSE customer END END AS customer,
        CASE WHEN ticket % 50 <> 0 THEN 'Package ' || item END AS item,
        CASE WHEN ticket % 50 <> 0 AND row_id % 41 <> 0 THEN qty END AS qty,
        ticket % 50 <> 0 AS held FROM sheets""",
    "events_tx": """SELECT event_id AS row_id, 'user ' || CAST(user_id AS VARCHAR) AS customer,
        ts AS tx_ts, CAST(ts AS DATE) AS tx_date, event_type AS item,
        CAST(value AS DECIMAL(18,2)) AS total_price FROM events""",
    "members": """SELECT c_custkey AS member_no, c_name AS name FROM customer
      WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD')""",
    "member_profile": """SELECT c_custkey AS member_no, c_name AS name, n_name AS city,
        r_name AS district, c_mktsegment AS profession,
        CAST(c_custkey % 5 AS VARCHAR) AS vip, c_acctbal AS acctbal
      FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "pricelist": """SELECT p_partkey AS row_id, p_type AS category, p_name AS service,
        CAST(p_retailprice AS DECIMAL(18,2)) AS price FROM part""",
    "area_dictionary": """SELECT r_name AS area FROM region WHERE r_regionkey < 4""",
    "text_dates": """SELECT o_orderkey AS row_id,
        CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
             WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
             WHEN 2 THEN strftime(o_orderdate, '%-d-%-m-%Y')
             WHEN 3 THEN strftime(o_orderdate, '%d/%m/%y')
             ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS date_text,
        CAST(o_orderdate AS DATE) AS true_date FROM orders""",
    "mixed_dates": """SELECT o_orderkey AS row_id,
        CASE o_orderkey % 12 WHEN 0 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m%d')
             WHEN 2 THEN strftime(o_orderdate, '%-d %b %Y') WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')
             WHEN 4 THEN strftime(o_orderdate, '%d/%m/%Y %H:%M') WHEN 5 THEN strftime(o_orderdate, '%b %-d, %Y')
             WHEN 6 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 7 THEN strftime(o_orderdate, '%-d-%b-%y')
             WHEN 8 THEN strftime(o_orderdate, '%B %-d %Y') WHEN 9 THEN strftime(o_orderdate, ' %d.%m.%Y ')
             WHEN 10 THEN 'n/a' ELSE '31/02/2024' END AS date_text,
        CAST(o_orderdate AS DATE) AS true_date FROM orders""",
    "sheets": """SELECT *, CASE WHEN ticket % 2 = 0
            THEN ['jan','feb','mar','apr','may','jun','jul','agst','sept','Okt','nov','des'][month(tx_date)] || strftime(tx_date, '%y')
            ELSE ['jan','feb','mar','apr','may','jun','jul','agst','sept','Okt','nov','des'][month(tx_date)] || ' ' || strftime(tx_date, '%y') END AS sheet
      FROM tx""",
}
# Views a view's SQL refers to, so that ``with_views`` can pull them in first.
_DEPENDS = {"dirty_tx": ["tx"], "hot_tx": ["tx"], "raw_sheets": ["sheets"], "raw_members": ["member_raw"], "sheets": ["tx"]}

SQL.update({
    "customer_geo": """SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey""",
    "member_raw": """SELECT c_custkey * 2 AS line_no, CAST(c_custkey AS VARCHAR) AS no, c_name AS name,
        n_name AS birthplace,
        CASE WHEN c_custkey % 2 = 0 THEN strftime(DATE '1950-01-01' + CAST(c_custkey * 37 % 20000 AS INTEGER), '%-d/%-m/%Y')
             ELSE strftime(DATE '1950-01-01' + CAST(c_custkey * 37 % 20000 AS INTEGER), '%-d-%-m-%y') END AS birth_date,
        CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Jl. ' || c_name END AS address FROM customer_geo
      UNION ALL
      SELECT c_custkey * 2 + 1, CASE WHEN c_custkey % 2 = 0 THEN ' *Address: ' || r_name || ' : ok'
             WHEN c_custkey % 5 = 1 THEN '*address' END,
        NULL, CASE WHEN c_custkey % 4 <> 0 THEN 'City ' || r_name END, NULL, NULL FROM customer_geo""",
    "bracket_names": """SELECT c_custkey AS member_no, CASE c_custkey % 4
        WHEN 0 THEN c_name || ' (VIP ' || CAST(c_custkey % 5 AS VARCHAR) || ')'
        WHEN 1 THEN c_name || ' (vip' || CAST(c_custkey % 3 AS VARCHAR) || ') (note ' || c_mktsegment || ')'
        WHEN 2 THEN c_name || ' (' || c_mktsegment || ')' ELSE c_name END AS name FROM customer""",
    "birth_text": """SELECT c_custkey AS member_no, CASE c_custkey % 5
        WHEN 0 THEN strftime(b, '%-d/%-m/%Y') WHEN 1 THEN strftime(b, '%-d-%-m-%y')
        WHEN 2 THEN strftime(b, '%d-%m-%Y') WHEN 3 THEN strftime(b, '%-d-%-m-') || '1' || strftime(b, '%y')
        ELSE 'n/a' END AS birth_text, b AS true_date
      FROM (SELECT c_custkey, DATE '1950-01-01' + CAST(c_custkey * 37 % 20000 AS INTEGER) AS b FROM customer)""",
    "member_records": """SELECT o_orderkey AS no, c_name AS name,
        CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '01-01-1970' WHEN 2 THEN '   ' ELSE '02-02-1980' END AS birth_date,
        CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN o_orderpriority || ' ' ELSE upper(o_orderpriority) END AS address,
        CASE o_orderstatus WHEN 'F' THEN 'YES' WHEN 'O' THEN 'no' END AS delivery,
        CASE WHEN o_orderkey % 7 = 0 THEN 'nan' ELSE o_orderpriority END AS hobby
      FROM orders JOIN customer ON o_custkey = c_custkey""",
    "raw_members": """SELECT line_no, no, CASE WHEN line_no % 2 = 0 AND line_no // 2 % 4 = 0 THEN name || ' (VIP ' || CAST(line_no // 2 % 5 AS VARCHAR) || ')'
             WHEN line_no % 2 = 0 AND line_no // 2 % 4 = 1 THEN 'Walk-in (from ' || birthplace || ')' ELSE name END AS name,
        birthplace, birth_date, CASE WHEN line_no % 2 = 0 AND address <> '' THEN birthplace ELSE address END AS address,
        CASE WHEN line_no % 2 = 0 AND line_no // 2 % 3 = 1 THEN ' ' WHEN line_no % 2 = 0 AND line_no // 2 % 3 = 2 THEN 'Oily' END AS skin_type
      FROM member_raw""",
    "messy_members": """SELECT CASE WHEN no % 10 = 7 THEN NULL ELSE no END AS no,
        CASE WHEN no % 11 = 5 THEN NULL WHEN no % 3 = 1 THEN '-' ELSE name END AS name,
        CASE WHEN no % 3 = 1 THEN CASE WHEN no % 13 < 4 THEN NULL ELSE CAST(no % 40 AS VARCHAR) END ELSE birth_date END AS birth_date,
        CASE WHEN no % 3 = 1 THEN CASE WHEN no % 5 = 0 THEN NULL ELSE CAST(no % 37 AS VARCHAR) END ELSE address END AS address,
        delivery, hobby, no AS row_id FROM member_records""",
    "district_lookup": """SELECT DISTINCT lower(n_name) AS address, 'Kecamatan ' || r_name AS district
      FROM customer_geo WHERE n_nationkey % 6 <> 5""",
    "geocode_replies": """SELECT n_name AS address, CASE WHEN n_nationkey % 5 = 4
        THEN '{"status":"ZERO_RESULTS","results":[]}'
        ELSE '{"status":"OK","results":[{"address_components":[{"long_name":"' || n_name
          || '","types":["locality","political"]},{"long_name":"' || r_name || '","types":["'
          || CASE WHEN n_nationkey % 4 = 3 THEN 'administrative_area_level_2' ELSE 'administrative_area_level_3' END
          || '","political"]}]}]}' END AS reply
      FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "money_text": """SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a'
        ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount_text FROM orders""",
})
_DEPENDS.update({"messy_members": ["member_records"], "member_raw": ["customer_geo"], "district_lookup": ["customer_geo"]})


def with_views(*names: str) -> str:
    """``WITH a AS (...), b AS (...) `` for the named views and their inputs."""
    order: list[str] = []

    def add(n):
        for dep in _DEPENDS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n"
