"""Checked queries: member cleaning, district enrichment, pricing, merge aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele.operators import clean as C
from clientele.operators import dedup as U
from clientele.operators import pricing as P
from clientele.plans.checks_text import _dmy_sql, service_key_sql
from clientele.plans.registry import name_key_sql, register, strip_sql
from clientele.sources import schemas as S
from clientele.sources import views as V


def _cont_sql(x: str) -> str:
    return (f"coalesce({strip_sql(f'CASE WHEN strpos({x}, {chr(39)}:{chr(39)}) > 0 THEN substr({x}, strpos({x}, {chr(39)}:{chr(39)}) + 1) END')}, '')")


def pair_sql(view: str, more: str = "") -> str:
    """CTE ``paired``: one record of two lines of ``view``; ``more`` names columns kept from the first."""
    return V.with_views(view).rstrip() + f""",
n AS (SELECT line_no, no, name, birthplace, {_dmy_sql('birth_date')} AS birth_date, address{more} FROM {view}),
top AS (SELECT *, line_no // 2 AS pair FROM n WHERE line_no % 2 = 0),
bot AS (SELECT (line_no - 1) // 2 AS pair, birthplace AS bp, no AS first FROM n WHERE line_no % 2 = 1),
j AS (SELECT top.*, bp, CASE WHEN coalesce(starts_with(lower({strip_sql('first')}), '*address'), false)
    THEN {_cont_sql('first')} END AS extra FROM top LEFT JOIN bot USING (pair)),
paired AS (SELECT line_no, no, name, coalesce(bp, birthplace) AS birthplace, birth_date,
    CASE WHEN extra IS NULL THEN address WHEN address IS NULL OR address = '' THEN extra
         ELSE address || ', ' || extra END AS address{more} FROM j)
"""


PAIR_SQL = pair_sql("member_raw")


@register("w13_row_pairing", PAIR_SQL + "SELECT * FROM paired")
def w13_row_pairing(spark, d):
    """W13 + X10 + X14: two export lines per member folded into one record."""
    return C.pair_rows(V.member_raw(spark, d))


@register("k04_split_by_address", PAIR_SQL + f""", a AS (SELECT {strip_sql("coalesce(address, '')")} AS address FROM paired)
SELECT address <> '' AS has_address, count(*) AS n_rows FROM a GROUP BY 1""")
def k04_split_by_address(spark, d):
    """Records with and without an address (two outputs, counted)."""
    with_a, without_a = C.split_by_address(C.pair_rows(V.member_raw(spark, d)))
    return (with_a.select(F.lit(True).alias("has_address"))
            .unionByName(without_a.select(F.lit(False).alias("has_address")))
            .groupBy("has_address").agg(F.count(F.lit(1)).alias("n_rows")))


def _addresses(spark, d):
    p = V.member_profile(spark, d)
    return p.select("member_no", F.when(F.col("member_no") % 10 == 0, F.lit("  "))
                    .otherwise(F.col("city")).alias("address"))


DISTRICT_SQL = V.with_views("member_profile", "district_lookup").rstrip() + f""",
addr AS (SELECT member_no, CASE WHEN member_no % 10 = 0 THEN '  ' ELSE city END AS address FROM member_profile),
lk AS (SELECT {name_key_sql('address')} AS ak, min(district) AS district FROM district_lookup GROUP BY 1),
enriched AS (SELECT member_no, address, CASE WHEN NOT coalesce({strip_sql('address')} <> '', false) THEN NULL
    ELSE coalesce(lk.district, 'Not Found') END AS district
  FROM addr LEFT JOIN lk ON {name_key_sql('addr.address')} = lk.ak)
"""


@register("j13_district_enrichment", DISTRICT_SQL + "SELECT * FROM enriched")
def j13_district_enrichment(spark, d):
    """District by address lookup; miss 'Not Found', blank address null."""
    return C.enrich_district(_addresses(spark, d), V.district_lookup(spark, d))


@register("f08_valid_districts", DISTRICT_SQL + """SELECT member_no, address,
    regexp_replace(district, '^Kecamatan\\s+', '') AS district FROM enriched
  WHERE district IS DISTINCT FROM 'Not Found'""")
def f08_valid_districts(spark, d):
    """F8 + X9: drop 'Not Found' (nulls kept) and strip the prefix."""
    return C.valid_districts(C.enrich_district(_addresses(spark, d), V.district_lookup(spark, d)))


@register("a25_district_counts", DISTRICT_SQL + """SELECT district, count(*) AS n_customers FROM enriched
  WHERE district IS NOT NULL GROUP BY 1""")
def a25_district_counts(spark, d):
    from clientele.operators.facets import value_counts
    e = C.enrich_district(_addresses(spark, d), V.district_lookup(spark, d))
    return value_counts(e, "district", "n_customers")


@register("j12_unmapped_districts", V.with_views("member_profile", "area_dictionary") + """SELECT DISTINCT district
  FROM member_profile WHERE district IS NOT NULL AND district NOT IN (SELECT area FROM area_dictionary WHERE area IS NOT NULL)""")
def j12_unmapped_districts(spark, d):
    """Districts in the data that the area dictionary lacks (anti join)."""
    p = V.member_profile(spark, d).select("district").where(F.col("district").isNotNull()).distinct()
    return p.join(V.area_dictionary(spark, d), p.district == F.col("area"), "left_anti")


@register("x28_geocode_reply", V.with_views("geocode_replies") + """SELECT address,
    CASE WHEN json_extract_string(reply, '$.status') = 'OK' THEN coalesce(list_filter(
        from_json(json_extract(reply, '$.results[0].address_components'), '[{"long_name":"VARCHAR","types":["VARCHAR"]}]'),
        lambda c: list_contains(c.types, 'administrative_area_level_3'))[1].long_name, 'Not Found')
    ELSE 'Not Found' END AS district FROM geocode_replies""")
def x28_geocode_reply(spark, d):
    """District name from stored geocoder replies."""
    g = V.geocode_replies(spark, d)
    return g.select("address", C.district_from_reply("reply").alias("district"))


@register("p09_canonical_profile", V.with_views("member_records") + f"""SELECT no,
    CASE WHEN {strip_sql('hobby')} IS NULL OR {strip_sql('hobby')} IN ('nan', '', 'None') THEN 'Unknown'
         ELSE {strip_sql('hobby')} END AS hobby,
    CASE WHEN lower({strip_sql('delivery')}) = 'yes' THEN 'Yes' ELSE 'No' END AS delivery
  FROM member_records""")
def p09_canonical_profile(spark, d):
    """P9 + P10: unknown text and yes/no flags made canonical."""
    r = V.member_records(spark, d).select("no", "hobby", "delivery")
    return C.canonical_profile(r, ["hobby"], ["delivery"])


@register("f07_nonblank_filter", V.with_views("member_records") + f"""SELECT no, birth_date FROM member_records
  WHERE coalesce({strip_sql('birth_date')} <> '', false)""")
def f07_nonblank_filter(spark, d):
    """Keep rows whose birth date holds text."""
    return C.with_value(V.member_records(spark, d).select("no", "birth_date"), "birth_date")


PRICE_SQL = V.with_views("dirty_tx", "pricelist").rstrip() + f""",
pl AS (SELECT svc, price FROM (SELECT {service_key_sql('service')} AS svc, price,
    row_number() OVER (PARTITION BY {service_key_sql('service')} ORDER BY row_id) AS rn FROM pricelist) WHERE rn = 1),
priced AS (SELECT t.row_id, t.item, t.qty, coalesce(TRY_CAST(pl.price AS DECIMAL(18,2)), 0) AS unit_price,
    CAST(coalesce(TRY_CAST(pl.price AS DECIMAL(18,2)), 0) * t.qty AS DECIMAL(38,2)) AS total_price
  FROM dirty_tx t LEFT JOIN pl ON {service_key_sql('t.item')} = pl.svc)
"""


@register("j01_price_lookup", PRICE_SQL + "SELECT * FROM priced")
def j01_price_lookup(spark, d):
    """J1 + P5: first price per service key, line total price x qty."""
    t = P.price_lookup(V.dirty_tx(spark, d).drop("total_price"), V.pricelist(spark, d))
    return t.select("row_id", "item", "qty", "unit_price", "total_price")


@register("a16_keep_first", PRICE_SQL + "SELECT svc, CAST(price AS DECIMAL(18,2)) AS price FROM pl")
def a16_keep_first(spark, d):
    """One price-list row per service key, the first in file order."""
    from clientele.functions.text import service_key
    pl = V.pricelist(spark, d)
    return P.first_per_key(pl, service_key("service"), "row_id", ["price"]).withColumnRenamed("_key", "svc")


@register("p06_placeholder_total", V.with_views("tx") + """SELECT CAST(sum(coalesce(qty, 1) * 100000) AS DECIMAL(38,2))
    AS total FROM tx""")
def p06_placeholder_total(spark, d):
    """Line value without a price column: coalesce(qty, 1) * 100000."""
    t = P.placeholder_total(V.tx(spark, d).drop("total_price"))
    return t.agg(F.sum("total_price").cast("decimal(38,2)").alias("total"))


@register("f01_label_only_rows", V.with_views("sheets") + """SELECT count(*) AS n_rows FROM (
    SELECT sheet, CASE WHEN ticket % 50 = 0 THEN NULL ELSE customer END AS customer,
           CASE WHEN ticket % 50 = 0 THEN NULL ELSE item END AS item FROM sheets)
  WHERE NOT (sheet IS NOT NULL AND customer IS NULL AND item IS NULL)""")
def f01_label_only_rows(spark, d):
    """rows holding only the sheet label are dropped."""
    s = V.sheets(spark, d)
    blank = F.col("ticket") % 50 == 0
    s = s.select("sheet", F.when(blank, F.lit(None)).otherwise(F.col("customer")).alias("customer"),
                 F.when(blank, F.lit(None)).otherwise(F.col("item")).alias("item"))
    return C.drop_label_only_rows(s, "sheet").agg(F.count(F.lit(1)).alias("n_rows"))


@register("s06_conform_columns", V.with_views("member_profile") + """SELECT member_no AS no, name, city,
    profession, CAST(NULL AS VARCHAR) AS email, CAST(0 AS INTEGER) AS points FROM member_profile""")
def s06_conform_columns(spark, d):
    """S6 + S7: mapped columns that exist are kept and renamed; absent ones
    are added with typed defaults."""
    p = V.member_profile(spark, d).withColumnRenamed("member_no", " member_no ")  # padded header
    c = S.conform(p, {"member_no": "no", "name": "name", "city": "city", "profession": "profession",
                      "Email": "email"})
    return S.fill_missing(c, {"email": (None, "string"), "points": (0, "int")})


@register("s08_resolve_column", V.with_views("member_records") + """SELECT no AS record_no, name FROM member_records""")
def s08_resolve_column(spark, d):
    """The 'No.' column found through its aliases."""
    r = V.member_records(spark, d)
    col = S.resolve_column(r, "No.", aliases=["No", "ID", "Index", "no"], numeric_fallback=True)
    return r.select(F.col(col).alias("record_no"), "name")


@register("a05_first_valid_per_name", V.with_views("member_records") + f"""SELECT name,
    coalesce(arg_min(birth_date, no) FILTER (WHERE birth_date IS NOT NULL AND {strip_sql('birth_date')} <> ''),
             arg_min(birth_date, no) FILTER (WHERE birth_date IS NOT NULL)) AS birth_date,
    CASE WHEN count(delivery) = 0 THEN NULL
         WHEN max(CASE WHEN upper({strip_sql('delivery')}) = 'YES' THEN 1 END) = 1 THEN 'Yes' ELSE 'No' END AS delivery
  FROM member_records GROUP BY 1""")
def a05_first_valid_per_name(spark, d):
    """A5 + A6: first non-blank value and yes/no merge, grouped by name."""
    r = V.member_records(spark, d)
    return r.groupBy("name").agg(U.first_valid("birth_date", F.col("no")).alias("birth_date"),
                                 U.merge_yes_no("delivery").alias("delivery"))


def person_ctes(records: str) -> str:
    """CTE text ``persons`` (no, name, person_id and the other columns) over a
    table of records numbered by ``no`` and ``row_id``: the scan as a recursion
    over the signatures of a name, the open clusters in lists."""
    blank = lambda c: f"CASE WHEN regexp_matches({c}, '^\\s*$') THEN NULL ELSE {c} END"
    return f""",
rec AS (SELECT *, {blank('birth_date')} AS bd, lower({strip_sql(blank('address'))}) AS ad,
    row_number() OVER (ORDER BY no IS NULL, no, row_id) AS place FROM {records}),
sig AS (SELECT name, bd, ad, min(place) AS first, row_number() OVER (PARTITION BY name ORDER BY min(place)) AS rn,
    count(*) OVER (PARTITION BY name) AS n FROM rec WHERE name IS NOT NULL GROUP BY name, bd, ad),
fold AS (SELECT DISTINCT name, 0::BIGINT AS k, n, []::VARCHAR[] AS bds, []::VARCHAR[] AS ads, []::BIGINT[] AS assigned FROM sig
  UNION ALL
  SELECT name, k + 1, n, CASE WHEN pos = 0 THEN list_append(bds, bd)
      ELSE list_transform(range(1, len(bds) + 1), lambda i: CASE WHEN i = pos THEN coalesce(bds[i], bd) ELSE bds[i] END) END,
    CASE WHEN pos = 0 THEN list_append(ads, ad)
      ELSE list_transform(range(1, len(ads) + 1), lambda i: CASE WHEN i = pos THEN coalesce(ads[i], ad) ELSE ads[i] END) END,
    list_append(assigned, CASE WHEN pos = 0 THEN len(bds) + 1 ELSE pos END)
  FROM (SELECT fold.*, sig.bd, sig.ad, coalesce(list_min(list_filter(range(1, len(bds) + 1), lambda i:
      (bds[i] IS NULL OR sig.bd IS NULL OR bds[i] = sig.bd) AND (ads[i] IS NULL OR sig.ad IS NULL OR ads[i] = sig.ad))), 0) AS pos
    FROM fold JOIN sig ON fold.name = sig.name AND sig.rn = fold.k + 1)),
cluster AS (SELECT sig.name, bd, ad, first, assigned[rn] AS c FROM sig JOIN fold ON sig.name = fold.name AND fold.k = fold.n),
label AS (SELECT name, c, coalesce(min(first) FILTER (WHERE bd IS NOT NULL OR ad IS NOT NULL), min(first)) AS first
  FROM cluster GROUP BY 1, 2),
persons AS (SELECT rec.*, CASE WHEN rec.name IS NULL THEN rec.row_id ELSE head.row_id END AS person_id FROM rec
  LEFT JOIN cluster ON rec.name = cluster.name AND rec.bd IS NOT DISTINCT FROM cluster.bd AND rec.ad IS NOT DISTINCT FROM cluster.ad
  LEFT JOIN label ON cluster.name = label.name AND cluster.c = label.c
  LEFT JOIN rec AS head ON head.place = label.first)
"""


def _valid_sql(c: str) -> str:
    return (f"coalesce(arg_min({c}, place) FILTER (WHERE {c} IS NOT NULL AND {strip_sql(f'CAST({c} AS VARCHAR)')} <> ''), "
            f"arg_min({c}, place) FILTER (WHERE {c} IS NOT NULL)) AS {c}")


YES_SQL = f"""CASE WHEN count(delivery) = 0 THEN NULL
    WHEN max(CASE WHEN upper({strip_sql('delivery')}) = 'YES' THEN 1 END) = 1 THEN 'Yes' ELSE 'No' END AS delivery"""
_MERGED = "SELECT person_id, " + ", ".join(
    [*map(_valid_sql, ["no", "name", "birth_date", "address"]), YES_SQL, *map(_valid_sql, ["hobby", "row_id"])]) + " FROM persons GROUP BY 1"
_RECURSIVE = (V.with_views("member_records").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
              + ", numbered AS (SELECT *, no AS row_id FROM member_records)")
_MESSY = (V.with_views("messy_members").replace("WITH ", "WITH RECURSIVE ", 1).rstrip())


def _numbered(spark, d):
    return V.member_records(spark, d).withColumn("row_id", F.col("no"))


@register("w15_entity_resolution", _RECURSIVE + person_ctes("numbered") + "SELECT no, name, person_id FROM persons")
def w15_entity_resolution(spark, d):
    """W15 + X26: same-person ids within a name (first fit in file order)."""
    return U.resolve_persons(_numbered(spark, d), row_id="row_id").select("no", "name", "person_id")


@register("a07_merge_persons", _RECURSIVE + person_ctes("numbered") + _MERGED)
def a07_merge_persons(spark, d):
    """A7 + U5: one merged record per person (A5 for text columns, A6 for
    yes/no); the per-column plan is built from the schema on the driver."""
    r = U.resolve_persons(_numbered(spark, d), row_id="row_id")
    return U.merge_persons(r, row_id="row_id", yes_no=["delivery"])


@register("w15_messy_members", _MESSY + person_ctes("messy_members") + "SELECT row_id, no, name, person_id FROM persons")
def w15_messy_members(spark, d):
    """W15 on records with missing names and numbers and one name that holds a third of them."""
    r = U.resolve_persons(V.messy_members(spark, d), row_id="row_id")
    return r.select("row_id", "no", "name", "person_id")


@register("a07_merge_messy_members", _MESSY + person_ctes("messy_members") + _MERGED)
def a07_merge_messy_members(spark, d):
    """A7 on the same records: unnamed rows stay apart, rows without a number count."""
    r = U.resolve_persons(V.messy_members(spark, d), row_id="row_id")
    return U.merge_persons(r, row_id="row_id", yes_no=["delivery"])


@register("w15_fold_bounds", V.with_views("member_records") + f"""SELECT count(*) AS n_names, max(records) AS max_records,
    max(signatures) AS max_signatures FROM (
  SELECT name, count(*) AS records, count(DISTINCT (bd, ad)) AS signatures FROM (
    SELECT name, CASE WHEN regexp_matches(birth_date, '^\\s*$') THEN NULL ELSE birth_date END AS bd,
      lower({strip_sql("CASE WHEN regexp_matches(address, '^\\s*$') THEN NULL ELSE address END")}) AS ad
    FROM member_records WHERE name IS NOT NULL) GROUP BY name)""")
def w15_fold_bounds(spark, d):
    """W15 diagnostics: records and distinct signatures of the largest name
    (the fold's array size is the signature count)."""
    return U.fold_bounds(V.member_records(spark, d))
