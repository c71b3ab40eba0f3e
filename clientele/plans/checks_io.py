"""Checked queries: readers, writers (read back), streaming ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele.operators import clean as C
from clientele.operators import quality as Q
from clientele.operators import rfm as R
from clientele.plans.checks_clean import PAIR_SQL
from clientele.plans.checks_rfm import rfm_sql
from clientele.plans.checks_text import DATA_YEARS, month_label_sql, service_key_sql
from clientele.plans.registry import register
from clientele.sources import readers as IO
from clientele.sources import sinks as K
from clientele.sources import views as V
from clientele.streaming import ingest as S

SNAP = V.SNAPSHOT_AFTER


@register("s01_read_table", "SELECT * FROM customer")
def s01_read_table(spark, d):
    return IO.read_table(spark, d, "customer")


PRICE_SCHEMA = "row_id BIGINT, category STRING, service STRING, price DECIMAL(18,2)"


@register("s02_csv_round_trip", V.with_views("pricelist") + "SELECT * FROM pricelist")
def s02_csv_round_trip(spark, d):
    """K2 + S2: price list written as CSV with a header, read with its schema."""
    path = K.write_csv(V.pricelist(spark, d), K.output_path(spark, "pricelist_csv"))
    return IO.read_csv(spark, path, PRICE_SCHEMA)


@register("s01_numbered_csv", V.with_views("pricelist") + """SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, service, price
  FROM pricelist""")
def s01_numbered_csv(spark, d):
    """Rows numbered in file order at ingest, over several files."""
    path = K.write_ordered_csv(V.pricelist(spark, d), K.output_path(spark, "ordered_csv"), "row_id")
    schema = "place BIGINT, category STRING, service STRING, price DECIMAL(18,2)"
    return IO.read_numbered(spark, path, schema).select("row_id", "service", "price")


@register("a16_numbered_keep_first", V.with_views("pricelist") + f"""SELECT svc, price FROM (SELECT {service_key_sql('service')} AS svc, price,
    row_number() OVER (PARTITION BY {service_key_sql('service')} ORDER BY row_id) AS rn FROM pricelist) WHERE rn = 1""")
def a16_numbered_keep_first(spark, d):
    """A16 on ingested files: the first price of a service in file order."""
    from clientele.functions.text import service_key
    from clientele.operators.pricing import first_per_key
    path = K.write_ordered_csv(V.pricelist(spark, d), K.output_path(spark, "ordered_prices"), "row_id")
    rows = IO.read_numbered(spark, path, "place BIGINT, category STRING, service STRING, price DECIMAL(18,2)")
    return first_per_key(rows, service_key("service"), "row_id", ["price"]).withColumnRenamed("_key", "svc")


@register("w13_numbered_pairing", PAIR_SQL + "SELECT line_no AS row_id, no, name, birthplace, birth_date, nullif(address, '') AS address FROM paired")
def w13_numbered_pairing(spark, d):
    """W13 on ingested files: lines paired by their place in the export (a CSV file holds no empty text but null)."""
    raw = V.member_raw(spark, d)
    path = K.write_ordered_csv(raw, K.output_path(spark, "member_export"), "line_no")
    rows = IO.read_numbered(spark, path, raw.schema).drop("line_no")
    return C.pair_rows(rows, "row_id").select("row_id", "no", "name", "birthplace", "birth_date",
                                              F.nullif("address", F.lit("")).alias("address"))


@register("s03_sheet_parts", V.with_views("sheets") + """SELECT sheet AS Month, count(*) AS n_rows,
    CAST(sum(total_price) AS DECIMAL(38,2)) AS total FROM sheets WHERE ends_with(trim(sheet), '98') GROUP BY 1""")
def s03_sheet_parts(spark, d):
    """S3 + P11: parts stored per sheet; only sheets ending in '98' are read
    (partition pruning), each row tagged with its sheet."""
    root = K.write_table(V.sheets(spark, d).withColumnRenamed("sheet", "Month"),
                         K.output_path(spark, "sheets"), partition_by=["Month"])
    parts = IO.read_partitions(spark, root, "Month", "98",
                               schema="row_id BIGINT, customer STRING, tx_date DATE, item STRING, "
                                      "qty DECIMAL(18,2), ticket BIGINT, total_price DECIMAL(18,2), Month STRING")
    return parts.groupBy("Month").agg(F.count(F.lit(1)).alias("n_rows"),
                                      F.sum("total_price").cast("decimal(38,2)").alias("total"))


@register("s05_read_any_json", "SELECT r_regionkey, r_name FROM region")
def s05_read_any_json(spark, d):
    """Reader chosen by extension (here JSON)."""
    path = K.output_path(spark, "regions") + ".json"
    IO.read_table(spark, d, "region").write.mode("overwrite").json(path)
    return IO.read_any(spark, path, "r_regionkey INT, r_name STRING")


@register("s09_area_names", "SELECT DISTINCT r_name AS area FROM region")
def s09_area_names(spark, d):
    """Area names from a GeoJSON document (features[].properties.NAME_3)."""
    regions = IO.read_table(spark, d, "region")
    doc = regions.agg(F.collect_list(F.struct(F.struct(F.col("r_name").alias("NAME_3")).alias("properties")))
                      .alias("features"))  # one document; the region table is 5 rows
    path = K.output_path(spark, "areas") + ".geojson"
    doc.coalesce(1).write.mode("overwrite").json(path)
    return IO.read_area_names(spark, path)


@register("k01_write_read_back", rfm_sql() + "SELECT * FROM rfm")
def k01_write_read_back(spark, d):
    """K1: the RFM table written as Parquet and read back."""
    path = K.write_table(R.rfm(V.visits(spark, d), SNAP, V.members(spark, d)), K.output_path(spark, "rfm"))
    return spark.read.parquet(path)


@register("k03_export_filtered", rfm_sql() + "SELECT * FROM rfm WHERE status = 'Member'")
def k03_export_filtered(spark, d):
    """K3: filtered export to '<stem>_filtered' (skipped when empty)."""
    r = R.rfm(V.visits(spark, d), SNAP, V.members(spark, d)).where(F.col("status") == "Member")
    path = K.export_filtered(r, K.output_path(spark, "exports"), "member_rfm")
    return spark.read.parquet(path)


@register("k04_split_write", rfm_sql() + """SELECT r_score = 'High' AS recent, count(*) AS n_rows FROM rfm
  GROUP BY 1""")
def k04_split_write(spark, d):
    """K4: one input, two outputs by a predicate, as one partitioned write."""
    r = R.rfm(V.visits(spark, d), SNAP, V.members(spark, d)).withColumn("recent", F.col("r_score") == "High")
    path = K.write_split(r, K.output_path(spark, "split"), "recent")
    back = spark.read.schema(r.schema).parquet(path)
    return back.groupBy("recent").agg(F.count(F.lit(1)).alias("n_rows"))


@register("k05_empty_output", V.with_views("visits") + """SELECT row_id, customer, CAST(NULL AS VARCHAR) AS note
  FROM visits WHERE false""")
def k05_empty_output(spark, d):
    """K5: a filter that keeps nothing still writes a table with its schema."""
    v = V.visits(spark, d).select("row_id", "customer", F.lit(None).cast("string").alias("note"))
    out = C.with_value(v, "note")
    path = K.write_table(out, K.output_path(spark, "empty"))
    return spark.read.parquet(path)


@register("q05_observed_write", V.with_views("tx") + "SELECT count(*) AS n_rows FROM tx")
def q05_observed_write(spark, d):
    """Q5: the stage's row count observed on its own write (no second job)."""
    metrics = Q.observed_write(V.tx(spark, d), K.output_path(spark, "observed"))
    return spark.range(1).select(F.lit(metrics["rows"]).cast("long").alias("n_rows"))


_SP, _EXP = month_label_sql("Month")


@register("st01_streaming_ingest", V.with_views("sheets", "pricelist").rstrip() + f""",
pl AS (SELECT svc, price FROM (SELECT {service_key_sql('service')} AS svc, price,
    row_number() OVER (PARTITION BY {service_key_sql('service')} ORDER BY row_id) AS rn FROM pricelist) WHERE rn = 1),
lab AS (SELECT *, {_SP} AS lbl FROM (SELECT sheet AS Month, * EXCLUDE (sheet, total_price) FROM sheets))
SELECT {_EXP} AS Month, customer, tx_date, item, qty,
    coalesce(TRY_CAST(pl.price AS DECIMAL(18,2)), 0) AS unit_price,
    CAST(coalesce(TRY_CAST(pl.price AS DECIMAL(18,2)), 0) * qty AS DECIMAL(38,2)) AS total_price
  FROM lab LEFT JOIN pl ON {service_key_sql('lab.item')} = pl.svc""")
def st01_streaming_ingest(spark, d):
    """Streaming: monthly parts cleaned and priced by a Structured Streaming
    job (availableNow), the sink read back."""
    src = K.output_path(spark, "stream_src")
    parts = V.sheets(spark, d).select(F.col("sheet").alias("Month"), "customer", "tx_date", "item", "qty")
    K.write_table(parts, src)  # a part a task, so there are more of them as the sheets grow
    schema = "Month STRING, customer STRING, tx_date DATE, item STRING, qty DECIMAL(18,2)"
    sink = K.output_path(spark, "stream_sink")
    S.run_ingest(spark, src, schema, V.pricelist(spark, d), sink, label="Month", years=DATA_YEARS)
    return spark.read.parquet(sink).select("Month", "customer", "tx_date", "item", "qty", "unit_price", "total_price")
