"""Golden tests for readers, writers and schema helpers."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from clientele.sources import readers as IO
from clientele.sources import schemas as S
from clientele.sources import sinks as K


def test_read_any_dispatch_and_reject(spark):
    base = tempfile.mkdtemp(prefix="clientele-src-")
    df = spark.createDataFrame([(1, "a")], "id long, s string")
    df.write.parquet(os.path.join(base, "t.parquet"))
    df.write.option("header", True).csv(os.path.join(base, "t.csv"))
    df.write.json(os.path.join(base, "t.json"))
    assert IO.read_any(spark, os.path.join(base, "t.parquet")).count() == 1
    df.write.parquet(os.path.join(base, "folder"))
    assert IO.read_any(spark, "file:" + os.path.join(base, "folder")).count() == 1
    assert IO.read_any(spark, os.path.join(base, "t.csv"), "id long, s string").first().s == "a"
    assert IO.read_any(spark, os.path.join(base, "t.json"), "id long, s string").first().id == 1
    with pytest.raises(ValueError):
        IO.read_any(spark, os.path.join(base, "t.xlsx"))
    with pytest.raises(ValueError):
        IO.read_any(spark, os.path.join(base, "t.csv"))  # CSV needs a declared schema


def test_conform_fill_and_order(spark):
    df = spark.createDataFrame([(1, "Ann", "x")], "`No.` long, ` Name ` string, Extra string")
    c = S.conform(df, {"No.": "no", "Name": "name", "Email": "email"})
    assert c.columns == ["no", "name"]
    f = S.fill_missing(c, {"email": (None, "string"), "points": (0, "int")})
    assert f.columns == ["no", "name", "email", "points"] and f.first().points == 0
    o = S.insert_after(f.withColumn("vip", F.lit("2")), "name", ["vip"])
    assert o.columns == ["no", "name", "vip", "email", "points"]


def test_resolve_column(spark):
    df = spark.createDataFrame([(1, "d", "a")], "ID long, `Birth_Date` string, Address string")
    assert S.resolve_column(df, "No.", aliases=["No", "ID"]) == "ID"
    assert S.resolve_column(df, "BirthDate", fuzzy=("birth", "date")) == "Birth_Date"
    assert S.resolve_column(df, "Missing") is None
    assert S.resolve_column(df, "Nope", numeric_fallback=True) == "ID"


def test_required_columns_and_all_null(spark):
    df = spark.createDataFrame([(1, None)], "a long, b string")
    with pytest.raises(ValueError, match="missing required columns"):
        S.require_columns(df, ["a", "c"])
    row = S.all_null_columns(df, ["a", "b"]).first()
    assert row.a_all_null is False and row.b_all_null is True


def test_export_filtered_skips_empty_and_keeps_schema(spark):
    base = tempfile.mkdtemp(prefix="clientele-out-")
    df = spark.createDataFrame([(1, "a")], "id long, s string")
    assert K.export_filtered(df.where(F.col("id") > 5), base, "none") is None
    path = K.export_filtered(df, base, "some")
    assert path.endswith("some_filtered") and spark.read.parquet(path).count() == 1
    empty = K.write_table(df.where(F.col("id") > 5), os.path.join(base, "empty"))
    back = spark.read.parquet(empty)
    assert back.count() == 0 and back.columns == ["id", "s"]


def test_stream_restart_keeps_every_row_once(spark):
    from clientele.streaming import ingest
    base = tempfile.mkdtemp(prefix="clientele-stream-")
    src, sinks = os.path.join(base, "src"), [os.path.join(base, x, "out") for x in ("a", "b")]
    schema = "Month string, customer string, tx_date date, item string, qty decimal(18,2)"
    prices = spark.sql("SELECT 1L AS row_id, 'wash' AS service, CAST(5 AS DECIMAL(18,2)) AS price")
    part = lambda names: (spark.createDataFrame([(n,) for n in names], "customer string")
                          .selectExpr("'jan24' Month", "customer", "date'2024-01-02' tx_date", "'wash' item",
                                      "cast(1 as decimal(18,2)) qty").write.mode("append").parquet(src))
    part(["ann", "bob"])
    for sink in sinks:  # two sinks of one base name
        ingest.run_ingest(spark, src, schema, prices, sink)
    part(["cid"])
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(os.path.join(base, "ckpt"))  # as a restarted application has
    try:
        for sink in sinks:
            ingest.run_ingest(spark, src, schema, prices, sink)
            assert spark.read.parquet(sink).count() == 3
    finally:
        if before:
            spark.sparkContext.setCheckpointDir(os.path.dirname(before.removeprefix("file:")))


def test_means_skip_nulls(spark):
    from clientele.operators import facets
    df = spark.createDataFrame([("a", 1.0, 1, 4), ("b", None, None, None)],
                               "cust_norm string, total_spent double, recency_days int, frequency int")
    row = facets.kpi_row(df).first()
    assert (row.avg_recency, row.avg_frequency, row.avg_monetary) == (1.0, 4.0, 1.0)
    assert facets.group_stats(df, ["cust_norm"]).where("cust_norm = 'b'").first().avg_spent is None


def test_streamed_parts_grow_with_the_sheets(spark, monkeypatch, tmp_path):
    from clientele.plans import checks_io as Q
    rows = spark.range(0, 1200, 1, 12).select(
        F.lit("jan98").alias("sheet"), F.lit("a").alias("customer"), F.lit("1998-01-01").cast("date").alias("tx_date"),
        F.lit("x").alias("item"), F.lit(1).cast("decimal(18,2)").alias("qty"))
    prices = spark.sql("SELECT 1L AS row_id, 'x' AS service, CAST(2 AS DECIMAL(18,2)) AS price")
    monkeypatch.setattr(Q.V, "sheets", lambda s, d: rows)
    monkeypatch.setattr(Q.V, "pricelist", lambda s, d: prices)
    monkeypatch.setattr(Q.K, "output_path", lambda s, name: str(tmp_path / name))
    out = Q.st01_streaming_ingest(spark, "")
    assert out.count() == 1200 and out.where("total_price = 2").count() == 1200
    assert len(list((tmp_path / "stream_src").glob("part-*.parquet"))) == 12  # a part a task, not four however many rows
