"""Physical-plan properties the design relies on (pushdown, pruning, no
single-task window over data, bounded broadcasts)."""

import os
import tempfile

from pyspark.sql import functions as F

from clientele.operators import ranking as K
from clientele.operators import rfm as R
from clientele.sources import readers as IO
from clientele.sources import views as V
from conftest import SF_SMALL


def formatted(df, spark):  # noqa: ARG001
    import io
    import contextlib
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_snapshot_filter_reaches_the_scan(spark):
    df = R.rfm(V.visits(spark, SF_SMALL), V.SNAPSHOT_BEFORE, V.members(spark, SF_SMALL))
    text = formatted(df, spark)
    assert "LessThan(o_orderdate," in text  # the cut is a Parquet pushed filter
    assert "o_comment" not in text


def test_one_column_read_is_pruned(spark):
    o = IO.read_table(spark, SF_SMALL, "orders").select(F.to_date("o_orderdate").alias("d"))
    text = formatted(o.agg(F.min("d")), spark)
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in text


def test_partition_filter_prunes_folders(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="clientele-parts-"), "sheets")
    df = spark.createDataFrame([(1, "jan24"), (2, "feb24"), (3, "jan25")], "x long, Month string")
    df.write.partitionBy("Month").parquet(root)
    parts = IO.read_partitions(spark, root, "Month", "24")
    text = formatted(parts, spark)
    assert "PartitionFilters: [" in text and "Month" in text.split("PartitionFilters: [", 1)[1].split("]")[0]
    assert sorted(r.x for r in parts.collect()) == [1, 2]


def test_segment_lookup_is_an_expression_not_a_join(spark):
    df = R.rfm(V.visits(spark, SF_SMALL), V.SNAPSHOT_AFTER)
    text = formatted(df, spark)
    assert "LocalTableScan" not in text  # the 27-row segment table is a literal map, not a joined table
    assert "map(High|High|High" in text or "Champion" in text


def test_range_path_has_no_unpartitioned_window_over_rows(spark):
    df = spark.range(0, 5000).select((F.col("id") % 7).alias("v"), F.col("id").alias("k"))
    ranked = K.global_rank(df, ["v", "k"])  # no size hint: distributed path
    text = formatted(ranked, spark)
    assert "BroadcastHashJoin" in text  # per-range offsets (one row per partition) are broadcast
    assert "MapInPandas" not in text  # running sums already checkpointed
    assert ranked.agg(F.max("rank")).first()[0] == 5000


def test_pair_counts_makes_the_basket_rows_once_in_a_given_number_of_partitions(spark):
    from clientele.operators import basket as B
    rows = [("a", d, d % 4, f"i{i:02d}") for d in range(3) for i in range(30) for _ in range(d + 1)]
    t = spark.createDataFrame(rows + [("a", 9, 9, "i00"), (None, 1, 1, "i00"), (None, 1, 1, "i01"), ("a", 1, None, "i00")],
                              "customer string, tx_date int, ticket long, item string")
    pairs = B.pair_counts(t, block=4)
    text = formatted(pairs, spark)
    assert text.count("\n(") and len([x for x in text.splitlines() if x.startswith("(") and "Scan ExistingRDD" in x]) == 1
    assert text.count("REPARTITION_BY_NUM") == 3  # else they are merged to a size when written, many times that in a task
    got = {(r.item_a, r.item_b): r.n_baskets for r in pairs.collect()}
    assert got == {(f"i{a:02d}", f"i{b:02d}"): 4 if (a, b) == (0, 1) else 3 for a in range(30) for b in range(a + 1, 30)}


def test_rank_tertiles_order_only_their_columns(spark, monkeypatch):
    from clientele.operators import tertiles as T
    seen, offsets = [], T.ordered_offsets
    monkeypatch.setattr(T, "ordered_offsets", lambda df, *a: seen.append(df.columns) or offsets(df, *a))
    df = spark.range(7).select("id", (F.col("id") % 2).alias("v"), F.lit("long text").alias("text"))
    got = {r.id: (r.text, r.m) for r in T.rank_tertiles(df, "v", ["id"], "m").collect()}
    assert seen == [["v", "id"]]
    assert [got[k] for k in (0, 2, 4, 6, 1, 3, 5)] == [("long text", m) for m in ("Low", "Low", "Medium", "Medium", "High", "High", "High")]
    again = T.rank_tertiles(df.union(df), "v", [], "m")  # keys repeat across the edges: the rows themselves are ranked
    assert sorted(r.m for r in again.collect()) == ["High"] * 5 + ["Low"] * 5 + ["Medium"] * 4
    nulls = spark.createDataFrame([("a", None), ("b", None), ("c", 1.0), ("d", float("nan"))], "k string, v double")
    assert {r.k: r.m for r in T.rank_tertiles(nulls, "v", ["k"], "m", stats={"nd": 2, "rows": 4}).collect()} == {
        "a": "Low", "b": "Medium", "c": "High", "d": "High"}


def test_report_passes_have_few_tasks(spark):
    from clientele.operators import report as P
    cust = P.customer_table(V.visits(spark, SF_SMALL))
    assert cust.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_distinct_texts_counts_each_column_once(spark):
    from clientele.operators import chains as H
    t = spark.createDataFrame([("x", 1, None), ("x", 2, "p"), (None, 2, "p")], "a string, b int, c string")
    got = sorted(((r.column, r.text, r.n) for r in H.distinct_texts(t, ["a", "b", "c"]).collect()), key=repr)
    assert got == sorted([("a", "x", 2), ("a", None, 1), ("b", "1", 1), ("b", "2", 2), ("c", None, 1), ("c", "p", 2)], key=repr)
