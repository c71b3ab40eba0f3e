"""Golden and brute-force tests: RFM arithmetic (C1), rule scores (C17),
segments, global rank (C6), quantiles (A21), tertiles (C7, C8, W10-W12)."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.functions import scores as S
from clientele.operators import ranking as K
from clientele.operators import rfm as R
from clientele.operators import tertiles as T

TX_SCHEMA = "row_id long, customer string, tx_date date, item string, total_price double"


def tx(spark, rows):
    df = spark.createDataFrame([(a, b, c, d, float(e)) for a, b, c, d, e in rows], TX_SCHEMA)
    return df.withColumn("total_price", F.col("total_price").cast("decimal(18,2)"))


def test_snapshot_arithmetic(spark):
    d = dt.date
    rows = [(1, "Ann", d(2024, 1, 10), "facial", 100), (2, " ann ", d(2024, 1, 11), "peel", 50),
            (3, "ANN", d(2024, 1, 12), "peel", 70), (4, None, d(2024, 1, 1), "", 5),
            (5, "Bob", None, "x", 9)]
    out = {r.cust_norm: r for r in R.rfm(tx(spark, rows), "2024-01-10").collect()}
    ann = out["ann"]
    # the next day is included (C1) and recency is measured to snapshot + 2
    assert ann.recency_days == 1 and ann.frequency == 2 and float(ann.monetary_value) == 150
    assert ann.customer == "Ann" and ann.total_items == 2 and ann.item_summary == "facial (1), peel (1)"
    # null names form one customer keyed '' ; a blank item is not counted
    assert out[""].total_items == 0 and out[""].item_summary == ""
    assert "bob" not in out  # undated rows drop
    snap_day = {r.cust_norm: r.recency_days for r in
                R.rfm(tx(spark, [(1, "a", d(2024, 1, 10), "x", 1)]), "2024-01-10").collect()}
    assert snap_day["a"] == 2


@pytest.mark.parametrize("value,expect", [(89, "High"), (90, "Medium"), (180, "Medium"), (181, "Low"), (None, "Low")])
def test_r_rule(spark, value, expect):
    df = spark.createDataFrame([(value,)], "v long")
    assert df.select(S.r_rule("v")).first()[0] == expect


def test_f_m_rules(spark):
    df = spark.createDataFrame([(14, 5000001.0), (13, 5000000.0), (2, 1000000.0), (1, 999999.99)], "f long, m double")
    got = [(r[0], r[1]) for r in df.select(S.f_rule("f"), S.m_rule("m")).collect()]
    assert got == [("High", "High"), ("Medium", "Medium"), ("Medium", "Medium"), ("Low", "Low")]


def test_segment_table_complete(spark):
    labels = ["High", "Medium", "Low"]
    rows = [(a, b, c) for a in labels for b in labels for c in labels] + [("x", "High", "High")]
    df = spark.createDataFrame(rows, "r string, f string, m string")
    got = df.select(S.segment("r", "f", "m")).collect()
    want = {(a, b, c): s for a, b, c, s in S.SEGMENT_TABLE}
    assert [g[0] for g in got[:-1]] == [want[r] for r in rows[:-1]]
    assert got[-1][0] == "Undefined"
    assert len(want) == 27


def test_global_rank_matches_sort(spark):
    random.seed(1)
    vals = [(f"c{i:04d}", random.choice([0, 0, 0, 1, 2, 3, 5, 8])) for i in range(600)]  # a third are 0
    df = spark.createDataFrame(vals, "k string, v long")
    got = {r.k: r.rank for r in K.global_rank(df, ["v", "k"]).collect()}
    want = {k: i + 1 for i, (k, _) in enumerate(sorted(vals, key=lambda t: (t[1], t[0])))}
    assert got == want


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.integers(0, 50, 300), np.zeros(200, dtype=int)])
    df = spark.createDataFrame([(int(v),) for v in vals], "v long")
    got = K.exact_quantiles(df, "v", [1 / 3, 2 / 3, 0.5, 0.0, 1.0])
    want = np.quantile(vals.astype(float), [1 / 3, 2 / 3, 0.5, 0.0, 1.0])
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def _qcut_rank_labels(n):
    """Brute force of C8: pandas-style tertiles of ranks 1..n with edges a
    hair low, as the survey measured (strict integer rule)."""
    return ["Low" if 3 * (k - 1) < n - 1 else "Medium" if 3 * (k - 1) < 2 * (n - 1) else "High"
            for k in range(1, n + 1)]


@pytest.mark.parametrize("n", [2, 3, 4, 5, 7, 10, 31])
def test_rank_tertiles(spark, n):
    rows = [(f"c{i:03d}", float(i % 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.m for r in T.rank_tertiles(df, "v", ["k"], "m").collect()}
    order = sorted(rows, key=lambda t: (t[1], t[0]))
    want = dict(zip([k for k, _ in order], _qcut_rank_labels(n)))
    assert got == want


def test_rank_tertiles_single_value(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "k string, v double")
    assert {r.m for r in T.rank_tertiles(df, "v", ["k"], "m").collect()} == {"Medium"}


def test_value_tertiles_edges_and_fallback(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 3, 4]], "v long")
    got = [r.s for r in T.value_tertiles(df, "v", "s").orderBy("v").collect()]
    assert got == ["Low", "Low", "Medium", "High"]  # edge 2.0 exactly is inclusive (C7)
    dup = spark.createDataFrame([(v,) for v in [1, 1, 1, 1, 2, 9]], "v long")  # q1 == q2 -> equal width
    got = [r.s for r in T.value_tertiles(dup, "v", "s").orderBy("v").collect()]
    assert got == ["Low", "Low", "Low", "Low", "Low", "High"]
    one = spark.createDataFrame([(5,), (5,)], "v long")
    assert {r.s for r in T.value_tertiles(one, "v", "s").collect()} == {"Medium"}


@pytest.mark.parametrize("d", [1, 2, 3, 4, 5, 6, 7, 8, 10, 13, 16, 22, 31, 40, 61])
def test_fair_tertiles(spark, d):
    """One label per distinct value, as pd.qcut of the distinct values gives them (one and two values: the first labels)."""
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(d)
    for values in (range(1, d + 1), sorted(rng.choice(5 * d, d, replace=False).tolist())):
        values = list(values)
        labels = list(pd.qcut(pd.Series(values), q=3, labels=["Low", "Medium", "High"])) if d > 2 else ["Low", "Medium"]
        expect = dict(zip(values, labels))
        df = spark.createDataFrame([(v,) for v in values + values[:1]], "v long")
        for few in (False, True):
            assert {r.v: r.f for r in T.fair_tertiles(df, "v", "f", few=few).collect()} == expect


def test_index_split_and_equal_width(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, 5]], "v long")
    got = {r.v: r.b for r in T.index_split_labels(df, "v", "b").collect()}
    assert got == {1: "Low", 2: "Low", 3: "Medium", 4: "Medium", 5: "High"}  # min(int(3i/5), 2)
    ew = {r.v: r.b for r in T.equal_width_labels(df, "v", "b").collect()}
    assert ew == {1: "Low", 2: "Low", 3: "Medium", 4: "High", 5: "High"}


def test_segment_counts_one_segment_per_customer(spark):
    d = dt.date
    rows = [(i, f"c{i % 17}", d(2024, 1, 1 + i % 20), "x", 1000 * i) for i in range(200)]
    scored = R.rfm(tx(spark, rows), "2024-01-31")
    assert scored.count() == scored.select("cust_norm").distinct().count() == 17
    counts = R.segment_counts(scored).collect()
    assert sum(r.n_customers for r in counts) == 17
    assert abs(sum(r.percent for r in counts) - 100) < 1e-9
    assert scored.where(F.col("rfm_class").isNull()).count() == 0


def test_global_rank_equals_a_sort(spark):
    random.seed(2)
    vals = [(f"c{i:04d}", random.choice([0, 0, 1, 2, 7])) for i in range(300)]
    df = spark.createDataFrame(vals, "k string, v long")
    a = {r.k: r.rank for r in K.global_rank(df, ["v", "k"]).collect()}
    assert a == {k: i for i, (v, k) in enumerate(sorted((v, k) for k, v in vals), 1)}
