"""File order at ingest, date shapes, the ordered scan, ROC corners, fits and guards."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clientele.functions import dates as D
from clientele.operators import churn as C
from clientele.operators import quality as Q
from clientele.operators import value as M
from clientele.operators.ranking import ordered_scan
from clientele.operators.series import decompose
from clientele.sources.readers import read_numbered


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    lines = []
    for k, n in enumerate([700, 0, 3, 2500, 1]):
        rows = [f"{k}-{i},{'x' * (i % 50)}" for i in range(n)]
        lines += [r.split(",")[0] for r in rows]
        (tmp_path / f"part-{k:03d}.csv").write_text("\n".join(["name,text", *rows]) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4k")
    try:
        got = read_numbered(spark, str(tmp_path), "name string, text string").orderBy("row_id").collect()
    finally:
        spark.conf.set(key, before)
    assert [r.row_id for r in got] == list(range(len(lines))) and [r.name for r in got] == lines


@pytest.mark.parametrize("text, date, step", [
    ("2024/01/05", "2024-01-05", "iso"), ("20240105", "2024-01-05", "compact"), ("5 Jan 2024", "2024-01-05", "month_name"),
    ("2024-01-05T10:00:00Z", "2024-01-05", "iso"), ("13/02/2024 10:00", "2024-02-13", "day_first"),
    ("2024-01-05 10:00:00.5 PM", "2024-01-05", "iso"), ("2024-01-05T10:00:00+07:00", "2024-01-05", "iso"),
    ("January 5, 2024", "2024-01-05", "month_name"), ("5-sept-24", "2024-09-05", "month_name"), ("2024 Dec 1", "2024-12-01", "month_name"),
    ("03/04/2024", "2024-04-03", "day_first"), ("03/14/2024", "2024-03-14", "month_first"), ("3.4.24", "2024-04-03", "two_digit_year"),
    ("3/14/95", "1995-03-14", "two_digit_year"), ("31/02/2024", None, "failed"), ("2024-13-40", None, "failed"), ("n/a", None, "failed"),
    ("", None, "failed"), (None, None, "failed"), ("0000-01-01", None, "failed"), ("5 Foo 2024", None, "failed"),
    ("123456789", None, "failed"), ("  2024-1-5\n", "2024-01-05", "iso")])
def test_date_shapes(spark, text, date, step):
    got = spark.createDataFrame([(text,)], "t string").select(D.parse_date_steps("t").alias("p")).first().p
    assert (got.date and got.date.isoformat(), got.step) == (date, step)


def test_unambiguous_dates_are_those_of_pandas(spark):
    texts = ["2024/01/25", "20240125", "25 Jan 2024", "2024-01-25T10:00:00Z", "25/02/2024 10:00", "Jan 25, 2024", "25-Jan-2024"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(D.parse_any_date("t")).collect()]
    assert got == [pd.to_datetime(t, dayfirst="/02/" in t).date() for t in texts]


def test_a_column_votes_on_its_order(spark):
    us = spark.createDataFrame([("03/04/2024",), ("03/14/2024",), ("14/03/2024",), ("12/25/24",), ("2024-01-01",), (None,)], "t string")
    assert tuple(D.day_month_votes(us, "t").first()) == (1, 2) and D.is_month_first(us, "t")
    got = [r[0] for r in us.select(D.parse_any_date("t", month_first=True)).collect()]
    assert got[:4] == [dt.date(2024, 3, 4), dt.date(2024, 3, 14), dt.date(2024, 3, 14), dt.date(2024, 12, 25)]
    assert not D.is_month_first(us.where("t LIKE '0%/04%'"), "t")


def test_samples_are_bounded_and_repeatable(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("bad "), F.col("id"))).otherwise("2024-01-01").alias("t"))
    a, b = ({r.step: (r.n_rows, r.samples) for r in Q.date_parse_report(d, "t", samples=True).collect()}
            for d in (df, df.repartition(7)))
    assert a == b and a["failed"][0] == 2500 and len(a["failed"][1]) == Q.SAMPLES and a["iso"] == (2500, ["2024-01-01"])


def test_ordered_scan_looks_across_ranges(spark):
    n = 500
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).alias("w"), (F.col("id") * 3).alias("v")).repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered_scan(df, ["k"], ["w"], ["v"]).orderBy("k").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.w_upto for r in got] == list(np.cumsum([k % 7 for k in range(n)]))
    assert [r.v_next for r in got] == [3 * (k + 1) for k in range(n - 1)] + [None]
    assert {r.w_total for r in got} == {sum(k % 7 for k in range(n))}


def roc_curve(y, s):
    """The points of a ROC curve by definition, then without those between equal steps."""
    points = [(math.inf, 0, 0)] + [(t, sum((s >= t) & (y == 0)), sum((s >= t) & (y == 1))) for t in sorted(set(s), reverse=True)]
    steps = [(b[1] - a[1], b[2] - a[2]) for a, b in zip(points, points[1:])]
    kept = [0, 1] + [k for k in range(2, len(points)) if k == len(points) - 1 or steps[k - 1] != steps[k]]
    return {(points[k][0], points[k][1] / sum(y == 0), points[k][2] / sum(y == 1)) for k in kept}


@pytest.mark.parametrize("digits", [1, 2, 9])
def test_roc_corners(spark, digits):
    rng = np.random.default_rng(digits)
    y, s = rng.integers(0, 2, 200), np.round(rng.random(200), digits)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "churned int, score double")
    assert {tuple(r) for r in C.roc_points(df, corners_only=True).collect()} == roc_curve(y, s)


def test_auc_of_many_ties_does_not_overflow(spark):
    big = 3_000_000_000
    sc = spark.createDataFrame([(0.1, 0, big), (0.9, big, 0)], "s double, pos long, neg long")
    import clientele.operators.churn as churn
    saved, churn._score_counts = churn._score_counts, lambda *_: sc
    try:
        assert C.auc(None).first().auc == 1.0
    finally:
        churn._score_counts = saved


@pytest.fixture(scope="module")
def summary(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(400):
        age, rate, leaves = rng.uniform(50, 400), rng.gamma(0.8, 1 / 30), rng.beta(0.7, 2.5)
        t, days = 0.0, [0]
        while (t := t + rng.exponential(1 / rate)) < age and rng.random() > leaves:
            days.append(int(t) + 1)
        x = len(set(days)) - 1
        rows.append((f"c{k}", x, max(days) if x else 0, int(age) + 1, float(rng.gamma(6, 1 / rng.gamma(4, 1 / 15))) if x else 0.0))
    return spark.createDataFrame(rows, "cust string, frequency long, recency long, T long, monetary_value double").cache()


def test_fits_are_minima(summary):
    models = M.fit_value_models(summary)
    assert models.bg["passes"] <= M.MAX_PASSES and models.gg["passes"] <= M.MAX_PASSES
    pdf = summary.toPandas()
    x, tx, T, m = (pdf[c].to_numpy(float) for c in ("frequency", "recency", "T", "monetary_value"))
    scale = 10 / T.max()

    def bg(p):
        return -M.bgnbd_terms(x, tx * scale, T * scale, *p)[0].mean() + M.PENALIZER * np.sum(p ** 2)

    def gg(p):
        rep = (x > 0) & (m > 0)
        return -M.gamma_gamma_terms(x[rep], m[rep], *p)[0].mean() + M.PENALIZER * np.sum(p ** 2)

    for f, best, value in ((bg, np.array([models.bg["r"], models.bg["alpha"] * scale, models.bg["a"], models.bg["b"]]), models.bg["neg_ll"]),
                           (gg, np.array([models.gg[k] for k in "pqv"]), models.gg["neg_ll"])):
        assert abs(f(best) - value) < 1e-9
        for k in range(len(best)):
            for step in (0.99, 1.01):
                other = best.copy()
                other[k] *= step
                assert f(other) >= value - 1e-10


def test_a_fit_that_does_not_converge_raises(summary):
    with pytest.raises(M.NotConverged):
        M.bgnbd_fit(summary, max_passes=2)
    with pytest.raises(M.NotConverged):
        M.newton(lambda points: [(math.inf, None, None)] * len(points), [0.0])


def test_expected_purchases_near_one():
    def series(t, x, tx, T, r, alpha, a, b):
        z, term, terms = t / (alpha + T + t), 1.0, [1.0]
        for n in range(200_000):
            term *= (r + x + n) * (b + x + n) / ((a + b + x - 1 + n) * (n + 1)) * z
            terms.append(term)
        gone = 1 + a / (b + x - 1) * ((alpha + T) / (alpha + tx)) ** (r + x)
        return (a + b + x - 1) / (a - 1) * (1 - math.fsum(terms) * ((alpha + T) / (alpha + t + T)) ** (r + x)) / gone

    for case in ((730, 1, 0.5, 1, 0.25, 0.3, 0.8, 2.4), (730, 1, 0.5, 1, 0.25, 0.3, 0.2, 2.4), (730, 3, 0.9, 1, 0.25, 0.3, 1.7, 0.4),
                 (30, 1, 1, 2000, 0.6, 60, 0.05, 2.4), (365, 10, 1500, 2000, 2.8, 640, 4e-9, 0.005)):
        t, x, tx, T, *p = case
        got = M.expected_purchases(t, np.array([x]), np.array([tx]), np.array([T]), *p)[0]
        assert abs(got / series(*case) - 1) < 1e-9
    assert M.expected_purchases(10, np.array([1]), np.array([1]), np.array([2]), 1.0, 5.0, 1.0, 2.0)[0] > 0  # a = 1


def test_guards_stop_the_fit(spark, summary):
    assert M.fit_value_models(summary.limit(3)) == M.Refused("too few customers")
    assert M.fit_value_models(summary.withColumn("frequency", F.lit(0))) == M.Refused("too few repeat customers")
    day = lambda s: dt.date.fromisoformat(s)
    tx = lambda rows: spark.createDataFrame(rows, "customer string, tx_date date, total_price int")
    fit = lambda rows: C.fit_churn(tx(rows), "2024-12-31", "2025-01-01")
    assert fit([("a", None, 1)]) == M.Refused("no dates")
    assert fit([("a", day("2024-12-30"), 1)]) == M.Refused("no dates in the churn window")
    assert fit([("a", day("2025-02-01"), 1)]) == M.Refused("no dates in the observation period")
    few = [(f"c{k}", day("2024-06-01"), 1) for k in range(5)] + [("c1", day("2025-02-01"), 1)]
    assert fit(few) == M.Refused("too few customers")
    many = [(f"c{k}", day("2024-06-01"), 1) for k in range(30)]
    assert fit([*many, ("new", day("2025-02-01"), 1)]) == M.Refused("only one outcome")
    assert fit([*many, ("c1", day("2025-02-01"), 1)]) == M.Refused("an outcome is missing after the split")
    fitted = fit([*many, *[(f"c{k}", day("2025-02-01"), 1) for k in range(10)]])
    assert fitted.scored.count() == 9


def test_decomposition_is_exact(spark):
    n, rng = 40, np.random.default_rng(8)
    values = [round(float(v), 2) for v in 100 + 50 * np.sin(np.arange(n) / 2) + rng.random(n)]
    df = spark.createDataFrame([(f"{2000 + k // 12}-{k % 12 + 1:02d}", str(v)) for k, v in enumerate(values)], "month string, v string")
    got = decompose(df.withColumn("v", F.col("v").cast("decimal(18,2)")), "month", "v").orderBy("month").collect()
    x = np.array(values)
    trend = np.full(n, np.nan)
    for t in range(6, n - 6):
        trend[t] = (x[t - 6:t + 7].sum() * 2 - x[t - 6] - x[t + 6]) / 24
    means = np.array([np.nanmean((x - trend)[q::12]) for q in range(12)])
    season = (means - means.mean())[np.arange(n) % 12]
    for r, t, s, v in zip(got, trend, season, x):
        assert r.seasonal == pytest.approx(s, abs=1e-11)
        assert (r.trend is None) == bool(np.isnan(t)) and (r.trend is None or r.resid == pytest.approx(v - t - s, abs=1e-11))


def test_forest_brings_no_session_and_keeps_node_ids(spark):
    rows = spark.range(60).select(F.col("id").cast("string").alias("cust"), (F.col("id") % 2).cast("int").alias("churned"),
                                  *[(F.col("id") * k % 7).cast("double").alias(f) for k, f in enumerate(C.FEATURES, 1)])
    model = C.train_forest(rows, trees=3, max_depth=4)
    forest = model.stages[-1]
    assert not forest.hasSummary  # a training summary holds the session, which a task can't always be sent
    out = spark._jvm.java.io.ByteArrayOutputStream()
    spark._jvm.java.io.ObjectOutputStream(out).writeObject(forest._java_obj)
    assert b"classic.SparkSession" not in bytes(out.toByteArray())
    assert forest.getCacheNodeIds()  # else each task is sent all trees of the levels before
    scored = C.predict_scores(model, rows)
    assert scored.where(F.col("score").between(0, 1)).count() == 60


def test_the_split_has_no_more_partitions_than_cores(spark):
    rows = spark.range(60).select(F.col("id").cast("string").alias("cust"), (F.col("id") % 3).cast("int").alias("churned")).repartition(6)
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        split = C.stratified_split(rows)
        assert split.rdd.getNumPartitions() <= max(spark.sparkContext.defaultParallelism, C.FEW_TASKS)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    assert split.columns == ["churned", "cust", "split"]
    assert {(r.churned, r.split): r["count"] for r in split.groupBy("churned", "split").count().collect()} == {
        (c, part): n for c in range(3) for part, n in (("train", 14), ("test", 6))}
    assert C.split_partitions(0, 4, 8) == 8 and C.split_partitions(15_000, 12, 200) == 12 and C.split_partitions(15_000, 12, 8) == 8
    assert C.split_partitions(10_000_000, 8, 200) == 40


def test_a_session_with_an_observed_query_scores_the_forest(spark):
    from pyspark.sql import Observation
    seen = Observation("rows")
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3  # the session then holds what cannot be sent to a task
    rows = spark.range(40).select((F.col("id") % 2).cast("int").alias("churned"), *[(F.col("id") % k).cast("double").alias(f) for k, f in
                                                                                    zip((2, 3, 5, 7), C.FEATURES)])
    model = C.train_forest(rows, trees=3, max_depth=3)
    assert C.predict_scores(model, rows).where(F.col("score").between(0, 1)).count() == 40


def test_a_text_is_read_once_or_row_by_row(spark):
    from clientele.operators import chains as H
    raw = spark.createDataFrame(
        [(1, "jan24", "13/02/2024", "a", "Package RF Arm", 2.0), (2, "Okt 25", "2024-01-05", "b", "rf  arm", float("nan")),
         (3, "jan24", None, "c", None, 1.0), (4, None, "n/a", None, "zz", 3.0), (5, "jan24", None, None, None, None),
         (6, "may24", "13/02/2024", "a", "RF Arm", 1.0)],
        "row_id long, Month string, Date string, `NAMA CUSTOMER` string, `NAMA TREATMENT` string, QTY double")
    prices = spark.createDataFrame([(1, "RF Arm", 10.0), (2, "rf arm", 99.0), (3, "package", 7.0)],
                                   "row_id long, service string, price double").withColumn("price", F.col("price").cast("decimal(18,2)"))
    once, by_row = (H.priced_sales(raw, prices, limit=n) for n in (100, 0))
    key = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert once.schema == by_row.schema and key(once) == key(by_row)
    got = {r.row_id: r for r in once.collect()}
    assert sorted(got) == [1, 2, 3, 4, 6] and got[1].month == "january 24" and got[1].tx_date == dt.date(2024, 2, 13)
    assert float(got[1].total_price) == 20 and got[2].total_price is None and float(got[3].unit_price) == 7
