"""Golden and brute-force tests: pairing (C9), entity resolution (C11),
merge aggregates, pricing, baskets (C5), movement (C18), decomposition
(C10), AUC, value-model helpers."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clientele.operators import basket as B
from clientele.operators import churn as C
from clientele.operators import clean as CL
from clientele.operators import dedup as U
from clientele.operators import flows as W
from clientele.operators import pricing as P
from clientele.operators import series as S
from clientele.operators import value as M
from conftest import SF_SMALL


def test_pair_rows(spark):
    raw = spark.createDataFrame([
        (0, "1", "Ann", "Jakarta", "9/5/53", "Jl. A"),
        (1, " *Address: Blok C: 2", None, "Bandung", None, None),
        (2, "2", "Bob", "Solo", "1-2-2001", ""),
        (3, "*address", None, None, None, None),
        (4, "3", "Cid", None, None, None),
    ], "line_no long, no string, name string, birthplace string, birth_date string, address string")
    got = {r.no: r for r in CL.pair_rows(raw).collect()}
    assert got["1"].address == "Jl. A, Blok C: 2" and got["1"].birthplace == "Bandung"
    assert got["1"].birth_date == "09-05-1953"
    assert got["2"].address == "" and got["2"].birthplace == "Solo"  # no ':' adds nothing (C9)
    assert got["3"].name == "Cid"  # a trailing odd line stands alone
    assert len(got) == 3


def brute_force_persons(records):
    """The greedy leader scan, written directly: for each unassigned record
    in (name, no) order, open a cluster and absorb every later compatible
    record of the same name, adopting missing fields."""
    def norm_bd(v):
        return None if v is None or str(v).strip() == "" else str(v)

    def norm_ad(v):
        return None if v is None or str(v).strip() == "" else str(v).strip().lower()

    recs = sorted(records, key=lambda r: (r[1] is None, r[1] or "", r[0]))
    pid, out = 0, {}
    for i, (no, name, bd, ad) in enumerate(recs):
        if no in out:
            continue
        pid += 1
        out[no] = pid
        if name is None:
            continue
        cb, ca = norm_bd(bd), norm_ad(ad)
        for no2, name2, bd2, ad2 in recs[i + 1:]:
            if no2 in out or name2 != name:
                continue
            b2, a2 = norm_bd(bd2), norm_ad(ad2)
            if (cb is not None and b2 is not None and cb != b2) or (ca is not None and a2 is not None and ca != a2):
                continue
            out[no2] = pid
            cb = cb if cb is not None else b2
            ca = ca if ca is not None else a2
    return out


def partition_of(assign):
    groups = {}
    for k, v in assign.items():
        groups.setdefault(v, set()).add(k)
    return sorted(sorted(g) for g in groups.values())


def test_entity_resolution_fixture(spark):
    rows = [(1, "Ann", None, "A"), (2, "Ann", "d1", None), (3, "Ann", "d2", "a "), (4, "Ann", "d2", "B"),
            (5, "Ann", None, "b"), (6, None, "x", "y"), (7, None, "x", "y")]
    df = spark.createDataFrame(rows, "no long, name string, birth_date string, address string")
    got = {r.no: r.person_id for r in U.resolve_persons(df).collect()}
    assert partition_of(got) == [[1, 2], [3], [4, 5], [6], [7]]
    assert partition_of(got) == partition_of(brute_force_persons(rows))


def test_entity_resolution_matches_brute_force_on_test_table(spark):
    from clientele.sources import views as V
    recs = V.member_records(spark, SF_SMALL).select("no", "name", "birth_date", "address")
    rows = [tuple(r) for r in recs.collect()]
    got = {r.no: r.person_id for r in U.resolve_persons(recs).collect()}
    assert partition_of(got) == partition_of(brute_force_persons(rows))
    # invariant to the input partitioning
    got2 = {r.no: r.person_id for r in U.resolve_persons(recs.repartition(7, "no")).collect()}
    assert partition_of(got2) == partition_of(got)


def test_entity_resolution_matches_brute_force_on_random_names(spark):
    """Few dates and addresses, many missing: halves of both kinds meet, in every order."""
    rng = np.random.default_rng(11)
    rows = []
    for k in range(3000):
        dates, places = 2 + k // 100 % 5, 2 + k // 500 % 4
        bd = None if rng.random() < 0.4 else f"d{rng.integers(dates)}"
        ad = None if rng.random() < 0.4 else f" A{rng.integers(places)}"
        rows.append((k, None if k % 97 == 0 else f"n{k // 12}", bd, ad))
    df = spark.createDataFrame(rows, "no long, name string, birth_date string, address string").repartition(5)
    got = {r.no: r.person_id for r in U.resolve_persons(df, row_id="no").collect()}
    assert partition_of(got) == partition_of(brute_force_persons(rows))


def test_one_name_with_many_signatures(spark):
    """A placeholder name with 100,000 signatures, halves of both kinds among them."""
    k = F.col("id")
    df = spark.range(100_000).select(
        k.alias("no"), F.lit("-").alias("name"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(k.cast("string")).alias("birth_date"),
        F.when(k % 3 == 1, F.lit(None)).otherwise(k.cast("string")).alias("address"))
    got = U.resolve_persons(df, row_id="no").groupBy("person_id").count().groupBy("count").count().collect()
    # 33,334 halves without a date pair off with 33,333 without an address; full ones are alone
    assert {r[0]: r[1] for r in got} == {2: 33333, 1: 33334}


def test_unnamed_rows_without_number_stay_apart(spark):
    rows = [(0, None, None, "d1", "A"), (1, None, None, "d1", "A"), (2, None, "Ann", " ", None), (3, 5, "Ann", "d1", None),
            (4, None, "Ann", "d2", None)]
    df = spark.createDataFrame(rows, "row_id long, no long, name string, birth_date string, address string")
    merged = U.merge_persons(U.resolve_persons(df, row_id="row_id"), row_id="row_id").collect()
    assert sorted((r.person_id, r.no, r.name, r.birth_date, r.address) for r in merged) == [
        (0, None, None, "d1", "A"), (1, None, None, "d1", "A"), (3, 5, "Ann", "d1", None), (4, None, "Ann", "d2", None)]


def test_merge_persons(spark):
    rows = [(1, "Ann", None, " ", "no", "p1"), (2, "Ann", "d1", "Jl. A", "YES", None),
            (3, "Bob", None, None, None, None)]
    df = spark.createDataFrame(rows, "no long, name string, birth_date string, address string, delivery string, hobby string")
    merged = {r.name: r for r in U.merge_persons(U.resolve_persons(df), yes_no=["delivery"]).collect()}
    ann = merged["Ann"]
    assert ann.birth_date == "d1" and ann.address == "Jl. A" and ann.delivery == "Yes" and ann.hobby == "p1"
    assert ann.no == 1 and merged["Bob"].delivery is None


def test_price_lookup_keep_first_and_nulls(spark):
    pl = spark.createDataFrame([(1, "RF Arm", 100.0), (2, "rf arm", 999.0), (3, "Filler", None)],
                               "row_id long, service string, price double")
    tx = spark.createDataFrame([("Package RF Arm", 2.0), ("filler", 1.0), ("unknown", 3.0)], "item string, qty double")
    tx = tx.withColumn("qty", F.col("qty").cast("decimal(18,2)"))
    got = {r.item: (float(r.unit_price), float(r.total_price)) for r in P.price_lookup(tx, pl).collect()}
    assert got == {"Package RF Arm": (100.0, 200.0), "filler": (0.0, 0.0), "unknown": (0.0, 0.0)}


def test_baskets_duplicates_pass_filter_but_make_no_pair(spark):
    d = dt.date(2024, 1, 1)
    rows = [("a", d, 1, "x"), ("a", d, 1, "x"), ("b", d, 2, "x"), ("b", d, 2, "y"), ("b", d, 2, "z"),
            ("c", d, None, "x"), ("c", d, None, "y")]
    tx = spark.createDataFrame(rows, "customer string, tx_date date, ticket long, item string")
    multi = B.multi_item(B.baskets(tx)).collect()
    assert sorted(r.customer for r in multi) == ["a", "b"]  # null ticket leaves (C5)
    pairs = {(r.item_a, r.item_b): r.n_baskets for r in B.pair_counts(tx).collect()}
    assert pairs == {("x", "y"): 1, ("x", "z"): 1, ("y", "z"): 1}


def test_movement_classes(spark):
    before = spark.createDataFrame([("a", 3, "Low"), ("b", 3, "High"), ("c", 5, "Low"), ("d", 9, "High"),
                                    ("e", 2, "Low")], "cust_norm string, total_items long, r_score string")
    after = spark.createDataFrame([("a", 3, "Low"), ("b", 3, "Medium"), ("c", 6, "Low"), ("d", 4, "High"),
                                   ("f", 1, "High")], "cust_norm string, total_items long, r_score string")
    got = {r.cust_norm: r.movement for r in W.movement(before, after).collect()}
    assert got == {"a": "Stay", "b": "Downgrade", "c": "Upgrade", "d": None, "e": None, "f": "New"}
    counts = {r.movement: r.n_customers for r in W.movement_counts(W.movement(before, after)).collect()}
    assert counts == {"New": 1, "Stay": 1, "Downgrade": 1, "Upgrade": 1}


def numpy_decompose(x, p):
    n = len(x)
    trend = np.full(n, np.nan)
    h = p // 2
    w = np.ones(p + 1) if p % 2 == 0 else np.ones(p)
    if p % 2 == 0:
        w[0] = w[-1] = 0.5
    w = w / p
    for t in range(h, n - h):
        trend[t] = np.dot(w, x[t - h:t + h + 1]) if p % 2 == 0 else np.mean(x[t - h:t + h + 1])
    det = x - trend
    pav = np.array([np.nanmean(det[i::p]) for i in range(p)])
    pav -= pav.mean()
    seas = np.tile(pav, n // p + 1)[:n]
    return trend, seas, x - trend - seas


@pytest.mark.parametrize("n", [30, 9])
def test_decomposition_matches_numpy(spark, n):
    rng = np.random.default_rng(3)
    x = np.round(1000 + 50 * np.sin(np.arange(n) * 2 * np.pi / 12) + rng.normal(0, 5, n), 2)
    df = spark.createDataFrame([(f"m{i:03d}", float(v)) for i, v in enumerate(x)], "month string, revenue double")
    df = df.withColumn("revenue", F.col("revenue").cast("decimal(18,2)"))
    p = S.decomposition_period(n)
    got = S.decompose(df, "month", "revenue").orderBy("month").toPandas()
    trend, seas, resid = numpy_decompose(x, p)
    assert np.allclose(got["trend"].to_numpy(dtype=float), trend, equal_nan=True, atol=1e-6)
    assert np.allclose(got["seasonal"].to_numpy(dtype=float), seas, atol=1e-3)
    ok = ~np.isnan(trend)
    assert np.allclose((got["trend"] + got["seasonal"] + got["resid"]).to_numpy(dtype=float)[ok], x[ok], atol=1e-3)


def test_auc_matches_pairwise_brute_force(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300), 1)  # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "churned int, score double")
    got = C.auc(df).first().auc
    pos, neg = s[y == 1], s[y == 0]
    want = np.mean([(1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg])
    assert abs(got - want) < 1e-12
    roc = C.roc_points(df).orderBy(F.col("threshold").desc()).toPandas()
    assert roc["tpr"].is_monotonic_increasing and abs(roc["tpr"].iloc[-1] - 1) < 1e-12


def test_class_report(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2), (0, 0.7), (0, 0.1)], "churned int, score double")
    got = {r["class"]: r for r in C.class_report(df).collect()}
    assert got[1].precision == 0.5 and got[1].recall == 0.5 and got[1].support == 2
    assert got[0].f1 == 0.5


def test_lgamma_np():
    z = np.array([0.01, 0.5, 1.0, 2.5, 7.0, 30.0, 1234.5])
    assert np.allclose(M.lgamma_np(z), [math.lgamma(v) for v in z], rtol=1e-12, atol=1e-12)


def test_expected_purchases_starts_at_zero():
    x = np.array([0.0, 3.0]); tx = np.array([0.0, 20.0]); T = np.array([30.0, 40.0])
    assert np.allclose(M.expected_purchases(0.0, x, tx, T, 1.0, 10.0, 0.5, 2.0), 0.0)
    a = M.expected_purchases(30.0, x, tx, T, 1.0, 10.0, 0.5, 2.0)
    b = M.expected_purchases(60.0, x, tx, T, 1.0, 10.0, 0.5, 2.0)
    assert np.all(b > a) and np.all(a > 0)


def test_repeat_summary(spark):
    d = dt.date
    rows = [("a", d(2024, 1, 1), 10.0), ("a", d(2024, 1, 1), 5.0), ("a", d(2024, 1, 5), 20.0),
            ("a", d(2024, 1, 9), 40.0), ("b", d(2024, 1, 3), 7.0), ("a", d(2024, 2, 9), 99.0)]
    tx = spark.createDataFrame(rows, "customer string, tx_date date, total_price double")
    tx = tx.withColumn("total_price", F.col("total_price").cast("decimal(18,2)"))
    got = {r.cust: r for r in M.repeat_summary(tx, "2024-01-10").collect()}
    assert (got["a"].frequency, got["a"].recency, got["a"].T, got["a"].monetary_value) == (2, 8, 9, 30.0)
    assert (got["b"].frequency, got["b"].T, got["b"].monetary_value) == (0, 7, 0.0)


def test_district_from_reply(spark):
    ok = ('{"status":"OK","results":[{"address_components":[{"long_name":"Kota","types":["locality"]},'
          '{"long_name":"Kecamatan X","types":["administrative_area_level_3","political"]}]}]}')
    rows = [(ok,), ('{"status":"ZERO_RESULTS","results":[]}',), ('{"status":"OK","results":[{"address_components":[]}]}',)]
    df = spark.createDataFrame(rows, "reply string")
    assert [r[0] for r in df.select(CL.district_from_reply("reply")).collect()] == ["Kecamatan X", "Not Found", "Not Found"]


def test_histogram_weighted(spark):
    df = spark.createDataFrame([(0, 2), (5, 1), (10, 3)], "g long, n long")
    got = {r.bin: r.n for r in S.histogram(df, "g", 2, weight="n").collect()}
    assert got == {0: 2, 1: 4}  # the maximum lands in the last bin


def test_purchase_gaps_multiset(spark):
    d = dt.date
    rows = [("a", d(2024, 1, 1)), ("a", d(2024, 1, 1)), ("a", d(2024, 1, 4)), ("a", d(2024, 1, 4)),
            ("a", d(2024, 1, 10)), ("b", d(2024, 1, 2))]
    tx = spark.createDataFrame(rows, "customer string, tx_date date")
    got = {r.gap_days: r.n_rows for r in S.purchase_gaps(tx).collect()}
    pdf = pd.DataFrame(rows, columns=["c", "d"]).sort_values(["c", "d"])
    gaps = (pdf["d"] - pdf.groupby("c")["d"].shift(1)).dropna().map(lambda t: t.days)
    assert got == gaps.value_counts().to_dict()
