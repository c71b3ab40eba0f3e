"""The forest whose trees are grown by tasks, held against Spark's trees and against plain walks."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.operators import churn as C
from clientele.operators import forest as T


@pytest.fixture(scope="module")
def rows(spark):
    """Customers with tied and untied features; two of them decide most outcomes."""
    rng = np.random.default_rng(5)
    n = 900
    frequency, recency = np.minimum(rng.poisson(2, n), 9), rng.integers(0, 40, n)
    age, money = recency + rng.integers(0, 50, n), np.where(rng.random(n) < 0.3, 0, rng.gamma(2, 30, n).round(3))
    churned = (frequency * 20 + money + rng.normal(0, 25, n) < 70).astype(int)
    data = [(f"c{k}", int(y), int(a), int(b), int(c), float(d)) for k, (y, a, b, c, d) in enumerate(zip(churned, frequency, recency, age, money))]
    return spark.createDataFrame(data, "cust string, churned int, frequency long, recency long, T long, monetary_value double").cache()


def test_a_tree_is_the_one_of_spark(spark, rows):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    weights = [0.5, 2.25]  # exact, so that equal gains are equal in both
    given = VectorAssembler(inputCols=C.FEATURES, outputCol="x").transform(
        rows.withColumn("w", F.when(F.col("churned") == 1, weights[1]).otherwise(weights[0])))
    for depth in (3, 30):
        model = DecisionTreeClassifier(featuresCol="x", labelCol="churned", weightCol="w", maxDepth=depth, maxBins=32).fit(given)
        want = {r.cust: r.p for r in model.transform(given).select("cust", vector_to_array("probability")[1].alias("p")).collect()}
        points = T.split_points(rows, "churned", C.FEATURES, weights, 32)
        assert [len(at) <= 31 for at in points] == [True] * 4 and len(points[0]) < 10 < len(points[3])
        placed = rows.select("cust", "churned", T.cell_of(C.FEATURES, points).alias("cell")).collect()
        number, place = np.unique([r.cell for r in placed], return_inverse=True)
        counts = np.zeros((len(number), 2))
        np.add.at(counts, (place, [r.churned for r in placed]), 1)
        n_bins = [len(at) + 1 for at in points]
        x = T.bins_of(number, n_bins)
        feature, cut, stats, gain = T.grow_tree(x, counts, weights, max(n_bins), 4, depth, np.random.default_rng(1))
        assert len(feature) == model.numNodes
        ends = stats[feature < 0]
        share = T.walk_tree(x, feature, cut, ends[:, 1] / ends.sum(1))
        assert [share[k] for k in place] == pytest.approx([want[r.cust] for r in placed], abs=1e-12)
        assert T.tree_importances(feature, stats, gain, 4) == pytest.approx(model.featureImportances.toArray(), abs=1e-9)


def test_a_forest_beyond_the_drivers_bound_stays_in_tasks(spark, rows):
    options = {"trees": 20, "max_depth": 30}
    model = C.train_forest(rows, driver_nodes=1000, **options)  # 20 trees of 900 customers can have 36,000 nodes
    assert isinstance(model, T.CellForest) and model.nodes.count() == 20
    assert not isinstance(C.train_forest(rows, driver_nodes=1000, trees=20, max_depth=3), T.CellForest)
    scored = C.predict_scores(model, rows)
    assert scored.columns == [*rows.columns, "score"]
    got = {r.cust: r for r in scored.collect()}
    assert len(got) == 900
    trees = []
    for r in model.nodes.collect():
        feature, cut, share = np.frombuffer(r.feature, np.int16), np.frombuffer(r["cut"], np.int16), np.frombuffer(r.share)
        inner = np.cumsum(feature >= 0)
        trees.append((feature, cut, share, inner))
        assert len(share) == (feature < 0).sum() == inner[-1] + 1 and inner[-1] > 50  # no depth but Spark's largest
    for r in list(got.values())[::60]:  # the features themselves against the split points
        total = 0.0
        for feature, cut, share, inner in trees:
            at = 0
            while feature[at] >= 0:
                k = feature[at]
                at = 2 * inner[at] - 1 + int(r[C.FEATURES[k]] > model.points[k][cut[at]])
            total += share[at - inner[at]]
        assert r.score == pytest.approx(total / 20, abs=1e-9)
    usual = C.train_forest(rows, **options)
    both = scored.select("cust", "score").join(C.predict_scores(usual, rows).select("cust", F.col("score").alias("usual")), "cust")
    assert both.select(F.corr("score", "usual")).first()[0] > 0.97
    important = [[r.importance for r in C.feature_importances(m, spark).collect()] for m in (model, usual)]
    assert sum(important[0]) == pytest.approx(1) and important[0] == pytest.approx(important[1], abs=0.08)


def test_the_forest_does_not_depend_on_partitions(spark, rows):
    score = lambda df: {r.cust: r.score for r in C.predict_scores(C.train_forest(df, trees=5, driver_nodes=0), df).collect()}
    assert score(rows.coalesce(1)) == score(rows.repartition(7, "cust"))


def test_split_points_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCKS", 512)
    df = spark.range(6000).select((F.col("id") % 2).cast("int").alias("y"), F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") / 7).alias("a"),
                                  (F.col("id") % 5).alias("b"), F.lit(1).alias("c"))
    a, b, c = T.split_points(df, "y", ["a", "b", "c"], [1.0, 1.0], 8)
    assert b == [0.5, 1.5, 2.5, 3.5] and c == []
    values = np.where(np.arange(6000) % 3 == 0, 0, np.arange(6000) / 7)
    assert 0 < a[0] < a[-1] and len(a) <= 7 and not np.isin(a, values).any()
    sizes = np.bincount(np.searchsorted(a, values))
    # 0 has passed two targets, so the next two points follow it; then they stand at equal shares
    assert 2000 <= sizes[0] < 2012 and sizes[1] <= 12 and np.abs(sizes[3:] - 750).max() <= 12


def test_missing_features_and_one_outcome(spark, rows):
    with pytest.raises(Exception, match="monetary_value has missing values"):
        C.train_forest(rows.withColumn("monetary_value", F.when(F.col("cust") != "c1", F.col("monetary_value"))), trees=2, driver_nodes=0)
    flat = rows.withColumns({f: F.lit(1.0) for f in C.FEATURES})
    scored = C.predict_scores(C.train_forest(flat, trees=2, driver_nodes=0), flat)  # no split at all
    assert scored.select("score").distinct().count() == 1
    assert C.predict_scores(C.train_forest(rows, trees=2, driver_nodes=0), rows.limit(0)).count() == 0


def test_metrics_of_a_forest_grown_by_tasks(spark, rows):
    from clientele.session import checkpoint_once
    split = C.stratified_split(checkpoint_once(rows))
    model = C.train_forest(split.where(F.col("split") == "train"), trees=10, driver_nodes=0)
    pred = checkpoint_once(C.predict_scores(model, split.where(F.col("split") == "test")).select("churned", "score"))
    y, s = (np.array(v) for v in zip(*[(r.churned, r.score) for r in pred.collect()]))
    assert len(y) == sum(-(-3 * n // 10) for n in np.bincount([r.churned for r in rows.select("churned").collect()]).tolist())
    pos, neg = s[y == 1][:, None], s[y == 0][None]
    want = ((pos > neg).sum() + (pos == neg).sum() / 2) / pos.size / neg.size
    assert C.auc(pred).first()["auc"] == pytest.approx(want, abs=1e-12) and want > 0.8
    for r in C.class_report(pred).collect():
        hit = (y == r["class"]) & ((s >= 0.5) == r["class"])
        assert r.support == (y == r["class"]).sum() and r.recall == pytest.approx(hit.sum() / r.support)
