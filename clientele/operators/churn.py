"""Churn modelling.

Labels and features are joins and aggregates; the split ranks rows inside
each class with the distributed global order (no per-class window, which
would put half of the data in one task); metrics come from grouped counts;
the forest is Spark ML, or, where the driver could not hold its nodes, the
one of ``forest``.  Dates are parameters (C24).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.functions.text import name_key_nan
from clientele.operators import forest as cells
from clientele.operators.ranking import ordered_offsets, ordered_scan
from clientele.operators.value import Refused, repeat_summary
from clientele.session import checkpoint_once, ensure_checkpoint_dir

FEATURES = ["frequency", "recency", "T", "monetary_value"]
MIN_ROWS = 20
TEST_FRACTION = 0.3
SEED = 42
#: The forest: trees, depth of a tree (Spark's largest, the reference sets none) and bins of a feature.
TREES, MAX_DEPTH, MAX_BINS = 100, 30, 32
#: A task of the forest holds statistics of every open node however few rows it has, so the customers stand in no
#: more partitions than there are cores (or FEW_TASKS), unless one would get more than MOST_ROWS.
FEW_TASKS, MOST_ROWS = 8, 250_000
#: Nodes that the driver may hold (2.1 million possible ones, sf0.1, take it to 1.49 GB), and cells (bins of all
#: features) of a forest whose trees are grown by tasks, at most.
DRIVER_NODES, MOST_CELLS = 1_000_000, 1 << 21


def churn_labels(tx: DataFrame, obs_end: str, window_start: str, window_end: str | None = None,
                 customer: str = "customer", date_col: str = "tx_date") -> DataFrame:
    """Customers seen up to ``obs_end``; churned = 1 unless they bought
    in [window_start, window_end] (default: to the last date)."""
    c = name_key_nan(customer).alias("cust")
    d = F.col(date_col)
    observed = tx.where(d <= F.lit(obs_end).cast("date")).select(c).distinct()
    win = d >= F.lit(window_start).cast("date")
    if window_end:
        win = win & (d <= F.lit(window_end).cast("date"))
    active = tx.where(win).select(c).distinct().withColumn("_active", F.lit(True))
    return (observed.join(active, "cust", "left")
                    .select("cust", F.when(F.col("_active"), 0).otherwise(1).cast("int").alias("churned")))


def training_set(tx: DataFrame, obs_end: str, window_start: str, **cols) -> DataFrame:
    """M5: labels with repeat-summary features as of ``obs_end``; a missing
    feature is 0."""
    labels = churn_labels(tx, obs_end, window_start, **cols)
    feats = repeat_summary(tx, obs_end, **cols)
    j = labels.join(feats, "cust", "left")
    return j.fillna(0, subset=FEATURES).select("cust", "churned", *FEATURES)


def scaler_stats(df: DataFrame, features=FEATURES) -> DataFrame:
    """M6: mean and population standard deviation per feature (one aggregate,
    unpivoted; rounded to 4 decimals for display)."""
    aggs = []
    for f in features:
        aggs += [F.avg(f).alias(f"{f}__mean"), F.stddev_pop(f).alias(f"{f}__std")]
    wide = df.agg(*aggs)
    parts = ", ".join(f"'{f}', round(`{f}__mean`, 4), round(`{f}__std`, 4)" for f in features)
    return wide.selectExpr(f"stack({len(features)}, {parts}) AS (feature, mean, std)")


def standardize(df: DataFrame, features=FEATURES) -> DataFrame:
    """M6: (x - mean) / std per feature with the fitted statistics."""
    st = df.agg(*[F.avg(f).alias(f"{f}__m") for f in features],
                *[F.stddev_pop(f).alias(f"{f}__s") for f in features]).first()
    out = df
    for f in features:
        s = st[f"{f}__s"] or 1.0
        out = out.withColumn(f"{f}_z", (F.col(f) - F.lit(st[f"{f}__m"])) / F.lit(s))
    return out


def split_partitions(rows: int, cores: int, most: int) -> int:
    """Partitions of so many customers, where the session shuffles into ``most``."""
    return max(min(max(cores, FEW_TASKS), most), math.ceil(rows / MOST_ROWS))


def stratified_split(df: DataFrame, label: str = "churned", key: str = "cust",
                     test_fraction: float = TEST_FRACTION) -> DataFrame:
    """M7: deterministic stratified split.  Inside each class rows are
    ordered by md5(key); the first n_c - ceil(test_fraction * n_c) are
    train.  The in-class rank is the global rank minus the size of the
    lower classes (a row a class).  ``df`` is read twice: give it checkpointed."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).orderBy(label).collect()  # a row a class
    rows = sum(r["_n"] for r in sizes)
    keyed = df.withColumn("_h", F.md5(F.col(key).cast("string")))
    spark = df.sparkSession
    parts = split_partitions(rows, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranked = ordered_offsets(keyed, [label, "_h", key], num_partitions=parts)
    n, start, below = F.lit(None).cast("long"), F.lit(None).cast("long"), 0
    for r in sizes:
        own = F.col(label) == F.lit(r[label])
        n, start, below = F.when(own, r["_n"]).otherwise(n), F.when(own, below).otherwise(start), below + r["_n"]
    k = F.col("_before") - start  # 0-based rank in class
    n_train = n - F.ceil(n * F.lit(str(test_fraction)).cast("decimal(10,6)"))  # exact
    return (ranked.where(F.col(label).isNotNull()).withColumn("split", F.when(k < n_train, "train").otherwise("test"))
            .select(label, *[c for c in df.columns if c != label], "split"))


def train_forest(train: DataFrame, label: str = "churned", features=FEATURES, seed: int = SEED, trees: int = TREES,
                 max_depth: int = MAX_DEPTH, max_bins: int = MAX_BINS, driver_nodes: int = DRIVER_NODES):
    """M8: balanced random forest (class weight n / (2 n_c)).  A forest that
    can have more than ``driver_nodes`` nodes is grown by tasks and its nodes
    stay out of the driver (``forest``), if its features have few enough bins
    together; others are Spark ML's, which holds all nodes in the driver.
    There each row's node in each tree is kept from level to level; otherwise
    every task would be sent all trees grown so far and walk them again."""
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(counts.values())
    if (trees * min(2 * n, 2 ** (max_depth + 1)) > driver_nodes and max_bins ** len(features) <= MOST_CELLS
            and len(counts) > 1 and all(type(c) is int and c >= 0 for c in counts)):
        weights = [n / (len(counts) * counts[c]) if c in counts else 0.0 for c in range(max(counts) + 1)]
        return cells.grow(train, label, list(features), weights, seed, trees, max_depth, max_bins)
    wexpr = None
    for c, nc in counts.items():
        wv = n / (len(counts) * nc)
        wexpr = F.when(F.col(label) == c, wv) if wexpr is None else wexpr.when(F.col(label) == c, wv)
    weighted = train.withColumn("_weight", wexpr.cast("double")).withColumn("_label", F.col(label).cast("double"))
    ensure_checkpoint_dir(train.sparkSession)  # Spark cuts the lineage of the kept nodes there
    pipe = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"),
                            RandomForestClassifier(featuresCol="_features", labelCol="_label",
                                                   weightCol="_weight", seed=seed, numTrees=trees,
                                                   maxDepth=max_depth, maxBins=max_bins, cacheNodeIds=True)])
    return pipe.fit(weighted).copy()  # a copy has no training summary, which would bring the session into each task


def predict_scores(model, df: DataFrame) -> DataFrame:
    """M8: probability of the positive class as ``score``."""
    if isinstance(model, cells.CellForest):
        return cells.score(model, df)
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    return out.withColumn("score", vector_to_array("probability")[1]).drop(
        "_features", "rawPrediction", "probability", "prediction")


def feature_importances(model, spark, features=FEATURES) -> DataFrame:
    """Forest feature importances, one row per feature."""
    imp = model.importances if isinstance(model, cells.CellForest) else model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, imp)), "feature string, importance double")


def class_report(pred: DataFrame, label: str = "churned", score: str = "score",
                 threshold: float = 0.5) -> DataFrame:
    """M9: precision, recall, F1 and support per class at ``threshold``
    (0 where a ratio is undefined)."""
    p = pred.select(F.col(label).cast("int").alias("y"), (F.col(score) >= threshold).cast("int").alias("yhat"))
    cell = lambda y, yhat: F.count(F.when((F.col("y") == y) & (F.col("yhat") == yhat), 1))
    counts = p.agg(*[cell(y, yhat).alias(f"c{y}{yhat}") for y in (0, 1) for yhat in (0, 1)])
    t = counts.selectExpr("stack(2, 0, c00, c10, c01, 1, c11, c01, c10) AS (class, tp, fp, fn)")
    div = lambda a, b: F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))
    return t.select("class",
                    div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
                    div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
                    div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
                    (F.col("tp") + F.col("fn")).cast("long").alias("support"))


def _score_counts(pred: DataFrame, label: str, score: str) -> DataFrame:
    return (pred.groupBy(F.col(score).alias("s"))
                .agg(F.sum(F.col(label).cast("long")).alias("pos"),
                     F.sum((1 - F.col(label)).cast("long")).alias("neg")))


def auc(pred: DataFrame, label: str = "churned", score: str = "score") -> DataFrame:
    """ROC AUC by the rank-sum with average ranks for ties:
    (2·Σ pos(s)·neg(< s) + Σ pos(s)·neg(s)) / (2·P·N), exact integers until
    one division.  Negatives below each score come from the distributed
    global order over the distinct scores."""
    sc = _score_counts(pred, label, score)
    off = ordered_offsets(sc, ["s"], "neg")  # _before = negatives with a lower score
    wide = lambda c: F.col(c).cast("decimal(18,0)")  # noqa: E731  products of counts pass 64 bits
    return off.agg(
        (F.sum(wide("pos") * (2 * wide("_before") + wide("neg"))).cast("double")
         / (2.0 * F.sum("pos") * F.sum("neg"))).alias("auc"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def roc_points(pred: DataFrame, label: str = "churned", score: str = "score", corners_only: bool = False) -> DataFrame:
    """One ROC point per distinct score threshold (score >= s): fpr, tpr.

    ``corners_only`` gives the points of a drawn curve: those on a straight line
    between their neighbours are left out, which are the ones whose step equals
    the next one, and the point (0, 0) is added with an infinite threshold."""
    counts = _score_counts(pred, label, score).withColumn("_order", -F.col("s"))
    sc = ordered_scan(counts, ["_order"], ["pos", "neg"], ["pos", "neg"] if corners_only else [])
    share = lambda part, whole: F.when(whole > 0, part / whole)
    if corners_only:
        first = (F.col("pos_upto") == F.col("pos")) & (F.col("neg_upto") == F.col("neg"))
        kept = sc.where(first | F.col("pos_next").isNull() | (F.col("pos_next") != F.col("pos"))
                        | (F.col("neg_next") != F.col("neg")))
        start = F.array(*[F.struct(t.alias("s"), p.alias("pos_upto"), n.alias("neg_upto")) for t, p, n in
                          ((F.lit(math.inf), F.lit(0).cast("long"), F.lit(0).cast("long")),
                           (F.col("s").cast("double"), F.col("pos_upto"), F.col("neg_upto")))])
        point = F.explode(F.when(first, start).otherwise(F.slice(start, 2, 1)))  # the first one brings (0, 0) along
        sc = kept.select(point.alias("p"), "pos_total", "neg_total").select("p.*", "pos_total", "neg_total")
    return sc.select(F.col("s").alias("threshold"), share(F.col("neg_upto"), F.col("neg_total")).alias("fpr"),
                     share(F.col("pos_upto"), F.col("pos_total")).alias("tpr"))


def churn_guard(ts: DataFrame, label: str = "churned", min_rows: int = MIN_ROWS) -> DataFrame:
    """Rows and classes available, and whether a model can be trained."""
    return (ts.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(label).alias("n_classes"))
              .withColumn("enough", (F.col("n_rows") >= min_rows) & (F.col("n_classes") >= 2)))


@dataclass(frozen=True)
class ChurnModel:
    """M8: a fitted forest and its test rows with their scores."""
    model: object
    scored: DataFrame


def churn_refusal(tx: DataFrame, obs_end: str, window_start: str, date_col: str = "tx_date") -> str | None:
    """M12 before any feature is made: why the dates allow no churn model; None if they do."""
    seen = tx.agg(F.max(date_col).cast("date").cast("string").alias("last"), F.min(date_col).cast("date").cast("string").alias("first")).first()
    if seen["last"] is None:
        return "no dates"
    if seen["last"] < str(window_start)[:10]:
        return "no dates in the churn window"
    return "no dates in the observation period" if seen["first"] > str(obs_end)[:10] else None


def set_refusal(rows: dict) -> str | None:
    """M12 for a training set with this guard row."""
    if rows["n_rows"] < MIN_ROWS:
        return "too few customers"
    return "only one outcome" if rows["n_classes"] < 2 else None


def split_refusal(split: DataFrame, label: str = "churned") -> str | None:
    """M12 after the split: both parts need both outcomes."""
    n = split.agg(*[F.countDistinct(F.when(F.col("split") == part, F.col(label))).alias(part) for part in ("train", "test")]).first()
    return None if min(n) >= 2 else "an outcome is missing after the split"


def fit_churn(tx: DataFrame, obs_end: str, window_start: str, **options) -> ChurnModel | Refused:
    """M5-M8 behind the guards (M12): dates, rows and outcomes, outcomes of both parts of the split."""
    reason = churn_refusal(tx, obs_end, window_start)
    if reason:
        return Refused(reason)
    ts = checkpoint_once(training_set(tx, obs_end, window_start))
    reason = set_refusal(churn_guard(ts).first().asDict())
    if reason:
        return Refused(reason)
    split = stratified_split(ts)
    reason = split_refusal(split)
    if reason:
        return Refused(reason)
    model = train_forest(split.where(F.col("split") == "train"), **options)
    return ChurnModel(model, predict_scores(model, split.where(F.col("split") == "test")))
