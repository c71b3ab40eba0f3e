"""Checked queries: repeat summary, churn labels/features/split/metrics,
value-model fits and scoring (fits are rows-only)."""

from __future__ import annotations

from pyspark.sql import functions as F

from clientele.operators import churn as C
from clientele.operators import value as M
from clientele.operators import rfm as R
from clientele.plans.checks_rfm import rfm_ctes
from clientele.plans.registry import name_key_nan_sql, register
from clientele.session import checkpoint_once
from clientele.sources import views as V

OBS_END = V.CHURN_OBSERVATION_END
WIN_START = V.CHURN_WINDOW_START


def repeat_sql(src: str, obs_end_sql: str, name: str = "rs") -> str:
    return f"""days_{name} AS (SELECT {name_key_nan_sql('customer')} AS cust, tx_date AS d,
    CAST(sum(total_price) AS DECIMAL(38,2)) AS day_total FROM {src}
  WHERE tx_date IS NOT NULL AND tx_date <= {obs_end_sql} GROUP BY 1, 2),
{name} AS (SELECT cust, count(*) - 1 AS frequency, CAST(max(d) - min(d) AS BIGINT) AS recency,
    CAST({obs_end_sql} - min(d) AS BIGINT) AS T,
    CASE WHEN count(*) > 1 THEN CAST(sum(day_total) - arg_min(day_total, d) AS DOUBLE) / (count(*) - 1)
         ELSE CAST(0 AS DOUBLE) END AS monetary_value
  FROM days_{name} GROUP BY 1)
"""


CLV_SQL = V.with_views("tx").rstrip() + """,
pos AS (SELECT * FROM tx WHERE total_price > 0),
""" + repeat_sql("pos", "(SELECT max(tx_date) FROM pos)")


def _clv_summary(spark, d):
    """Rows with a positive price; observation end = their last date."""
    return M.repeat_summary(V.tx(spark, d).where(F.col("total_price") > 0))


@register("m01_repeat_summary", CLV_SQL + "SELECT * FROM rs")
def m01_repeat_summary(spark, d):
    """M1: frequency / recency / T / monetary_value per customer (day grain)."""
    return _clv_summary(spark, d)


@register("m12_value_guard", CLV_SQL + """SELECT count(*) AS n_customers,
    count(*) FILTER (WHERE frequency > 0 AND monetary_value > 0) AS n_repeat,
    count(*) >= 10 AND count(*) FILTER (WHERE frequency > 0 AND monetary_value > 0) >= 10 AS enough FROM rs""")
def m12_value_guard(spark, d):
    return M.model_guard(_clv_summary(spark, d))


CHURN_SQL = V.with_views("tx").rstrip() + f""",
obs AS (SELECT DISTINCT {name_key_nan_sql('customer')} AS cust FROM tx WHERE tx_date <= DATE '{OBS_END}'),
act AS (SELECT DISTINCT {name_key_nan_sql('customer')} AS cust FROM tx WHERE tx_date >= DATE '{WIN_START}'),
labels AS (SELECT obs.cust, CAST(CASE WHEN act.cust IS NULL THEN 1 ELSE 0 END AS INTEGER) AS churned
  FROM obs LEFT JOIN act ON obs.cust = act.cust),
""" + repeat_sql("tx", f"DATE '{OBS_END}'") + """,
ts AS (SELECT l.cust, l.churned, coalesce(frequency, 0) AS frequency, coalesce(recency, 0) AS recency,
    coalesce(T, 0) AS T, coalesce(monetary_value, 0) AS monetary_value FROM labels l LEFT JOIN rs USING (cust)),
pred AS (SELECT *, CASE WHEN T > 0 THEN CAST(1 AS DOUBLE) - recency / T ELSE CAST(1 AS DOUBLE) END AS score FROM ts)
"""


def _ts(spark, d):
    return C.training_set(V.tx(spark, d), OBS_END, WIN_START)


def _split(spark, d):
    return C.stratified_split(checkpoint_once(_ts(spark, d)))


def _pred(spark, d):
    ts = _ts(spark, d)
    return ts.withColumn("score", F.when(F.col("T") > 0, 1.0 - F.col("recency") / F.col("T")).otherwise(1.0))


@register("j11_churn_labels", CHURN_SQL + "SELECT * FROM labels")
def j11_churn_labels(spark, d):
    return C.churn_labels(V.tx(spark, d), OBS_END, WIN_START)


@register("m05_churn_training_set", CHURN_SQL + "SELECT * FROM ts")
def m05_churn_training_set(spark, d):
    """M5 + J9: labels left-joined to the features, a missing feature is 0."""
    return _ts(spark, d)


@register("m06_scaler_stats", CHURN_SQL + """SELECT * FROM (
  SELECT 'frequency' AS feature, round(avg(frequency), 4) AS mean, round(stddev_pop(frequency), 4) AS std FROM ts
  UNION ALL SELECT 'recency', round(avg(recency), 4), round(stddev_pop(recency), 4) FROM ts
  UNION ALL SELECT 'T', round(avg(T), 4), round(stddev_pop(T), 4) FROM ts
  UNION ALL SELECT 'monetary_value', round(avg(monetary_value), 4), round(stddev_pop(monetary_value), 4) FROM ts)""")
def m06_scaler_stats(spark, d):
    """M6: the standardisation table (mean, sample std) of the features."""
    return C.scaler_stats(_ts(spark, d))


@register("m07_stratified_split", CHURN_SQL + """SELECT cust, churned,
    CASE WHEN k < n - ceil(n * 0.3) THEN 'train' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY churned ORDER BY md5(cust), cust) - 1 AS k,
      count(*) OVER (PARTITION BY churned) AS n FROM ts)""")
def m07_stratified_split(spark, d):
    """M7: deterministic 70/30 split per class (md5 order)."""
    return _split(spark, d).select("cust", "churned", "split")


@register("m09_class_report", CHURN_SQL + """, cm AS (SELECT churned AS y, CAST(score >= 0.5 AS INTEGER) AS yhat FROM pred),
c AS (SELECT k AS class,
    count(*) FILTER (WHERE y = k AND yhat = k) AS tp, count(*) FILTER (WHERE y <> k AND yhat = k) AS fp,
    count(*) FILTER (WHERE y = k AND yhat <> k) AS fn FROM cm, (VALUES (0), (1)) v(k) GROUP BY k)
SELECT CAST(class AS INTEGER) AS class,
    CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE CAST(0 AS DOUBLE) END AS precision,
    CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE CAST(0 AS DOUBLE) END AS recall,
    CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE CAST(0 AS DOUBLE) END AS f1,
    CAST(tp + fn AS BIGINT) AS support FROM c""")
def m09_class_report(spark, d):
    """M9: class report at 0.5 for a given score (here 1 - recency/T)."""
    return C.class_report(_pred(spark, d))


@register("m10_auc", CHURN_SQL + """, sc AS (SELECT score AS s, sum(churned) AS pos, sum(1 - churned) AS neg
    FROM pred GROUP BY 1),
o AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bf FROM sc)
SELECT CAST(sum(2 * pos * bf + pos * neg) AS DOUBLE)
       / (CAST(2 AS DOUBLE) * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc,
    CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM o""")
def m10_auc(spark, d):
    """ROC AUC with average ranks for ties, for a given score."""
    return C.auc(_pred(spark, d))


@register("m10_roc_points", CHURN_SQL + """, sc AS (SELECT score AS s, sum(churned) AS pos, sum(1 - churned) AS neg
    FROM pred GROUP BY 1),
r AS (SELECT s, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp,
    sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fp FROM sc),
tot AS (SELECT CAST(sum(pos) AS BIGINT) AS P, CAST(sum(neg) AS BIGINT) AS N FROM sc)
SELECT s AS threshold, CASE WHEN N > 0 THEN CAST(fp AS BIGINT) / N END AS fpr,
    CASE WHEN P > 0 THEN CAST(tp AS BIGINT) / P END AS tpr FROM r, tot""")
def m10_roc_points(spark, d):
    return C.roc_points(_pred(spark, d))


@register("m10_roc_curve", CHURN_SQL + """, sc AS (SELECT score AS s, sum(churned) AS pos, sum(1 - churned) AS neg
    FROM pred GROUP BY 1),
r AS (SELECT s, pos, neg, CAST(sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
    CAST(sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp,
    lead(pos) OVER (ORDER BY s DESC) AS next_pos, lead(neg) OVER (ORDER BY s DESC) AS next_neg,
    row_number() OVER (ORDER BY s DESC) AS k FROM sc),
tot AS (SELECT CAST(sum(pos) AS BIGINT) AS P, CAST(sum(neg) AS BIGINT) AS N FROM sc)
SELECT s AS threshold, CASE WHEN N > 0 THEN fp / N END AS fpr, CASE WHEN P > 0 THEN tp / P END AS tpr FROM r, tot
  WHERE k = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
UNION ALL SELECT CAST('inf' AS DOUBLE), CASE WHEN N > 0 THEN CAST(0 AS DOUBLE) END, CASE WHEN P > 0 THEN CAST(0 AS DOUBLE) END FROM tot""")
def m10_roc_curve(spark, d):
    """The points of the drawn curve, (0, 0) included, none on a straight line."""
    return C.roc_points(_pred(spark, d), corners_only=True)


_Z = ", ".join(f"round(({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER (), 6) AS {f}_z" for f in C.FEATURES)


@register("m06_standardized", CHURN_SQL + f"SELECT cust, {_Z} FROM ts")
def m06_standardized(spark, d):
    """M6: the standardised features of each customer."""
    z = C.standardize(_ts(spark, d))
    return z.select("cust", *[F.round(f"{f}_z", 6).alias(f"{f}_z") for f in C.FEATURES])


#: Parameters at which the value models are held against SQL (days, money).
FIXED_BG = {"r": 0.6, "alpha": 60.0, "a": 0.9, "b": 2.4}
FIXED_GG = {"p": 6.0, "q": 4.0, "v": 15.0}
_PARAMS = ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in (FIXED_BG | FIXED_GG).items())
LL_SQL = CLV_SQL + f""", par AS (SELECT {_PARAMS}),
ll AS (SELECT cust, frequency AS x, recency AS tx, T AS age, monetary_value AS m, par.* FROM rs, par)
"""


@register("m02_log_likelihood", LL_SQL + """SELECT cust, round(lgamma(r + x) - lgamma(r) + r * ln(alpha)
    + lgamma(a + b) + lgamma(b + x) - lgamma(b) - lgamma(a + b + x)
    + ln(pow(alpha + age, -(r + x)) + CASE WHEN x > 0 THEN a / (b + x - 1) * pow(alpha + tx, -(r + x)) ELSE 0 END), 6) AS visit_ll,
    CASE WHEN x > 0 AND m > 0 THEN round(lgamma(p * x + q) - lgamma(p * x) - lgamma(q) + q * ln(v) + (p * x - 1) * ln(m)
      + p * x * ln(x) - (p * x + q) * ln(x * m + v), 6) END AS spend_ll FROM ll""")
def m02_log_likelihood(spark, d):
    """M2 + M3: each customer's log-likelihood under both models, at fixed parameters."""
    l = M.log_likelihoods(_clv_summary(spark, d), FIXED_BG, FIXED_GG)
    return l.select("cust", F.round("visit_ll", 6).alias("visit_ll"), F.round("spend_ll", 6).alias("spend_ll"))


# the published formula; its hypergeometric series converges fast enough at these parameters
CLV_FIXED_SQL = LL_SQL.rstrip() + """,
rep AS (SELECT * FROM ll WHERE x > 0 AND m > 0),
e AS (SELECT *, (a + b + x - 1) / (a - 1)
    * (1 - list_sum(list_transform(range(0, 1500), lambda k: exp(lgamma(r + x + k) - lgamma(r + x) + lgamma(b + x + k) - lgamma(b + x)
          - lgamma(a + b + x - 1 + k) + lgamma(a + b + x - 1) - lgamma(k + 1) + k * ln(30.0 * i / (alpha + age + 30 * i)))))
       * pow((alpha + age) / (alpha + age + 30 * i), r + x))
    / (1 + a / (b + x - 1) * pow((alpha + age) / (alpha + tx), r + x)) AS bought
  FROM rep, (SELECT unnest(range(1, 13)) AS i)),
months AS (SELECT *, bought - coalesce(lag(bought) OVER (PARTITION BY cust ORDER BY i), 0) AS n FROM e),
clv AS (SELECT cust, round(sum(((1 - p * x / (p * x + q - 1)) * (v * p / (q - 1)) + p * x / (p * x + q - 1) * m) * n / pow(1.01, i)), 2)
    AS predicted_clv FROM months GROUP BY cust)
"""


def _fixed_clv(spark, d):
    return M.clv(_clv_summary(spark, d), FIXED_BG, FIXED_GG, 365)


@register("m04_clv_fixed", CLV_FIXED_SQL + "SELECT * FROM clv")
def m04_clv_fixed(spark, d):
    """M4: 365-day discounted value at fixed parameters."""
    return _fixed_clv(spark, d).select("cust", F.round("predicted_clv", 2).alias("predicted_clv"))


PROFILE_SQL = CLV_FIXED_SQL.rstrip() + f",\nmembers AS ({V.SQL['members']}),\n" + rfm_ctes("tx", V.SNAPSHOT_AFTER) + """, profile AS (SELECT cust_norm, rfm_class,
    monetary_value, coalesce(predicted_clv, 0) AS predicted_clv FROM rfm LEFT JOIN clv ON cust_norm = cust)
"""


def _clv_profile(spark, d):
    profile = R.rfm(V.tx(spark, d), V.SNAPSHOT_AFTER, V.members(spark, d)).select("cust_norm", "rfm_class", "monetary_value")
    return M.clv_to_profile(profile, _fixed_clv(spark, d))


@register("j08_clv_to_profile", PROFILE_SQL + "SELECT * FROM profile")
def j08_clv_to_profile(spark, d):
    """Predicted value joined to every customer of the report, 0 for a miss."""
    return _clv_profile(spark, d)


@register("t08_top_clv_fixed", PROFILE_SQL + "SELECT * FROM profile ORDER BY predicted_clv DESC, cust_norm LIMIT 10")
def t08_top_clv_fixed(spark, d):
    """The 10 customers with the largest predicted value, their segment and spend."""
    from clientele.operators.basket import top_by_value
    return top_by_value(_clv_profile(spark, d), "predicted_clv", 10, "cust_norm")


@register("m12_refusals", CLV_SQL + """, parts AS (SELECT T // 100 AS age, count(*) AS n_customers,
    count(*) FILTER (WHERE frequency > 0 AND monetary_value > 0) AS n_repeat FROM rs GROUP BY 1)
SELECT *, CASE WHEN n_customers < 10 THEN 'too few customers' WHEN n_repeat < 10 THEN 'too few repeat customers' END AS reason
  FROM parts""")
def m12_refusals(spark, d):
    """Which parts of the customers, by age, the value models refuse, and why."""
    s = _clv_summary(spark, d).withColumn("age", F.floor(F.col("T") / 100))
    return M.refusals(s, "age")


SPLIT_SQL = CHURN_SQL + """, split AS (SELECT cust, churned, CASE WHEN k < n - ceil(n * 0.3) THEN 'train' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY churned ORDER BY md5(cust), cust) - 1 AS k,
      count(*) OVER (PARTITION BY churned) AS n FROM ts))
"""


@register("m08_forest_facts", SPLIT_SQL + """SELECT churned, count(*) AS n_rows, count(*) AS n_scores, 4 AS n_features,
    CAST(1 AS DOUBLE) AS importance FROM split WHERE split = 'test' GROUP BY 1""")
def m08_forest_facts(spark, d):
    """M8 + M11, what is determined: every test row has a score from 0 to 1, importances add up to 1."""
    fitted = C.fit_churn(V.tx(spark, d), OBS_END, WIN_START, max_depth=5)
    facts = C.feature_importances(fitted.model, spark).agg(F.count(F.lit(1)).cast("int").alias("n_features"),
                                                           F.round(F.sum("importance"), 9).alias("importance")).first()
    return (fitted.scored.groupBy("churned").agg(F.count(F.lit(1)).alias("n_rows"),
                                                 F.count(F.when(F.col("score").between(0, 1), 1)).alias("n_scores"))
            .withColumn("n_features", F.lit(facts["n_features"])).withColumn("importance", F.lit(facts["importance"])))


@register("m12_churn_guard", CHURN_SQL + """SELECT count(*) AS n_rows, count(DISTINCT churned) AS n_classes,
    count(*) >= 20 AND count(DISTINCT churned) >= 2 AS enough FROM ts""")
def m12_churn_guard(spark, d):
    return C.churn_guard(_ts(spark, d))


# ----------------------------------------------------------- rows-only fits
def _fits(spark, d):
    """The summary and both fits to it."""
    summary = _clv_summary(spark, d)
    return summary, M.bgnbd_fit(summary), M.gamma_gamma_fit(summary)


@register("m02_bgnbd_fit")
def m02_bgnbd_fit(spark, d):
    """M2: BG/NBD parameters (one row); each likelihood step is summed by Spark tasks."""
    summary = _clv_summary(spark, d)
    bg = M.bgnbd_fit(summary)
    return spark.range(1).select(*[F.lit(bg[k]).alias(k) for k in ("r", "alpha", "a", "b", "neg_ll")])


@register("m03_gamma_gamma_fit")
def m03_gamma_gamma_fit(spark, d):
    """M3: Gamma-Gamma parameters (one row)."""
    summary = _clv_summary(spark, d)
    gg = M.gamma_gamma_fit(summary)
    return spark.range(1).select(*[F.lit(gg[k]).alias(k) for k in ("p", "q", "v", "neg_ll")])


@register("m04_clv")
def m04_clv(spark, d):
    """M4: 365-day discounted customer value for repeat buyers."""
    summary, bg, gg = _fits(spark, d)
    return M.clv(summary, bg, gg, 365)


@register("t08_top_clv")
def t08_top_clv(spark, d):
    """The 10 customers with the largest predicted value (top-k)."""
    from clientele.operators.basket import top_by_value
    summary, bg, gg = _fits(spark, d)
    return top_by_value(M.clv(summary, bg, gg, 365), "predicted_clv", 10, "cust")


@register("m08_forest_scores")
def m08_forest_scores(spark, d):
    """M8: balanced random forest trained on the split's train part, churn
    probability on its test part."""
    split = _split(spark, d)
    model = C.train_forest(split.where(F.col("split") == "train"))
    return C.predict_scores(model, split.where(F.col("split") == "test")).select("cust", "churned", "score")


@register("m11_feature_importances")
def m11_feature_importances(spark, d):
    split = _split(spark, d)
    model = C.train_forest(split.where(F.col("split") == "train"))
    return C.feature_importances(model, spark)


@register("a24_clv_histogram")
def a24_clv_histogram(spark, d):
    """A24 on the value model: 50 equal-width bins of positive predicted CLV."""
    from clientele.operators.series import histogram
    summary, bg, gg = _fits(spark, d)
    scored = M.clv(summary, bg, gg, 365).where(F.col("predicted_clv") > 0)
    return histogram(scored, "predicted_clv", 50)


@register("m10_forest_metrics")
def m10_forest_metrics(spark, d):
    """M9 + M10 on the forest's test-split probabilities: AUC with the class
    report rows (one row per class)."""
    split = _split(spark, d)
    model = C.train_forest(split.where(F.col("split") == "train"))
    pred = checkpoint_once(C.predict_scores(model, split.where(F.col("split") == "test")).select("churned", "score"))
    auc = C.auc(pred).select("auc")
    one = F.lit(1).alias("_k")
    return (C.class_report(pred).select("*", one).join(auc.select("*", one), "_k").drop("_k"))
