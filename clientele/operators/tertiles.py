"""Three-label scores from the data's own distribution.

All scorers label rows through native expressions.  The driver reads only
scalars: two cut points and min/max (value tertiles) or a row / distinct
count (rank and fair tertiles, which use the global order of ``ranking``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.operators.ranking import distinct_value_edges, exact_quantiles, ordered_offsets

LOW_MED_HIGH = ("Low", "Medium", "High")
HIGH_MED_LOW = ("High", "Medium", "Low")


def _label(col: Column, e1, e2, labels) -> Column:
    return (F.when(col <= F.lit(e1), labels[0]).when(col <= F.lit(e2), labels[1])
             .otherwise(labels[2]))


def equal_width_edges(mn: float, mx: float) -> tuple[float, float]:
    """Inner edges of three equal-width bins over [mn, mx] (NumPy linspace)."""
    step = (mx - mn) / 3
    return 1 * step + mn, 2 * step + mn


def value_tertiles(df: DataFrame, col: str, out: str, labels=LOW_MED_HIGH, stats: dict | None = None,
                   few: bool = False) -> DataFrame:
    """W8 (+W11 fallback): right-closed tertiles of the values.

    Edges are the exact 1/3 and 2/3 quantiles (C7: a value exactly on an edge
    takes the lower label).  One distinct value -> every row gets the middle
    label; duplicated edges (min = q1, q1 = q2 or q2 = max) fall back to
    equal-width bins over [min, max], as the reference's exception path does.
    """
    if stats is None:
        stats = df.agg(*value_stats(col)).first().asDict()
    if stats["nd"] is None or stats["nd"] <= 1:
        return df.withColumn(out, F.lit(labels[1]))
    q1, q2 = exact_quantiles(df, col, [1 / 3, 2 / 3], n_values=stats["n"], few=few)
    edges = [stats["mn"], q1, q2, stats["mx"]]
    if len(set(edges)) < 4:
        q1, q2 = equal_width_edges(stats["mn"], stats["mx"])
    return df.withColumn(out, _label(F.col(col).cast("double"), q1, q2, labels))


def value_stats(col: str, prefix: str = ""):
    """Aggregate expressions a scorer needs about ``col`` (min, max, distinct
    and non-null counts), so a caller can compute several in one pass."""
    return [F.min(col).cast("double").alias(prefix + "mn"), F.max(col).cast("double").alias(prefix + "mx"),
            F.count_distinct(col).alias(prefix + "nd"), F.count(col).alias(prefix + "n")]


def rank_tertiles(df: DataFrame, col: str, tie_cols: list[str], out: str,
                  labels=LOW_MED_HIGH, stats: dict | None = None) -> DataFrame:
    """Tertiles of the rank (ties in row order given by ``tie_cols``).

    For rank k of n: first label iff 3(k-1) < n-1, second iff 3(k-1) < 2(n-1),
    else third — the integer form of quantile edges on ranks.  One distinct
    value -> middle label.

    Only the order's columns are put in order; the row at each edge is read, and
    every row is labelled by its place before or after it.  Where rows of one key
    stand on both sides of an edge, the rows themselves are ranked.
    """
    st = stats or df.agg(F.count_distinct(col).alias("nd"), F.count(F.lit(1)).alias("rows")).first().asDict()
    if st["nd"] is None or st["nd"] <= 1:
        return df.withColumn(out, F.lit(labels[1]))
    total, order = st["rows"], [col] + list(tie_cols)
    edges = [-(-(total - 1) // 3), -(-2 * (total - 1) // 3)]  # k - 1 of the first row of the second and third label
    beside = {e - step for e in edges for step in (0, 1)}
    at = {r["_before"]: [r[c] for c in order] for r in
          ordered_offsets(df.select(*order), order).where(F.col("_before").isin(*beside)).collect()}  # 4 rows at most
    if all(repr(at[e]) != repr(at[e - 1]) for e in edges):
        before = lambda e: F.struct(*order) < F.struct(*[F.lit(v).cast(df.schema[c].dataType).alias(c)
                                                         for c, v in zip(order, at[e])])
        return df.withColumn(out, F.when(before(edges[0]), labels[0]).when(before(edges[1]), labels[1]).otherwise(labels[2]))
    ranked = ordered_offsets(df, order)
    k1 = F.col("_before")  # k - 1
    lab = (F.when(3 * k1 < total - 1, labels[0]).when(3 * k1 < 2 * (total - 1), labels[1])
            .otherwise(labels[2]))
    return ranked.withColumn(out, lab).drop("_before", "_w")


def fair_tertiles(df: DataFrame, col: str, out: str, labels=LOW_MED_HIGH, n_distinct: int | None = None,
                  few: bool = False) -> DataFrame:
    """Tertiles over the *distinct* values, so equal values share a label.
    1 distinct value -> first label; 2 -> first, second; more -> right-closed
    between the edges of thirds of the distinct values.  A null gets the second label."""
    c = F.col(col)
    d = n_distinct if n_distinct is not None else df.agg(F.count_distinct(col)).first()[0]
    if d <= 1:
        lab = F.lit(labels[0])
    elif d == 2:
        low = df.agg(F.min(col)).first()[0]
        lab = F.when(c == F.lit(low), labels[0]).otherwise(labels[1])
    else:
        lab = _label(c.cast("double"), *distinct_value_edges(df, col, d, few=few), labels)
    return df.withColumn(out, F.when(c.isNull(), labels[1]).otherwise(lab))


def index_split_labels(df: DataFrame, col: str, out: str, labels=LOW_MED_HIGH) -> DataFrame:
    """Label ``min(floor(3 i / d), 2)`` for the i-th of d distinct values."""
    distinct = df.select(F.col(col).alias("_v")).where(F.col("_v").isNotNull()).distinct()
    d = distinct.count() or 1
    idx = ordered_offsets(distinct, ["_v"])
    pos = F.least(F.floor(F.col("_before") * 3 / d), F.lit(2))
    lab = F.element_at(F.array(*[F.lit(x) for x in labels]), (pos + 1).cast("int"))
    table = idx.select("_v", lab.alias(out))
    return df.join(table, df[col] == table["_v"], "left").drop("_v")


def equal_width_labels(df: DataFrame, col: str, out: str, labels=LOW_MED_HIGH) -> DataFrame:
    """W11 on its own: three equal-width right-closed bins over [min, max]."""
    st = df.agg(F.min(col).cast("double").alias("mn"), F.max(col).cast("double").alias("mx")).first()
    if st["mn"] is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    e1, e2 = equal_width_edges(st["mn"], st["mx"])
    return df.withColumn(out, _label(F.col(col).cast("double"), e1, e2, labels))
