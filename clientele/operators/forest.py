"""A random forest whose trees are grown, kept and walked by tasks.

Spark's forest holds every node of every tree in the driver, which a forest
without a depth bound outgrows: a tree has nearly as many nodes as there are
customers.  Here a tree is grown whole by one task and stays in the
checkpoint folder.  A tree only ever sees the bins of a row, so its input is
the table of *cells* (bins of all features) with the rows of each class; that
table has at most bins ** features rows, however many customers there are,
and is what the driver broadcasts.  A sample with replacement gives each row
a Poisson(1) weight, so a cell of n rows gets Poisson(n): the draw is the same
whichever partition a row stands in.

The rules are those of Spark's forest: Gini impurity of weighted classes, the
square root of the features (rounded up) in each node, a node is split while
its best split gains anything and the depth allows, sibling leaves of one
prediction are merged, a score is the mean of the leaves' class shares.
"""

from __future__ import annotations

import functools
import math
import operator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.operators.ranking import ordered_scan
from clientele.session import checkpoint_once

#: Split points are sought between the distinct values of a feature, or between so many blocks of them of equal weight.
BLOCKS = 4096
#: Entries of the histograms made at a time, bounds the memory of a task.
HISTOGRAM = 1 << 18
#: Trees whose scores one task adds up, at most.
TREES_A_TASK = 8
#: Shares are added as multiples of 1 / ONE: whole numbers add up the same in any order.
ONE = 1 << 40


@dataclass(frozen=True)
class CellForest:
    """``nodes`` has a row a tree, its nodes packed level by level; ``points`` the split points of each feature."""
    nodes: DataFrame
    features: list[str]
    points: list[list[float]]
    trees: int
    importances: list[float]


def choose_points(values: list[tuple[float, float | None, float]], most: int) -> list[float]:
    """At most ``most`` split points among (value, next value, weight) in
    order: all of them, or those nearest to equal shares of the weight, by
    the walk of Spark's forest."""
    between = [(v + after) / 2 for v, after, _ in values[:-1]]
    if len(between) <= most:
        return between
    stride = sum(w for *_, w in values) / (most + 1)
    points, upto, target = [], values[0][2], stride
    for point, (*_, w) in zip(between, values[1:]):
        before, upto = upto, upto + w
        if abs(before - target) < abs(upto - target):
            points.append(point)
            target += stride
    return points


def _value(feature: str) -> Column:
    """The feature as a double; as in Spark's forest, none may be missing."""
    v = F.col(feature).cast("double")
    return F.when(v.isNull() | F.isnan(v), F.raise_error(F.lit(f"{feature} has missing values")).cast("double")).otherwise(v)


def split_points(train: DataFrame, label: str, features: list[str], weights: list[float], max_bins: int) -> list[list[float]]:
    """Split points of each feature from all rows: at most BLOCKS rows a
    feature reach the driver, each a distinct value or a run of values."""
    spread = train.select(label, F.posexplode(F.array(*[_value(f) for f in features])).alias("f", "v"))
    names = [f"n{c}" for c in range(len(weights))]
    values = spread.groupBy("f", "v").agg(*[F.count(F.when(F.col(label) == c, 1)).alias(n) for c, n in enumerate(names)])
    scan = ordered_scan(values, ["f", "v"], names, ["f", "v"])
    # every feature has all rows, so those of the features before are known
    own = lambda n: F.col(f"{n}_upto") - F.col("f") * (F.col(f"{n}_total") / len(features))
    add = lambda part: functools.reduce(operator.add, [F.lit(float(w)) * part(n) for w, n in zip(weights, names)])
    share = add(own) / (add(lambda n: F.col(f"{n}_total")) / len(features))
    few = [r["f"] for r in scan.groupBy("f").count().collect() if r["count"] <= BLOCKS]  # a row a feature
    block = F.when(F.col("f").isin(few), F.col("v")).otherwise(F.floor(share * BLOCKS).cast("double"))
    rows = (scan.groupBy("f", block.alias("block"))
                .agg(F.max("v").alias("v"), F.max_by("v_next", "v").alias("after"), F.sum(add(F.col)).alias("w"))
                .orderBy("f", "v").collect())
    return [choose_points([(r["v"], r["after"], r["w"]) for r in rows if r["f"] == k], max_bins - 1) for k in range(len(features))]


def cell_of(features: list[str], points: list[list[float]]) -> Column:
    """The number of a row's cell: its bins as the digits of a number."""
    below = lambda at, v: F.size(F.filter(F.array(*map(F.lit, at)), lambda point: point < v)) if at else F.lit(0)
    cell = F.lit(0).cast("long")
    for f, at in zip(features, points):
        cell = cell * (len(at) + 1) + below(at, _value(f))
    return cell


def bins_of(cells: np.ndarray, n_bins: list[int]) -> np.ndarray:
    """The bins (cells x features) of numbered cells."""
    out = np.empty((len(cells), len(n_bins)), dtype=np.uint8 if max(n_bins) <= 256 else np.int32)
    for k in range(len(n_bins) - 1, -1, -1):
        cells, out[:, k] = np.divmod(cells, n_bins[k])
    return out


def _best_splits(x, n, rows, sizes, chosen, weights, bins):
    """Feature, last bin on the left and gain of the best split of each node;
    ``rows`` lists the nodes' cells one node after the other."""
    ends, m = np.concatenate([[0], np.cumsum(sizes)]), chosen.shape[1]
    feature, cut, gain = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), np.empty(len(sizes))
    step = max(1, HISTOGRAM // (m * bins))
    for a in range(0, len(sizes), step):
        b = min(a + step, len(sizes))
        r, node = rows[ends[a]:ends[b]], np.repeat(np.arange(b - a), sizes[a:b])
        left, right = np.empty((2, n.shape[1], b - a, m, bins - 1))
        for c in range(n.shape[1]):
            rows_of = n[r, c]
            for j in range(m):
                h = np.bincount(node * bins + x[r, chosen[a:b][node, j]], rows_of, (b - a) * bins).reshape(b - a, bins).cumsum(1)
                left[c, :, j], right[c, :, j] = h[:, :-1], h[:, -1:] - h[:, :-1]
        both = (left.sum(0) >= 1) & (right.sum(0) >= 1)
        weigh = weights[:, None, None, None]
        left, right = left * weigh, right * weigh
        of_left, of_right, whole = left.sum(0), right.sum(0), (left + right).sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            impurity = lambda part, total: 1 - ((part / total) ** 2).sum(0)
            gains = impurity(left + right, whole) - of_left / whole * impurity(left, of_left) - of_right / whole * impurity(right, of_right)
        gains = np.where(both, gains, -1.0).reshape(b - a, -1)
        best = gains.argmax(1)
        feature[a:b], cut[a:b] = chosen[a:b][np.arange(b - a), best // (bins - 1)], best % (bins - 1)
        gain[a:b] = gains[np.arange(b - a), best]
    return feature, cut, gain


def grow_tree(x, n, weights, bins: int, per_node: int, max_depth: int, rng):
    """A tree from cells (their bins ``x``, their drawn rows of each class
    ``n``) as arrays over its nodes, level by level: feature (-1 in a leaf),
    last bin on the left, weighted rows of each class, gain.  The children of
    the i-th inner node are the nodes 2 i + 1 and 2 i + 2."""
    weights = np.asarray(weights, dtype=float)
    kept = n.any(axis=1)
    x, n = x[kept], n[kept].astype(float)
    levels, stats, rows = [], n.sum(0)[None], np.arange(len(x))
    is_open, sizes = (stats > 0).sum(1) > 1, np.array([len(x)])
    for level in range(max_depth + 1):
        feature, cut, gain = np.full(len(stats), -1, np.int16), np.zeros(len(stats), np.int16), np.zeros(len(stats))
        levels.append([feature, cut, stats * weights, gain])
        nodes = np.flatnonzero(is_open)
        if level == max_depth or not len(nodes) or bins < 2:
            break
        chosen = np.sort(rng.random((len(nodes), x.shape[1])).argsort(1)[:, :per_node])  # of equal gains the first counts
        f, at, g = _best_splits(x, n, rows, sizes, chosen, weights, bins)
        split = g > 0
        if not split.any():
            break
        feature[nodes[split]], cut[nodes[split]], gain[nodes[split]] = f[split], at[split], g[split]
        node = np.repeat(np.arange(len(nodes)), sizes)
        rows, node = rows[split[node]], node[split[node]]
        child = 2 * (np.cumsum(split) - 1)[node] + (x[rows, f[node]] > at[node])
        order = np.argsort(child, kind="stable")
        rows, child, many = rows[order], child[order], 2 * int(split.sum())
        stats = np.stack([np.bincount(child, n[rows, c], many) for c in range(n.shape[1])], 1)
        sizes = np.bincount(child, minlength=many)
        is_open = ((stats > 0).sum(1) > 1) & (sizes > 1)  # rows of one class or one cell stay together
        rows, sizes = rows[is_open[child]], sizes[is_open]
    for upper, lower in zip(levels[-2::-1], levels[:0:-1]):  # sibling leaves of one prediction become one leaf
        leaf, says = lower[0] < 0, lower[2].argmax(1)
        same = leaf[::2] & leaf[1::2] & (says[::2] == says[1::2])
        upper[0][np.flatnonzero(upper[0] >= 0)[same]] = -1
        lower[:] = [part[np.repeat(~same, 2)] for part in lower]
    return tuple(np.concatenate(part) for part in zip(*levels))


def tree_importances(feature, stats, gain, n_features: int) -> np.ndarray:
    """Gain times weight of the inner nodes of each feature, which add up to 1 (0 in a tree without any)."""
    inner = feature >= 0
    found = np.bincount(feature[inner], (gain * stats.sum(1))[inner], n_features)
    return found / found.sum() if found.sum() else found


def walk_tree(x, feature, cut, share) -> np.ndarray:
    """The share of the leaf that each cell comes to; ``share`` has the leaves only."""
    inner = feature >= 0
    left, leaf = 2 * np.cumsum(inner) - 1, np.cumsum(~inner) - 1
    at, on = np.zeros(len(x), np.int64), np.arange(len(x))
    while len(on := on[inner[at[on]]]):
        here = at[on]
        at[on] = left[here] + (x[on, feature[here]] > cut[here])
    return share[leaf[at]]


def grow(train: DataFrame, label: str, features: list[str], weights: list[float], seed: int, trees: int, max_depth: int,
         max_bins: int) -> CellForest:
    """The forest of rows labelled 0, 1, ...; ``weights`` has the weight of a row of each class."""
    spark = train.sparkSession
    points = split_points(train, label, features, weights, max_bins)
    table = (train.select(cell_of(features, points).alias("cell"), label).groupBy("cell")
             .agg(*[F.count(F.when(F.col(label) == c, 1)).alias(f"n{c}") for c in range(len(weights))])
             .orderBy("cell").toArrow())  # at most bins ** features rows
    cells = spark.sparkContext.broadcast(tuple(c.to_numpy() for c in table.columns))
    n_bins, m = [len(at) + 1 for at in points], len(features) if trees == 1 else math.ceil(math.sqrt(len(features)))

    def grown(batches):
        import pandas as pd
        number, *counts = cells.value
        x, counts = bins_of(number, n_bins), np.stack(counts, 1)
        for pdf in batches:
            for tree in pdf["tree"].tolist():
                rng = np.random.default_rng([seed, tree])
                feature, cut, stats, gain = grow_tree(x, rng.poisson(counts), weights, max(n_bins), m, max_depth, rng)
                ends = stats[feature < 0]
                share = ends[:, 1] / np.maximum(ends.sum(1), np.finfo(float).tiny)  # 0 if no row was drawn
                yield pd.DataFrame({"tree": [tree], "feature": [feature.tobytes()], "cut": [cut.tobytes()], "share": [share.tobytes()],
                                    "importance": [tree_importances(feature, stats, gain, len(n_bins))]})

    nodes = checkpoint_once(spark.range(0, trees, 1, trees).withColumnRenamed("id", "tree")  # a task a tree
                            .mapInPandas(grown, "tree long, feature binary, cut binary, share binary, importance array<double>"))
    cells.destroy()
    total = np.sum([r["importance"] for r in nodes.select("tree", "importance").orderBy("tree").collect()], axis=0)
    return CellForest(nodes, list(features), points, trees, (total / total.sum() if total.sum() else total).tolist())


def score(forest: CellForest, df: DataFrame) -> DataFrame:
    """``df`` with the probability of class 1 as ``score``: the trees are
    walked once a distinct cell, by tasks that have a few trees each."""
    spark, trees, n_bins = df.sparkSession, forest.trees, [len(at) + 1 for at in forest.points]
    placed = df.withColumn("_cell", cell_of(forest.features, forest.points))
    cells = spark.sparkContext.broadcast(placed.select("_cell").distinct().toArrow()["_cell"].to_numpy())  # at most bins ** features

    def walked(batches):
        import pandas as pd
        x, total = bins_of(cells.value, n_bins), np.zeros(len(cells.value), np.int64)
        for pdf in batches:
            for feature, cut, share in zip(pdf["feature"], pdf["cut"], pdf["share"]):
                found = walk_tree(x, np.frombuffer(feature, np.int16), np.frombuffer(cut, np.int16), np.frombuffer(share))
                total += np.rint(found * ONE).astype(np.int64)
        yield pd.DataFrame({"_cell": cells.value, "_sum": total})

    tasks = max(math.ceil(trees / TREES_A_TASK), min(trees, spark.sparkContext.defaultParallelism))
    sums = (forest.nodes.select("feature", "cut", "share").coalesce(tasks).mapInPandas(walked, "_cell long, _sum long")
            .groupBy("_cell").agg((F.sum("_sum") / F.lit(float(ONE)) / trees).alias("score")))
    return placed.join(F.broadcast(sums), "_cell", "left").select(*df.columns, "score")  # a row a cell
