"""Global order statistics without a single-task window.

``Window.orderBy(...)`` without ``partitionBy`` pulls every row into one
task.  Here the global order is built the way a distributed sort does it:

1. ``repartitionByRange`` on the (unique) order key -> P ordered ranges;
   a composite key splits even a value shared by a third of the rows.
2. ``sortWithinPartitions`` + ``mapInPandas`` -> running weight sum inside
   each range (Arrow batches, no per-row Python).
3. ``checkpoint()`` to the shared checkpoint folder, so both consumers below
   read the same materialised ranges and lineage is cut (executor loss
   re-reads the files instead of re-sampling range bounds).
4. per-range totals (P rows) -> prefix offsets -> broadcast join back.
   The broadcast side has exactly P rows: its size bound is the partition count.

The same path runs at every size.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from clientele.session import checkpoint_once


def _running_sum(batches):
    acc = 0
    for pdf in batches:
        cs = pdf["_w"].cumsum() + acc
        if len(cs):
            acc = int(cs.iloc[-1])
        pdf["_local"] = cs.astype("int64")
        yield pdf


def ordered_offsets(df: DataFrame, order_cols: list[str], weight: str | None = None,
                    num_partitions: int | None = None) -> DataFrame:
    """Add ``_before``: total weight of all rows strictly before each row in
    the global order of ``order_cols`` (which must be unique per row), and
    ``_w``: the row's own weight (1 when ``weight`` is None)."""
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    weighted = df.withColumn("_w", w)
    # Without an explicit count AQE sizes the ranges to the data; coalesced
    # partitions are contiguous ranges, so partition ids still follow the order.
    ranged = (weighted.repartitionByRange(*order_cols) if num_partitions is None
              else weighted.repartitionByRange(num_partitions, *order_cols))
    ranged = (ranged.sortWithinPartitions(*order_cols)
                .withColumn("_pid", F.spark_partition_id()))
    schema = StructType(ranged.schema.fields + [StructField("_local", LongType(), False)])
    local = checkpoint_once(ranged.mapInPandas(_running_sum, schema))
    totals = local.groupBy("_pid").agg(F.sum("_w").alias("_tot"))
    prior = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_tot").over(prior), F.lit(0)).cast("long").alias("_off"))
    return (local.join(F.broadcast(offsets), "_pid")
                 .withColumn("_before", F.col("_off") + F.col("_local") - F.col("_w"))
                 .drop("_pid", "_local", "_off"))


def ordered_scan(df: DataFrame, order_cols: list[str], weights: list[str], lead: list[str] = ()) -> DataFrame:
    """For each row of the global order of ``order_cols`` (unique per row), from
    one range partitioning: ``<w>_upto``, the sum of each weight up to and
    including the row, ``<w>_total``, its sum over all rows, and ``<c>_next``, the
    value of each ``lead`` column in the next row (null in the last).

    The last row of a range looks into the first row of the next range that has
    rows; those edges and the totals are a row per range, which is broadcast."""
    weights, lead = list(weights), list(lead)
    ranged = (df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
                .withColumn("_pid", F.spark_partition_id()))
    fields = [StructField(f"_{w}_local", LongType(), False) for w in weights]
    fields += [StructField(f"{c}_next", df.schema[c].dataType, True) for c in lead] + [StructField("_place", LongType(), False)]
    schema = StructType(ranged.schema.fields + fields)

    def scan(batches):
        import pandas as pd
        sums, place, held = dict.fromkeys(weights, 0), 0, None  # the last row waits for the one behind it
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.copy()
            for w in weights:
                pdf[f"_{w}_local"] = (pdf[w].cumsum() + sums[w]).astype("int64")
                sums[w] = int(pdf[f"_{w}_local"].iloc[-1])
            pdf["_place"] = range(place, place + len(pdf))
            place += len(pdf)
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            for c in lead:
                pdf[f"{c}_next"] = pdf[c].shift(-1)
            held = pdf.iloc[-1:].drop(columns=[f"{c}_next" for c in lead])
            yield pdf.iloc[:-1][schema.names]
        if held is not None:
            yield held.assign(**{f"{c}_next": None for c in lead})[schema.names]

    local = checkpoint_once(ranged.mapInPandas(scan, schema))
    first = F.min_by(F.struct("_place", *lead), "_place").alias("_first")
    edges = local.groupBy("_pid").agg(*[F.sum(w).cast("long").alias(f"_{w}") for w in weights], first,
                                      F.max("_place").alias("_last"))
    order, everything = Window.orderBy("_pid"), Window.partitionBy()  # a row per range
    prior = order.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("_pid", "_last", F.lead("_first").over(order).alias("_next"),
                         *[F.coalesce(F.sum(f"_{w}").over(prior), F.lit(0)).cast("long").alias(f"_{w}_off") for w in weights],
                         *[F.sum(f"_{w}").over(everything).cast("long").alias(f"{w}_total") for w in weights])
    joined = local.join(F.broadcast(edges), "_pid")  # a row per range
    at_edge = F.col("_place") == F.col("_last")
    return joined.select(*df.columns, *[(F.col(f"_{w}_off") + F.col(f"_{w}_local")).alias(f"{w}_upto") for w in weights],
                         *[f"{w}_total" for w in weights],
                         *[F.when(at_edge, F.col("_next")[c]).otherwise(F.col(f"{c}_next")).alias(f"{c}_next") for c in lead])


def global_rank(df: DataFrame, order_cols: list[str], out: str = "rank") -> DataFrame:
    """1-based row number in the global order (ties broken by the
    trailing order columns, which must make the key unique)."""
    return (ordered_offsets(df, order_cols)
            .withColumn(out, F.col("_before") + 1).drop("_before", "_w"))


def _value_order(df: DataFrame, col: str, few: bool, count) -> DataFrame:
    """(_v, _w, _before): the distinct non-null values of ``col`` in order, each
    with its weight ``count`` and the weight of all smaller ones.

    ``few`` says that the column's kind bounds its distinct values (days, counts
    of days): their order is then a plain window.  Otherwise it is the
    distributed one, at every size."""
    vals = (df.select(F.col(col).alias("_v")).where(F.col("_v").isNotNull())
              .groupBy("_v").agg(count.cast("long").alias("_cnt")))
    if not few:
        return ordered_offsets(vals, ["_v"], "_cnt").drop("_cnt")
    before = F.sum("_cnt").over(Window.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1))  # a row per day at most
    return vals.select("_v", F.col("_cnt").alias("_w"), F.coalesce(before, F.lit(0)).alias("_before"))


def _at(order: DataFrame, positions: set[int]) -> dict[int, float]:
    """The values at 0-based ``positions`` of the order; only their rows reach the driver."""
    cond = F.lit(False)
    for pos in sorted(positions):
        cond = cond | ((F.col("_before") <= pos) & (F.col("_before") + F.col("_w") > pos))
    hits = [(r["_before"], r["_w"], r["_v"]) for r in order.where(cond).select("_before", "_w", "_v").collect()]
    return {pos: float(v) for pos in positions for before, w, v in hits if before <= pos < before + w}


def exact_quantiles(df: DataFrame, col: str, probs: list[float],
                    n_values: int | None = None, few: bool = False) -> list[float | None]:
    """Exact linear-interpolated quantiles (NumPy 'linear', DuckDB
    ``quantile_cont``).  Values are pre-aggregated to (value, count) first, so
    a heavily repeated value is one row; only the <= 2 order statistics per
    probability reach the driver.  ``n_values``: the count of non-null
    values, where the caller has already measured it; ``few`` as in
    ``_value_order``."""
    order = _value_order(df.withColumn(col, F.col(col).cast("double")), col, few, F.count(F.lit(1)))
    total = n_values if n_values is not None else order.agg(F.sum("_w")).first()[0]
    if not total:
        return [None for _ in probs]
    places = [(total - 1) * p for p in probs]
    at = _at(order, {f(h) for h in places for f in (math.floor, math.ceil)})
    return [at[math.floor(h)] + (at[math.ceil(h)] - at[math.floor(h)]) * (h - math.floor(h)) for h in places]


def distinct_value_edges(df: DataFrame, col: str, n_distinct: int, parts: int = 3, few: bool = False) -> list[float]:
    """Inner edges of equal shares of the *distinct* values, by the floating-point
    arithmetic of the usual quantile routines: shares go through percent, and a
    value between two neighbours is taken from the nearer one.  An edge that
    falls on a value can so come out just below it."""
    places = [(n_distinct - 1) * (k / parts * 100 / 100) for k in range(1, parts)]
    at = _at(_value_order(df, col, few, F.lit(1)), {p for h in places for p in (math.floor(h), min(math.floor(h) + 1, n_distinct - 1))})
    edges = []
    for h in places:
        low, high, t = at[math.floor(h)], at[min(math.floor(h) + 1, n_distinct - 1)], h - math.floor(h)
        edges.append(high - (high - low) * (1 - t) if t >= 0.5 else low + (high - low) * t)
    return edges
