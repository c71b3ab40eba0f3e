"""Price lookup and line totals.

The price list is reduced to one row per service key *before* the join
(keep-first by file order), so the join cannot fan out.  The first row is
found with ``min_by`` in a grouped aggregate — partial aggregation, no
per-key sort — and the reduced list joins the transactions on the key; AQE
broadcasts it when its measured size is under the threshold and falls back
to a shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.functions.text import service_key

MONEY = "decimal(18,2)"
# Fixed value: line value used when a table has no price column at all.
PLACEHOLDER_PRICE = 100000


def first_per_key(df: DataFrame, key, order_col: str, cols: list[str]) -> DataFrame:
    """One row per key — the row first in ``order_col`` order (its
    values as they are, nulls included)."""
    first = F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order_col))
    return (df.withColumn("_key", key).groupBy("_key").agg(first.alias("_first"))
              .select("_key", *[F.col("_first")[c].alias(c) for c in cols]))


def price_lookup(tx: DataFrame, pricelist: DataFrame, *, item: str = "item", qty: str | None = "qty",
                 service: str = "service", price: str = "price", row_id: str = "row_id",
                 items: DataFrame | None = None) -> DataFrame:
    """J1 + P5: attach the first price of the item's service key and the line
    total ``price * qty`` (price alone when there is no quantity column).
    A missing or unparseable price counts as 0.

    ``items``, few enough to be broadcast, holds the distinct item texts of ``tx``
    (column ``text``, null too): their keys are made once a text then, not once a row."""
    prices = first_per_key(pricelist, service_key(service), row_id, [price]).withColumnRenamed("_key", "_svc")
    # one scan of the transactions, batch or stream; the small side is broadcast where it is measured small
    if items is None:
        j = tx.withColumn("_svc", service_key(item)).join(prices, "_svc", "left").drop("_svc")
    else:
        priced = items.withColumn("_svc", service_key("text")).join(prices, "_svc", "left").select("text", price)
        j = tx.join(F.broadcast(priced), F.col(item).cast("string").eqNullSafe(F.col("text")), "left").drop("text")
    p = F.coalesce(F.col(price).try_cast(MONEY), F.lit(0).cast(MONEY))
    j = j.withColumn("unit_price", p).drop(price)
    if qty and qty in tx.columns:
        total = (F.col("unit_price") * F.col(qty)).cast("decimal(38,2)")
    else:
        total = F.col("unit_price").cast("decimal(38,2)")
    return j.withColumn("total_price", total)


def placeholder_total(tx: DataFrame, qty: str | None = "qty") -> DataFrame:
    """Without any price column, ``coalesce(qty, 1) * 100000``."""
    q = F.coalesce(F.col(qty), F.lit(1)) if qty and qty in tx.columns else F.lit(1)
    return tx.withColumn("total_price", (q * F.lit(PLACEHOLDER_PRICE)).cast("decimal(38,2)"))
