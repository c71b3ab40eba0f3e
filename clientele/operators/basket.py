"""Baskets, item pairs and top-item reports (A20, F11, X27, T3-T7, J4, J5,
X12, X13).

Pair expansion (X27) runs on *distinct* (basket, item) rows: however many
rows a hot basket holds, it has one for each of its items.  The items of a large
basket are cut into blocks, and each pair of blocks is a row of its own, so the
pairs of one basket spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientele.functions.text import name_key_nan, title_case


#: Items of a block of a basket; a row of two blocks makes its pairs in one task.
BLOCK = 256
#: Partitions of the basket rows at least.  Their number is given, as partitions that are merged to a size
#: when written hold many times that size of rows in the hash tables and sorts of a task.
PARTS = 128


def _basket_rows(tx: DataFrame, keys, item: str) -> tuple[DataFrame, list[str]]:
    """Rows with an item and all keys but the customer's, a null name as 'nan' (X2)."""
    present = [k for k in keys if k in tx.columns]
    t = tx.where(F.col(item).isNotNull())
    for k in present:
        t = t.withColumn(k, name_key_nan(k)) if k == "customer" else t.where(F.col(k).isNotNull())
    return t, present


def baskets(tx: DataFrame, keys=("customer", "tx_date", "ticket"), item: str = "item") -> DataFrame:
    """A20 (C5): items per basket.  Rows with a null date or ticket leave the
    analysis (grouping drops null keys); a null customer is the name 'nan'.
    ``n_items`` counts rows (duplicates too), ``items`` is the sorted distinct set."""
    t, present = _basket_rows(tx, keys, item)
    return t.groupBy(*present).agg(F.count(F.lit(1)).alias("n_items"),
                                   F.array_sort(F.collect_set(item)).alias("items"))


def multi_item(b: DataFrame) -> DataFrame:
    """baskets listing more than one item (duplicates count)."""
    return b.where(F.col("n_items") > 1)


def pair_counts(tx: DataFrame, keys=("customer", "tx_date", "ticket"), item: str = "item",
                block: int = BLOCK) -> DataFrame:
    """For every unordered pair of distinct items, the number of
    baskets containing both; pairs satisfy a < b.

    The distinct rows are made once, spread by basket and item, so that a hot basket
    is in many tasks; then each basket is one row, its items in order.  These are cut
    into blocks of ``block``; each pair of blocks is a row, spread again, and makes its
    pairs there.  A basket of few items is one block, hence one row."""
    t, present = _basket_rows(tx, keys, item)
    parts = max(PARTS, int(tx.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bi = t.select(*present, F.col(item).alias("it")).repartition(parts, *present, "it").distinct()
    listed = (bi.repartition(parts, *present).groupBy(*present).agg(F.sort_array(F.collect_list("it")).alias("items"))
              .where(F.size("items") > 1).select(F.xxhash64(*present).alias("_spread"), "items"))
    last = F.floor((F.size("items") - 1) / block).cast("int")
    cut = lambda i: F.slice("items", F.col(i) * block + 1, F.lit(block))
    rows = (listed.withColumn("_i", F.explode(F.sequence(F.lit(0), last)))
            .withColumn("_j", F.explode(F.sequence(F.col("_i"), last)))
            .select("_spread", "_i", "_j", cut("_i").alias("xs"), F.when(F.col("_i") < F.col("_j"), cut("_j")).alias("ys"))
            .repartition(parts, "_spread", "_i", "_j"))
    each = rows.select(F.posexplode("xs").alias("at", "item_a"), "xs", "ys")
    partner = F.coalesce("ys", F.slice("xs", F.col("at") + 2, F.lit(block)))  # of its own block those behind it
    pairs = each.select("item_a", F.explode(partner).alias("item_b"))
    return pairs.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("n_baskets"))


def top_pairs(pairs: DataFrame, n: int = 25) -> DataFrame:
    """The n most frequent pairs, ties by (a, b)."""
    return pairs.orderBy(F.col("n_baskets").desc(), "item_a", "item_b").limit(n)


def item_counts(tx: DataFrame, item: str = "item") -> DataFrame:
    """A8 on items: times each item was sold (nulls dropped)."""
    return tx.where(F.col(item).isNotNull()).groupBy(item).agg(F.count(F.lit(1)).alias("times_sold"))


def top_items(tx: DataFrame, n: int = 10, item: str = "item") -> DataFrame:
    """The n most sold items, ties by item."""
    return item_counts(tx, item).orderBy(F.col("times_sold").desc(), F.col(item)).limit(n)


def top_items_by_segment(tx: DataFrame, scored: DataFrame, n: int = 10, item: str = "item",
                         segment: str = "rfm_class") -> DataFrame:
    """J4 + T4: transactions joined (inner) to each customer's segment, then
    the n most sold items of *every* segment.  Rows are counted by (customer,
    item) before the join, so a hot customer meets it with one row an item; the
    ranking window runs over (segment, item) counts."""
    seg = scored.select(F.col("cust_norm").alias("_c"), F.col(segment).alias("segment"))
    t = tx.select(name_key_nan("customer").alias("_c"), F.col(item).alias("item")).where(F.col("item").isNotNull())
    t = t.groupBy("_c", "item").agg(F.count(F.lit(1)).alias("_n"))
    counts = t.join(seg, "_c").groupBy("segment", "item").agg(F.sum("_n").cast("long").alias("times_sold"))
    w = Window.partitionBy("segment").orderBy(F.col("times_sold").desc(), F.col("item"))
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)


def segment_rows(tx: DataFrame, scored: DataFrame, segment: str = "rfm_class") -> DataFrame:
    """Transaction rows of each segment; rows are counted by customer before the join."""
    seg = scored.select(F.col("cust_norm").alias("_c"), F.col(segment).alias("segment"))
    t = tx.groupBy(name_key_nan("customer").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    return t.join(seg, "_c").groupBy("segment").agg(F.sum("_n").cast("long").alias("n_rows"))


def buyer_value_by_item(tx: DataFrame, scored: DataFrame, spend: str = "total_spent",
                        item: str = "item") -> DataFrame:
    """J5 + A11: distinct (customer, item) pairs joined (inner) to the
    customer's total spend, then the mean spend of each item's buyers."""
    pairs = (tx.select(name_key_nan("customer").alias("_c"), F.col(item).alias("item"))
             .where(F.col("item").isNotNull()).distinct())
    spend_df = scored.select(F.col("cust_norm").alias("_c"), F.col(spend).alias("_s")).where(F.col("_s").isNotNull())
    j = pairs.join(spend_df, "_c")
    return j.groupBy("item").agg(
        (F.sum("_s").cast("double") / F.count(F.lit(1))).alias("avg_customer_spend"),
        F.count(F.lit(1)).alias("n_buyers"))


def top_by_value(df: DataFrame, col: str, n: int, key: str) -> DataFrame:
    """The n rows with the largest ``col`` (ties by key)."""
    return df.orderBy(F.col(col).desc(), F.col(key)).limit(n)


def parse_summary(report: DataFrame, summary: str = "item_summary") -> DataFrame:
    """X12 + X13: summary strings back into (item, n) rows; the item is
    title-cased.  Parts that do not look like 'name (n)' are skipped."""
    parts = report.select(F.explode(F.split(F.col(summary), ",")).alias("p"))
    p = F.btrim(F.col("p"))
    pat = r"^(.+?)\s*\((\d+)\)"
    name = F.btrim(F.regexp_extract(p, pat, 1))
    cnt = F.regexp_extract(p, pat, 2)
    return (parts.where(p.rlike(pat))
                 .select(title_case(name).alias("item"), cnt.cast("long").alias("n")))


def top_summary_items(report: DataFrame, n: int = 10) -> DataFrame:
    """Most sold items across summary strings (ties by item)."""
    s = parse_summary(report).groupBy("item").agg(F.sum("n").cast("long").alias("times_sold"))
    return s.orderBy(F.col("times_sold").desc(), "item").limit(n)
