"""Snapshot RFM.

``rfm_base`` is one ``groupBy(cust_norm)`` with partial aggregation, so a hot
customer is pre-aggregated map-side before the shuffle; ``countDistinct`` is
planned by Spark as a (customer, date) expand first, which also splits a hot
customer across tasks.  The full report needs items as well (A2/A3): grouping sets
bring the transactions to (customer, item) and (customer, day) rows in one scan and
one shuffle, and one more aggregate gives the customer; a hot customer meets it with
a row per item and day.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from clientele.functions import scores as S
from clientele.functions.text import name_key

MONEY = "decimal(38,2)"


def _as_date(v) -> Column:
    if isinstance(v, Column):
        return F.to_date(v)
    if isinstance(v, (_dt.date, _dt.datetime)):
        v = v.isoformat()[:10]
    return F.lit(str(v)[:10]).cast("date")


def as_of(tx: DataFrame, snapshot, date_col: str = "tx_date", include_next_day: bool = True) -> DataFrame:
    """rows dated on or before the cut; null dates drop.

    C1: the reference cuts at midnight of the day *after* the snapshot
    (``include_next_day=True``), so DATE rows of that next day are kept.
    """
    cut = _as_date(snapshot)
    if include_next_day:
        cut = F.date_add(cut, 1)
    c = F.col(date_col)
    if isinstance(tx.schema[date_col].dataType, DateType):
        return tx.where(c <= cut)
    return tx.where(c <= F.to_timestamp_ntz(cut.cast("string")))


def recency_days(last, reference) -> Column:
    """Whole days from ``last`` to ``reference`` (floor for timestamps)."""
    return F.timestamp_diff("DAY", last, reference).cast("long")


def rfm_base(tx: DataFrame, reference_day: Column | None, *, customer="customer", date_col="tx_date",
             money="total_price", row_id="row_id") -> DataFrame:
    """A1 + A4: recency, distinct-date frequency, money and first display name.

    ``reference_day`` is the DATE recency is measured to; with None the
    last purchase itself is returned as ``last_date`` (for a reference that
    depends on the whole table, applied later).  Money becomes
    DECIMAL(38,2); unparseable money counts as 0 (P7).
    """
    if reference_day is None:
        recency = F.max(date_col).alias("last_date")
    elif isinstance(tx.schema[date_col].dataType, DateType):
        recency = F.datediff(reference_day, F.max(date_col)).cast("long")
    else:
        recency = recency_days(F.max(date_col), F.to_timestamp_ntz(reference_day.cast("string")))
    m = F.coalesce(F.col(money).try_cast(MONEY), F.lit(0).cast(MONEY))
    named = F.when(F.col(customer).isNotNull(), F.col(row_id))
    return (tx.withColumn("cust_norm", name_key(customer))
              .groupBy("cust_norm")
              .agg(recency if reference_day is None else recency.alias("recency_days"),
                   F.countDistinct(date_col).alias("frequency"),
                   F.sum(m).cast(MONEY).alias("monetary_value"),
                   F.min_by(customer, named).alias("customer")))


def item_summary(tx: DataFrame, *, customer="customer", item="item") -> DataFrame:
    """A2 + A3: items per customer (blank items excluded) and the text
    ``'item (n), item (n)'`` sorted by item, plus the structured array.

    Two aggregates: (customer, item) counts, then one row per customer whose
    array size is bounded by the number of distinct items the customer bought.
    """
    t = (tx.select(name_key(customer).alias("cust_norm"), name_key(item).alias("item_norm"))
           .where(F.col("item_norm") != ""))
    per_item = t.groupBy("cust_norm", "item_norm").agg(F.count(F.lit(1)).alias("n"))
    arr = F.array_sort(F.collect_list(F.struct(F.col("item_norm").alias("item"), F.col("n"))))
    return (per_item.groupBy("cust_norm")
                    .agg(F.sum("n").cast("long").alias("total_items"), arr.alias("items"))
                    .withColumn("item_summary", F.array_join(
                        F.transform("items", lambda x: F.concat(x["item"], F.lit(" ("),
                                                                 x["n"].cast("string"), F.lit(")"))),
                        ", ")))


def _parts(tx: DataFrame, *, customer: str, date_col: str, money: str, item: str, row_id: str) -> DataFrame:
    """Rows reduced to what the metrics need: cust_norm, item_norm, day, shown, n, money, row."""
    m = F.coalesce(F.col(money).try_cast(MONEY), F.lit(0).cast(MONEY))
    return tx.select(name_key(customer).alias("cust_norm"), name_key(item).alias("item_norm"), F.col(date_col).alias("day"),
                     F.col(customer).alias("shown"), F.lit(1).cast("long").alias("n"), m.alias("money"), F.col(row_id).alias("row"))


def customer_metrics(parts: DataFrame, keys: tuple[str, ...] = ("cust_norm",)) -> DataFrame:
    """A1-A4 in one scan of ``parts``: keys, last_date, frequency,
    monetary_value, customer, total_items, item_summary.

    The grouping sets are (customer, item), (customer, day) and (customer, name
    as written); their aggregates are sums and minima of numbers, so Spark hashes
    them and sorts nothing."""
    keys = list(keys)
    sets = {"item_norm": 0, "day": 1, "shown": 2}
    cells = (parts.groupingSets([[*keys, c] for c in sets], *keys, *sets)
             .agg(*[F.grouping(c).alias(f"no_{c}") for c in sets], F.sum("n").alias("n"),
                  F.sum("money").cast(MONEY).alias("money"), F.min("row").alias("row")))
    day, shown = F.col("no_day") == 0, (F.col("no_shown") == 0) & F.col("shown").isNotNull()
    bought = (F.col("no_item_norm") == 0) & (F.col("item_norm") != "")
    pair = F.when(bought, F.struct(F.col("item_norm").alias("item"), F.col("n")))
    text = F.transform(F.array_sort(F.collect_list(pair)), lambda x: F.concat(x["item"], F.lit(" ("), x["n"].cast("string"), F.lit(")")))
    return cells.groupBy(*keys).agg(
        F.max(F.when(day, F.col("day"))).alias("last_date"),
        F.count(F.when(day, F.col("day"))).alias("frequency"),
        F.sum(F.when(day, F.col("money"))).cast(MONEY).alias("monetary_value"),
        F.min_by("shown", F.when(shown, F.col("row"))).alias("customer"),
        F.coalesce(F.sum(F.when(bought, F.col("n"))), F.lit(0)).cast("long").alias("total_items"),
        F.array_join(text, ", ").alias("item_summary"))


def member_flag(df: DataFrame, members: DataFrame | None, member_name: str = "name",
                key: str = "cust_norm") -> DataFrame:
    """J10: 'Member' when the normalised name is in the member list.

    Existence join against *distinct* member keys, so duplicates in the
    member list cannot multiply rows.  AQE turns it into a broadcast join
    only when the distinct key side is measured under the threshold.
    """
    if members is None:
        return df.withColumn("status", F.lit("Non-Member"))
    keys = (members.select(name_key(member_name).alias(key)).distinct()
                   .withColumn("_member", F.lit(True)))
    return (df.join(keys, key, "left")
              .withColumn("status", F.when(F.col("_member"), "Member").otherwise("Non-Member"))
              .drop("_member"))


def rfm(tx: DataFrame, snapshot, members: DataFrame | None = None, *,
        include_next_day: bool = True, recency_offset: int = 2,
        cutoffs: S.RuleCutoffs = S.DEFAULT_CUTOFFS, customer="customer", date_col="tx_date",
        money="total_price", item="item", row_id="row_id", member_name="name") -> DataFrame:
    """Snapshot RFM with rule scores and segment (the parametrised build).

    C1: rows up to midnight after ``snapshot`` (``include_next_day``), recency
    measured to ``snapshot + recency_offset`` days (reference: 2, so a
    purchase on the snapshot day has recency 2).  F is scored on the item
    count, not on visits (C17).  Null names form one customer keyed ''.

    Columns: cust_norm, customer, monetary_value, status, recency_days,
    frequency, total_items, r_score, f_score, m_score, rfm_class, item_summary.
    """
    cut = as_of(tx, snapshot, date_col, include_next_day)
    ref = F.date_add(_as_date(snapshot), recency_offset)
    parts = _parts(cut, customer=customer, date_col=date_col, money=money, item=item, row_id=row_id)
    if isinstance(tx.schema[date_col].dataType, DateType):
        recency = F.datediff(ref, "last_date").cast("long")
    else:
        recency = recency_days(F.col("last_date"), F.to_timestamp_ntz(ref.cast("string")))
    out = customer_metrics(parts).withColumn("recency_days", recency)
    out = (out.withColumn("r_score", S.r_rule("recency_days", cutoffs))
              .withColumn("f_score", S.f_rule("total_items", cutoffs))
              .withColumn("m_score", S.m_rule("monetary_value", cutoffs)))
    out = out.withColumn("rfm_class", S.segment("r_score", "f_score", "m_score"))
    out = member_flag(out, members, member_name)
    return out.select("cust_norm", "customer", "monetary_value", "status", "recency_days",
                      "frequency", "total_items", "r_score", "f_score", "m_score",
                      "rfm_class", "item_summary")


def rfm_snapshots(tx: DataFrame, snapshots: list, members: DataFrame | None = None, *,
                  include_next_day: bool = True, recency_offset: int = 2,
                  cutoffs: S.RuleCutoffs = S.DEFAULT_CUTOFFS, customer="customer", date_col="tx_date",
                  money="total_price", item="item", row_id="row_id", member_name="name") -> DataFrame:
    """``rfm`` at several snapshot dates in one pass over the transactions.

    Rows are reduced to (customer, item, day) first; each of those is tagged with
    every snapshot whose cut it falls under (``explode`` over a short literal
    array — no join), then all metrics are grouped by (snapshot, customer).  The
    fan-out is bounded by the number of snapshots given.  Output: ``rfm``'s columns plus ``snapshot`` (DATE).
    """
    if not isinstance(tx.schema[date_col].dataType, DateType):
        raise ValueError("rfm_snapshots needs a DATE column; cut timestamps with to_date first")
    snaps = F.array(*[_as_date(s) for s in snapshots])
    shift = 1 if include_next_day else 0
    d = F.col(date_col)
    parts = _parts(tx.where(d.isNotNull()), customer=customer, date_col=date_col, money=money, item=item, row_id=row_id)
    cells = parts.groupBy("cust_norm", "item_norm", "day", "shown").agg(
        F.sum("n").alias("n"), F.sum("money").cast(MONEY).alias("money"), F.min("row").alias("row"))
    tagged = cells.withColumn("snapshot", F.explode(F.filter(snaps, lambda s: F.col("day") <= F.date_add(s, shift))))
    out = customer_metrics(tagged, ("snapshot", "cust_norm")).withColumn(
        "recency_days", F.datediff(F.date_add(F.col("snapshot"), recency_offset), "last_date").cast("long"))
    out = (out.withColumn("r_score", S.r_rule("recency_days", cutoffs))
              .withColumn("f_score", S.f_rule("total_items", cutoffs))
              .withColumn("m_score", S.m_rule("monetary_value", cutoffs)))
    out = out.withColumn("rfm_class", S.segment("r_score", "f_score", "m_score"))
    out = member_flag(out, members, member_name)
    return out.select("snapshot", "cust_norm", "customer", "monetary_value", "status", "recency_days",
                      "frequency", "total_items", "r_score", "f_score", "m_score", "rfm_class", "item_summary")


def fill_metrics(joined: DataFrame, recency: str = "recency_days", money: str = "monetary_value",
                 frequency: str = "frequency", fallback: int = 0) -> DataFrame:
    """A customer without purchases has no money and no visit, and the
    largest recency of all others (``fallback`` if there is none).  The maximum is
    one aggregate."""
    most = joined.agg(F.max(recency)).first()[0]
    most = fallback if most is None else most
    return (joined.withColumn(money, F.coalesce(money, F.lit(0).cast(MONEY)).cast(MONEY))
            .withColumn(frequency, F.coalesce(frequency, F.lit(0)).cast("long"))
            .withColumn(recency, F.coalesce(recency, F.lit(most)).cast("long")))


def segment_counts(scored: DataFrame, segment_col: str = "rfm_class") -> DataFrame:
    """A8 + P13: customers per segment and percent share of the total.

    The share divides by a window over the already-aggregated rows (one per
    segment, at most 28), so the unpartitioned window is tiny.
    """
    from pyspark.sql import Window
    counts = scored.groupBy(segment_col).agg(F.count(F.lit(1)).alias("n_customers"))
    total = F.sum("n_customers").over(Window.partitionBy())
    return counts.withColumn("percent", F.col("n_customers") * 100.0 / total)
