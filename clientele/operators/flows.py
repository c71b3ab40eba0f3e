"""Two-snapshot comparisons: segment flow and stage movement
(J6, J7, X24, X25, W5, P12, P14).

Both snapshots come from the same transaction frame; each side is one row
per customer, so every join here is a key-to-key join on ``cust_norm``
(C3: the normalised key, not the display name).  All the percentages are
computed over already-aggregated rows (at most segments x segments).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.functions.scores import score_rank

NEW_CUSTOMER = "New Customer"
MOVEMENT_CLASSES = ["New", "Stay", "Downgrade", "Upgrade"]
STAGE_CAP = 24


def pct_label(n: Column, total: Column) -> Column:
    """``'n (p%)'`` with p to one decimal, rounded half-up on the exact
    ratio by integer arithmetic (no float formatting differences)."""
    tenths = F.floor((n * 2000 + total) / (total * 2)).cast("long")
    return F.concat(n.cast("string"), F.lit(" ("), (tenths / 10).cast("long").cast("string"), F.lit("."),
                    (tenths % 10).cast("string"), F.lit("%)"))


def flow_edges(before: DataFrame, after: DataFrame, key: str = "cust_norm",
               segment: str = "rfm_class") -> DataFrame:
    """Right join before -> after on the customer; a customer absent
    before is 'New Customer'.  One row per customer: (key, old, new)."""
    b = before.select(key, F.col(segment).alias("old_category"))
    a = after.select(key, F.col(segment).alias("new_category"))
    return (b.join(a, key, "right")
             .withColumn("old_category", F.coalesce("old_category", F.lit(NEW_CUSTOMER))))


def flow_links(edges: DataFrame) -> DataFrame:
    """X25 links: customers per (old, new) with share of the old category's
    total and of the new category's total (percent; one exact division)."""
    links = edges.groupBy("old_category", "new_category").agg(F.count(F.lit(1)).alias("n_customers"))
    old_total = F.sum("n_customers").over(Window.partitionBy("old_category"))
    new_total = F.sum("n_customers").over(Window.partitionBy("new_category"))
    return (links.withColumn("pct_of_old", F.col("n_customers") * 100.0 / old_total)
                 .withColumn("pct_of_new", F.col("n_customers") * 100.0 / new_total)
                 .withColumn("label", pct_label(F.col("n_customers"), old_total)))


def flow_nodes(edges: DataFrame) -> DataFrame:
    """X25 nodes: per category its total out (as old) and in (as new) and the
    growth ``(in - out) / out`` in percent (null when out is 0)."""
    outs = edges.groupBy(F.col("old_category").alias("category")).agg(F.count(F.lit(1)).alias("total_out"))
    ins = edges.groupBy(F.col("new_category").alias("category")).agg(F.count(F.lit(1)).alias("total_in"))
    j = outs.join(ins, "category", "full")
    out = F.coalesce("total_out", F.lit(0))
    inn = F.coalesce("total_in", F.lit(0))
    return j.select("category", out.cast("long").alias("total_out"), inn.cast("long").alias("total_in"),
                    F.when(out > 0, (inn - out) * 100.0 / out).alias("growth_pct"))


def node_text(edges: DataFrame) -> DataFrame:
    """The summary text of each node of the flow, one row a node: an old
    category with its total out; a new one with its total in, the increase over
    the old one of that name and where its customers came from (sorted by origin).
    At most segments x segments rows are gathered."""
    pairs = edges.groupBy("old_category", "new_category").agg(F.count(F.lit(1)).alias("n"))
    outs = pairs.groupBy(F.col("old_category").alias("category")).agg(F.sum("n").alias("total_out"))
    old = outs.select("category", F.lit("old").alias("side"),
                      F.concat(F.lit("Old Category: "), "category", F.lit("<br>Total Out: "), F.col("total_out").cast("string")).alias("text"))
    ins = pairs.groupBy(F.col("new_category").alias("category")).agg(
        F.sum("n").alias("total_in"), F.array_sort(F.collect_list(F.struct("old_category", "n"))).alias("flows"))
    j = ins.join(outs, "category", "left")
    # half-up on the exact ratio, in hundredths of a percent
    change = (F.col("total_in") - F.col("total_out")) * 10000
    hundredths = F.floor((change * 2 + F.col("total_out")) / (F.col("total_out") * 2)).cast("long")
    grown = F.concat(F.when(hundredths < 0, "-").otherwise(""), F.floor(F.abs(hundredths) / 100).cast("string"), F.lit("."),
                     F.lpad((F.abs(hundredths) % 100).cast("string"), 2, "0"), F.lit("%"))
    lines = F.array_join(F.transform("flows", lambda x: F.concat(
        F.lit("from "), x["old_category"], F.lit(": "), pct_label(x["n"], F.col("total_in")))), "<br>")
    new = j.select("category", F.lit("new").alias("side"), F.concat(
        F.lit("New Category: "), "category", F.lit("<br>Total In: "), F.col("total_in").cast("string"), F.lit("<br>Increase: "),
        F.when(F.coalesce("total_out", F.lit(0)) > 0, grown).otherwise("N/A"), F.lit("<br>Flows:<br>"), lines).alias("text"))
    return old.unionByName(new)


def with_stage(df: DataFrame, items: str = "total_items", cap: int = STAGE_CAP) -> DataFrame:
    """F-stage = item count top-coded at ``cap`` (null stays null;
    Spark's ``least`` alone would turn a null into the cap)."""
    return df.withColumn("fstage", _capped(F.col(items), cap))


def _capped(c: Column, cap: int = STAGE_CAP) -> Column:
    return F.when(c.isNotNull(), F.least(c, F.lit(cap)))


def stage_mix(scored: DataFrame) -> DataFrame:
    """A9 + W5 + P14: customers per (F-stage, R score) and the share within
    the stage; the window runs over <= 24 x 3 aggregated rows."""
    counts = (with_stage(scored).groupBy("fstage", "r_score")
              .agg(F.count(F.lit(1)).alias("n_customers")))
    stage_total = F.sum("n_customers").over(Window.partitionBy("fstage"))
    return (counts.withColumn("percent", F.col("n_customers") * 100.0 / stage_total)
                  .withColumn("label", pct_label(F.col("n_customers"), stage_total)))


def movement(before: DataFrame, after: DataFrame, key: str = "cust_norm") -> DataFrame:
    """J7 + X24 (C18): full outer join of two staged snapshots with a match
    indicator and a movement class.

    New: only after.  Stay: same stage and R.  Downgrade: same stage, worse R.
    Upgrade: higher stage, or same stage and better R.  A stage drop and
    before-only customers get no class (null).
    """
    cols = ["fstage", "r_score"]
    b = with_stage(before).select(key, *[F.col(c).alias(c + "_before") for c in cols],
                                  F.lit(True).alias("_in_before"))
    a = with_stage(after).select(key, *[F.col(c).alias(c + "_after") for c in cols],
                                 F.lit(True).alias("_in_after"))
    j = b.join(a, key, "full")
    ib, ia = F.coalesce("_in_before", F.lit(False)), F.coalesce("_in_after", F.lit(False))
    merge = (F.when(ib & ia, "both").when(ia, "left_only").otherwise("right_only"))
    sb, sa = F.col("fstage_before"), F.col("fstage_after")
    rb, ra = score_rank("r_score_before"), score_rank("r_score_after")
    both = ib & ia
    cls = (F.when(ia & ~ib, "New")
            .when(both & (sa == sb) & (F.col("r_score_after") == F.col("r_score_before")), "Stay")
            .when(both & (sa == sb) & (rb > ra), "Downgrade")
            .when(both & ((sa > sb) | ((sa == sb) & (ra > rb))), "Upgrade"))
    return j.withColumn("merge", merge).withColumn("movement", cls).drop("_in_before", "_in_after")


def side_by_side(both: DataFrame, before, after, key: str = "cust_norm",
                 cols=("rfm_class", "total_items", "r_score")) -> DataFrame:
    """One row per customer with ``<col>_before`` / ``<col>_after`` and
    presence flags, from a multi-snapshot RFM table (``rfm_snapshots``).

    A single ``groupBy(customer)`` with conditional aggregates replaces the
    two filtered branches and their join, so the transactions behind
    ``both`` are scanned once and nothing is materialised."""
    b = F.lit(str(before)[:10]).cast("date")
    a = F.lit(str(after)[:10]).cast("date")
    snap = F.col("snapshot")
    aggs = [F.max(F.when(snap == b, True)).alias("_in_before"), F.max(F.when(snap == a, True)).alias("_in_after")]
    for c in cols:
        aggs += [F.max(F.when(snap == b, F.col(c))).alias(f"{c}_before"),
                 F.max(F.when(snap == a, F.col(c))).alias(f"{c}_after")]
    return both.where(snap.isin(b, a)).groupBy(key).agg(*aggs)


def flow_edges_one_pass(both: DataFrame, before, after, key: str = "cust_norm") -> DataFrame:
    """J6 from a multi-snapshot table: customers present at ``after``; old
    category 'New Customer' when absent at ``before``."""
    sbs = side_by_side(both, before, after, key, cols=("rfm_class",))
    return (sbs.where(F.col("_in_after"))
               .select(key, F.coalesce(F.col("rfm_class_before"), F.lit(NEW_CUSTOMER)).alias("old_category"),
                       F.col("rfm_class_after").alias("new_category")))


def movement_one_pass(both: DataFrame, before, after, key: str = "cust_norm") -> DataFrame:
    """J7 + X24 from a multi-snapshot table: the same classes as ``movement``."""
    sbs = side_by_side(both, before, after, key, cols=("total_items", "r_score"))
    ib, ia = F.coalesce("_in_before", F.lit(False)), F.coalesce("_in_after", F.lit(False))
    sb = _capped(F.col("total_items_before"))
    sa = _capped(F.col("total_items_after"))
    rb, ra = score_rank("r_score_before"), score_rank("r_score_after")
    both_sides = ib & ia
    cls = (F.when(ia & ~ib, "New")
            .when(both_sides & (sa == sb) & (F.col("r_score_after") == F.col("r_score_before")), "Stay")
            .when(both_sides & (sa == sb) & (rb > ra), "Downgrade")
            .when(both_sides & ((sa > sb) | ((sa == sb) & (ra > rb))), "Upgrade"))
    merge = F.when(ib & ia, "both").when(ia, "left_only").otherwise("right_only")
    return sbs.select(key, sb.alias("fstage_before"), F.col("r_score_before"), sa.alias("fstage_after"),
                      F.col("r_score_after"), merge.alias("merge"), cls.alias("movement"))


def movement_counts(moves: DataFrame) -> DataFrame:
    """X24 summary: the four classes with their counts (0 included), from one
    conditional aggregate unpivoted with ``stack``."""
    aggs = [F.count(F.when(F.col("movement") == c, 1)).alias(c) for c in MOVEMENT_CLASSES]
    wide = moves.agg(*aggs)
    pairs = ", ".join(f"'{c}', `{c}`" for c in MOVEMENT_CLASSES)
    return wide.selectExpr(f"stack({len(MOVEMENT_CLASSES)}, {pairs}) AS (movement, n_customers)")
