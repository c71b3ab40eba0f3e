"""Mixing sources to target weights: capped water-filling and seeded repetition.

Everything is DataFrame operations.  Targets: sources are clamped at
``max_epochs`` times their size and the excess is shared again by weight
until none is above - the fixed point is a water level, found on the table of
one row per source by ordering the sources by the level at which they clamp.
Sampling: a document is taken a whole number of times, and once more if it
falls into the fractional part; documents stand in seeded order, and a source
takes the shortest run from the front that comes nearest to its fraction.  The
run's end is found from sums of 4096 hash buckets a source, so a source that
holds a third of all rows is summed by many tasks and no task orders more than
one bucket of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.common import WORD, free_name, materialize, plain_text

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17


def water_fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` (double) to (source, source_size, weight).

    Targets sum to the sum of all sizes; none exceeds max_epochs * its size.
    A source of size 0 has target 0.  One row per source, ordered in one
    task: sources are metadata, not data."""
    cap = F.col("source_size") * max_epochs
    order = Window.orderBy("clamps_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    return (
        sources.withColumn("cap", cap)
        .withColumn("clamps_at", F.col("cap").cast("double") / F.col("weight").cast("double"))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(everything)
                    - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.sum("source_size").over(everything) - F.col("cap_before")).cast("double")
                    / F.col("weight_left").cast("double"))
        .withColumn("clamped", F.col("level") >= F.col("clamps_at"))
        # levels fall along the order, so the largest one of an unclamped source is the water level
        .withColumn("water", F.max(F.when(~F.col("clamped"), F.col("level"))).over(everything))
        .select("source", "source_size", "weight",
                F.when(F.col("clamped"), F.col("cap").cast("double"))
                .otherwise(F.col("water") * F.col("weight")).alias("target")))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
                seed: int = SEED, id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, size, source, source_size, target,
    copies (0 to max_epochs), taken (size * copies).

    Size is the number of words; a null or empty text has size 0 and takes 0
    words.  Sources stand in code-point order, null last as a source of its
    own, and weigh ``weights`` in turn.  Rows that repeat an id are separate
    rows.  The taken words of a source differ from its target by at most half
    of one document.  Reruns agree: the order is a hash of seed and id.  An
    empty table gives an empty result; other columns are not read."""
    base = materialize(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.regexp_count(plain_text(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
              .cast("binary")).alias("place")).withColumn("bucket", F.substring("place", 1, 3)))

    sums = materialize(base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    sources = sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")).withColumn("weight", weight)
    targets = water_fill(sources, max_epochs)

    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(epochs)
    in_source = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    s, t = sums.alias("s"), targets.alias("t")
    quotas = materialize(
        s.join(t, F.col("s.source").eqNullSafe(F.col("t.source")))
        .select("s.source", "s.bucket", "s.bucket_size", "t.source_size", "t.target")
        .withColumn("before", F.coalesce(F.sum("bucket_size").over(in_source), F.lit(0)))
        .withColumn("whole", whole)
        # words of the fractional repetition that are still to be taken where this bucket begins
        .withColumn("quota", F.col("target") - whole * F.col("source_size") - F.col("before"))
        .select("source", "bucket", "source_size", "target", "whole", "quota"))

    b, q = base.alias("b"), quotas.alias("q")
    joined = (b.join(q, F.col("b.source").eqNullSafe(F.col("q.source")) & (F.col("b.bucket") == F.col("q.bucket")))
              .select("b.id", "b.source", "b.size", "b.place", "b.bucket",
                      "q.source_size", "q.target", "q.whole", "q.quota"))
    in_bucket = (Window.partitionBy("source", "bucket").orderBy("place", "id", "size")
                 .rowsBetween(Window.unboundedPreceding, -1))
    so_far = F.coalesce(F.sum("size").over(in_bucket), F.lit(0))
    copies = F.col("whole") + (so_far + F.col("size") / F.lit(2.0) <= F.col("quota")).cast("long")
    copies = F.when(F.col("size") > 0, F.least(copies, F.lit(max_epochs).cast("long"))).otherwise(F.col("whole"))
    return (joined.withColumn("copies", copies)
            .select(F.col("id").alias(id_col), "size", "source", "source_size", "target",
                    F.col("copies").cast("int").alias("copies"),
                    (F.col("size") * F.col("copies")).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                    **options) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it, all
    columns as they were; a row that the mix does not take goes.

    Rows of one id, source and size are taken equally often, but where a
    source's fraction ends among them: there as many as the mix says are taken
    once more, those first by a hash of the row.  So the words of a source are
    those that :func:`mix_sources` takes."""
    ident, of, size, own, times, copy, low, high, extra, place = (free_name(docs, f"__{x}") for x in (
        "id", "source", "size", "own", "times", "copy", "low", "high", "extra", "place"))
    shares = materialize(
        mix_sources(docs, id_col=id_col, source_col=source_col, text_col=text_col, **options)
        .groupBy(F.col(id_col).alias(ident), F.col("source").alias(of), F.col("size").alias(size))
        .agg(F.min("copies").alias(low), F.max("copies").alias(high),
             F.sum(F.col("copies")).alias(extra), F.count(F.lit(1)).alias(times))
        .withColumn(extra, F.col(extra) - F.col(low) * F.col(times)).drop(times).filter(F.col(high) > 0))
    sized = docs.withColumn(own, F.regexp_count(plain_text(text_col), F.lit(WORD)).cast("long"))

    def of_rows(part: DataFrame) -> DataFrame:
        return sized.join(part, sized[id_col].eqNullSafe(part[ident]) & sized[source_col].eqNullSafe(part[of])
                          & (sized[own] == part[size]))

    even, uneven = shares.filter(F.col(high) == F.col(low)), shares.filter(F.col(high) > F.col(low))
    taken = of_rows(even).select(*docs.columns, F.col(low).alias(times))
    if not uneven.isEmpty():  # at most one id and size of each source
        order = Window.partitionBy(ident, of, size).orderBy(place)
        taken = taken.unionByName(
            of_rows(uneven).withColumn(place, F.xxhash64(F.to_json(F.struct(*docs.columns))))
            .withColumn(times, F.col(low) + (F.row_number().over(order) <= F.col(extra)).cast("int"))
            .filter(F.col(times) > 0).select(*docs.columns, times))
    return (taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
            .select(*docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('17:' || coalesce(doc_id::VARCHAR, '')) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight
      FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight::DOUBLE AS clamps_at FROM s),
l AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0))::DOUBLE
                 / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE) AS level FROM c
      WINDOW o AS (ORDER BY clamps_at, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size,
             CASE WHEN level >= clamps_at THEN cap::DOUBLE
                  ELSE max(CASE WHEN level < clamps_at THEN level END) OVER () * weight END AS target FROM l),
r AS (SELECT d.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN size > 0 AND so_far + size / 2.0 <= target - whole * source_size
                     THEN least(whole + 1, 3) ELSE whole END AS copies FROM r)
SELECT doc_id, size, source, source_size, target, copies::INT AS copies, (size * copies)::BIGINT AS taken FROM k
"""
