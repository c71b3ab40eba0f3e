"""Exact dedup with a heavy-hitter split.

1. One pass over the texts writes a narrow digest table (id, SHA-256 of the
   text with every run of white space replaced by one space).
2. Misra-Gries counters (``counters`` a task, merged by summing and
   subtracting the (counters + 1)-th largest) name the digests that may be
   frequent.  An exact count of just these verifies them.
3. The verified winners - at most ``counters`` rows, whatever the input -
   are broadcast, so the copies of a frequent text are resolved on the map
   side and never meet in one task.
4. The remaining digests go through an ordinary shuffle on the digest; none
   of them can hold more than the share of rows that Misra-Gries guarantees.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import SPACES, free_name, materialize, plain_text

COUNTERS = 1024


def digest_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, row): ``row`` tells repeated rows of one id apart."""
    norm = F.regexp_replace(plain_text(text_col), SPACES, " ")
    return materialize(docs.select(
        F.col(id_col).alias("id"), F.sha2(norm, 256).alias("digest"),
        F.monotonically_increasing_id().alias("row")))


def _shrink(counts: dict[str, int], counters: int) -> dict[str, int]:
    """The Misra-Gries reduction: at most ``counters`` positive counts stay."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return {k: v - cut for k, v in counts.items() if v > cut}


def misra_gries(digests: DataFrame, counters: int) -> list[str]:
    """Digests that may be frequent, at most ``counters`` of them.

    Any digest held by more than about rows / (counters + 1) rows is among
    them; others may be too, so callers verify the counts."""
    def summarise(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            for item in pc.value_counts(batch.column(0)).to_pylist():
                counts[item["values"]] = counts.get(item["values"], 0) + item["counts"]
            counts = _shrink(counts, counters)
        yield pa.RecordBatch.from_pydict(
            {"digest": list(counts), "n": list(counts.values())},
            schema=pa.schema([("digest", pa.string()), ("n", pa.int64())]))

    merged = (digests.select("digest").mapInArrow(summarise, "digest string, n long")
              .groupBy("digest").agg(F.sum("n").alias("n")))
    top = merged.orderBy(F.desc("n"), "digest").limit(counters + 1).collect()
    return list(_shrink({r["digest"]: r["n"] for r in top}, counters))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     counters: int = COUNTERS) -> DataFrame:
    """One row per input row: ``id_col``, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing each run of
    ``[\\x20\\x09-\\x0D]`` by one space; a null text is an empty text.  The
    row with the smallest id of a group stays; a null id is larger than any
    other, and of rows that repeat both id and text exactly one stays.  An
    empty table gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    digests = digest_table(docs, id_col, text_col)
    n_rows = digests.count()
    first = F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "row")).alias("first")

    suspects = spark.createDataFrame([(d,) for d in misra_gries(digests, counters)], "digest string")
    winners = materialize(
        digests.join(F.broadcast(suspects), "digest")  # at most `counters` rows
        .groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), first)
        .filter(F.col("group_size") * (counters + 1) > n_rows))

    tagged = digests.join(F.broadcast(winners), "digest", "left")  # at most `counters` rows
    hot = tagged.filter(F.col("first").isNotNull())
    cold = tagged.filter(F.col("first").isNull()).select("id", "digest", "row")
    sizes = cold.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), first)
    both = hot.unionByName(cold.join(sizes, "digest"))
    return both.select(
        F.col("id").cast(id_type).alias(id_col),
        F.col("first.id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.col("digest").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    counters: int = COUNTERS) -> DataFrame:
    """``docs`` without the rows that :func:`exact_duplicates` does not keep,
    all columns as they were.  Rows that repeat an id and a text leave one."""
    ident, digest, key = (free_name(docs, f"__{x}") for x in ("id", "digest", "key"))
    kept = (exact_duplicates(docs, id_col, text_col, counters).filter("kept")
            .select(F.col(id_col).alias(ident), F.col("text_sha256").alias(digest)))
    keyed = docs.withColumn(key, F.sha2(F.regexp_replace(plain_text(text_col), SPACES, " "), 256))
    return (keyed.join(kept, keyed[id_col].eqNullSafe(kept[ident]) & (keyed[key] == kept[digest]), "left_semi")
            .dropDuplicates([id_col, key]).select(*docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d
"""
