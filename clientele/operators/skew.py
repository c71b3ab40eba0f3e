"""Many-to-one joins in which one key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy with more than 1 / HEAVY of all rows, so there are fewer than HEAVY of them.
HEAVY = 256
#: Parts into which the rows of a heavy key are dealt.
PARTS = 64


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str = "n_rows") -> DataFrame:
    """Inner join of ``rows`` to ``table``, which holds one row a key and in
    ``count`` how many of ``rows`` have it (read twice: give it checkpointed).

    The heavy keys, fewer than HEAVY, are broadcast to mark their rows, which are
    dealt to PARTS; the one row of such a key is copied to each part.  No task
    then gets more of a key than 1 / PARTS of it, and ``rows`` is read once."""
    total = F.lit(table.agg(F.sum(count)).first()[0] or 0)
    heavy = table.where(F.col(count) * HEAVY > total).select(key, F.lit(True).alias("_heavy"))
    marked = rows.join(F.broadcast(heavy), key, "left")  # fewer than HEAVY rows
    part = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")
    marked = marked.withColumn("_part", F.when(F.col("_heavy"), part).otherwise(0)).drop("_heavy")
    parts = F.when(F.col(count) * HEAVY > total, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
    copied = table.withColumn("_part", F.explode(parts)).drop(count)
    return marked.join(copied, [key, "_part"]).drop("_part")
