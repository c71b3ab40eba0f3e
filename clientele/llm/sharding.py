"""Sharding by minimax contiguous partition.

Groups of equal texts are atomic and stand in the order of their digest.  The
smallest shard capacity that lets ``shards`` contiguous runs hold every group
is found by binary search; each capacity is checked greedily.  The groups
themselves stay in Spark: the driver holds sums of blocks of consecutive
groups (a bounded number), and only the blocks in which a greedy cut can fall
are split into finer blocks, round by round, until each of them is one group.
A block of many groups is cut nowhere in the check that proves a capacity
feasible and anywhere in the check that proves it infeasible, so both ends of
the search are exact bounds and meet.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import materialize, plain_text

SHARDS = 16
#: Blocks of the first round, and pieces into which a block is split later.
BLOCKS, PIECES = 4096, 64


@dataclass
class Blocks:
    """Consecutive blocks of groups: where the first group begins, how many
    there are, and where the last one begins."""
    starts: list[int]
    counts: list[int]
    lasts: list[int]
    total: int

    def at(self, byte: int) -> int:
        return bisect_right(self.starts, byte) - 1

    def end(self, i: int) -> int:
        return self.starts[i + 1] if i + 1 < len(self.starts) else self.total

    def floor(self, byte: int, divisible: bool) -> int:
        """The last place at or before ``byte`` where a cut may fall."""
        if byte >= self.total:
            return self.total
        i = self.at(byte)
        return byte if divisible and self.counts[i] > 1 else self.starts[i]

    def cuts(self, capacity: int, shards: int, divisible: bool, start: int = 0) -> list[int] | None:
        """Ends of the greedy runs from ``start``, or None if they don't reach the end."""
        out = []
        for _ in range(shards):
            nxt = self.floor(start + capacity, divisible)
            if nxt <= start and start < self.total:
                return None
            out.append(start := nxt)
        return out if start >= self.total else None


def _search(blocks: Blocks, shards: int, divisible: bool, low: int, high: int) -> int:
    """The smallest feasible capacity, by binary search with a greedy check."""
    while low < high:
        mid = (low + high) // 2
        if blocks.cuts(mid, shards, divisible) is not None:
            high = mid
        else:
            low = mid + 1
    return low


def _block_sums(groups: DataFrame, starts: list[int], ends: list[int], steps: list[int]) -> list[tuple[int, int, int]]:
    """Where the first group begins, number of groups and where the last one begins, of the pieces of ``steps`` bytes into
    which the spans from ``starts`` to ``ends`` are split."""
    spans = [np.array(x, np.int64) for x in (starts, ends, steps)]  # a bounded number, see BLOCKS and PIECES

    def run(batches):
        first, last, step = spans
        for batch in batches:
            begin = np.asarray(batch.column(0))
            at = np.searchsorted(first, begin, "right") - 1
            inside = (at >= 0) & (begin < last[at])
            begin, at = begin[inside], at[inside]
            order = np.lexsort((begin, at))
            begin, at = begin[order], at[order]
            piece = (begin - first[at]) // step[at]
            new = np.ones(len(begin), bool)
            new[1:] = (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])
            f = np.flatnonzero(new)
            n = np.diff(np.append(f, len(begin)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at[f]), pa.array(piece[f]), pa.array(begin[f]), pa.array(n), pa.array(begin[f + n - 1])],
                names=["span", "piece", "begin", "n", "last"])

    rows = (groups.select("begin").mapInArrow(run, "span long, piece long, begin long, n long, last long")
            .groupBy("span", "piece").agg(F.min("begin").alias("begin"), F.sum("n").alias("n"),
                                          F.max("last").alias("last")).collect())
    return sorted((r["begin"], r["n"], r["last"]) for r in rows)


def minimax_cuts(groups: DataFrame, total: int, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity of ``shards`` contiguous runs, and the
    ``shards - 1`` inner cuts (bytes at which a group begins; ``total`` for
    empty shards at the end).

    ``groups``: begin (sum of the sizes before it), size (at least 1)."""
    if total == 0:
        return 0, [0] * (shards - 1)
    width = -(-total // BLOCKS)
    found = _block_sums(groups, [0], [total], [width])
    blocks = Blocks(*map(list, zip(*found, strict=True)), total)
    low, high = -(-total // shards), total
    while True:
        high = _search(blocks, shards, False, low, high)
        low = _search(blocks, shards, True, low, high)
        # cut j lies between the undivided greedy cut at `low` and the byte-wise one at `high`
        open_blocks, first, last = set(), 0, 0
        for _ in range(shards):
            first, last = blocks.floor(first + low, False) or first, min(last + high, total)
            if first >= total:
                break
            open_blocks.update(i for i in range(blocks.at(first), blocks.at(min(last, total - 1)) + 1)
                               if blocks.counts[i] > 1)
        if low == high or not open_blocks:
            break
        # from the first to the last group, so that those two part in every round
        spans = [(blocks.starts[i], blocks.lasts[i] + 1) for i in sorted(open_blocks)]
        finer = _block_sums(groups, [a for a, _ in spans], [b for _, b in spans],
                            [-(-(b - a) // PIECES) for a, b in spans])
        kept = [x for i, x in enumerate(zip(blocks.starts, blocks.counts, blocks.lasts, strict=True))
                if i not in open_blocks]
        blocks = Blocks(*map(list, zip(*sorted(kept + finer), strict=True)), total)
    return high, _near_equal(blocks, high, shards)


def _near_equal(blocks: Blocks, capacity: int, shards: int) -> list[int]:
    """Inner cuts under ``capacity``, each as near to an equal share of what
    is left as the shards after it allow."""
    cuts, start = [], 0
    for left in range(shards - 1, 0, -1):
        if start >= blocks.total:
            cuts.append(blocks.total)
            continue
        ideal = start + (blocks.total - start) / (left + 1)
        i = blocks.at(min(int(ideal), blocks.total - 1))
        reach = blocks.floor(start + capacity, False)
        # the group that holds the ideal cut goes to the nearer side
        options = sorted({blocks.starts[i], blocks.end(i), reach}, key=lambda x: abs(x - ideal))
        start = next((x for x in options if start < x <= reach
                      and (x >= blocks.total or blocks.cuts(capacity, left, False, x) is not None)), reach)
        cuts.append(start)
    return cuts


def _number_rows(batches):
    """Place and bytes before each row within its ordered partition."""
    from pyspark import TaskContext
    part, rows, size = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = np.asarray(batch.column("size"), dtype=np.int64)
        ends = np.cumsum(sizes)
        n = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(rows, rows + n)),
             pa.array(size + ends - sizes)],
            names=[*batch.schema.names, "part", "row_here", "bytes_here"])
        rows, size = rows + n, size + int(ends[-1] if n else 0)


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, size, text_crc32, law ('bytes'),
    shard, slot, grown_shard (null: the law is not 'key').

    Size is the UTF-8 length plus 1; a null text counts as an empty one.
    Equal texts share a shard, so the largest shard is the smallest possible
    for contiguous runs of groups in digest order.  Rows of a shard stand in
    the order (digest, id, row); repeated rows have slots of their own.  More
    shards than groups leave the last ones empty.  An empty table gives an
    empty result; other columns are not read.

    The global order is by range partitions (a text held by a third of all
    rows is split by id); the driver sees one row per partition and sums of
    blocks, never a group table."""
    spark = docs.sparkSession
    text = plain_text(text_col)
    base = materialize(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.md5(text.cast("binary")).alias("digest"),
        F.monotonically_increasing_id().alias("row")))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in base.schema.fields)
    ranked = materialize(
        base.repartitionByRange("digest", "id", "row").sortWithinPartitions("digest", "id", "row")
        .mapInArrow(_number_rows, fields + ", part int, row_here long, bytes_here long").drop("row"))

    parts = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()
    offsets, rows, total = [], 0, 0
    for p in sorted(parts, key=lambda r: r["part"]):
        offsets.append((p["part"], rows, total))
        rows, total = rows + p["n"], total + p["b"]
    before = spark.createDataFrame(offsets, "part int, rows_before long, bytes_before long")
    placed = (ranked.join(F.broadcast(before), "part")  # one row per partition
              .withColumn("place", F.col("row_here") + F.col("rows_before"))
              .withColumn("begin", F.col("bytes_here") + F.col("bytes_before")))

    groups = materialize(placed.groupBy("digest").agg(F.min("begin").alias("begin"), F.sum("size").alias("size"))
                         .drop("digest"))
    _, cuts = minimax_cuts(groups, total, shards)
    shard = sum(((F.col("begin") >= c).cast("int") for c in cuts), F.lit(0))
    placed = placed.withColumn("shard", shard)
    firsts = {r["shard"]: r["p"] for r in placed.groupBy("shard").agg(F.min("place").alias("p")).collect()}
    first = F.element_at(F.array(*[F.lit(firsts.get(i, 0)).cast("long") for i in range(shards)]), F.col("shard") + 1)
    return placed.select(
        F.col("id").alias(id_col), "size", F.col("crc").cast("long").alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
