"""Language-model scoring by stupid backoff, relationally.

The n-gram counts of the whole corpus are tables partitioned by the hash of
the n-gram; the n-grams of the texts are joined to them, and the scores are
summed per document.  To keep the shuffle small, n-grams travel as blocks:
a row holds the distinct n-grams of a block of texts that fall into one hash
partition, as sorted 64-bit hashes (their steps, in as few bytes as the largest
needs) with their counts, and the answer holds the counts of the other
blocks in the same order.  The texts of a block travel compressed.

Blocks and partitions both grow with the corpus, so a block never makes a row
for every partition: it cuts its n-grams by the first ``FAN_BITS`` bits of their
hashes.  While a partition needs more bits than that, groups of about
``2 ** FAN_BITS`` blocks are merged within their bits and cut by the next ones,
and the answers come back the same way.  Every level has at most
``2 ** FAN_BITS`` rows for each block of texts.

    S(w_i | context) = c(context w_i) / c(context)      if c(context w_i) >= min_count
                     = ALPHA * S(w_i | shorter context)  otherwise
    S(w_i) = c(w_i) / (number of words)

Counts come from all documents, the scored one included; n-grams below
``min_count`` are not in the table, so what one document alone holds backs off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm import textops
from clientele.llm.common import materialize

ORDER, MIN_COUNT, ALPHA = 3, 2, 0.4
#: Text bytes of a block; n-grams that a hash partition should hold; bits of the hash that one exchange deals by.
BLOCK_BYTES, PARTITION_GRAMS, FAN_BITS = 16 << 20, 2_000_000, 8
#: Zstandard level of the texts, which are written once and shuffled once.
TEXT_LEVEL = 6


def _zstd(data: bytes, level: int = 3) -> bytes:
    """The length and the compressed bytes."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def _plain(data: pa.Buffer) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _packed(values: np.ndarray, base: int) -> bytes:
    """Ascending 64-bit values as steps from ``base``, each in as many bytes as the
    largest needs; the last bytes of the steps, which are mostly small, compressed."""
    steps = np.diff(values, prepend=np.uint64(base)).astype("<u8")
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    raw = steps.view(np.uint8).reshape(-1, 8)
    return bytes([width]) + raw[:, :width - 1].tobytes() + _zstd(raw[:, width - 1].tobytes())


def _unpacked(data: pa.Buffer, n: int, base: int) -> np.ndarray:
    raw, width = np.zeros((n, 8), np.uint8), data[0]
    end = 1 + n * (width - 1)
    raw[:, :width - 1] = np.frombuffer(data[1:end], np.uint8).reshape(n, width - 1)
    raw[:, width - 1] = np.frombuffer(_plain(data[end:]), np.uint8)
    return np.cumsum(raw.view("<u8").ravel(), dtype=np.uint64) + np.uint64(base)


def _packed_counts(counts: np.ndarray) -> bytes:
    """How many, a byte for each count, and 8 bytes more for each of at least 255; compressed."""
    large = counts >= 255
    return _zstd(len(counts).to_bytes(8, "little") + np.where(large, 255, counts).astype(np.uint8).tobytes()
                 + counts[large].astype("<u8").tobytes())


def _unpacked_counts(data: pa.Buffer) -> np.ndarray:
    data = _plain(data)
    n = int.from_bytes(data[:8], "little")
    counts = np.frombuffer(data, np.uint8, n, 8).astype(np.uint64)
    counts[counts == 255] = np.frombuffer(data, "<u8", offset=8 + n)
    return counts


def _compressed(texts: pa.Array) -> bytes:
    """Lengths and bytes of the texts."""
    sizes = np.asarray(pc.binary_length(texts)).astype("<i8")
    return len(sizes).to_bytes(8, "little") + _zstd(sizes.tobytes() + "".join(texts.to_pylist()).encode(), TEXT_LEVEL)


def _texts(data: pa.Buffer) -> pa.Array:
    n, body = int.from_bytes(data[:8], "little"), _plain(data[8:])
    ends = np.concatenate([[0], np.cumsum(np.frombuffer(body[:8 * n], "<i8"))]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(body[8 * n:]))


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(block, ids, texts, words), one row per block of texts, written."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext
        part, n = TaskContext.get().partitionId(), 0
        ids, own, size = [], [], 0

        def block():
            texts = pa.concat_arrays(own)
            words = sum(len(textops.runs(~textops.SPACE[d], b)[0]) for _, d, b in textops.chunks(texts))
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + n], pa.int64()),
                 pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.concat_arrays(ids)),
                 pa.array([_compressed(texts)], pa.binary()), pa.array([words], pa.int64())],
                names=["block", "ids", "texts", "words"])

        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            sizes = np.cumsum(np.asarray(pc.binary_length(texts)))
            lo = 0
            while lo < len(texts):
                before = int(sizes[lo - 1]) if lo else 0
                hi = int(np.searchsorted(sizes, before + BLOCK_BYTES - size, "right"))
                hi = max(hi, lo if own else lo + 1)
                if hi > lo:
                    ids.append(batch.column(0).slice(lo, hi - lo))
                    own.append(texts.slice(lo, hi - lo))
                    size += int(sizes[hi - 1]) - before
                if hi < len(texts):  # the next text does not fit
                    yield block()
                    ids, own, size, n = [], [], 0, n + 1
                lo = hi
        if own:
            yield block()

    return materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"block long, ids array<{kind}>, texts binary, words long"))


def _grams(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams ending at each word, for n = 1 to ``order`` (0: the text
    begins too near), and the number of words of each text."""
    hashes, counts = [], []
    for _, data, bounds in textops.chunks(texts):
        h, first = textops.words(data, bounds)
        hashes.append(h)
        counts.append(np.diff(first))
    words = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    lengths = np.concatenate([*counts, np.zeros(0, np.int64)]).astype(np.int64)
    place = np.arange(len(words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = [words]
    for n in range(2, order + 1):
        g = np.zeros(len(words), np.uint64)
        g[n - 1:] = textops.ngrams(words, n)
        g[place < n - 1] = 0
        out.append(g)
    return out, lengths


def _distinct(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.sort(np.concatenate(grams))
    every = every[np.searchsorted(every, 1):]  # without the 0 of places that have no n-gram
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    at = np.flatnonzero(new)
    return every[at], np.diff(np.append(at, len(every)))


#: A node is a block of texts or a group of nodes; prefix: the first bits of the hashes.
_ASKED = "node long, prefix long, grams binary, counts binary"
_FOUND = "node long, prefix long, found binary"


def _cut(node: int, prefix: int, done: int, more: int, grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A node's n-grams with the first ``done`` bits ``prefix``, a row for each value of the next ``more``."""
    prefixes = [(prefix << more) + j for j in range(1 << more)]
    starts = [p << (64 - done - more) for p in prefixes]
    cut = [*np.searchsorted(grams, np.array(starts, np.uint64)).tolist(), len(grams)]
    return pa.RecordBatch.from_arrays(
        [pa.array([node] * len(prefixes), pa.int64()), pa.array(prefixes, pa.int64()),
         pa.array([_packed(grams[a:b], s) for a, b, s in zip(cut[:-1], cut[1:], starts, strict=True)], pa.binary()),
         pa.array([_packed_counts(counts[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())],
        names=["node", "prefix", "grams", "counts"])


def _summed(rows: pa.Table, done: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The n-grams of each row of a prefix, and all of them with the sums of their counts."""
    counts = [_unpacked_counts(c.as_buffer()) for c in rows.column("counts")]
    asked = [_unpacked(g.as_buffer(), len(c), p << (64 - done)) for g, c, p in zip(
        rows.column("grams"), counts, rows.column("prefix").to_pylist(), strict=True)]
    every = np.concatenate([*asked, np.zeros(0, np.uint64)])
    order = np.argsort(every, kind="stable")
    every = every[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    at = np.flatnonzero(new)
    sums = np.concatenate([*counts, np.zeros(0, np.uint64)])[order]
    return asked, every[at], np.add.reduceat(sums, at) if len(at) else sums


def _answers(rows: pa.Table, asked: list[np.ndarray], grams: np.ndarray, sums: np.ndarray) -> pa.Table:
    """The counts beyond a row's own, which are 0 for most of its n-grams."""
    return pa.table({"node": rows.column("node"), "prefix": rows.column("prefix"), "found": pa.array(
        [_packed_counts(sums[np.searchsorted(grams, a)] - _unpacked_counts(own.as_buffer()))
         for a, own in zip(asked, rows.column("counts"), strict=True)], pa.binary())})


def _counted(asked: DataFrame, nodes: int, done: int, left: int) -> DataFrame:
    """(node, prefix, found): the corpus counts of each row's n-grams without its own, in their order.

    ``done``: bits of the prefixes; ``left``: bits by which partitions are finer."""
    if not left:
        return asked.groupBy("prefix").applyInArrow(lambda rows: _answers(rows, *_summed(rows, done)), _FOUND)
    more, groups = min(left, FAN_BITS), -(-nodes // (1 << FAN_BITS))
    asked = materialize(asked.withColumn("group", F.pmod(F.xxhash64("node"), F.lit(groups))))

    def merge(rows):
        _, grams, sums = _summed(rows, done)
        return pa.Table.from_batches([_cut(rows["group"][0].as_py(), rows["prefix"][0].as_py(), done, more, grams, sums)])

    def share(rows, found):
        rows_of, grams, sums = _summed(rows, done)
        found = found.sort_by("fine")
        others = np.concatenate([_unpacked_counts(f.as_buffer()) for f in found["found"]])
        return _answers(rows, rows_of, grams, sums + others)

    merged = asked.groupBy("group", "prefix").applyInArrow(merge, _ASKED)
    found = _counted(merged, groups, done + more, left - more).select(
        F.col("node").alias("group"), F.shiftright("prefix", more).alias("prefix"), F.col("prefix").alias("fine"), "found")
    return (asked.groupBy("group", "prefix").cogroup(found.groupBy("group", "prefix")).applyInArrow(share, _FOUND))


def backoff_scores(docs: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, alpha: float = ALPHA,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_words, log_score (sum of the
    natural logs of the words' scores), mean_log_score.

    Words are runs of anything but ``[\\x20\\x09-\\x0D]``, A-Z in lower case.
    A null or empty text has no words, log_score 0 and mean_log_score null.
    Repeated rows count and are scored as documents of their own.  An empty
    table gives an empty result; other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()
    blocks = _blocks(docs, id_col, text_col)
    n_blocks, total = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("words"), F.lit(0))).first()
    bits = max(0, int(np.ceil(np.log2(max(1, order * total / PARTITION_GRAMS)))))
    first = min(bits, FAN_BITS)

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                grams, _ = _grams(_texts(batch.column(1)[i].as_buffer()), order)
                yield _cut(batch.column(0)[i].as_py(), 0, 0, first, *_distinct(grams))

    asked = blocks.select("block", "texts").mapInArrow(ask, _ASKED)
    answers = _counted(asked, n_blocks, first, bits - first).withColumnRenamed("node", "block")
    per_block = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("prefix", "found"))).alias("found"))

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, texts = batch.column(0)[i].values, _texts(batch.column(1)[i].as_buffer())
                grams, lengths = _grams(texts, order)
                seen, own = _distinct(grams)
                parts = batch.column(2)[i].values.field("found")
                found = own.astype(np.uint64) + np.concatenate([_unpacked_counts(p.as_buffer()) for p in parts])
                logs = _log_scores(grams, seen, found, total, min_count, alpha)
                sums = np.add.reduceat(np.append(logs, 0.0), np.cumsum(lengths) - lengths) if len(lengths) else logs
                sums = np.where(lengths > 0, sums, 0.0)
                with np.errstate(invalid="ignore", divide="ignore"):
                    means = pa.array(sums / lengths, mask=lengths == 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(lengths), pa.array(sums), means],
                                                 names=["id", "n_words", "log_score", "mean_log_score"])

    return (blocks.join(per_block, "block").select("ids", "texts", "found")
            .mapInArrow(score, f"id {kind}, n_words long, log_score double, mean_log_score double")
            .withColumnRenamed("id", id_col))


def _log_scores(grams: list[np.ndarray], seen: np.ndarray, found: np.ndarray, total: int, min_count: int,
                alpha: float) -> np.ndarray:
    """Log score of each word, from the longest n-gram down."""
    def counts(g):
        out = np.zeros(len(g))
        has = g != 0
        out[has] = found[np.searchsorted(seen, g[has])]
        return out

    of = [counts(g) for g in grams]
    out = np.zeros(len(grams[0]))
    backed = np.zeros(len(out))  # backoffs so far
    todo = np.ones(len(out), bool)
    for n in range(len(grams), 0, -1):
        if n == 1:
            out[todo] = backed[todo] * np.log(alpha) + np.log(of[0][todo]) - np.log(max(1, total))
            break
        possible = todo & (grams[n - 1] != 0)
        good = possible & (of[n - 1] >= min_count)
        context = np.concatenate([[0.0], of[n - 2][:-1]]) if len(out) else out
        out[good] = backed[good] * np.log(alpha) + np.log(of[n - 1][good]) - np.log(context[good])
        backed[possible & ~good] += 1
        todo &= ~good
    return out
