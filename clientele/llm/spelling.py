"""Spelling variants: words one edit apart, by dense prefix-suffix tiling.

1. Words are counted a task at a time, so that only (word, count) rows are
   shuffled.  The vocabulary is what occurs often enough.
2. Two words are one edit apart exactly if the lengths of their common prefix
   and common suffix reach the longer length minus one.  With ``size`` the
   shorter length, one of the two reaches ``size // 2``: the pair shares its
   first or its last ``size // 2`` code points.  Each word therefore goes to
   four buckets: (size, first half) and (size, last half) for its own length
   as the shorter one, and the same for its length less one.
3. A bucket of more than ``BLOCK`` words is dealt into blocks, and each pair of
   blocks is a tile of its own, so no task holds an unbounded bucket.  Small
   buckets share a tile.
4. A tile is a padded matrix of code points, aligned left for prefixes and
   right for suffixes; both lengths of all pairs come column by column.  Pairs
   never leave it: each word gets the number of its near words there and the
   best of them.  A pair that shares both halves counts in the first one only.
5. Forms are followed to their roots by pointer jumping; a form occurs at
   least twice as often as its word, so chains are short.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.common import bound_batches, materialize

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A run loses a code point where this divides the checksum of its document and itself (fixed value of the contract).
EVERY = 97
#: Words of a block; a tile compares two of them at most.
BLOCK = 1024
#: Small buckets are compared together up to about so many words.
TILE = 256
#: Code points of a text that are read at once.
PIECE = 1 << 20
#: Entries of a task's counter before it is handed on.
COUNTED = 200_000

#: Runs of letters, and what is not one (fixed values of the contract); texts are in lower case by then.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
GAP = re.compile("[^A-Za-zÀ-ÿ]")


def _pieces(text: str) -> Iterator[str]:
    """``text`` in pieces of about PIECE code points that cut no run."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def runs_of(name: str, text: bytes, every: int = EVERY) -> Counter:
    """How often each word stands in a document, after the deletions."""
    found: Counter = Counter()
    for piece in _pieces(text.lower().decode()):  # bytes: only A-Z change
        found.update(RUN.findall(piece))
    start = zlib.crc32(f"{name}:".encode())
    out: Counter = Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += n
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n) of the words that are long and frequent enough, written."""
    bound_batches(docs.sparkSession)

    def count(batches):
        def handed(counts):
            return pa.RecordBatch.from_pydict({"word": list(counts), "n": list(counts.values())},
                                              schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))
        counts: Counter = Counter()
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts.update({w: n for w, n in runs_of(name or "", text.as_py() or b"", every).items()
                               if len(w) >= least_length})
                if len(counts) >= COUNTED:
                    yield handed(counts)
                    counts = Counter()
        yield handed(counts)

    return materialize(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
                       .mapInArrow(count, "word string, n long")
                       .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count))


def _tiles(words: DataFrame, block: int) -> DataFrame:
    """(size, side, half, i, j, own, word, n): the words of each tile."""
    length = F.char_length("word")
    half = lambda size: (size / 2).cast("int")
    places = F.array(*(F.struct(size.alias("size"), F.lit(side).alias("side"), key.alias("half"))
                       for size in (length, length - 1)
                       for side, key in ((0, F.substring("word", F.lit(1), half(size))),
                                         (1, F.substring("word", length - half(size) + 1, half(size))))))
    placed = words.select("word", "n", F.explode(places).alias("p")).select("p.*", "word", "n")
    bucket = ["size", "side", "half"]
    # a bucket without two words, or without one of its shorter length, has no pair to compare
    used = (placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.char_length("word") == F.col("size")).alias("short"))
            .filter("c > 1 AND short > 0").select(*bucket, F.ceil(F.col("c") / block).cast("int").alias("blocks")))
    own = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    return (placed.join(used, bucket).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(*bucket, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "word", "n"))


def _common(left: np.ndarray, size: int) -> np.ndarray:
    """For all pairs of rows the number of leading columns, of ``size``, in which they agree."""
    alive = np.ones((len(left), len(left)), bool)
    length = np.zeros(alive.shape, np.int32)
    for k in range(size):
        alive &= left[:, k, None] == left[None, :, k]
        length += alive
        if np.count_nonzero(alive) == len(left):  # only each row with itself
            length[np.diag_indices(len(left))] = size
            break
    return length


def near_in_tile(words: list[str], counts: np.ndarray, group: np.ndarray, own: np.ndarray, apart: np.ndarray, size: int,
                 side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word of a tile the number of its near words and the place of
    the best one.  Words have ``size`` or one more code points.  Only words
    of one ``group`` are compared, and, where ``apart`` says so, of two blocks
    (``own``)."""
    order = np.array(sorted(range(len(words)), key=lambda k: (-counts[k], words[k])))
    lengths = np.array([len(words[k]) for k in order])
    codes = np.frombuffer("".join(words[k].ljust(size + 1, "\0") for k in order).encode("utf-32-le"),
                          np.uint32).reshape(len(words), size + 1)
    ends = np.where((lengths == size)[:, None], codes[:, :size], codes[:, 1:])[:, ::-1]
    prefix, suffix = _common(codes, size), _common(ends, size)
    short = lengths == size
    both = short[:, None] & short[None, :]
    near = (prefix + suffix >= size - both) & (short[:, None] | short[None, :]) & ~(both & (prefix == size))
    near &= (prefix >= size // 2) if side == 0 else (suffix >= size // 2) & (prefix < size // 2)
    group, own, apart = group[order], own[order], apart[order]
    near &= (group[:, None] == group[None, :]) & (~apart[:, None] | (own[:, None] != own[None, :]))
    number = near.sum(1)
    return order, number, order[near.argmax(1)]


def _near_words(tiles: DataFrame) -> DataFrame:
    """(word, near, best_n, best): what each tile finds for each of its words."""
    key = ["size", "side", "half", "i", "j"]
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])

    def compare(batches):
        held: list[tuple] = []  # (size, side, half, i, j, own, word, n), whole tiles of one size and side but for the last

        def found(rows):
            if len(rows) < 2:
                return
            words, counts = [r[6] for r in rows], np.array([r[7] for r in rows], np.int64)
            group = np.cumsum([0, *(a[2:5] != b[2:5] for a, b in zip(rows, rows[1:], strict=False))])
            own, apart = np.array([r[5] for r in rows]), np.array([r[3] != r[4] for r in rows])
            order, number, best = near_in_tile(words, counts, group, own, apart, rows[0][0], rows[0][1])
            at = np.flatnonzero(number)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([words[k] for k in order[at]]), pa.array(number[at].astype(np.int64)),
                     pa.array(counts[best[at]]), pa.array([words[k] for k in best[at]])], schema=schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:5] != held[-1][:5] and (row[:2] != held[-1][:2] or len(held) >= TILE):
                    yield from found(held)
                    held = []
                held.append(row)
        yield from found(held)

    return (tiles.repartition(*key).sortWithinPartitions(*key)
            .mapInArrow(compare, "word string, near long, best_n long, best string"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: the form of the form and so on."""
    links = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        jump = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = materialize(links.join(jump, "root", "left").select(
            "word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        links = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return links


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH,
                      least_count: int = LEAST_COUNT, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """A row per word of at least ``least_length`` code points and
    ``least_count`` occurrences: word, form, root, n, n_near, form_n.

    Words are the runs ``[A-Za-z\\u00C0-\\u00FF]+`` with A-Z in lower case; a run
    loses one code point where the contract's checksum says so, for a null id
    that of an empty one.  A null or empty text has none.  n_near counts the
    words one edit apart (0 if none); the one of them with the largest count,
    of equal ones the first in code-point order, is the form if it occurs at
    least twice as often, else form and form_n are null.  root follows the
    forms to the last, and is the word itself without one.  Repeated rows count
    as often as they stand there.  An empty table gives an empty result; other
    columns are not read.  ``least_length`` is 2 at least."""
    words = word_counts(docs, id_col, text_col, least_length, least_count, every)
    best = (_near_words(_tiles(words, block)).groupBy(F.col("word").alias("w"))
            .agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("b")))
    good = -F.col("b.less") >= 2 * F.col("n")
    found = materialize(words.join(best, words["word"] == best["w"], "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("b.best")).alias("form"), F.when(good, -F.col("b.less")).alias("form_n")))
    roots = _roots(found.filter("form IS NOT NULL")).withColumnRenamed("word", "w")
    return (found.join(roots, found["word"] == roots["w"], "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
