"""Fitting sparse hashed models with Spark: a bounded labelled sample, its
features as a written table, and rounds of training in which every learner
learns from its own rows and the changes are averaged (iterative parameter
mixing).  A hash of its id deals a row to one of ``LEARNERS`` learners, however
many partitions there are.  The driver holds ``LEARNERS`` copies of the model,
each of at most ``MAX_FEATURES`` features, and nothing that grows with the
corpus."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm import textops
from clientele.llm.common import bound_batches, materialize

#: Labelled rows used for fitting at most: those first in the order of a hash of the id.
MAX_ROWS = 8192
#: Features of a model at most: the most frequent of the sample; each in MIN_DOCS sample documents at least.
MAX_FEATURES, MIN_DOCS = 1 << 18, 3
#: Shares of the sample that are learned side by side.
LEARNERS = 4

#: A feature extractor: (bytes, text bounds) -> text number, feature, value of each feature of each text.
Features = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """The fold rule of the contracts: crc32 of the id as text."""
    c = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(c.cast("binary")) % modulus == remainder


def grouped(text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs in order, and how often each occurs."""
    order = np.lexsort((feature, text))
    text, feature = text[order], feature[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
    at = np.flatnonzero(new)
    return text[at], feature[at], np.diff(np.append(at, len(text)))


def sample_features(docs: DataFrame, labels: DataFrame, label: str, features: Features, max_rows: int = MAX_ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(y, features, values) of the sampled documents, written.  A label of an
    id that has no document, and a document without a label, teach nothing."""
    chosen = (labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull())
              .groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
              .orderBy(F.xxhash64("id"), "id").limit(max_rows))
    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(chosen), "id")  # at most max_rows rows
            .select("id", "y", "text"))

    def extract(batches):
        for batch in batches:
            out = []
            for _, data, bounds in textops.chunks(batch.column(2)):
                text, feature, value = features(data, bounds)
                cut = np.searchsorted(text, np.arange(1, len(bounds) - 1))
                out += zip(np.split(feature.view(np.int64), cut), np.split(value, cut), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([f for f, _ in out], pa.list_(pa.int64())),
                 pa.array([v.astype(np.float32) for _, v in out], pa.list_(pa.float32()))],
                names=["id", "y", "features", "values"])

    kind = chosen.schema["id"].dataType.simpleString()
    return materialize(rows.mapInArrow(extract, f"id {kind}, y int, features array<bigint>, values array<float>"))


def active_features(sample: DataFrame, max_features: int = MAX_FEATURES, min_docs: int = MIN_DOCS) -> np.ndarray:
    """Sorted hashes of the features that the model knows."""
    counts = (sample.select(F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") >= min_docs).orderBy(F.desc("n"), "f").limit(max_features))
    return np.sort(np.array([r["f"] for r in counts.collect()], np.int64).view(np.uint64))


def lookup(keys: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index in ``keys`` of each feature, and whether it is there."""
    if not len(keys):
        return np.zeros(len(feature), np.int64), np.zeros(len(feature), bool)
    at = np.minimum(np.searchsorted(keys, feature), len(keys) - 1)
    return at, keys[at] == feature


def _ragged(column: pa.ListArray, dtype) -> list[np.ndarray]:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    ends = np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1])


def indexed(sample: DataFrame, keys: np.ndarray) -> DataFrame:
    """(learner, id, y, at, values) with the places in ``keys`` of the known features, the rows of a learner together."""
    shared = sample.sparkSession.sparkContext.broadcast(keys)  # at most MAX_FEATURES hashes

    def run(batches):
        for batch in batches:
            rows = []
            for f, v in zip(_ragged(batch.column(2), np.int64), _ragged(batch.column(3), np.float32), strict=True):
                at, known = lookup(shared.value, f.view(np.uint64))
                rows.append((at[known], v[known]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([at for at, _ in rows], pa.list_(pa.int64())),
                 pa.array([v for _, v in rows], pa.list_(pa.float32()))], names=["id", "y", "at", "values"])

    kind = sample.schema["id"].dataType.simpleString()
    rows = sample.select("id", "y", "features", "values").mapInArrow(
        run, f"id {kind}, y int, at array<bigint>, values array<float>")
    learner = F.pmod(F.hash(F.xxhash64("id")), F.lit(LEARNERS))
    return materialize(rows.select(learner.alias("learner"), "*")
                       .repartitionByRange(LEARNERS, "learner").sortWithinPartitions("learner", "id"))


def mixing_round(rows: DataFrame, state: list[np.ndarray], seed: int,
                 learn: Callable[[list[np.ndarray], int, np.ndarray, np.ndarray], None]) -> list[np.ndarray]:
    """One round: every learner runs ``learn(state, y, at, values)`` over its
    rows in a seeded order, changing its copy of ``state`` in place; returns
    the mean of the copies, weighed by rows.  At most LEARNERS copies reach the
    driver, or one more for each file of a learner that is read in two tasks."""
    shared = rows.sparkSession.sparkContext.broadcast(state)  # the model: at most MAX_FEATURES features

    def run(batches):
        mine = {}
        for b in batches:
            for learner, *row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _ragged(b.column(2), np.int64),
                                     _ragged(b.column(3), np.float32), strict=True):
                mine.setdefault(learner, []).append(row)
        for own_rows in mine.values():
            own = [x.copy() for x in shared.value]
            for i in np.random.default_rng(seed).permutation(len(own_rows)):
                learn(own, *own_rows[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(own_rows)], pa.int64()), pa.array([[x.tobytes() for x in own]], pa.list_(pa.binary()))],
                names=["n", "state"])

    got = rows.select("learner", "y", "at", "values").mapInArrow(run, "n long, state array<binary>").toArrow()
    shared.destroy()
    if not got.num_rows:
        return state
    parts = [(n, [np.frombuffer(v.as_buffer(), x.dtype).reshape(x.shape) for v, x in zip(copy.values, state, strict=True)])
             for n, copy in zip(got.column(0).to_pylist(), got.column(1), strict=True)]
    parts.sort(key=lambda part: part[1][0].tobytes())  # so that sums do not depend on the order of arrival
    total = sum(n for n, _ in parts)
    mean = [np.zeros_like(x) for x in state]
    for n, copy in parts:
        for out, x in zip(mean, copy, strict=True):
            out += x * (n / total)
    return mean


def score_documents(docs: DataFrame, model: dict, score: Callable[[dict, np.ndarray, np.ndarray], np.ndarray],
                    text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text; nothing is shuffled."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_FEATURES features
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            out = [score(shared.value, data, bounds) for _, data, bounds in textops.chunks(batch.column(at))]
            scores = np.concatenate([*out, np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, score_col])

    from pyspark.sql.types import DoubleType, StructType
    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add(score_col, DoubleType()))
