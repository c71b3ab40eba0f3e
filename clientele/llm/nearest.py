"""Approximate nearest neighbours by largest inner product, with an adaptive
dimension scan inside the probed lists of an inverted index.

* Inner product becomes distance: a vector x gets one more component
  sqrt(M^2 - |x|^2), M the largest norm, and a query gets 0 there; then the
  nearest vectors have the largest inner products.
* Vectors are rotated at random, so that any leading components are a fair
  sample of the distance, and are scanned in blocks of columns.  After each
  block a hypothesis test compares the distance so far, scaled to all
  components, with the query's 20th best distance: a candidate that is beyond
  it with high confidence is abandoned.
* Every vector is in one list.  The list centres are fitted on a bounded
  sample.  A query's nearest list is scanned first and gives it a threshold;
  its other probed lists are scanned against that.
* A long list is scanned in pieces and many queries of a list in blocks, so a
  list that holds a third of all vectors is many small tasks.

Survivors get their exact inner product in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm.common import materialize

TOP = 20
#: Vectors a list should hold, lists at most, sampled vectors for the centres at most, share of the lists that a query probes.
LIST_SIZE, MOST_LISTS, SAMPLE, PROBED = 1024, 1024, 16_384, 0.75
#: Rows of a piece of a list, queries of a block, components of a column block, confidence of the test (in standard errors).
PIECE, QUERIES, COLUMNS, CONFIDENCE = 4096, 512, 16, 2.1


def usable_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part: not null, not zero, no null or
    non-finite component, of the most frequent length (the shorter in a tie)."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = (table.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
            .select(F.col(id_col).alias("id"), v.alias("v"))
            .filter(finite & F.exists("v", lambda x: x != 0)))
    rows = materialize(rows)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (lengths["d"] if lengths else 0))


def fit_centres(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centres of Lloyd's k-means on a bounded sample."""
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(1) - 2 * sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _augmented(vectors: np.ndarray, norm: float, query: bool, rotation: np.ndarray) -> np.ndarray:
    squares = (vectors * vectors).sum(1)
    more = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(norm * norm - squares, 0.0))
    return np.column_stack([vectors, more]) @ rotation


def scan(queries: np.ndarray, vectors: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, vector) that survive the adaptive scan.

    Both are rotated; ``radius`` is each query's squared threshold (infinite:
    nothing is abandoned)."""
    size = vectors.shape[1]
    q, c = np.divmod(np.arange(len(queries) * len(vectors)), max(1, len(vectors)))
    far = np.zeros(len(q))
    for start in range(0, size, COLUMNS):
        stop = min(start + COLUMNS, size)
        a, b = queries[:, start:stop], vectors[:, start:stop]
        if start == 0:
            far = ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T).ravel()
        else:
            diff = a[q] - b[c]
            far = far + np.einsum("ij,ij->i", diff, diff)
        slack = 1.0 if stop == size else (1.0 + CONFIDENCE / np.sqrt(stop)) ** 2 * stop / size
        near = far <= radius[q] * slack * (1 + 1e-9) + 1e-9
        q, c, far = q[near], c[near], far[near]
    return q, c


def _probe(top: int):
    """Scan a piece of a list for a block of queries; keep the best ``top`` of each query."""
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        qid, vid = (t.column("id").to_numpy() for t in (queries, vectors))
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(qid) and len(vid):
            raw_q, raw_v = _matrix(queries.column("v")), _matrix(vectors.column("v"))
            q, c = scan(_matrix(queries.column("r")), _matrix(vectors.column("r")), queries.column("radius").to_numpy())
            other = qid[q] != vid[c]
            q, c = q[other], c[other]
            score = np.einsum("ij,ij->i", raw_q[q], raw_v[c])
            order = np.lexsort((vid[c], -score, q))
            q, c, score = q[order], c[order], score[order]
            begin = np.searchsorted(q, q)
            best = np.arange(len(q)) - begin < top
            found = [qid[q[best]], vid[c[best]], score[best]]
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "vec_id": pa.array(found[1], pa.int64()),
                         "score": pa.array(found[2], pa.float64())})
    return run


def nearest_neighbours(table: DataFrame, query_filter: str = "vec_id % 20 = 0", top: int = TOP,
                       probed: float = PROBED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's ``top`` nearest found: query_id, rank (from 1), vec_id,
    score (inner product in double precision), nearest first, ties to the
    smaller id.

    Queries are the usable rows that meet ``query_filter`` (on ``id_col``);
    candidates are all usable rows but those of the query's own id.  Vectors
    that are null, zero or hold a null or non-finite component, or are of
    another length than most, take no part, and neither do rows without id.
    A query's probed lists hold more than ``top`` vectors if there are so many.
    Vectors that repeat are separate candidates.  An empty table gives an empty
    result; other columns are not read.  Ids are integers."""
    spark = table.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows = usable_vectors(table, id_col, vector_col)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"),
                     F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    n = stats["n"]
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, norm = stats["d"] + 1, float(np.sqrt(stats["m"]))
    rotation = np.linalg.qr(np.random.default_rng(11).normal(size=(size, size)))[0]
    lists = int(min(MOST_LISTS, max(1, -(-n // LIST_SIZE))))
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()  # SAMPLE rows at most
    centres = fit_centres(_augmented(_matrix(picked.column("v")), norm, False, rotation), lists)
    index = spark.sparkContext.broadcast((rotation, norm, centres))  # MOST_LISTS centres at most

    def to_list(batches):
        rotation, norm, centres = index.value
        for b in batches:
            if not b.num_rows:
                continue
            r = _augmented(_matrix(b.column(1)), norm, False, rotation)
            near = np.argmin((centres * centres).sum(1) - 2 * r @ centres.T, axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(list(r), pa.list_(pa.float64())), pa.array(near.astype(np.int32))],
                names=["id", "v", "r", "list"])

    vectors = materialize(rows.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(
        to_list, "id long, v array<double>, r array<double>, list int"))
    held = np.zeros(len(centres), np.int64)
    for row in vectors.groupBy("list").count().collect():  # one row per list
        held[row["list"]] = row["count"]
    probes = max(1, int(np.ceil(probed * len(centres))))

    def to_probes(batches):
        rotation, norm, centres = index.value
        for b in batches:
            if not b.num_rows:
                continue
            r = _augmented(_matrix(b.column(1)), norm, True, rotation)
            order = np.argsort((centres * centres).sum(1) - 2 * r @ centres.T, axis=1, kind="stable")
            enough = np.cumsum(held[order], axis=1) > top  # the own row may be among them
            upto = np.maximum(probes, np.where(enough.any(1), enough.argmax(1) + 1, len(centres)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(list(r), pa.list_(pa.float64())),
                 pa.array([o[:u].astype(np.int32) for o, u in zip(order, upto, strict=True)], pa.list_(pa.int32()))],
                names=["id", "v", "r", "lists"])

    asked = rows.filter(F.expr(query_filter.replace(id_col, "id"))).select(F.col("id").cast("long").alias("id"), "v")
    queries = materialize(asked.dropDuplicates(["id"]).mapInArrow(
        to_probes, "id long, v array<double>, r array<double>, lists array<int>"))
    pieces = F.element_at(F.array(*[F.lit(int(max(1, -(-h // PIECE)))) for h in held]), F.col("list") + 1)

    def probe(part: DataFrame) -> DataFrame:
        """``part``: id, v, r, radius, list, one row per query and list."""
        blocks = np.ones(len(centres), np.int64)
        for row in part.groupBy("list").count().collect():  # one row per list
            blocks[row["list"]] = -(-row["count"] // QUERIES)
        n_blocks = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("list") + 1)
        left = (part.withColumn("block", F.pmod(F.xxhash64("id"), n_blocks))
                .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), (pieces - 1).cast("long")))))
        right = (vectors.withColumn("piece", F.pmod(F.xxhash64("id", F.lit(1)), pieces))
                 .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (n_blocks - 1).cast("long")))))
        keys = ["list", "piece", "block"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_probe(top), schema)

    first = probe(queries.select("id", "v", "r", F.lit(float("inf")).alias("radius"), F.col("lists")[0].alias("list")))
    first = materialize(first)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    limit = (first.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") == top)
             .select(F.col("query_id").alias("id"), F.col("score").alias("worst")))
    # squared distance of the worst of the first list: |q|^2 + M^2 - 2 q.x
    norm_q = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rest = (queries.join(limit, "id", "left")
            .withColumn("radius", F.coalesce(norm_q + F.lit(norm * norm) - 2 * F.col("worst"), F.lit(float("inf"))))
            .withColumn("list", F.explode(F.slice("lists", 2, len(centres))))
            .select("id", "v", "r", "radius", "list"))
    found = first.unionByName(probe(materialize(rest)))
    return (found.withColumn("rank", F.row_number().over(ranked).cast("int")).filter(F.col("rank") <= top)
            .select("query_id", "rank", "vec_id", "score"))
