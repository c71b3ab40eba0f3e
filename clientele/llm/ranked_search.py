"""Ranked lexical search for many items at once, sharing common subexpressions.

1. Items are cut into blocks of a bounded number of (item, term) rows.  For
   each block one pass over the texts writes the postings of its terms: a row
   per document with its length and the terms that it shares with the block.
2. Shared term sets are mined among the items of the block: terms that occur
   equally often in exactly the same items form one set, and items that begin
   with the same sets, the most widely shared ones first, share those
   beginnings.  Sets, beginnings and items are the nodes of a graph.
3. Document by document the accumulator of each set is filled once, that of a
   beginning is that of the shorter beginning plus its own sets, and an item
   reads the beginning it ends in.  No term is summed twice for two items that
   share it there.
4. A task keeps the best documents of each item; they are ranked in two steps,
   first within parts of an item.

Counts, lengths and frequencies cover all documents.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm import textops
from clientele.llm.common import bound_batches, materialize

BEST = 10
#: (item, term) rows of a block, on average; what goes to all tasks is in proportion to it.
BLOCK_ROWS = 1 << 17
#: Entries of a task's accumulators (8 bytes each): documents of a step times nodes.
ENTRIES = 1 << 21
#: Parts of an item in the first step of its ranking.
PARTS = 32


def _terms(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of a chunk of texts in order, and for each text the
    index of its first.  Terms are runs of ASCII letters, digits and all that is
    not ASCII; only A-Z are lower-cased."""
    starts, ends = textops.runs(textops.LETTER[data], bounds)
    return textops.span_hash(textops.prefix_hash(textops.LOWER[data]), starts, ends), np.searchsorted(starts, bounds)


def item_terms(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, term, times): the terms of each item, written."""
    kind = items.schema[item_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, data, bounds in textops.chunks(batch.column(1)):
                terms, first = _terms(data, bounds)
                at = np.repeat(np.arange(lo, lo + len(bounds) - 1), np.diff(first))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(terms.view(np.int64))],
                                                 names=["item", "term"])

    return materialize(items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
                       .mapInArrow(run, f"item {kind}, term long").groupBy("item", "term").agg(F.count(F.lit(1)).alias("times")))


def postings(docs: DataFrame, vocabulary: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, terms, tf) of the documents with a term, written: n counts all
    terms, terms are the places in ``vocabulary`` (sorted hashes) of those found there."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # BLOCK_ROWS entries or so

    def run(batches):
        known = shared.value
        for batch in batches:
            for lo, data, bounds in textops.chunks(batch.column(1)):
                terms, first = _terms(data, bounds)
                n = np.diff(first)
                at = np.minimum(np.searchsorted(known, terms), max(0, len(known) - 1))
                hit = known[at] == terms if len(known) else np.zeros(len(terms), bool)
                doc = np.repeat(np.arange(len(n)), n)[hit]
                cell, tf = np.unique(doc * len(known) + at[hit], return_counts=True)
                ends = np.searchsorted(cell, np.arange(len(n) + 1) * len(known))
                place = pa.array((cell % max(1, len(known))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(n)), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), place),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tf.astype(np.int64)))],
                    names=["id", "n", "terms", "tf"]).filter(pa.array(n > 0))

    return materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
                       .mapInArrow(run, f"id {kind}, n long, terms array<int>, tf array<long>"))


@dataclass
class Sharing:
    """The graph that the items of a block share.

    term[k] counts times[k] times in set[k]; a node holds the sets sets[node]
    and all that its parent holds (-1: none); nodes stand after their parents.
    Item k ends in node ends[k]."""
    term: np.ndarray
    times: np.ndarray
    set: np.ndarray
    n_sets: int
    parents: list[int]
    sets: list[list[int]]
    ends: list[int]


def mine(item: np.ndarray, term: np.ndarray, times: np.ndarray, n_items: int) -> Sharing:
    """Shared sets and beginnings of the items, from rows (item, term, times)."""
    holders: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, t, m in sorted(zip(item.tolist(), term.tolist(), times.tolist(), strict=True)):
        holders[t, m].append(i)
    alike: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
    for symbol, held in holders.items():
        alike[tuple(held)].append(symbol)
    order = sorted(alike, key=lambda held: (-len(held), held))  # the most widely shared sets first
    members = [(t, m, k) for k, held in enumerate(order) for t, m in alike[held]]
    chains: list[list[int]] = [[] for _ in range(n_items)]
    for k, held in enumerate(order):
        for i in held:
            chains[i].append(k)

    # a compressed tree of the chains: depth, parent and last set of each node
    parent, begin, end, chain_of = [-1], [0], [0], [[]]
    ends, path, before = [0] * n_items, [0], []
    for i in sorted(range(n_items), key=lambda i: chains[i]):
        chain = chains[i]
        same = next((k for k, (a, b) in enumerate(zip(chain, before, strict=False)) if a != b), min(len(chain), len(before)))
        child = None
        while end[path[-1]] > same:
            child = path.pop()
        if end[path[-1]] < same:  # the last child is split where the two chains part
            parent.append(path[-1])
            begin.append(end[path[-1]])
            end.append(same)
            chain_of.append(chain)
            parent[child], begin[child] = len(parent) - 1, same
            path.append(len(parent) - 1)
        if len(chain) > same:
            parent.append(path[-1])
            begin.append(same)
            end.append(len(chain))
            chain_of.append(chain)
            path.append(len(parent) - 1)
        ends[i], before = path[-1], chain
    nodes = sorted(range(len(parent)), key=lambda v: end[v])  # a parent ends before its children
    place = {v: k for k, v in enumerate(nodes)}
    columns = np.array(members, np.int64).reshape(-1, 3)
    return Sharing(columns[:, 0], columns[:, 1], columns[:, 2], len(order),
                   [place.get(parent[v], -1) for v in nodes], [chain_of[v][begin[v]:end[v]] for v in nodes],
                   [place[v] for v in ends])


def _shares(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each document: 25 + (75 * n * n_docs) div n_terms."""
    if len(n) and int(n.max()) * 75 * n_docs >= 1 << 63:
        n = n.astype(object)
    return (25 + 75 * n * n_docs // n_terms).astype(np.int64)


def accumulate(graph: Sharing, by_term: tuple[np.ndarray, np.ndarray, np.ndarray], doc: np.ndarray, term: np.ndarray,
               part: np.ndarray, n_docs: int) -> np.ndarray:
    """Scores (items x documents): ``part`` is what ``term`` adds to ``doc``.
    ``by_term`` = sets and times ordered by term, and where each term begins."""
    sets, times, first = by_term
    many = first[term + 1] - first[term]
    at = np.repeat(first[term], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    filled = np.zeros((graph.n_sets, n_docs), np.int64)
    np.add.at(filled, (sets[at], np.repeat(doc, many)), np.repeat(part, many) * times[at])
    held = np.zeros((len(graph.parents), n_docs), np.int64)
    for node, (parent, own) in enumerate(zip(graph.parents, graph.sets, strict=True)):
        if own:
            filled[own].sum(0, out=held[node])
        if parent >= 0:
            held[node] += held[parent]
    return held[graph.ends]


def _best(item, score, missing, ids, k: int) -> np.ndarray:
    """Places of the k best rows of each item, those of equal score by id, rows without id last."""
    order = np.lexsort((ids, missing, -score, item))
    item = item[order]
    begin = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    rank = np.arange(len(order)) - np.repeat(begin, np.diff([*begin, len(order)]))
    return order[rank < k]


def _search_block(docs: DataFrame, rows: pa.Table, best: int, id_col: str, text_col: str, item_kind: str) -> DataFrame:
    """(item, doc, score): the best documents of each task for the items of a block."""
    spark = docs.sparkSession
    names = rows.column("item").combine_chunks().dictionary_encode("encode")
    vocabulary, term = np.unique(rows.column("term").to_numpy().view(np.uint64), return_inverse=True)
    graph = mine(names.indices.to_numpy(), term, rows.column("times").to_numpy(), len(names.dictionary))
    held = postings(docs, vocabulary, id_col, text_col)
    n_docs, n_terms = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    counted = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df[counted.column("term").to_numpy()] = counted.column("df").to_numpy()  # a row per term of the block at most
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    order = np.argsort(graph.term, kind="stable")
    by_term = graph.set[order], graph.times[order], np.searchsorted(graph.term[order], np.arange(len(vocabulary) + 1))
    shared = spark.sparkContext.broadcast((graph, by_term, weight, names.dictionary))  # in proportion to BLOCK_ROWS
    step = max(1, ENTRIES // max(1, graph.n_sets + 2 * len(graph.parents)))

    def run(batches):
        graph, by_term, weight, items = shared.value
        least = np.ones(len(items), np.int64)  # scores above 0, and not below the best so far
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                ids, n = part.column(0), part.column(1).to_numpy()
                counts = part.column(2).value_lengths().to_numpy()
                term, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                doc = np.repeat(np.arange(len(n)), counts)
                m = _shares(n, n_docs, n_terms)[doc]
                scores = accumulate(graph, by_term, doc, term, weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m)), len(n))
                item, at = np.nonzero(scores >= least[:, None])
                missing = ids.is_null().to_numpy(zero_copy_only=False)
                values = ids.fill_null(0).to_numpy()
                found = [np.concatenate(x) for x in zip(found, (item, scores[item, at], missing[at], values[at]), strict=True)]
                if len(found[0]) > 4 * best * len(items):
                    kept = _best(*found, best)
                    found = [x[kept] for x in found]
                    full = np.bincount(found[0], minlength=len(items)) >= best
                    lowest = np.full(len(items), np.iinfo(np.int64).max)
                    np.minimum.at(lowest, found[0], found[1])
                    least = np.where(full, lowest, least)
        kept = _best(*found, best) if len(found[0]) else np.zeros(0, np.int64)
        item, score, missing, ids = (x[kept] for x in found)
        yield pa.RecordBatch.from_arrays([items.take(pa.array(item)), pa.array(ids, mask=missing), pa.array(score)],
                                         names=["item", "doc", "score"])

    return held.select(F.col("id").cast("long").alias("id"), "n", "terms", "tf").mapInArrow(
        run, f"item {item_kind}, doc long, score long")


def ranked_documents(docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text",
                     item_col: str = "item_id", item_text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``best`` documents of each item: ``item_col``, rank, ``id_col``, score.

    Scores are those of the contract (README, op13), from integers only but
    for the logarithm.  Documents and items whose text is null, empty or
    without a term find nothing.  Rows that repeat an item id are one item with
    the terms of all; items without id are one.  Each row of documents counts
    and ranks by itself, also if its id repeats; ids are whole numbers, equal
    scores stand by ascending id, rows without id last.  An empty table on
    either side gives an empty result; other columns are not read."""
    bound_batches(docs.sparkSession)
    item_kind = items.schema[item_col].dataType.simpleString()
    terms = item_terms(items, item_col, item_text_col)
    n_rows = terms.count()
    blocks = max(1, math.ceil(n_rows / block_rows))
    found = None
    for k in range(blocks):
        rows = terms.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).toArrow()
        if rows.num_rows:
            part = _search_block(docs, rows, best, id_col, text_col, item_kind)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], f"item {item_kind}, doc long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc")]
    parts = Window.partitionBy("item", F.pmod(F.xxhash64("doc", "score"), F.lit(PARTS))).orderBy(*order)
    whole = Window.partitionBy("item").orderBy(*order)
    return (found.withColumn("place", F.row_number().over(parts)).filter(F.col("place") <= best)
            .withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= best)
            .select(F.col("item").alias(item_col), "rank", F.col("doc").cast(docs.schema[id_col].dataType).alias(id_col), "score"))


ORACLE = r"""
WITH t AS (SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
           FROM (SELECT row_number() OVER () AS row, doc_id, text FROM documents)),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
i AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY 1, 2),
d AS (SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY 1),
g AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM d),
m AS (SELECT row, doc_id, 25 + (75 * n * big_n) // big_l AS m FROM d, g),
p AS (SELECT row, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM i) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, big_n),
s AS (SELECT item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM i JOIN p USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY 1, 2, 3),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
