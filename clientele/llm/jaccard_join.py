"""Exact n-gram Jaccard self-join with a token-group matrix.

A document is the set of its distinct word shingles (64-bit hashes).
Documents link when 100 * |intersection| >= percent * |union|.

1. Documents with the same word sequence are one *node*.
2. Tokens have a global order, frequent ones last.  Two linked sets share at
   least ``OVERLAP`` tokens of their prefixes (the first n - ceil(t n) +
   OVERLAP tokens), so only prefix tokens that two nodes share are kept.  Any
   order is exact; the table of frequent tokens only steers the cost.
3. Similar nodes are partitioned into groups: nodes that agree on a band of
   min-hashes are each compared with one pivot of theirs, another one for
   every band, and nodes that link form a group.  That is at most ``BANDS``
   comparisons a node, however large a group of near copies is.  Copies that
   are farther from each other than from their original rarely agree on a band;
   so the holders of a token that many groups share are compared with the one
   among them that has the fewest tokens of its own, one comparison a node and
   round.
4. The token-group matrix holds the union of each group's prefix tokens, by
   bands of set sizes.  Sets of similar size share many prefix tokens if they
   link, sets of very different size few; a node asks for a band only with those
   of its tokens behind which enough others are left, and a group answers only
   where one of its members has enough left as well.  So a token that many groups
   hold makes rows for those only that can still reach the overlap with it as
   their first common token.  Groups that answer are opened, and only those
   members are compared that share enough tokens with the node.  Pairs within a
   group are linked already and never listed.
5. Links of both steps give the components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clientele.llm import textops
from clientele.llm.common import materialize
from clientele.llm.components import connected_components

SHINGLE, PERCENT = 4, 85
#: Prefix tokens that a linked pair shares at least (one for sets of one token).
OVERLAP = 2
#: Bands of min-hashes, and min-hashes in each.
BANDS, BAND_ROWS = 8, 3
#: A token counts as frequent from FREQUENT nodes of one in SAMPLE on; the table of frequent tokens has MOST entries
#: (8 MB) at most.  It steers the order and with it the cost, never the result.
FREQUENT, SAMPLE, MOST = 3, 8, 1 << 20
#: The sizes of a band differ by this factor at most.
BAND = 1.05
#: A token that so many groups hold gives them a pivot, in ROUNDS rounds.
MANY, ROUNDS = 8, 2
#: A join side is broadcast up to so many narrow rows, and shuffled beyond.
BROADCAST_ROWS = 500_000
#: A group of equal texts is hot with more than 1 / HOT of all rows; there are fewer than HOT such groups.
HOT = 1024


def _needed(n, percent: int):
    """Smallest intersection of a set of n tokens with one that it links to."""
    return (n * percent + 99) // 100


def _prefix_size(n, percent: int):
    need = _needed(n, percent)
    return n - need + np.minimum(OVERLAP, need)


def _common(n: str, percent: int) -> Column:
    """Prefix tokens that a set of n tokens shares at least with one that it links to."""
    return F.least(F.lit(OVERLAP), F.floor((F.col(n) * percent + 99) / 100))


def _common_of_pair(n: str, m: Column, percent: int) -> Column:
    """Prefix tokens that sets of n and m tokens share at least if they link:
    their whole overlap less what can lie behind the prefix of either."""
    behind = lambda x: F.floor((x * percent + 99) / 100) - F.least(
        F.lit(OVERLAP), F.floor((x * percent + 99) / 100))
    overlap = F.floor(((F.col(n) + m) * percent + 99 + percent) / (100 + percent))
    return F.greatest(F.lit(1), overlap - F.greatest(behind(F.col(n)), behind(m)))


def _min_hash_bands(sets: list[np.ndarray]) -> np.ndarray:
    """A hash for each set and band; sets without tokens get 0."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), BANDS), np.uint64)
    full = sizes > 0
    if full.any():
        flat = np.concatenate(sets)
        at = (np.cumsum(sizes) - sizes)[full]
        odd = textops.mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        with np.errstate(over="ignore"):
            for k, factor in enumerate(odd):
                low = np.minimum.reduceat(flat * factor, at)
                out[full, k // BAND_ROWS] = textops.mix(out[full, k // BAND_ROWS] * np.uint64(31) + low)
    return out


def _sets(data: np.ndarray, bounds: np.ndarray, shingle: int):
    """Sorted distinct shingles of each text, and two order-sensitive hashes of its words."""
    hashes, first = textops.words(data, bounds)
    counts = np.diff(first)
    grams = textops.ngrams(hashes, shingle)
    place = (np.arange(len(hashes)) - np.repeat(first[:-1], counts)).astype(np.uint64)
    sums = []
    with np.errstate(over="ignore"):
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            total = np.concatenate([[np.uint64(0)], np.cumsum(
                textops.mix(hashes ^ textops.mix(place + np.uint64(salt))), dtype=np.uint64)])
            sums.append(total[first[1:]] - total[first[:-1]])
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= shingle:
            s = np.sort(grams[a:b - shingle + 1])
            new = np.ones(len(s), bool)
            new[1:] = s[1:] != s[:-1]
            sets.append(s[new])
        else:  # fewer words: the whole sequence is one shingle; no words: none
            sets.append(textops.ngrams(hashes[a:b], b - a) if b > a else hashes[:0])
    return sets, counts, sums[0], sums[1]


def _list_array(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate([*parts, np.zeros(0, np.uint64)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def _document_table(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """(id, words, fp_a, fp_b, n, low, bands): low = the lowest shingle hashes, about one and a half prefixes."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for lo, data, bounds in textops.chunks(batch.column(1)):
                sets, counts, a, b = _sets(data, bounds, shingle)
                n = np.array([len(s) for s in sets], np.int64)
                reach = np.minimum(n, _prefix_size(n, percent) * 3 // 2 + 16)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(n)), pa.array(counts.astype(np.int64)), pa.array(a.view(np.int64)),
                     pa.array(b.view(np.int64)), pa.array(n),
                     _list_array([s[:r] for s, r in zip(sets, reach.tolist(), strict=True)]),
                     _list_array(list(_min_hash_bands(sets)))],
                    names=["id", "words", "fp_a", "fp_b", "n", "low", "bands"])

    return materialize(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, words long, fp_a long, fp_b long, n long, low array<bigint>, bands array<bigint>"))


def _frequent_tokens(tokens: DataFrame) -> np.ndarray:
    """(token, df), the most frequent ones of a column ``token`` of sampled nodes."""
    rows = (tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= FREQUENT)
            .orderBy(F.desc("df"), "token").limit(MOST).toArrow())
    return np.rec.fromarrays([rows.column("token").to_numpy().view(np.uint64), rows.column("df").to_numpy()], names="token,df")


def _order(tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the frequent tokens, sorted, and the place of each in the
    order of the frequent ones (rarest first)."""
    every = np.concatenate(tables)
    token, at = np.unique(every["token"], return_inverse=True)
    df = np.zeros(len(token), np.int64)
    np.maximum.at(df, at, every["df"])
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, df))] = np.arange(len(token))
    return token, rank


def _prefix(tokens: np.ndarray, n: int, percent: int, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray | None:
    """The first tokens of a set in the global order, from its lowest hashes;
    None if those are too few to tell."""
    at = np.minimum(np.searchsorted(frequent, tokens), max(0, len(frequent) - 1))
    often = frequent[at] == tokens if len(frequent) else np.zeros(len(tokens), bool)
    size = int(_prefix_size(n, percent))
    rare = tokens[~often]
    if len(rare) >= size:
        return rare[:size]
    if len(tokens) < n:
        return None
    last = tokens[often][np.argsort(rank[at[often]], kind="stable")]
    return np.concatenate([rare, last])[:size]


def _prefix_rows(ids: pa.Array, sizes: list[int], prefixes: list[np.ndarray | None]) -> pa.RecordBatch:
    """A row for each prefix token; none for a set that is still to be read."""
    parts = [p if p is not None else np.zeros(0, np.uint64) for p in prefixes]
    counts = np.array([len(p) for p in parts], np.int64)
    at = np.repeat(np.arange(len(parts)), counts)
    token = pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64))
    place = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(at)), pa.array(np.array(sizes, np.int64)[at]), token, pa.array(place)],
        names=["node", "n", "token", "place"])


def _texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the ids (column id, distinct).  The ids are broadcast up to
    a checked number of rows; beyond it both sides are shuffled."""
    few = ids.count() <= BROADCAST_ROWS
    return (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(ids) if few else ids, "id", "left_semi"))


def _shared_prefixes(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, shingle: int,
                     percent: int) -> DataFrame:
    """(token, node, n, left, alone): prefix tokens that at least two nodes
    have, written; ``left`` counts those of the node from this one on, in the
    global order, ``alone`` its prefix tokens that no other node has."""
    spark = docs.sparkSession
    kind = nodes.schema["id"].dataType.simpleString()
    schema = f"node {kind}, n long, token long, place long"

    def prefixes(batch, order):
        low = batch.column(2)
        ends = np.cumsum([0, *pc.list_value_length(low).to_pylist()])
        flat = low.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        sizes = batch.column(1).to_pylist()
        return sizes, [_prefix(flat[a:b], n, percent, *order)
                       for a, b, n in zip(ends[:-1].tolist(), ends[1:].tolist(), sizes, strict=True)]

    def unread(nodes, shared):
        """Ids of the nodes whose lowest hashes do not tell their prefix."""
        def run(batches):
            for batch in batches:
                yield batch.select([0]).filter(pa.array([p is None for p in prefixes(batch, shared.value)[1]], pa.bool_()))
        return materialize(nodes.mapInArrow(run, f"id {kind}").distinct())

    def tokens(batches):
        for batch in batches:
            for _, data, bounds in textops.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(_sets(data, bounds, shingle)[0]).view(np.int64))], names=["token"])

    low = nodes.select("id", "n", "low")
    sampled = low.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0)
    tables = [_frequent_tokens(sampled.select(F.explode("low").alias("token")))]
    first = spark.sparkContext.broadcast(_order(tables))  # MOST entries at most
    # nodes full of frequent tokens reach beyond their lowest hashes: what is frequent among their other tokens
    full = unread(sampled, first)
    tables.append(_frequent_tokens(_texts_of(docs, full, id_col, text_col).mapInArrow(tokens, "token long")))
    shared = spark.sparkContext.broadcast(_order(tables))  # 2 * MOST entries at most

    def from_low(batches):
        for batch in batches:
            yield _prefix_rows(batch.column(0), *prefixes(batch, shared.value))

    def from_text(batches):
        for batch in batches:
            for lo, data, bounds in textops.chunks(batch.column(1)):
                sets = _sets(data, bounds, shingle)[0]
                yield _prefix_rows(batch.column(0).slice(lo, len(sets)), [len(s) for s in sets],
                                   [_prefix(s, len(s), percent, *shared.value) for s in sets])

    again = unread(low, shared)
    every = (low.mapInArrow(from_low, schema)
             .unionByName(_texts_of(docs, again, id_col, text_col).mapInArrow(from_text, schema)))
    holders = every.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token")))
    own = Window.partitionBy("node", "n")  # a part of one text
    size = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + _common("n", percent)
    return materialize(holders.filter("df > 1")
                       .withColumn("left", F.row_number().over(own.orderBy(F.desc("place"))))
                       .withColumn("alone", size - F.count(F.lit(1)).over(own)).drop("df", "place"))


def _verify(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough, written.

    The set of ``a`` travels to that of ``b`` once a pair; both come straight
    from the texts, whose ids are found as in _texts_of."""
    kind = pairs.schema["a"].dataType.simpleString()
    pairs = materialize(pairs.select("a", "b").distinct())
    few = pairs.count() <= BROADCAST_ROWS
    texts = docs.select(F.col(id_col).alias("a"), F.col(text_col).alias("text"))
    asking = texts.join(F.broadcast(pairs) if few else pairs, "a").select("a", "b", "text")
    asked = _texts_of(docs, pairs.select(F.col("b").alias("id")).distinct(), id_col, text_col)

    def read(batches):
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            for lo, data, bounds in textops.chunks(text):
                sets = _sets(data, bounds, shingle)[0]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(lo, len(sets)) for c in batch.columns[:-1]),
                     pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=[*batch.schema.names[:-1], "tokens"])

    def compare(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
                both = int((y[at] == x).sum()) if len(y) else 0
                good.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    left = asking.mapInArrow(read, f"a {kind}, b {kind}, tokens binary").withColumnRenamed("tokens", "x")
    right = asked.mapInArrow(read, f"id {kind}, tokens binary").select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    return materialize(left.join(right, "b").select("a", "b", "x", "y")
                       .mapInArrow(compare, f"a {kind}, b {kind}").distinct())


def _fits(n: str, low: str, high: str, percent: int) -> Column:
    """Whether some size from ``low`` to ``high`` can link to a set of ``n`` tokens."""
    return (F.col(high) * 100 >= F.col(n) * percent) & (F.col(low) * percent <= F.col(n) * 100)


def _pivot_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node and, for each band, a pivot of the nodes that agree with it there."""
    held = nodes.select(F.col("id").alias("a"), "n", F.posexplode("bands").alias("band", "value"))
    pivots = (held.groupBy("band", "value")
              .agg(F.min(F.struct(F.xxhash64("a", "band").alias("draw"), "a", "n")).alias("p"), F.count(F.lit(1)).alias("c"))
              .filter("c > 1").select("band", "value", F.col("p.a").alias("b"), F.col("p.n").alias("b_n")))
    return (held.join(pivots, ["band", "value"]).filter("a <> b").filter(_fits("n", "b_n", "b_n", percent))
            .select("a", "b"))


def _grouped(shared: DataFrame, links: DataFrame) -> DataFrame:
    """``shared`` with the group of each node."""
    groups = connected_components(links)
    return materialize(shared.join(groups, "node", "left")
                       .select("token", "node", "n", "left", "alone", F.coalesce("component", "node").alias("grp")))


def _band(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(BAND)).cast("int")


def _central_pairs(grouped: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each node at most one comparison, with the node of fewest own
    tokens among those of about its size that hold one of its widely held tokens."""
    kind = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int")
    held = grouped.withColumn("kind", kind)
    pivots = (held.groupBy("token", "kind")
              .agg(F.min(F.struct("alone", "node", "n", "grp")).alias("p"), F.approx_count_distinct("grp").alias("groups"))
              .filter(F.col("groups") >= MANY).select("token", "kind", "p"))
    return (held.join(pivots, ["token", "kind"]).filter(F.col("grp") != F.col("p.grp"))
            .filter(_fits("n", "p.n", "p.n", percent)).filter(F.col("left") >= _common_of_pair("n", F.col("p.n"), percent))
            .groupBy(F.col("node").alias("a")).agg(F.min("p").alias("p")).select("a", F.col("p.node").alias("b")))


def _opened_pairs(grouped: DataFrame, percent: int) -> DataFrame:
    """(a, b): a node and the members it is compared with of each group that
    its bound opens.  Of two sizes the larger asks for the smaller; within a
    band, the group with the larger id."""
    smallest = F.floor((F.col("n") * percent + 99) / 100)  # that a set of n tokens links to
    matrix = (grouped.withColumn("band", _band(F.col("n"))).groupBy("token", "band", F.col("grp").alias("other"))
              .agg(F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("left").alias("most_left")))
    own = _band(F.col("n"))
    asked = (grouped.withColumn("band", F.explode(F.sequence(_band(smallest), own)))
             .withColumn("from_n", F.greatest(smallest, F.floor(F.pow(F.lit(BAND), F.col("band")) - 1e-6).cast("long")))
             # a token can be the first common one only with enough of the node's left from it on; the nearer the
             # other set's size to the node's own, the more are needed, so an end of the band needs the fewest
             .withColumn("to_n", F.when(F.col("band") < own, F.col("n")).otherwise(F.ceil(F.pow(F.lit(BAND), F.col("band") + 1))))
             .filter(F.col("left") >= F.least(_common_of_pair("n", F.col("from_n"), percent),
                                              _common_of_pair("n", F.col("to_n"), percent)))
             .select("token", "band", "node", "n", "left", "grp", (F.col("band") == own).alias("same")))
    least = F.greatest(F.col("least_n"), smallest)  # of the members that can link
    enough = F.least("left", "most_left") >= F.least(_common_of_pair("n", least, percent), _common_of_pair("n", F.col("most_n"), percent))
    opened = materialize(asked.join(matrix, ["token", "band"])
                         .filter((F.col("grp") > F.col("other")) | (~F.col("same") & (F.col("grp") != F.col("other"))))
                         .filter(_fits("n", "least_n", "most_n", percent)).filter(enough)
                         .select("node", "other").distinct())
    # members that can reach the overlap with a common token as the first one; then all common tokens of these pairs
    members = grouped.select("token", F.col("grp").alias("other"), F.col("node").alias("b"), F.col("n").alias("b_n"),
                             F.col("left").alias("b_left"))
    asking = grouped.select("token", F.col("node").alias("a"), "n", "left").join(opened.withColumnRenamed("node", "a"), "a")
    needed = _common_of_pair("n", F.col("b_n"), percent)
    pairs = materialize(asking.join(members, ["token", "other"]).filter(_fits("n", "b_n", "b_n", percent))
                        .filter(F.least("left", "b_left") >= needed).select("a", "b", needed.alias("needed")).distinct())
    held = grouped.groupBy("node", "n").agg(F.collect_list("token").alias("tokens"))  # a prefix
    side = lambda c: held.select(F.col("node").alias(c), F.col("tokens").alias(f"{c}_tokens"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .filter(F.size(F.array_intersect("a_tokens", "b_tokens")) >= F.col("needed")).select("a", "b"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``id_col``, n_shingles, component_id.

    Words are runs of anything but ``[\\x20\\x09-\\x0D]``, A-Z in lower case.
    With fewer words than ``shingle`` the whole sequence is one shingle; an
    empty or null text has none, links with nothing and is its own component.
    component_id is the smallest id reachable by links.  Rows that repeat an
    id are one document that links wherever one of its texts does; each row
    carries the component of its own text.  A row without id takes part only
    by the other rows of its text.  An empty table gives an empty result;
    other columns are not read."""
    table = _document_table(docs, id_col, text_col, shingle, percent)
    n_rows = table.count()
    same = ["fp_a", "fp_b", "words"]
    texts = materialize(table.filter("n > 0").groupBy(*same)
                        .agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("rows")).filter("node IS NOT NULL"))
    # rows of a text that is another row's node go; they are few, or else both sides are shuffled
    first = texts.select(*same, "node")
    copies = materialize(table.select("id", *same).filter("id IS NOT NULL").join(first, same)
                         .filter("id <> node").select("id", *same).distinct())
    few = copies.count() <= BROADCAST_ROWS
    nodes = (table.filter("n > 0 AND id IS NOT NULL").join(F.broadcast(copies) if few else copies, ["id", *same],
                                                           "left_anti"))
    shared = _shared_prefixes(docs, nodes, id_col, text_col, shingle, percent)
    links = _verify(docs, _pivot_pairs(nodes, percent), id_col, text_col, shingle, percent)
    grouped = _grouped(shared, links)
    for _ in range(ROUNDS):
        new = _verify(docs, _central_pairs(grouped, percent), id_col, text_col, shingle, percent)
        if new.isEmpty():
            break
        links = links.unionByName(new)
        grouped = _grouped(shared, links)
    more = _verify(docs, _opened_pairs(grouped, percent), id_col, text_col, shingle, percent)
    components = connected_components(links.unionByName(more))

    # one row per distinct text; the hot ones, fewer than HOT, are broadcast
    found = materialize(texts.join(components, "node", "left")
                        .select(*same, "rows", F.coalesce("component", "node").alias("component_id")))
    hot = found.filter(F.col("rows") * HOT > n_rows).drop("rows")
    rest = found.filter(F.col("rows") * HOT <= n_rows).drop("rows")
    narrow = table.select("id", "n", *same).join(F.broadcast(hot), same, "left")
    done = narrow.filter("component_id IS NOT NULL OR n = 0")
    open_rows = narrow.filter("component_id IS NULL AND n > 0").drop("component_id").join(rest, same, "left")
    return done.unionByName(open_rows).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest
    id; all columns as they were.  Rows without id stay."""
    kept = (similar_components(docs, id_col, text_col, **options)
            .filter(F.col(id_col).isNull() | (F.col(id_col) == F.col("component_id")))
            .select(F.col(id_col).alias("__id")).distinct())
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__id"]), "left_semi")
