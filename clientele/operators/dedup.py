"""Same-person merge of member records.

C11: within one name, records in (No., row) order join the first open
cluster whose birth date and address do not conflict (null is compatible); a
cluster adopts the fields it was missing.

Records with the same *signature* (birth date, address) always end in the same
cluster, so the work is on distinct signatures.  Most of them need no scan:

* A signature without either field fits every cluster, so it belongs to the
  first one of its name.
* A full signature fits its own cluster or an open one of its date or of its
  address, which only a *half* signature (one field missing) can have opened.
* If a name has halves of one kind only, a half belongs to the earliest full
  signature of its field: a ``groupBy`` on (name, field), at any size.
* If it has both kinds, a half without address can also take the earliest open
  cluster without date, and the other way round.  Only this is a sequence.  Its
  events are the halves, one for each distinct field, and the full signatures
  that can close one (the earliest of a half's field); they stream through a
  sorted partition, and the state of a name is its open halves.
* Every other full signature joins the pair of halves with its two fields, or is
  a person of its own: one join.

Rows without a name are persons of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.functions.text import blank_to_null, strip_ws
from clientele.session import checkpoint_once

YES_NO_COLUMNS = ["delivery", "donasi", "reward", "reward_deposit", "jual_atas_nama_sendiri",
                  "jual_bawah_harga", "officer_check"]


def record_order(no: str, row_id: str) -> Column:
    """File order within a name: by number, rows without one last, then by row."""
    return F.struct(F.col(no).isNull().alias("missing"), F.col(no).alias("no"), F.col(row_id).alias("row"))


def _signatures(named: DataFrame) -> DataFrame:
    """The distinct signatures (name, bd, ad), with t, the place of the first
    record of each, key, that record's row id, and of its name: whether it has
    halves with a date (``dated``) and with an address (``placed``), and the row id
    of the first signature that holds a field."""
    sig = (named.groupBy(F.col("_name").alias("name"), F.col("_bd").alias("bd"), F.col("_ad").alias("ad"))
           .agg(F.min("_ord").alias("t")))
    b, a = F.col("bd").isNotNull(), F.col("ad").isNotNull()
    names = sig.groupBy("name").agg(F.max(b & ~a).alias("dated"), F.max(a & ~b).alias("placed"),
                                    F.min(F.when(a | b, F.col("t")))["row"].alias("first_key"))
    return checkpoint_once(sig.join(names, "name").withColumn("key", F.col("t.row")))


class _Name:
    """The open clusters of one name, in the order in which they began."""

    def __init__(self):
        self.open: dict[str, dict[str, tuple[int, object]]] = {"bd": {}, "ad": {}}  # field -> value -> (place, root)
        self.first: dict[str, dict[str, tuple[int, object]]] = {"bd": {}, "ad": {}}  # earliest cluster of a closed field
        self.pair: dict[tuple[str, str], object] = {}  # (bd, ad) of two halves that met -> root
        self.n = 0

    def half(self, field: str, value: str, key) -> object:
        """Place a half signature that has ``field``; returns its root."""
        other = "ad" if field == "bd" else "bd"
        known = self.first[field].pop(value, None)
        waiting = next(iter(self.open[other].items()), None)  # the earliest open cluster without this field
        if waiting and (known is None or waiting[1][0] < known[0]):
            del self.open[other][waiting[0]]
            self.pair[(value, waiting[0]) if field == "bd" else (waiting[0], value)] = waiting[1][1]
            return waiting[1][1]
        if known:
            return known[1]
        self.n += 1
        self.open[field][value] = (self.n, key)
        return key

    def full(self, bd: str, ad: str, key) -> object:
        """Place a full signature; returns its root."""
        found = self.open["bd"].pop(bd, None) or self.open["ad"].pop(ad, None)
        if found is None and (bd, ad) in self.pair:
            return self.pair[bd, ad]
        if found is None:
            self.n += 1
            found = (self.n, key)
        for field, value in (("bd", bd), ("ad", ad)):
            self.first[field][value] = min(found, self.first[field].get(value, found), key=lambda x: x[0])
        return found[1]


def _fold(events: DataFrame) -> DataFrame:
    """(name, bd, ad, key, root, met): the roots of the signatures of names with
    both kinds of halves; ``met`` tells that two halves met in (bd, ad)."""
    schema = events.select("name", "bd", "ad", "key", F.col("key").alias("root")).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", met boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state, last = None, _Name(), None
        for batch in batches:
            keys = batch.column(3)
            out: list[tuple] = []
            for nm, bd, ad, key in zip(*(c.to_pylist() for c in batch.columns[:4]), strict=True):
                if nm != name:
                    name, state = nm, _Name()
                elif key == last:  # a full signature that is the earliest of both its fields comes twice
                    continue
                last = key
                if bd is None or ad is None:
                    pairs = len(state.pair)
                    root = state.half("ad" if bd is None else "bd", ad if bd is None else bd, key)
                    if len(state.pair) > pairs:
                        out.append((nm, *next(reversed(state.pair)), None, root, True))
                else:
                    root = state.full(bd, ad, key)
                out.append((nm, bd, ad, key, root, False))
            types = [pa.string(), pa.string(), pa.string(), keys.type, keys.type, pa.bool_()]
            columns = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                             names=["name", "bd", "ad", "key", "root", "met"])

    return (events.select("name", "bd", "ad", "key", "t").repartition("name").sortWithinPartitions("name", "t")
            .select("name", "bd", "ad", "key").mapInArrow(run, ddl))


def _roots(sig: DataFrame) -> DataFrame:
    """``sig`` with the root of every signature: the key of the person's first one with a field."""
    both = F.col("bd").isNotNull() & F.col("ad").isNotNull()
    side = lambda name, c: F.struct(F.lit(name).alias("side"), F.col(c).alias("value"))
    # the earliest full signature of each field, where its name has halves
    firsts = (sig.where(both & (F.col("dated") | F.col("placed")))
              .withColumn("f", F.explode(F.array(side("bd", "bd"), side("ad", "ad"))))
              .groupBy("name", "f.side", "f.value").agg(F.min(F.struct("t", "bd", "ad", "key")).alias("e")))
    halves = (sig.where(F.col("bd").isNotNull() != F.col("ad").isNotNull())
              .withColumn("side", F.when(F.col("bd").isNotNull(), "bd").otherwise("ad")).withColumn("value", F.coalesce("bd", "ad"))
              .withColumn("mixed", F.col("dated") & F.col("placed"))
              .select("name", "side", "value", "mixed", F.struct("t", "bd", "ad", "key").alias("h"))
              .join(firsts, ["name", "side", "value"], "left"))
    # halves of one kind: one person with that full signature
    root = F.least("h.t", "e.t")["row"]
    alone = halves.where("NOT mixed AND e IS NOT NULL").select(F.explode(F.array("h.key", "e.key")).alias("key"), root.alias("root"))
    events = (halves.where("mixed").select("name", F.explode(F.array("h", "e")).alias("x")).where("x IS NOT NULL")
              .select("name", "x.bd", "x.ad", "x.key", "x.t"))
    folded = checkpoint_once(_fold(events))
    known = alone.unionByName(folded.where("NOT met").select("key", "root"))
    met = folded.where("met").select("name", "bd", "ad", F.col("root").alias("pair"))
    empty = F.col("bd").isNull() & F.col("ad").isNull()
    return (sig.join(known, "key", "left").join(met, ["name", "bd", "ad"], "left")
            .withColumn("root", F.when(empty, F.coalesce("first_key", "key")).otherwise(F.coalesce("root", "pair", "key"))))


def resolve_persons(df: DataFrame, *, name: str = "name", no: str = "no", birth_date: str = "birth_date",
                    address: str = "address", row_id: str | None = None) -> DataFrame:
    """Add ``person_id``, the row id of the person's earliest record that
    holds a birth date or an address (of the earliest record if none does).

    ``row_id`` names a unique column; without one rows are numbered first, and
    the frame is checkpointed so that the numbers hold.  Rows without a name
    are persons of their own."""
    recs = df
    if row_id is None:
        row_id = "_row"
        recs = checkpoint_once(df.withColumn(row_id, F.monotonically_increasing_id()))
    bd = blank_to_null(F.col(birth_date).cast("string"))
    ad = F.lower(strip_ws(blank_to_null(F.col(address).cast("string"))))
    recs = (recs.withColumn("_name", F.col(name).cast("string")).withColumn("_bd", bd).withColumn("_ad", ad)
                .withColumn("_ord", record_order(no, row_id)))
    named, unnamed = recs.where(F.col("_name").isNotNull()), recs.where(F.col("_name").isNull())
    persons = _roots(_signatures(named)).select(
        F.col("name").alias("_name"), F.coalesce("bd", F.lit("")).alias("_b"), F.coalesce("ad", F.lit("")).alias("_a"),
        F.col("root").alias("person_id"))
    # blank fields are null, so '' stands for null here; a hot signature is one row on the other side
    keyed = (named.withColumn("_b", F.coalesce("_bd", F.lit(""))).withColumn("_a", F.coalesce("_ad", F.lit("")))
             .join(persons, ["_name", "_b", "_a"]))
    cols = [*df.columns, "person_id"]
    return keyed.select(*cols).unionByName(unnamed.withColumn("person_id", F.col(row_id)).select(*cols))


def fold_bounds(df: DataFrame, *, name: str = "name", birth_date: str = "birth_date",
                address: str = "address") -> DataFrame:
    """Names, and for the largest name its records and distinct signatures.  One row."""
    bd = blank_to_null(F.col(birth_date).cast("string"))
    ad = F.lower(strip_ws(blank_to_null(F.col(address).cast("string"))))
    per_name = (df.where(F.col(name).isNotNull())
                  .groupBy(name).agg(F.count(F.lit(1)).alias("records"),
                                     F.count_distinct(F.struct(bd.alias("b"), ad.alias("a"))).alias("signatures")))
    return per_name.agg(F.count(F.lit(1)).alias("n_names"), F.max("records").alias("max_records"),
                        F.max("signatures").alias("max_signatures"))


def first_valid(c: str, order: Column) -> Column:
    """A5: first non-blank value in order, else first non-null, else null.  A row
    whose order is null comes last, it is not left out."""
    v = F.col(c)
    place = F.struct(order.isNull().alias("missing"), order.alias("order"))
    nonblank = F.when(v.isNotNull() & (strip_ws(v.cast("string")) != ""), place)
    nonnull = F.when(v.isNotNull(), place)
    return F.coalesce(F.min_by(v, nonblank), F.min_by(v, nonnull))


def merge_yes_no(c: str) -> Column:
    """All null -> null; any 'YES' (case/space-insensitive) -> 'Yes'; else 'No'."""
    v = F.upper(strip_ws(F.col(c).cast("string")))
    return (F.when(F.count(c) == 0, F.lit(None).cast("string"))
             .when(F.max(F.when(v == "YES", 1)) == 1, F.lit("Yes")).otherwise(F.lit("No")))


def merge_persons(resolved: DataFrame, *, no: str = "no", row_id: str | None = None,
                  yes_no: list[str] | None = None) -> DataFrame:
    """One row per person; yes/no columns merged by A6, every other column
    by A5 in (No., row) order; columns keep the input order.  ``row_id`` decides
    between records of one number; without it the values themselves do."""
    yn = [c for c in (yes_no if yes_no is not None else YES_NO_COLUMNS) if c in resolved.columns]
    aggs = []
    for c in resolved.columns:
        if c == "person_id":
            continue
        order = record_order(no, row_id or c)
        aggs.append((merge_yes_no(c) if c in yn else first_valid(c, order)).alias(c))
    cols = [c for c in resolved.columns if c != "person_id"]
    return resolved.groupBy("person_id").agg(*aggs).select("person_id", *cols)
