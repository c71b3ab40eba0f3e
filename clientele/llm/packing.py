"""Best-fit packing of token sequences by hierarchical residual packing.

1. One pass tokenises the texts and cuts only documents longer than a
   sequence; it writes a narrow table of pieces (no text, no ids).
2. Pieces are spread over many partitions and each packs its own by best fit
   decreasing.  Bins that are full, but for a small slack, are final.
3. The underfull bins are items of the next round, with a fraction of the
   partitions, and so up a tree until the items fit one partition.  A
   bin carries its pieces (at most one per token of its capacity).

A partition passes on its emptiest bins, at most ``items_per_task / fan_in``
of them, and closes the rest, so every round has at most 1 / ``fan_in`` of the
partitions of the one before, no task ever packs more than about
``items_per_task`` items, and nothing is left out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm import textops
from clientele.llm.common import materialize

CAPACITY = 4096
END_ID = 1
#: Items that one task packs, the factor by which each round narrows, and tokens by which a full bin may fall short.
ITEMS_PER_TASK, FAN_IN, SLACK = 20_000, 8, 8


#: Kinds of bytes: white space, letters (ASCII, and the bytes of any other character), signs.
_LETTER = textops.LETTER.copy()
_LETTER[48:58] = False
#: Bytes that make a word irregular: controls, digits, the apostrophe (it starts a suffix such as 's), and lead
#: bytes of characters other than U+00C0 to U+017F.  Three of those are irregular too: see _irregular.
_IRREGULAR = np.zeros(256, bool)
_IRREGULAR[[*range(9), *range(14, 32), 39, *range(48, 58), 127, *range(0xC0, 0xC3), *range(0xC6, 256)]] = True


def _irregular(data: np.ndarray) -> np.ndarray:
    bad = _IRREGULAR[data]
    pair = data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]
    # the signs U+00D7 and U+00F7, U+0130 (two characters in lower case), and the opening of a special token
    bad[:-1] |= (pair == 0xC397) | (pair == 0xC3B7) | (pair == 0xC4B0) | (pair == 0x3C7C)
    return bad


class WordIds:
    """Token ids of texts by a byte-level BPE tokenizer that handles every
    white-space word on its own (white space is dropped and joins nothing).

    A regular word is runs of letters and of signs, each a unit that the
    tokenizer also handles on its own.  Units are found and looked up by hash
    for many texts at once.  Unseen ones are put in lower case and go many at
    a time through the same BPE model without the normaliser and splitter,
    which do nothing more to them; the ids that end a word tell them apart.
    Any other word is a unit that goes through the whole tokenizer.  The table
    of units is bounded and starts anew when full."""

    def __init__(self, path: str, limit: int = 400_000):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.limit = limit
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        for token, i in self.whole.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        #: Sorted hashes of the units and, for each, where its ids are.
        self.keys, self.begin, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _add(self, keys: np.ndarray, regular: list[str], other: list[str]) -> None:
        """Append the ids of unseen units to the table; keys: of the regular ones, then of the others."""
        lines = [" ".join(regular[i:i + 1000]) for i in range(0, len(regular), 1000)]
        ids = np.array([i for e in self.bare.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids],
                       np.uint32)
        cut = np.flatnonzero(self.ends[ids]) + 1
        if len(cut) != len(regular):
            raise ValueError("the tokenizer does not end every word with an end-of-word id")
        more = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(other, add_special_tokens=False)]
        length = np.concatenate([np.diff(cut, prepend=0), np.array([len(x) for x in more], np.int64)])
        begin = len(self.ids) + np.cumsum(length) - length
        self.ids = np.concatenate([self.ids, ids, *more])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.begin = np.concatenate([self.begin, begin])[order]
        self.length = np.concatenate([self.length, length])[order]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a chunk (see textops.chunks), and the bounds of each text's ids."""
        if len(self.keys) > self.limit:
            self.clear()
        kind = np.where(_LETTER[data], np.uint8(1), np.uint8(2))
        kind[textops.SPACE[data]] = 0
        starts, ends = textops.runs(kind != 0, bounds)
        odd = np.zeros(0, bool)
        if len(starts):
            odd = np.logical_or.reduceat(_irregular(data), starts)
            inside = np.zeros(len(data) + 1, np.int8)
            inside[starts[odd]] = 1
            inside[ends[odd]] -= 1
            kind[np.cumsum(inside[:-1], dtype=np.int8) > 0] = 3
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[bounds] = True
        edges = np.flatnonzero(edge)
        first, last = edges[:-1], edges[1:]
        used = kind[first] != 0 if len(first) else np.zeros(0, bool)
        first, last = first[used], last[used]
        whole = kind[first] == 3
        hashes = textops.span_hash(textops.prefix_hash(textops.LOWER[data]), first, last)
        if whole.any():  # case and signs matter to these
            hashes[whole] = ~textops.span_hash(textops.prefix_hash(data), first[whole], last[whole])
        seen, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, seen)
        unseen = np.ones(len(seen), bool)
        inside = at < len(self.keys)
        unseen[inside] = self.keys[at[inside]] != seen[inside]
        if unseen.any():
            new = np.flatnonzero(unseen)
            new = new[np.argsort(whole[example[new]], kind="stable")]
            raw = data.tobytes()
            text = [raw[a:b].decode() for a, b in zip(first[example[new]].tolist(), last[example[new]].tolist(), strict=True)]
            n = len(new) - int(whole[example[new]].sum())
            self._add(seen[new], [t.lower() for t in text[:n]], text[n:])
            at = np.searchsorted(self.keys, seen)
        slot = at[which]
        lengths = self.length[slot]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.arange(upto[-1]) + np.repeat(self.begin[slot] - upto[:-1], lengths)]
        return ids, upto[np.searchsorted(first, bounds)]


def shared_encoder(path: str) -> WordIds:
    """The encoder of this process: a Python worker keeps it for later tasks."""
    import sys
    import types
    store = sys.modules.setdefault("_word_ids_of_process", types.ModuleType("_word_ids_of_process")).__dict__
    if path not in store:
        store[path] = WordIds(path)
    return store[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): every document's ids and then
    ``end_id``, cut into pieces of ``capacity`` if longer."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        encoder, end = shared_encoder(tokenizer_path), np.array(end_id, "<u4")
        for batch in batches:
            out = {"at": [], "piece": [], "start": [], "length": [], "crc": []}
            for lo, data, bounds in textops.chunks(batch.column(1)):
                ids, ends = encoder.encode(data, bounds)
                ids = ids.astype("<u4")
                for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True), lo):
                    own = np.append(ids[a:b], end)
                    for piece, start in enumerate(range(0, len(own), capacity)):
                        part = own[start:start + capacity]
                        for name, value in zip(out, (i, piece, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                            out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out["at"], pa.int64())), pa.array(out["piece"], pa.int32()),
                 pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64())],
                names=["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        cut, f"id {id_type}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing: bins as lists of item numbers."""
    bins: list[list[int]] = []
    open_bins: list[tuple[int, int]] = []  # (room left, bin), ordered
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(open_bins, (sizes[i], -1))
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > sizes[i]:
            insort(open_bins, (room - sizes[i], b))
    return bins


def _pack_partition(capacity: int, slack: int, carry: int):
    """Pack a partition's items.  Items and bins are rows (fill, members): the
    pieces an item holds.  The emptiest bins, at most ``carry``, are not final."""
    def pack(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        batches = [b for b in batches if b.num_rows]
        if not batches:  # a partition that no item fell into
            return
        items = pa.Table.from_batches(batches)
        items = items.combine_chunks()
        bins = best_fit(items.column("fill").to_pylist(), capacity)
        order = pa.array(np.concatenate([np.array(b, np.int64) for b in bins]))
        taken = items.take(order).combine_chunks()
        fills = np.add.reduceat(taken.column("fill").to_numpy(), np.cumsum([0, *map(len, bins)])[:-1])
        members = pa.concat_arrays(taken.column("members").chunks)
        # members of the items of a bin follow each other: only the list bounds change
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(members).to_numpy(zero_copy_only=False))])
        per_bin = bounds[np.cumsum([0, *map(len, bins)])]
        merged = pa.ListArray.from_arrays(pa.array(per_bin, pa.int32()), members.flatten())
        final = fills >= capacity - slack
        final[np.argsort(fills, kind="stable")[carry:]] = True
        yield pa.RecordBatch.from_arrays(
            [pa.array(fills), merged, pa.array(final),
             pa.array([(part << 33) + b for b in range(len(bins))], pa.int64())],
            names=["fill", "members", "final", "bin"])
    return pack


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   items_per_task: int = ITEMS_PER_TASK, fan_in: int = FAN_IN, slack: int = SLACK,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32,
    sequence_id, offset.

    A null or empty text is the end id alone.  Only documents longer than
    ``capacity`` tokens are cut; their last piece may be shorter.  Rows that
    repeat an id are packed as documents of their own.  Offsets are gapless
    from 0 in each sequence.  An empty table gives an empty result; other
    columns are not read."""
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    member = F.struct("id", "piece", "start", "length", "ids_crc32")
    items = pieces.select(F.col("length").alias("fill"), F.array(member).alias("members"))
    kind = items.schema["members"].dataType.simpleString()
    count, level, done = items.count(), 0, []
    while True:
        parts = max(1, -(-count // items_per_task))
        last = parts == 1
        spread = items.repartition(parts, F.xxhash64("members", F.lit(level)))
        packed = materialize(spread.mapInArrow(
            _pack_partition(capacity, slack, 0 if last else max(1, items_per_task // fan_in)), f"fill long, members {kind}, final boolean, bin long"))
        done.append(packed.filter("final").select(
            (F.col("bin") * 64 + level).alias("sequence_id"), "members"))
        if last:
            break
        items = packed.filter("NOT final").select("fill", "members")
        count = items.count()
        level += 1
    sequences = done[0]
    for more in done[1:]:
        sequences = sequences.unionByName(more)
    before = F.aggregate("members", F.array(F.lit(0).cast("long")),
                         lambda acc, m: F.concat(acc, F.array(F.element_at(acc, -1) + m["length"])))
    return (sequences.withColumn("offsets", before)
            .select("sequence_id", "offsets", F.posexplode("members").alias("pos", "m"))
            .select(F.col("m.id").alias(id_col), F.col("m.piece").alias("piece"), F.col("m.start").alias("start"),
                    F.col("m.length").alias("length"), F.col("m.ids_crc32").alias("ids_crc32"), "sequence_id",
                    F.element_at("offsets", F.col("pos") + 1).alias("offset")))
