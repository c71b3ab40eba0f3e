"""The operators against brute force, SQL, round trips and held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from clientele.llm import (backoff_lm, exact_dedup, jaccard_join, line_templates, mixing, nearest, packing, queries,
                           sharding)
from clientele.llm.components import connected_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string"
LONG = " ".join(f"w{i % 977} x{i}" for i in range(6000))
ROWS = [
    (0, "One two  three\tfour five.\nsame line here\n", "en", "b", 1, "s", "t"),
    (1, "One two three four five. same line here ", "en", "b", 1, "s", "t"),
    (2, None, None, None, None, None, None),
    (3, "", "en", "a", 0, None, None),
    (4, "   \n\t ", "en", "a", 0, None, None),
    (5, LONG, "en", "é", 0, None, None),
    (6, LONG.replace("x17 ", "y17 "), "en", "b", 0, None, None),
    (7, "One two three four five. same line here ", "en", None, 1, "s", "t"),
    (7, "One two three four five. same line here ", "en", None, 1, "s", "t"),
    (8, "a a a a a", "en", "c", 1, "s", "t"),
    (9, "a a a a", "en", "c", 1, "s", "t"),
    (10, "it's <|endoftext|> Élan ΣΑΣ 3.14　中文 don't", "fr", "c", 1, "s", "t"),
    (None, "no id", "en", "c", 1, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def table(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name", ["op4_exact_dedup", "op6_mixing"])
def test_sql_twins(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df().sort_values("doc_id").reset_index(drop=True)
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    for c in got.columns:
        assert (got[c] == want[c]).all(), c


@pytest.mark.parametrize("counters", [1, 3, 1024])
def test_exact_dedup_edges(docs, counters):
    rows = exact_dedup.exact_duplicates(docs, counters=counters).collect()
    assert len(rows) == len(ROWS)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in texts(docs):
        groups[hashlib.sha256(norm(t).encode()).hexdigest()].append(i)
    for r in rows:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == min((i for i in ids if i is not None), default=None)
    kept = Counter(r["text_sha256"] for r in rows if r["kept"])
    assert set(kept) == set(groups) and set(kept.values()) == {1}
    left = exact_dedup.drop_duplicates(docs, counters=counters)
    assert left.columns == docs.columns and left.count() == len(groups)


def test_misra_gries_finds_heavy(spark):
    d = spark.createDataFrame([("hot",)] * 400 + [(f"c{i}",) for i in range(600)], "digest string").repartition(7)
    found = exact_dedup.misra_gries(d, 3)
    assert "hot" in found and len(found) <= 3


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(n, seed):
    """Chains of near copies whose similarity is about the threshold, a shared passage, short and odd texts."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 4000)}"
    passage, out = [word() for _ in range(25)], []
    for i in range(n):
        if out and rng.random() < 0.7:
            w = list(out[rng.integers(0, len(out))])
            for _ in range(rng.integers(0, 5)):
                w[rng.integers(0, len(w))] = word()
        else:
            w = [word() for _ in range(rng.integers(1, 120))]
            if rng.random() < 0.5:
                w += passage
        out.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("shingle,percent,seed", [(4, 85, 1), (5, 80, 2)])
def test_jaccard_join_brute_force(spark, monkeypatch, shingle, percent, seed):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 4)
    rows = near_copies(260, seed)
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string"),
                                          shingle=shingle, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, shingle, percent)


def test_jaccard_join_without_bands(spark, monkeypatch):
    """The matrix alone finds every link that the bands would have found."""
    monkeypatch.setattr(jaccard_join, "_pivot_pairs", lambda nodes, percent: nodes.select(
        F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    rows = near_copies(160, 5)
    got = jaccard_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 4, 85)


def test_jaccard_join_edges(docs):
    got = jaccard_join.similar_components(docs).collect()
    assert len(got) == len(ROWS)
    of = {r["doc_id"]: r["component_id"] for r in got}
    assert of[1] == of[7] == of[0] == 0 and of[6] == 5 and of[9] == 8 and of[2] == 2 and of[3] == 3
    left = jaccard_join.keep_one_of_each(docs)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {0, 2, 3, 4, 5, 8, 10, None}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(
        spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_mixing_targets_and_edges(spark, docs):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(ROWS)
    size = Counter()
    for _, t, _, s, *_ in ROWS:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(size.values()))
    while True:  # clamp, reshare the rest by weight, until none is above
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] >= 3 * size[s]}
        if not above:
            break
        for s in above:
            target[s] = 3.0 * size[s]
            left -= target[s]
        free -= above
    target |= {s: level * weight[s] for s in free}
    for r in rows:
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
    assert sorted(rows, key=str) == sorted(mixing.mix_sources(docs.repartition(5)).collect(), key=str)
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_sharding_law(spark, docs):
    for df in (table(spark), docs, spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"t{i}" * (i % 9)) for i in
                                                          range(400)], "doc_id long, text string")):
        rows = sharding.shard_documents(df).collect()
        source = texts(df)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
            (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in source)
        shards, groups, sizes = defaultdict(list), defaultdict(set), Counter()
        for r in rows:
            shards[r["shard"]].append(r["slot"])
            sizes[r["shard"]] += r["size"]
            groups[r["text_crc32"]].add(r["shard"])
        assert all(sorted(s) == list(range(len(s))) for s in shards.values()) and set(shards) <= set(range(16))
        assert all(len(s) == 1 for s in groups.values())
        by_text = Counter()
        for _, t in source:
            by_text[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 1
        assert max(sizes.values()) == smallest_capacity([by_text[k] for k in sorted(by_text)], 16)


def smallest_capacity(sizes, shards):
    def fits(cap):
        used, room = 1, cap
        for s in sizes:
            if s > cap:
                return False
            if s > room:
                used, room = used + 1, cap
            room -= s
        return used <= shards
    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_minimax_refines_to_the_optimum(spark, monkeypatch, seed):
    monkeypatch.setattr(sharding, "BLOCKS", 8)
    monkeypatch.setattr(sharding, "PIECES", 3)
    sizes = np.random.default_rng(seed).pareto(1.0, 300).astype(int) + 1
    begin = np.cumsum(sizes) - sizes
    groups = spark.createDataFrame([(int(b),) for b in begin], "begin long")
    cap, cuts = sharding.minimax_cuts(groups, int(sizes.sum()), 7)
    assert cap == smallest_capacity(sizes.tolist(), 7) and len(cuts) == 6
    shard = np.searchsorted(cuts, begin, "right")
    assert np.bincount(shard, weights=sizes).max() <= cap and set(cuts) <= {*begin.tolist(), int(sizes.sum())}


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.word_tokenizer())
    for df, options in ((table(spark), {}), (docs, {"items_per_task": 4, "fan_in": 2, "capacity": 64})):
        rows = packing.pack_documents(df, queries.word_tokenizer(), **options).collect()
        capacity = options.get("capacity", 4096)
        want = Counter()
        for i, t in texts(df):
            ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            for p, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start:start + capacity]
                want[(i, p, start, len(part), zlib.crc32(part.tobytes()))] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        bins = defaultdict(list)
        for r in rows:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for spans in bins.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
            assert at <= capacity
        if not options:
            assert len(bins) <= 1.03 * sum(k[3] * n for k, n in want.items()) / capacity + 1


def test_learned_scores_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, label, least in (("op3_quality_classifier", "quality", 0.95), ("op1_toxicity", "toxic", 0.9)):
        rows = queries.QUERIES[name](spark, sf).join(labels, "doc_id").filter("held_out").select(
            "score", "predicted", label).collect()
        assert all(0 <= r[0] <= 1 for r in rows)
        assert np.mean([r[1] == r[2] for r in rows]) >= least


def test_learners_do_not_follow_the_partitions(spark):
    from clientele.llm import learning, quality
    sample = spark.createDataFrame([(i, i % 2, [i % 5, 7], [1.0, 0.5]) for i in range(60)],
                                   "id long, y int, features array<bigint>, values array<float>")
    rows = learning.indexed(sample, np.array([0, 1, 2, 3, 4, 7], np.uint64))
    state = [np.zeros(7), np.zeros(7)]
    few = learning.mixing_round(rows, state, 3, quality._learn)
    many = learning.mixing_round(rows.repartitionByRange(23, "learner").sortWithinPartitions("learner", "id"),
                                 state, 3, quality._learn)
    one = learning.mixing_round(rows.coalesce(1).sortWithinPartitions("learner", "id"), state, 3, quality._learn)
    assert all((a == b).all() and (a == c).all() for a, b, c in zip(few, many, one, strict=True))
    assert not (few[1] == 0).all()
    assert rows.select("learner").distinct().count() <= learning.LEARNERS


def test_scores_of_odd_rows(docs, empty, spark):
    from clientele.llm import quality, toxicity
    labels = spark.createDataFrame([(0, 1, 1), (5, 1, 0), (8, 0, None), (99, 0, 1), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        model = module.fit(docs, labels, label=label, rounds=2)
        out = module.score(docs, model, score_col="__s")
        assert out.columns == [*docs.columns, "__s"]
        rows = out.collect()
        assert len(rows) == len(ROWS) and all(0 <= r["__s"] <= 1 for r in rows)
        nothing = module.fit(empty, labels.limit(0), label=label, rounds=1)
        assert {r["__s"] for r in module.score(docs, nothing, score_col="__s").collect()} == {0.5}


def test_nearest_neighbours(spark):
    rows = nearest.nearest_neighbours(table(spark, "embeddings")).collect()
    data = [(r["vec_id"], np.array(r["embedding"], float)) for r in table(spark, "embeddings").collect()]
    found = defaultdict(list)
    for r in rows:
        found[r["query_id"]].append(r)
    assert set(found) == {i for i, _ in data if i % 20 == 0}
    hits = 0
    for q, got in found.items():
        v = next(v for i, v in data if i == q)
        got.sort(key=lambda r: r["rank"])
        best = sorted(((-float(x @ v), i) for i, x in data if i != q))[:20]
        assert [r["rank"] for r in got] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in got] == sorted((-r["score"], r["vec_id"]) for r in got)
        hits += len({i for _, i in best} & {r["vec_id"] for r in got})
    assert hits >= 0.9 * 20 * len(found)


def test_nearest_neighbours_edges(spark):
    vectors = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]),
               (4, [None, 1.0]), (5, [1.0, 0.0]), (6, [1.0, 0.0]), (None, [1.0, 1.0]), (7, [1.0])]
    got = nearest.nearest_neighbours(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r[:2])] == [
        (0, 1, 5, 1.0), (0, 2, 6, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 5, 0.0), (20, 3, 6, 0.0)]


@pytest.mark.parametrize("order, fan", [(1, 8), (2, 8), (3, 8), (3, 2)])
def test_backoff_brute_force(spark, monkeypatch, order, fan):
    """With 2 bits an exchange, the n-grams pass several levels of merged blocks."""
    monkeypatch.setattr(backoff_lm, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(backoff_lm, "PARTITION_GRAMS", 10_000 if fan == 8 else 3000)
    monkeypatch.setattr(backoff_lm, "FAN_BITS", fan)
    df = table(spark).limit(60).unionByName(table(spark).limit(1).select(
        F.lit(-1).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars"))
    source = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in texts(df)]
    counts = Counter(tuple(w[j:j + n]) for _, w in source for n in range(1, order + 1) for j in range(len(w) - n + 1))
    total = sum(len(w) for _, w in source)

    def log_score(words):
        for n in range(len(words), 0, -1):
            back = (len(words) - n) * math.log(0.4)
            gram = tuple(words[-n:])
            if n == 1:
                return back + math.log(counts[gram]) - math.log(total)
            if counts[gram] >= 2:
                return back + math.log(counts[gram]) - math.log(counts[gram[:-1]])
    got = {r["doc_id"]: r for r in backoff_lm.backoff_scores(df, order=order).collect()}
    assert len(got) == len(source)
    for i, w in source:
        want = sum(log_score(w[max(0, j - order + 1):j + 1]) for j in range(len(w)))
        assert got[i]["n_words"] == len(w) and got[i]["log_score"] == pytest.approx(want, abs=1e-6)
    assert got[-1]["mean_log_score"] is None


def test_backoff_rows_grow_linearly(spark, monkeypatch):
    """Every exchange has at most 2 ** FAN_BITS rows for a block, whatever the number of partitions."""
    monkeypatch.setattr(backoff_lm, "FAN_BITS", 1)
    rng = np.random.default_rng(5)
    sent, cut = [], backoff_lm._counted

    def counted(asked, nodes, done, left):
        sent.append((nodes, asked.count()))
        return cut(asked, nodes, done, left)

    monkeypatch.setattr(backoff_lm, "_counted", counted)
    for blocks in (8, 32):
        sent.clear()
        rows = [(backoff_lm._cut(b, 0, 0, 1, *backoff_lm._distinct([rng.integers(1, 1 << 63, 200, np.uint64) * np.uint64(2)])))
                for b in range(blocks)]
        asked = spark.createDataFrame([r for batch in rows for r in map(tuple, (d.values() for d in batch.to_pylist()))],
                                      backoff_lm._ASKED)
        got = backoff_lm._counted(asked, blocks, 1, 3)
        assert got.count() == 2 * blocks
        assert len(sent) == 4 and all(n <= 2 * blocks for _, n in sent)
        found = [backoff_lm._unpacked_counts(pa.py_buffer(bytes(r["found"]))) for r in got.collect()]
        assert sum(map(len, found)) == 200 * blocks and not any(f.any() for f in found)


@pytest.mark.parametrize("values", [[], [0], [254, 255, 256, 1, 1 << 40], [7] * 300])
def test_counts_in_bytes(values):
    values = np.array(values, np.uint64)
    assert (backoff_lm._unpacked_counts(pa.py_buffer(backoff_lm._packed_counts(values))) == values).all()


def test_line_templates(spark):
    rows = [(i, f"Error {i} at host-{i}: disk full now\nunique words alpha{'abcdefghij'[i]} only here {'klmnopqrst'[i]}\n\nend")
            for i in range(10)]
    rows += [(20 + i, f"please contact our office {w} for more help today") for i, w in enumerate(
        ["north", "south", "east", "west", "upper", "lower", "inner", "outer", "main"])]
    rows += [(40, None), (41, ""), (42, "\n"), (43, "Error 5 at home")]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(10):  # the numbered line and "end" recur; the others are alone
        assert got[i]["text"].split("\n")[0].startswith("unique") and got[i]["n_dropped"] == 2, got[i]
    assert all(got[20 + i]["n_dropped"] == 1 and got[20 + i]["text"] == "" for i in range(9))
    assert got[40] == Row(doc_id=40, text=None, n_lines=0, n_dropped=0)
    assert got[41]["text"] == "" and got[42]["text"] == "\n" and got[43]["n_dropped"] == 0


def test_empty_tables(spark, empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert jaccard_join.similar_components(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert sharding.shard_documents(empty).count() == 0
    assert packing.pack_documents(empty, queries.word_tokenizer()).count() == 0
    assert backoff_lm.backoff_scores(empty).count() == 0
    assert line_templates.drop_recurring_lines(empty).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.nearest_neighbours(vectors).count() == 0


def test_odd_rows_in_the_others(docs):
    assert backoff_lm.backoff_scores(docs).count() == len(ROWS)
    out = line_templates.drop_recurring_lines(docs)
    assert out.count() == len(ROWS) and out.columns == [*docs.columns, "n_lines", "n_dropped"]
