"""Archives, spelling variants and ranked search against SQL, brute force and round trips."""

import gzip
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.llm import queries, ranked_search, spelling, warc

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_warc", "op13_ranked_search"])
def test_sql_twins(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(frame.columns)
    assert Counter(map(tuple, frame.select(*columns).collect())) == Counter(want.fetchall())


# -- archives -------------------------------------------------------------------------------------------------------

BIG = "<html>é" + "x\r\n\r\nWARC/1.1\r\n" * 4000 + "</html>"
PAGES = [(1, "http://a/1 2", BIG), (2, None, BIG), (3, "http://a/3\r\nX: y", ""), (4, "u", None), (5, "u", "short"), (6, "u", "short"),
         (7, "u", "y" * 100), (8, "u", "y" * 100), (8, "u", "y" * 100), (None, "u", "y" * 100), (None, "u", "z" * 200),
         (None, "u", "z" * 200), (9, "u", "w" * 99), (10, "u", "w" * 99), (11, "u", "é" * 50), (12, "u", "é" * 50),
         (13, "u", "q" * 300), (13, "u", "q" * 300)]
PAGE_SCHEMA = "page_id long, url string, html string, record_type string, payload string"


def expected_pages(rows):
    by = defaultdict(list)
    for i, _, html in rows:
        by[html or ""].append(i)
    for i, _, html in rows:
        first = min((x for x in by[html or ""] if x is not None), default=None)
        again = len((html or "").encode()) >= 100 and first is not None and i != first
        yield i, len((html or "").encode()), "revisit" if again else "response", first if again else None


@pytest.mark.parametrize("segment", [100, 4096, 1 << 20])
def test_archived_pages_edges(spark, segment):
    pages = spark.createDataFrame([(*r, "c", "d") for r in PAGES], PAGE_SCHEMA).repartition(3)
    got = warc.archived_pages(pages, segment_bytes=segment, records_per_file=7).collect()
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == Counter(expected_pages(PAGES))
    assert got[0].__fields__ == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_archived_pages_empty_and_text_ids(spark):
    assert warc.archived_pages(spark.createDataFrame([], PAGE_SCHEMA)).collect() == []
    rows = spark.createDataFrame([("a b/ü", "u", "y" * 100), ("+c", "u", "y" * 100)], "page_id string, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archived_pages(rows).collect()}
    assert got == {"+c": ("response", None), "a b/ü": ("revisit", "+c")}


def test_archives_hold_what_was_written(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame([(*r, "c", "d") for r in PAGES], PAGE_SCHEMA), path, segment_bytes=500,
                        records_per_file=20)
    records = warc.read_records(spark, path)
    files = [p for p in (tmp_path / "a").iterdir() if p.name.endswith(".gz")]
    assert records.count() == sum(gzip.open(p).read().count(b"\r\nWARC-Record-ID: ") for p in files)
    assert all(gzip.open(p).read().count(b"\r\nWARC-Record-ID: ") <= 20 for p in files)
    assert records.select(F.max(F.octet_length("block"))).first()[0] <= 500
    assert records.select("record_id").distinct().count() == records.count()
    back = {r.headers["x-page-id"]: r.payload.decode() for r in warc.read_responses(spark, path).collect()
            if r.payload is not None and "x-page-id" in r.headers}
    for i, _, html in PAGES:
        if i is not None and str(i) in back:
            assert back[str(i)] == (html or "")
    assert {"1", "3", "4", "5", "7"} <= set(back)


def record(kind, name, block, *more):
    head = [warc.VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n"
    whole = http + b"Transfer-Encoding: Chunked\r\n\r\n5;x=y\r\nhello\r\n1\r\n!\r\n0\r\nA: b\r\n\r\n"
    parts = [whole[:20], whole[20:50], whole[50:]]

    def segments(name, pieces, total, numbers=None):
        out = [record("response", name, pieces[0], "WARC-Segment-Number: 1")]
        for k, piece in zip(numbers or range(2, len(pieces) + 1), pieces[1:], strict=True):
            last = [f"WARC-Segment-Total-Length: {total}"] if piece is pieces[-1] else []
            out.append(record("continuation", f"{name}-{k}", piece, f"WARC-Segment-Origin-ID: {name}",
                              f"WARC-Segment-Number: {k}", *last))
        return out

    good, gap = segments("s", parts, len(whole)), segments("g", parts, len(whole), [2, 4])
    short, twice = segments("t", parts, len(whole) + 1), segments("d", parts, len(whole))
    alone = [record("continuation", "o-2", b"x", "WARC-Segment-Origin-ID: o", "WARC-Segment-Number: 2", "WARC-Segment-Total-Length: 1")]
    plain = [record("warcinfo", "i", b"software: x"), record("response", "l", http + b"Content-Length: 2\r\n\r\nokay"),
             record("response", "c", http + b"Transfer-Encoding: chunked\r\n\r\n9\r\nhello\r\n"), record("response", "n", b"no http"),
             record("response", "b", http + b"\r\nbody \xff\xfe")]
    (tmp_path / "1.warc").write_bytes(b"".join([good[2], *plain, gap[0], short[1], twice[1]]))
    (tmp_path / "2.warc.gz").write_bytes(b"".join(map(gzip.compress, [good[0], gap[2], short[0], short[2], *twice])))
    cut = record("response", "e", whole)[:-30]
    (tmp_path / "3.warc").write_bytes(b"".join([*alone, gap[1], good[1], cut]))
    got = {r.record_id: None if r.payload is None else bytes(r.payload) for r in warc.read_responses(spark, str(tmp_path)).collect()}
    assert got == {"s": b"hello!", "g": None, "t": None, "d": b"hello!", "l": b"ok", "c": None, "n": None, "b": b"body \xff\xfe",
                   "e": None}


# -- spelling variants ----------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def variants(rows, least=3):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))


@pytest.mark.parametrize("block", [2, 7, 1024])
def test_spelling_variants(spark, block):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = rows if block == 1024 else rows[:60]  # small blocks: buckets in several tiles
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = Counter(map(tuple, spelling.spelling_variants(docs, block=block).collect()))
    want = Counter(variants(rows))
    assert got == want and any(r[4] for r in want)


def test_spelling_variants_edges(spark):
    schema = "doc_id long, text string, form string"
    assert spelling.spelling_variants(spark.createDataFrame([], schema)).collect() == []
    words = ["abcde"] * 9 + ["abcdef"] * 3 + ["bbcde"] * 4 + ["bbbde"] * 3 + ["aaaaa"] * 3 + ["aaaaaa"] * 6 + ["ÀBCDE"] * 4 + ["Éabcd"] * 3
    long = "q" * 3000
    rows = [(1, " ".join(words), "f"), (None, "ABCDE×÷ abcde9abcde", "f"), (2, None, "f"), (3, "", "f"), (4, f"{long} {long}r", "f"),
            (4, f"{long} {long}r", "f"), (5, f"{long} {long}r {long}", "f"), (6, "zz " * 3 + "zzzzé " * 3, "f")]
    got = Counter(map(tuple, spelling.spelling_variants(spark.createDataFrame(rows, schema).repartition(3)).collect()))
    assert got == Counter(variants([r[:2] for r in rows]))


def test_long_texts_are_read_whole(monkeypatch):
    text = "".join(np.random.default_rng(5).choice(list("abé xyz  -"), 5000))
    want = spelling.runs_of("1", text.encode())
    monkeypatch.setattr(spelling, "PIECE", 50)
    assert spelling.runs_of("1", text.encode()) == want


# -- ranked search --------------------------------------------------------------------------------------------------


def ranked(docs, items, k=10):
    terms = lambda t: TERM.findall((t or "").translate(LOWER))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    big_n, big_l = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * x + 1))) for t, x in df.items()}
    asked = defaultdict(Counter)
    for i, t in items:
        asked[i].update(terms(t))
    for item, q in asked.items():
        scores = []
        for i, c in held:
            m = 25 + 75 * c.total() * big_n // big_l
            s = sum(x * weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, x in q.items() if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1):
            yield item, rank, None if none else i, -s


DOCS = [(1, "The cat sat. THE cat!"), (2, "a dog"), (3, None), (4, ""), (5, "... "), (6, "cat dog Élan élan"), (7, "cat dog Élan élan"),
        (7, "cat dog Élan élan"), (None, "cat dog Élan élan"), (8, "it's 3.14 naïve　x"), (9, "cat " * 5000 + "rare"),
        *[(20 + k, f"cat w{k} the") for k in range(15)]]
ITEMS = [(1, "cat the"), (2, "cat the dog"), (3, "Cat cat DOG élan"), (4, None), (5, ""), (6, "nothing here"), (7, "cat the dog élan"),
         (7, "rare"), (None, "naïve　x 14"), (8, "cat the"), (9, "w3 w4 the the")]


@pytest.mark.parametrize("block_rows", [1, 5, 1 << 17])
@pytest.mark.parametrize("entries", [1, 1 << 21])
def test_ranked_documents(spark, monkeypatch, block_rows, entries):
    monkeypatch.setattr(ranked_search, "ENTRIES", entries)
    docs = spark.createDataFrame([(*r, 1, "s") for r in DOCS], "doc_id long, text string, rank int, score string").repartition(3)
    items = spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, item int")
    got = Counter(map(tuple, ranked_search.ranked_documents(docs, items, block_rows=block_rows).collect()))
    assert got == Counter(ranked(DOCS, ITEMS))


def test_ranked_documents_empty(spark):
    docs, items = (spark.createDataFrame(r, f"{c} long, text string") for r, c in ((DOCS, "doc_id"), (ITEMS, "item_id")))
    assert ranked_search.ranked_documents(docs.limit(0), items).collect() == []
    assert ranked_search.ranked_documents(docs, items.limit(0)).collect() == []


def test_shared_sets_are_summed_once():
    rng = np.random.default_rng(3)
    rows = sorted({(i, int(t)) for i in range(30) for t in rng.integers(0, 12, 8)})
    item, term = np.array(rows).T
    times = np.array([1 + t % 2 for _, t in rows])
    graph = ranked_search.mine(item, term, times, 30)
    for i in range(30):
        node, sets = graph.ends[i], []
        while node >= 0:
            sets += graph.sets[node]
            node = graph.parents[node]
        at = np.isin(graph.set, sets)
        assert sorted(zip(graph.term[at].tolist(), graph.times[at].tolist(), strict=True)) == [
            (t, 1 + t % 2) for j, t in rows if j == i]
    # each pair of a term and its count stands in one set only, and beginnings are shared
    assert len(graph.term) == len({(t, m) for t, m in zip(term, times, strict=True)})
    assert sum(map(len, graph.sets)) < len(rows)
