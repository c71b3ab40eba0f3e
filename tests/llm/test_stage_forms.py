"""The forms that keep whole rows: clashing column names, many lines in one text."""

import re
from collections import Counter

from clientele.llm import exact_dedup, line_templates, mixing

CLASH = "doc_id long, text string, source string, __id long, __digest string, __key string, __copies long, __copy long, __version long, __drop string, __of long"
ROWS = [(k, f"text {k // 2}\nshared line of all\n", "ab"[k % 2], k + 100, "d", f"k{k}", k, k, k, "x", k) for k in range(20)]


def test_columns_with_our_names_stay_as_they_are(spark):
    docs = spark.createDataFrame(ROWS, CLASH).repartition(3)
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [r for r in ROWS if r[0] % 2 == 0]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= set(ROWS) and mixed.count() > 0
    less = line_templates.drop_recurring_lines(docs, min_docs=8)
    assert less.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = {r.doc_id: tuple(r) for r in less.collect()}
    for r in ROWS:
        assert got[r[0]][2:11] == r[2:] and "shared line" not in got[r[0]][1]


def test_a_text_of_many_dropped_lines(spark):
    """Linear in the lines of a text: 40,000 of them, nearly all dropped."""
    body = "\n".join(f"word {'abcdefgh'[k % 8]} tail" for k in range(40_000))
    own = ["own" + " line" * (k + 4) for k in range(8)]  # another number of tokens in each text
    docs = spark.createDataFrame([(k, f"{body}\n{own[k]}") for k in range(8)], "doc_id long, text string")
    got = line_templates.drop_recurring_lines(docs, min_docs=8).collect()
    assert Counter((r.n_dropped, r.n_lines) for r in got) == {(40_000, 40_001): 8}
    assert all(r.text == own[r.doc_id] for r in got)


def test_repeated_ids_meet_the_target(spark):
    """Rows of one id and size are not all taken as often as the one taken most; null ids and sources too."""
    rows = [(1, " ".join(["w"] * 10) + f" {k}", "b") for k in range(200)]
    rows += [(None, f"null id {k}", None) for k in range(30)] + [(2, "a b c", "b")] * 3 + [(3, "", "a"), (3, None, "a")]
    rows += [(10 + k, f"x{k} " * (k % 7 + 1), "ac"[k % 2]) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    want, got = Counter(), Counter()
    for r in mixing.mix_sources(docs).collect():
        want[(r.doc_id, r.source, r.size)] += r.copies
    out = mixing.mixed_documents(docs).collect()
    for r in out:
        got[(r.doc_id, r.source, len((r.text or "").split()))] += 1
    assert got == +want
    times = Counter(r.text for r in out)
    often = {times[r[1]] for r in rows[:200]}
    assert len(often) == 2 and max(often) - min(often) == 1  # the fraction of "b" ends among these rows
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixed_documents(docs.repartition(2)).collect()))


def test_a_text_of_many_staying_lines(spark):
    """Linear where nearly all of 100,000 lines stay."""
    own = ["\n".join(f"{'abcd'[k]} own{'x' * (i % 5)} {chr(97 + i % 26)} {chr(97 + i // 26 % 26)}" for i in range(100_000))
           for k in range(4)]
    docs = spark.createDataFrame([(k, f"{own[k]}\nshared line of them all") for k in range(4)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs, min_docs=4).collect()}
    assert all(got[k].n_lines == 100_001 and "shared line" not in got[k].text for k in range(4))


def test_tokens_of_a_line(spark):
    lines = ["a", " a", "a ", "a b", "a  b", "a\tb", "\x0ba b\r", "äö 漢字 c", "a b c", "x" * 5000 + " y", "a b c d  e\x0cf"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {r.line: r.n for r in df.select("line", line_templates.token_count(df.line).alias("n")).collect()}
    assert got == {x: len([w for w in re.split(r"[\x20\x09-\x0D]+", x) if w]) for x in lines}


def test_narrowed_keeps_partners_and_stands_before_a_join(spark, monkeypatch):
    monkeypatch.setattr(line_templates, "BUCKETS", 16)
    rows = spark.createDataFrame([(k if k % 10 else None, k % 7) for k in range(200)], "a long, __bucket long")
    keys = spark.createDataFrame([(3, 3), (None, 2), (15, 1)], "a long, __bucket long")
    names = ["a", "__bucket"]
    some, none = (sorted(map(str, line_templates.narrowed(rows, keys, names, how).collect())) for how in ("left_semi", "left_anti"))
    assert sorted([*some, *none]) == sorted(map(str, rows.collect())) and none
    held = set(map(str, keys.collect()))
    assert held & set(map(str, rows.collect())) == held & set(some)
    assert line_templates.narrowed(rows, keys.limit(0), names).count() == 0
