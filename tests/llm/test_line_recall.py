"""Lines and templates that must be found to recur, however few documents or however mixed the leaf."""

import random

import pytest

from clientele.llm import line_templates


def passage(word, n=60):
    return " ".join(f"{word}{'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}" for i in range(n))


def dropped(spark, rows):
    out = line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r["doc_id"]: r["n_dropped"] for r in out.collect()}


@pytest.mark.parametrize("copies", [2, 3])
def test_long_line_in_few_documents(spark, copies):
    rows = [(i, f"{passage('x')}\nshort line of few words\n{passage(f'own{chr(97 + i)}')}") for i in range(copies)]
    rows += [(9, f"{passage('y')}\n{passage('y')}")]  # twice in one document is not two documents
    got = dropped(spark, rows)
    assert got == {**dict.fromkeys(range(copies), 1), 9: 0}


def test_two_long_lines_of_one_lead_need_common_words(spark):
    lead = "these four lead words "
    rows = [(1, lead + passage("x", 26)), (2, lead + passage("y", 26)),  # 4 of 30 positions agree
            (3, "these are four others " + passage("x", 26)),
            (4, "these are four others " + passage("x", 20) + " " + passage("z", 6))]  # 24 of 30 agree
    assert dropped(spark, rows) == {1: 0, 2: 0, 3: 1, 4: 1}


VARYING = "north south east west upper lower inner outer main left right front back".split()


def test_two_families_in_one_leaf(spark):
    lead = "please contact our office "
    rows = [(i, f"{lead}{w} for more help today") for i, w in enumerate(VARYING[:9])]
    rows += [(20 + i, f"{lead}before you {w} send parcels") for i, w in enumerate(VARYING)]
    # a token that the other family has there parts this one by chance
    rows += [(40, f"{lead}before for send parcels more"), (41, f"{lead}you must never do this")]
    got = dropped(spark, rows)
    assert {k for k, v in got.items() if v} == {*range(9), *range(20, 33)}


def test_family_among_unrelated_lines(spark):
    lead = "these four lead words "
    rows = [(i, lead + passage(f"u{chr(97 + i)}", 26)) for i in range(20)]
    common = passage("x", 26).split()
    for i, w in enumerate(VARYING[:3]):
        rows.append((50 + i, lead + " ".join([*common[:5], w, *common[6:]])))
    got = dropped(spark, rows)
    assert {k for k, v in got.items() if v} == {50, 51, 52}


@pytest.mark.parametrize("few", [0, 1000])
def test_templates_against_every_line_of_the_leaf(spark, monkeypatch, few):
    """Each template's lines are those that agree with it, by a plain count."""
    monkeypatch.setattr(line_templates, "FEW", few)
    rng = random.Random(3)
    lines = []
    for i in range(120):
        family = rng.randrange(4)
        lines.append(["a", "b", "c", "d", *[f"w{'klmnop'[rng.randrange(6)]}" if rng.random() < 0.4 else f"f{'abcd'[family]}{'abcdefgh'[p]}"
                                           for p in range(8)]])
    distinct = sorted({tuple(x) for x in lines})
    bodies = spark.createDataFrame([(1, i, 1, 12, list(x), 1, 8) for i, x in enumerate(distinct)],
                                   "leaf long, line long, n long, tokens int, body array<string>, docs long, needed int")
    templates = line_templates.leaf_templates(bodies)
    kept = {r["template"]: [(k["pos"], k["word"]) for k in r["kept"]] for r in templates.collect()}
    want = {(t, i) for t, ks in kept.items() for i, x in enumerate(distinct)
            if sum(x[p] == w for p, w in ks) >= 12 * line_templates.SIMILAR}
    got = [(r["template"], r["line"]) for r in line_templates.drawn_lines(bodies, templates).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {i for _, i in want} == set(range(len(distinct)))  # every line has a template
