"""The machine's pairwise part learns what no term means alone."""

import numpy as np

from clientele.llm import toxicity


def area(scores, y):
    rank = np.argsort(np.argsort(scores))
    y = np.array(y) == 1
    return (rank[y].mean() - (y.sum() - 1) / 2) / (~y).sum()


def test_rows_that_only_the_combination_makes_toxic(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(2400):  # toxic if the two words are of one kind; each word is as often in toxic rows as in others
        a, b = rng.integers(6, size=2)
        words = [f"f{w}" for w in rng.choice(300, 6, replace=False)] + [f"a{a}", f"b{b}"]
        rows.append((i, " ".join(words), int((a < 3) == (b < 3))))
    rows = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(rows.filter("doc_id < 1800"), rows.select("doc_id", "toxic"))
    fresh = rows.filter("doc_id >= 1800")
    got = [(r["score"], r["toxic"]) for r in toxicity.score(fresh, model).collect()]
    linear = model | {"vectors": np.zeros_like(model["vectors"])}
    alone = [(r["score"], r["toxic"]) for r in toxicity.score(fresh, linear).collect()]
    assert area(*zip(*got)) >= 0.95
    assert area(*zip(*alone)) <= 0.6
