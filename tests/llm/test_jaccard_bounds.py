"""The Jaccard join on many near copies of few originals, against brute force: sizes across bands, links near the threshold."""

import itertools
import random

import pytest

from clientele.llm import jaccard_join


def sets(text, shingle):
    words = text.split()
    return {tuple(words[i:i + shingle]) for i in range(len(words) - shingle + 1)} or {tuple(words)}


def components(texts, shingle, percent):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = [sets(t, shingle) for t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(held[i] & held[j])
        if 100 * both >= percent * (len(held[i]) + len(held[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: find(i) for i in range(len(texts))}


@pytest.mark.parametrize("shingle, percent, seed, frequent, sample", [(4, 85, 1, 3, 8), (5, 80, 2, 2, 1), (4, 85, 3, 2, 1)])
def test_stars_chains_and_passages(spark, monkeypatch, shingle, percent, seed, frequent, sample):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = []
    for length in (40, 120, 300):
        original = [word() for _ in range(length)]
        texts.append(" ".join(original))
        for _ in range(60):  # copies around the threshold, each changed elsewhere, some longer or shorter
            copy = list(original)
            for _ in range(rng.randint(0, max(2, length // 30))):
                copy[rng.randrange(len(copy))] = word()
            cut = rng.randint(0, length // 8)
            texts.append(" ".join(copy[cut:] if rng.random() < 0.5 else copy + [word() for _ in range(cut)]))
    passage = [word() for _ in range(50)]
    texts += [" ".join([word() for _ in range(rng.randint(0, 25))] + passage + [word() for _ in range(rng.randint(0, 25))]) for _ in range(60)]
    chain = [word() for _ in range(200)]
    texts += [" ".join(chain[k:k + 100]) for k in range(0, 100, 3)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[k] for k in order]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = components(texts, shingle, percent)
    assert len(set(want.values())) < len(texts) - 60
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "SAMPLE", sample)
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_components(docs, shingle=shingle, percent=percent).collect()}
    assert got == want
