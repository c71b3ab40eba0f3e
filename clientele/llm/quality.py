"""Quality classifier: logistic regression over hashed word n-grams, trained
with follow-the-regularised-leader updates, scored as sparse dot products.

A word is a run of letters and digits or a run of signs; a word equal to the
one before it counts as the word REPEAT, so that repetition is an n-gram that
other texts share.  Unigrams and bigrams are features; a feature's value is
log(1 + its count) / log(1 + the number of words).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm import learning, textops

ROUNDS = 12
#: Per-coordinate learning rate and its offset, L1 and L2 strength.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.5, 1.0
THRESHOLD = 0.7
_REPEAT = np.uint64(0xD1B54A32D192ED03)


def _ngrams(data, bounds):
    """Text number of each n-gram, its hash, and the number of words of each text."""
    starts, ends, _, first = textops.units(data, bounds)
    words = textops.span_hash(textops.prefix_hash(textops.LOWER[data]), starts, ends)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))
    same = (text[1:] == text[:-1]) if len(text) else np.zeros(0, bool)
    repeat = np.zeros(len(words), bool)
    repeat[1:] = same & (words[1:] == words[:-1])
    words[repeat] = _REPEAT
    pairs = textops.ngrams(words, 2)
    return (np.concatenate([text, text[:len(same)][same]]), np.concatenate([words, pairs[same]]), np.diff(first))


def _values(counts, text, n_words):
    return np.log1p(counts) / np.log1p(n_words[text])


def features(data, bounds):
    text, gram, n_words = _ngrams(data, bounds)
    text, gram, counts = learning.grouped(text, gram)
    return text, gram, _values(counts, text, n_words)


def _weights(z, n):
    """The regularised leader's weights, from the sums of the gradients."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _learn(state, y, at, values):
    z, n = state  # the last coordinate is the intercept, which has no penalty but L2
    at = np.append(at, len(z) - 1)
    values = np.append(values, 1.0)
    w = _weights(z[at], n[at])
    p = 1.0 / (1.0 + np.exp(-np.clip(w @ values, -35, 35)))
    g = (p - y) * values
    n_at = n[at]
    sigma = (np.sqrt(n_at + g * g) - np.sqrt(n_at)) / ALPHA
    z[at] += g - sigma * w
    n[at] = n_at + g * g


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rounds: int = ROUNDS,
        max_rows: int = learning.MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Model: sorted feature hashes, their weights (those not zero), intercept.

    Learns from at most ``max_rows`` labelled rows; ``labels`` must hold only
    rows that may teach.  Without any the model gives 0.5 to every text."""
    sample = learning.sample_features(docs, labels, label, features, max_rows, id_col, text_col)
    keys = learning.active_features(sample)
    rows = learning.indexed(sample, keys)
    state = [np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)]
    for i in range(rounds):
        state = learning.mixing_round(rows, state, i, _learn)
    w = _weights(*state)
    used = np.flatnonzero(w[:-1])
    return {"keys": keys[used], "weights": w[used], "intercept": float(w[-1])}


def _score(model, data, bounds):
    text, gram, n_words = _ngrams(data, bounds)
    at, known = learning.lookup(model["keys"], gram)
    text, at, counts = learning.grouped(text[known], at[known])
    total = np.bincount(text, weights=model["weights"][at] * _values(counts, text, n_words) if len(text) else None,
                        minlength=len(bounds) - 1)
    return 1.0 / (1.0 + np.exp(-np.clip(total + model["intercept"], -35, 35)))


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1).  A null or empty text has no
    features and gets the intercept's score; repeated rows get equal scores; an
    empty table stays empty; other columns are kept."""
    return learning.score_documents(docs, model, _score, text_col, score_col)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted) of every document; the rows held out
    (crc32 of the id mod 4 is 2) teach nothing."""
    out = learning.held_out(id_col, 4, 2)
    model = fit(docs, labels.filter(~out), id_col=id_col)
    return (score(docs.select(id_col, "text"), model)
            .select(F.col(id_col), out.alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
