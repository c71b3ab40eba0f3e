"""Toxicity: a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their leading 4 and 6 bytes (so
that inflected forms share terms); a term is present or not.  The score adds
linear weights and pairwise interactions: each known term has a vector, and a
pair of present terms adds the product of their vectors, so that two terms can
mean more together than apart, also if each alone means nothing.  Linear
weights are trained by follow-the-regularised-leader updates, whose L1 term
keeps most at zero.  The pairs' sum is divided by the number of known terms of
the text, so that the many pairs of a long text add no noise.  Vectors are
trained by AdaGrad.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm import learning, textops

#: Length of a term's vector; rounds; rounds in which only the linear part learns.
FACTORS, ROUNDS, LINEAR_ROUNDS = 4, 16, 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.0, 0.1
#: Weight of a toxic row in training: toxic rows are the rarer kind.
POSITIVE = 2.0
#: AdaGrad step and L2 strength of the vectors, and the size of their first values.
STEP, DECAY, SPREAD = 0.3, 0.01, 0.1
THRESHOLD = 0.5
PREFIXES = (4, 6)


def _terms(data, bounds):
    """Text number and hash of each term occurrence."""
    starts, ends, letters, first = textops.units(data, bounds)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(first))[letters]
    starts, ends = starts[letters], ends[letters]
    prefix = textops.prefix_hash(textops.LOWER[data])
    texts, terms = [text], [textops.span_hash(prefix, starts, ends)]
    for n in PREFIXES:
        longer = ends - starts > n
        texts.append(text[longer])
        # a prefix is another term than the word of the same letters
        terms.append(textops.mix(textops.span_hash(prefix, starts[longer], starts[longer] + n)))
    return np.concatenate(texts), np.concatenate(terms)


def features(data, bounds):
    text, term, counts = learning.grouped(*_terms(data, bounds))
    return text, term, np.ones(len(counts))


def _weights(z, n):
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _learner(with_factors: bool):
    def learn(state, y, at, values):
        z, n = state[:2]
        at = np.append(at, len(z) - 1)  # the intercept, which has no vector
        w = _weights(z[at], n[at])
        total = w.sum()
        if with_factors:
            v, sq = state[2:]
            on = at[:-1]
            own = v[on].astype(np.float64)
            summed = own.sum(0)
            share = 1.0 / max(len(on), 1)
            total += 0.5 * share * float((summed * summed - (own * own).sum(0)).sum())
        g = 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))) - y
        g *= POSITIVE if y else 1.0
        n_at = n[at]
        sigma = (np.sqrt(n_at + g * g) - np.sqrt(n_at)) / ALPHA
        z[at] += g - sigma * w
        n[at] = n_at + g * g
        if with_factors and len(on):
            gv = share * (g * (summed - own) + DECAY * own)
            sq[on] += gv * gv
            v[on] = own - STEP * gv / np.sqrt(sq[on] + 1e-8)
    return learn


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rounds: int = ROUNDS,
        max_rows: int = learning.MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Model: sorted term hashes, weights and vectors of the known terms,
    intercept.  Learns from at most ``max_rows`` labelled
    rows; ``labels`` must hold only rows that may teach.  Without any the
    model gives 0.5 to every text."""
    sample = learning.sample_features(docs, labels, label, features, max_rows, id_col, text_col)
    keys = learning.active_features(sample)
    rows = learning.indexed(sample, keys)
    size = len(keys) + 1
    start = np.random.default_rng(5).normal(0.0, SPREAD, (size, FACTORS)).astype(np.float32)
    state = [np.zeros(size), np.zeros(size), start, np.full((size, FACTORS), 0.1, np.float32)]
    for i in range(rounds):
        if i < LINEAR_ROUNDS:  # the vectors stay as they are and need not travel
            state[:2] = learning.mixing_round(rows, state[:2], i, _learner(False))
        else:
            state = learning.mixing_round(rows, state, i, _learner(True))
    z, n, v, _ = state
    w = _weights(z, n)
    return {"keys": keys, "weights": w[:-1], "vectors": v[:-1], "intercept": float(w[-1])}


def _score(model, data, bounds):
    text, term = _terms(data, bounds)
    at, known = learning.lookup(model["keys"], term)
    text, at, _ = learning.grouped(text[known], at[known])
    n = len(bounds) - 1
    total = np.bincount(text, weights=model["weights"][at] if len(text) else None, minlength=n).astype(np.float64)
    share = 1.0 / np.maximum(np.bincount(text, minlength=n), 1)
    for column in model["vectors"].T if len(text) else ():
        x = column[at].astype(np.float64)
        total += 0.5 * share * (np.bincount(text, weights=x, minlength=n) ** 2 - np.bincount(text, weights=x * x, minlength=n))
    return 1.0 / (1.0 + np.exp(-np.clip(total + model["intercept"], -35, 35)))


def score(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col`` (0 to 1).  A null or empty text has no terms
    and gets the intercept's score; repeated rows get equal scores; an empty
    table stays empty; other columns are kept."""
    return learning.score_documents(docs, model, _score, text_col, score_col)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, held_out, score, predicted) of every document; the rows held out
    (crc32 of the id mod 5 is 0) teach nothing."""
    out = learning.held_out(id_col, 5, 0)
    model = fit(docs, labels.filter(~out), id_col=id_col)
    return (score(docs.select(id_col, "text"), model)
            .select(F.col(id_col), out.alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))
