"""Customer value models.

M1 is two grouped aggregates.  The model fits (M2, M3) keep only their 3-4
parameters on the driver.  A step of the fit is one Spark job over the
*pre-grouped* sufficient statistics (distinct (x, t_x, T) or (x, m) with a
count), materialised once in the checkpoint folder: a single ``mapInPandas``
stage returns for each partition the sums of the log-likelihood, its gradient
and its Hessian at a few points, so a step neither shuffles nor regenerates
code, and Newton's method needs few steps.  A fit that does not converge is an
error, never a result.  M4 scores customers with an Arrow-batched pandas UDF;
parameters are closure constants.

Model semantics follow the published BG/NBD (Fader, Hardie & Lee 2005) and
Gamma-Gamma (Fader & Hardie 2013) likelihoods with an L2 penalty on the
parameters, mean log-likelihood, time rescaled so that max(T) = 10 during the
BG/NBD fit, and a search in log-parameter space.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from clientele.functions.text import name_key_nan
from clientele.session import checkpoint_once

HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
# The dashboard's model settings.
PENALIZER = 0.01
DISCOUNT_RATE = 0.01
DAYS_PER_MONTH = 30.44
MIN_CUSTOMERS = 10
#: Passes over the data of a fit at most.
MAX_PASSES = 30
#: A Newton step is tried at these lengths, in one pass.
STEP_LENGTHS = (1.0, 0.5, 0.25, 1 / 16)
#: Relative error of the expected purchases at most.
QUADRATURE_ERROR = 1e-10
#: Rows whose expected purchases are integrated at once.
QUADRATURE_ROWS = 2048


class NotConverged(RuntimeError):
    """A fit or an integral did not reach its tolerance."""


@dataclass(frozen=True)
class Refused:
    """A model that was not fitted, and why."""
    reason: str


@dataclass(frozen=True)
class ValueModels:
    """M2 + M3: the parameters of both models."""
    bg: dict
    gg: dict


# ------------------------------------------------------------------ M1
def repeat_summary(tx: DataFrame, obs_end=None, customer: str = "customer", date_col: str = "tx_date",
                   money: str = "total_price") -> DataFrame:
    """M1 (C19): per customer at day grain — frequency = repeat days,
    recency = last - first day, T = observation end - first day,
    monetary_value = mean daily total over the days after the first (0 if
    none).  Rows after ``obs_end`` are excluded.

    ``obs_end=None`` means the last purchase date in the data: the
    per-customer table is materialised and the end is the maximum of its
    last days, so the transactions are not scanned a second time."""
    t = tx.where(F.col(date_col).isNotNull())
    if obs_end is not None:
        t = t.where(F.to_date(date_col) <= F.lit(str(obs_end)[:10]).cast("date"))
    days = (t.groupBy(name_key_nan(customer).alias("cust"), F.to_date(date_col).alias("d"))
              .agg(F.sum(money).cast("decimal(38,2)").alias("day_total")))
    first = F.min("d")
    agg = days.groupBy("cust").agg(
        first.alias("first_day"), F.max("d").alias("last_day"), F.count(F.lit(1)).alias("n_days"),
        F.sum("day_total").alias("all_total"),
        F.min_by("day_total", "d").alias("first_total"))
    if obs_end is None:
        agg = _materialize(agg)
        last = agg.agg(F.max("last_day")).first()[0]
        obs_end = str(last)[:10] if last is not None else "1970-01-01"
    end = F.lit(str(obs_end)[:10]).cast("date")
    freq = (F.col("n_days") - 1).cast("long")
    return agg.select(
        "cust", freq.alias("frequency"),
        F.datediff("last_day", "first_day").cast("long").alias("recency"),
        F.datediff(end, "first_day").cast("long").alias("T"),
        F.when(freq > 0, (F.col("all_total") - F.col("first_total")).cast("double") / freq)
         .otherwise(F.lit(0.0)).alias("monetary_value"))


# ------------------------------------------------------------------ helpers
def lgamma_np(z):
    """lnΓ(z) for z > 0, vectorised: shift by 7 then the Stirling series."""
    z = np.asarray(z, dtype=float)
    w = z + 7.0
    shift = np.log(z * (z + 1) * (z + 2) * (z + 3) * (z + 4) * (z + 5) * (z + 6))
    st = ((w - 0.5) * np.log(w) - w + HALF_LOG_2PI + 1 / (12 * w) - 1 / (360 * w ** 3)
          + 1 / (1260 * w ** 5) - 1 / (1680 * w ** 7) + 1 / (1188 * w ** 9) - 691 / (360360 * w ** 11)
          + 1 / (156 * w ** 13))
    return st - shift


def digamma_np(z):
    """The derivative of lnΓ(z) for z > 0: shift by 7, then the asymptotic series."""
    z = np.asarray(z, dtype=float)
    w = z + 7.0
    v = 1 / w ** 2
    tail = v * (1 / 12 - v * (1 / 120 - v * (1 / 252 - v * (1 / 240 - v * (1 / 132 - v * 691 / 32760)))))
    return np.log(w) - 0.5 / w - tail - sum(1 / (z + k) for k in range(7))


def trigamma_np(z):
    """The second derivative of lnΓ(z) for z > 0, in the same way."""
    z = np.asarray(z, dtype=float)
    w = z + 7.0
    v = 1 / w ** 2
    tail = v * (1 / 6 - v * (1 / 30 - v * (1 / 42 - v * (1 / 30 - v * (5 / 66 - v * 691 / 2730)))))
    return 1 / w + 0.5 * v + tail / w + sum(1 / (z + k) ** 2 for k in range(7))


def newton(evaluate, x0, max_passes: int = MAX_PASSES, tol: float = 1e-12,
           flat: float = 1e-7) -> tuple[np.ndarray, float, int]:
    """Minimise by Newton's method with a line search; returns the point, its
    value and the number of passes.

    ``evaluate(points)`` gives (value, gradient, Hessian) of each point in one
    pass over the data, so a step is tried at several lengths at once.  Negative
    curvature is turned, and a step moves a log-parameter by 3 at most.  Ends
    when the step would lower the value by less than ``tol`` of it."""
    best, points = None, [np.asarray(x0, dtype=float)]
    lengths, step = STEP_LENGTHS, None
    for passes in range(1, max_passes + 1):
        results = evaluate(points)
        tried = [(f, k) for k, (f, *_) in enumerate(results) if math.isfinite(f)]
        if tried and (best is None or min(tried)[0] < best[0]):
            f, k = min(tried)
            best, lengths = (f, points[k], *results[k][1:]), STEP_LENGTHS
            values, vectors = np.linalg.eigh(best[3])
            curvature = np.maximum(np.abs(values), 1e-8 * max(1.0, np.abs(values).max()))
            step = -vectors @ ((vectors.T @ best[2]) / curvature)
            if -best[2] @ step / 2 <= tol * max(1.0, abs(f)) or np.abs(best[2]).max() <= flat * max(1.0, abs(f)):
                return best[1], f, passes
            step *= min(1.0, 3.0 / np.abs(step).max())
        elif best is None:
            raise NotConverged("the likelihood is not finite where the search begins")
        else:
            lengths = [x / 128 for x in lengths]
        points = [best[1] + x * step for x in lengths]
    raise NotConverged(f"no minimum after {max_passes} passes; gradient {np.abs(best[2]).max():.2g}")


def _materialize(df: DataFrame, rows_per_partition: int | None = None) -> DataFrame:
    """Checkpoint ``df`` (computed once); with ``rows_per_partition`` the
    checkpointed rows are then coalesced to partitions of about that size
    (each optimiser step is one job over them)."""
    out = checkpoint_once(df)
    if rows_per_partition:
        n = out.count()
        out = out.coalesce(max(1, -(-n // rows_per_partition)))
    return out


def _evaluator(grouped: DataFrame, cols: list[str], terms, n_total: int, penalizer: float):
    """``evaluate`` for :func:`newton` in log-parameters: one single-stage job.

    ``terms(*data, *parameters)`` gives for each row the log-likelihood, its
    gradient and the upper triangle of its Hessian by the parameters.  Each task
    sums them, weighted, for all points (NumPy over Arrow batches) and emits one
    row a point; the driver adds partitions x points partial sums."""
    def evaluate(points):
        params = np.exp(np.asarray(points, dtype=float))
        n = params.shape[1]
        width = 1 + n + n * (n + 1) // 2

        def part(batches):
            sums = np.zeros((len(params), width))
            for pdf in batches:
                data = [pdf[c].to_numpy(dtype=float) for c in cols]
                w = pdf["w"].to_numpy(dtype=float)
                for k, p in enumerate(params):
                    with np.errstate(all="ignore"):
                        sums[k] += [float(np.sum(t * w)) for t in terms(*data, *p)]
            yield pd.DataFrame({"k": np.arange(len(params), dtype="int32"), "s": list(sums)})

        sums = np.zeros((len(params), width))
        for r in grouped.mapInPandas(part, "k int, s array<double>").collect():
            sums[r["k"]] += r["s"]
        out = []
        for p, s in zip(params, sums / n_total, strict=True):
            hessian = np.zeros((n, n))
            hessian[np.triu_indices(n)] = s[1 + n:]
            hessian = hessian + np.triu(hessian, 1).T
            gradient = -s[1:1 + n] * p + 2 * penalizer * p ** 2
            curved = -hessian * np.outer(p, p) + np.diag(-s[1:1 + n] * p + 4 * penalizer * p ** 2)
            value = -s[0] + penalizer * float(np.sum(p ** 2))
            finite = math.isfinite(value) and np.isfinite(gradient).all() and np.isfinite(curved).all()
            out.append((value if finite else math.inf, gradient, curved))
        return out
    return evaluate


# ------------------------------------------------------------------ M2
def bgnbd_terms(x, tx, T, r, alpha, a, b):
    """Log-likelihood of each row, its gradient by (r, alpha, a, b) and the upper
    triangle of its Hessian.  The likelihood is a product with a sum of two
    terms, still alive and gone after the last purchase; the sum is taken by
    their logs, so neither underflows for a customer of many purchases."""
    zero, n = np.zeros_like(x), r + x
    again = x > 0
    late, left = alpha + T, alpha + tx
    rest = np.where(again, b + x - 1, 1.0)
    alive = -n * np.log(late)
    gone = np.where(again, np.log(a) - np.log(rest) - n * np.log(left), -np.inf)
    both = np.logaddexp(alive, gone)
    w = np.exp(gone - both)  # share of 'gone'
    value = (lgamma_np(n) - lgamma_np(r) + r * np.log(alpha)
             + lgamma_np(a + b) + lgamma_np(b + x) - lgamma_np(b) - lgamma_np(a + b + x) + both)
    g_alive = [-np.log(late), -n / late, zero, zero]
    g_gone = [-np.log(left), -n / left, zero + 1 / a, -1 / rest]
    whole, part = digamma_np(a + b) - digamma_np(a + b + x), digamma_np(b + x) - digamma_np(b)
    outer = [digamma_np(n) - digamma_np(r) + np.log(alpha), zero + r / alpha, whole, whole + part]
    gradient = [o + (1 - w) * p + w * q for o, p, q in zip(outer, g_alive, g_gone, strict=True)]
    curve = trigamma_np(a + b) - trigamma_np(a + b + x)
    own = {(0, 0): trigamma_np(n) - trigamma_np(r), (0, 1): 1 / alpha - (1 - w) / late - w / left,
           (1, 1): -r / alpha ** 2 + (1 - w) * n / late ** 2 + w * n / left ** 2,
           (2, 2): curve - w / a ** 2, (2, 3): curve,
           (3, 3): curve + trigamma_np(b + x) - trigamma_np(b) + w / rest ** 2}
    apart = [q - p for p, q in zip(g_alive, g_gone, strict=True)]
    hessian = [own.get((i, j), zero) + w * (1 - w) * apart[i] * apart[j] for i in range(4) for j in range(i, 4)]
    return [value, *gradient, *hessian]


def bgnbd_fit(summary: DataFrame, penalizer: float = PENALIZER, max_passes: int = MAX_PASSES) -> dict:
    """M2: BG/NBD parameters (r, alpha, a, b) from (frequency, recency, T)."""
    t_max = summary.agg(F.max("T")).first()[0]
    scale = 10.0 / float(t_max) if t_max else 1.0
    grouped = _materialize(summary.groupBy("frequency", "recency", "T").agg(F.count(F.lit(1)).alias("w")), 200_000)
    n_total = grouped.agg(F.sum("w")).first()[0]
    scaled = lambda x, tx, T, *p: bgnbd_terms(x, tx * scale, T * scale, *p)
    best, value, passes = newton(_evaluator(grouped, ["frequency", "recency", "T"], scaled, n_total, penalizer),
                                 np.zeros(4), max_passes)
    r, alpha, a, b = np.exp(best)
    return {"r": float(r), "alpha": float(alpha) / scale, "a": float(a), "b": float(b), "neg_ll": float(value),
            "passes": passes}


# ------------------------------------------------------------------ M3
def gamma_gamma_terms(x, m, p, q, v):
    """Log-likelihood of each row, its gradient by (p, q, v) and the upper triangle of its Hessian."""
    px, s = x * p, x * m + v
    both, one = trigamma_np(px + q), np.ones_like(x)
    value = (lgamma_np(px + q) - lgamma_np(px) - lgamma_np(q) + q * np.log(v)
             + (px - 1) * np.log(m) + px * np.log(x) - (px + q) * np.log(s))
    return [value, x * (digamma_np(px + q) - digamma_np(px) + np.log(m) + np.log(x) - np.log(s)),
            digamma_np(px + q) - digamma_np(q) + np.log(v) - np.log(s), q / v - (px + q) / s,
            x * x * (both - trigamma_np(px)), x * both, -x / s,
            both - trigamma_np(q), one / v - 1 / s, -q / v ** 2 + (px + q) / s ** 2]


def gamma_gamma_fit(summary: DataFrame, penalizer: float = PENALIZER, max_passes: int = MAX_PASSES) -> dict:
    """M3: Gamma-Gamma spend parameters (p, q, v) on repeat buyers with a
    positive mean spend."""
    rep = summary.where((F.col("frequency") > 0) & (F.col("monetary_value") > 0))
    grouped = _materialize(rep.groupBy("frequency", "monetary_value").agg(F.count(F.lit(1)).alias("w")), 200_000)
    n_total = grouped.agg(F.sum("w")).first()[0]
    best, value, passes = newton(_evaluator(grouped, ["frequency", "monetary_value"], gamma_gamma_terms, n_total, penalizer),
                                 np.zeros(3), max_passes)
    p, q, v = np.exp(best)
    return {"p": float(p), "q": float(q), "v": float(v), "neg_ll": float(value), "passes": passes}


def log_likelihoods(summary: DataFrame, bg: dict, gg: dict) -> DataFrame:
    """M2 + M3: the log-likelihood of each customer at given parameters,
    unscaled; that of the spend is null for those without a repeat purchase."""
    @F.pandas_udf(DoubleType())
    def visits(x: pd.Series, tx: pd.Series, T: pd.Series) -> pd.Series:
        return pd.Series(bgnbd_terms(*(s.to_numpy(dtype=float) for s in (x, tx, T)), bg["r"], bg["alpha"], bg["a"], bg["b"])[0])

    @F.pandas_udf(DoubleType())
    def spend(x: pd.Series, m: pd.Series) -> pd.Series:
        x, m = (s.to_numpy(dtype=float) for s in (x, m))
        with np.errstate(all="ignore"):
            value = gamma_gamma_terms(x, m, gg["p"], gg["q"], gg["v"])[0]
        return pd.Series(np.where((x > 0) & (m > 0), value, np.nan))

    out = summary.select("cust", visits("frequency", "recency", "T").alias("visit_ll"),
                         spend("frequency", "monetary_value").alias("spend_ll"))
    return out.withColumn("spend_ll", F.nanvl("spend_ll", F.lit(None).cast("double")))


# ------------------------------------------------------------------ M4
def _quadrature(step: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Double-exponential nodes on (0, 1): log s, log(1 - s) and the log weight of each."""
    u = np.arange(-10, 10 + step / 2, step)
    q = np.pi * np.sinh(u)
    return -np.logaddexp(0, -q), -np.logaddexp(0, q), np.log(np.pi * np.cosh(u) * step)


def expected_purchases(t, x, tx, T, r, alpha, a, b):
    """BG/NBD expected purchases in (0, t] given (x, t_x, T) - NumPy.

    The usual formula holds a hypergeometric series that hardly converges for
    long horizons and is undefined at a = 1.  It is the mean over the dropout
    rate s, Beta(a, b + x) distributed, of (1 - (1 + y s)^-(r + x)) / s with
    y = t / (alpha + T), which is integrated here by double-exponential
    quadrature: the steps are halved until two results agree to
    QUADRATURE_ERROR, and the finer one is better still.  For small a the rate
    crowds at 0, so the value there, (r + x) y, is taken out first."""
    x, tx, T = (np.atleast_1d(np.asarray(v, dtype=float)) for v in (x, tx, T))
    n, y = r + x, t / (alpha + T)
    log_beta = lgamma_np(a) + lgamma_np(b + x) - lgamma_np(a + b + x)
    if np.any(b + x < 2e-3):
        raise NotConverged("b + x is too small for the quadrature")

    def integral(step, rows):
        log_s, log_rest, weight = _quadrature(step)
        s = np.exp(log_s)
        yr, nr = y[rows, None], n[rows, None]
        log_rest = (b + x[rows, None]) * log_rest
        with np.errstate(all="ignore"):
            bought = -np.expm1(-nr * np.log1p(yr * s))
            if a < 0.5:
                less = np.where(s > 1e-9, bought / s - nr * yr, -nr * (nr + 1) / 2 * yr ** 2 * s)
                return (nr * yr)[:, 0] + (np.exp(a * log_s + log_rest + weight - log_beta[rows, None]) * less).sum(1)
            bought = np.where(s > 1e-9, np.log(bought), np.log(nr * yr) + log_s)
        return np.exp((a - 1) * log_s + log_rest + bought + weight - log_beta[rows, None]).sum(1)

    mean = np.zeros_like(x)
    for lo in range(0, len(x), QUADRATURE_ROWS):
        rows = np.arange(lo, min(lo + QUADRATURE_ROWS, len(x)))
        rows = rows[y[rows] > 0]
        if not len(rows):
            continue
        step, fine = 1 / 4, integral(1 / 4, rows)
        while True:
            step, coarse, fine = step / 2, fine, integral(step / 2, rows)
            if np.all(np.abs(fine - coarse) <= QUADRATURE_ERROR * fine):
                break
            if step < 1 / 256:
                raise NotConverged("the expected purchases did not reach their error bound")
        mean[rows] = fine
    denom = 1 + (x > 0) * (a / np.where(x > 0, b + x - 1, 1.0)) * ((alpha + T) / (alpha + tx)) ** n
    return mean / denom


def clv(summary: DataFrame, bg: dict, gg: dict, horizon_days: int = 365,
        discount_rate: float = DISCOUNT_RATE) -> DataFrame:
    """M4 (C21): discounted value over ``horizon_days`` (months = days/30.44,
    monthly steps of 30 days) for repeat buyers with positive spend.  The
    computed value is returned (the reference's display zeroes it)."""
    months = int(np.ceil(horizon_days / DAYS_PER_MONTH))  # a begun month counts: 12 steps for 365 days
    r, alpha, a, b = bg["r"], bg["alpha"], bg["a"], bg["b"]
    p, q, v = gg["p"], gg["q"], gg["v"]

    @F.pandas_udf(DoubleType())
    def score(x: pd.Series, tx: pd.Series, T: pd.Series, m: pd.Series) -> pd.Series:
        x, tx, T, m = (s.to_numpy(dtype=float) for s in (x, tx, T, m))
        w = p * x / (p * x + q - 1)
        spend = (1 - w) * (v * p / (q - 1)) + w * m
        total = np.zeros_like(x)
        before = np.zeros_like(x)
        for k in range(1, months + 1):
            until = expected_purchases(30.0 * k, x, tx, T, r, alpha, a, b)
            total += spend * (until - before) / (1 + discount_rate) ** k
            before = until
        return pd.Series(total)

    rep = summary.where((F.col("frequency") > 0) & (F.col("monetary_value") > 0))
    return rep.withColumn("predicted_clv", score("frequency", "recency", "T", "monetary_value"))


def model_guard(summary: DataFrame, min_customers: int = MIN_CUSTOMERS) -> DataFrame:
    """Customers and repeat buyers available, and whether both reach
    the minimum the value models need — one aggregate row."""
    rep = (F.col("frequency") > 0) & (F.col("monetary_value") > 0)
    return (summary.agg(F.count(F.lit(1)).alias("n_customers"), F.count(F.when(rep, 1)).alias("n_repeat"))
                   .withColumn("enough", (F.col("n_customers") >= min_customers) & (F.col("n_repeat") >= min_customers)))


def refusal(guard: dict) -> str | None:
    """Why the value models are not fitted to a summary with this guard row; None if they are."""
    if guard["enough"]:
        return None
    return "too few customers" if guard["n_customers"] < MIN_CUSTOMERS else "too few repeat customers"


def fit_value_models(summary: DataFrame, **options) -> ValueModels | Refused:
    """M2 + M3 behind their guard (M12): nothing is fitted to too few customers."""
    reason = refusal(model_guard(summary).first().asDict())
    if reason:
        return Refused(reason)
    return ValueModels(bgnbd_fit(summary, **options), gamma_gamma_fit(summary, **options))


def refusals(summary: DataFrame, by: str, min_customers: int = MIN_CUSTOMERS) -> DataFrame:
    """M12 for each part of the customers: whether the models may be fitted to it, and why not."""
    rep = (F.col("frequency") > 0) & (F.col("monetary_value") > 0)
    counted = summary.groupBy(by).agg(F.count(F.lit(1)).alias("n_customers"), F.count(F.when(rep, 1)).alias("n_repeat"))
    return counted.withColumn("reason", F.when(F.col("n_customers") < min_customers, "too few customers")
                              .when(F.col("n_repeat") < min_customers, "too few repeat customers"))


def clv_to_profile(profile: DataFrame, scored: DataFrame, key: str = "cust_norm") -> DataFrame:
    """Each customer of the profile with the predicted value to 2 places, 0 for a miss."""
    s = scored.select(F.col("cust").alias("_c"), F.col("predicted_clv").alias("_v"))
    return (profile.join(s, profile[key] == s["_c"], "left")
            .withColumn("predicted_clv", F.round(F.coalesce("_v", F.lit(0.0)), 2)).drop("_c", "_v"))
