"""Document quality from positive and unlabelled texts.

Trusted positives and unlabelled texts are sampled up to a stated bound and described by counts. The class prior is
estimated from how much of the unlabelled mass any score threshold leaves per positive mass, and a linear model is
fitted by minimising the non-negative unbiased risk of positive-unlabelled learning.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from math import log, log1p, sqrt
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splits import sampled
from .storage import carried, own, packed, unpacked

# The fit sees about so many rows of either kind, whatever the size of the corpus.
MOST_POSITIVE = 4000
MOST_UNLABELLED = 6000
BUCKETS = 1 << 8
DENSE = 23
# Spread given to hashed words, whose own spread would make rare ones weigh most.
HASHED_SCALE = 1 / 3
THRESHOLD = 0.7
TURNS = 400
RATE = 0.05
RIDGE = 1e-4

_KIND = np.zeros(256, np.int64)
for _kind, _members in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>", b"!?", b".", b",;:", b" \t", b"\n\r"),
    start=1,
):
    for _b in _members:
        _KIND[_b] = _kind
_KIND[128:] = 10


def describe(text: str | None) -> np.ndarray:
    """Features of one whole text: shares of kinds of characters, lengths, repeats, and hashed words."""
    text = text or ""
    out = np.zeros(DENSE + BUCKETS, np.float32)
    words = text.split()
    n = len(words)
    if not n:
        out[0] = 1.0
        return out
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(_KIND, weights=np.bincount(raw, minlength=256), minlength=11)
    seen = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = kinds[1] + kinds[2] + 1.0
    out[1] = log1p(n)
    out[2] = (kinds.sum() - kinds[8] - kinds[9]) / n
    out[3] = kinds[1] / letters
    out[4:10] = np.minimum(kinds[[3, 4, 5, 6, 7, 9]] / n, 4.0)
    out[10] = kinds[10] / kinds.sum()
    out[11] = log1p(len(seen)) / log1p(n)
    out[12] = seen.most_common(1)[0][1] / n
    out[13] = 1.0 - len(set(lines)) / max(1, len(lines))
    out[14] = min(n / len(lines), 500.0) / 100.0
    out[15] = 1.0 if n < 10 else 0.0
    out[16] = sum(map(eq, words, islice(words, 1, None))) / n
    out[17:DENSE] = (
        out[12] > 0.25, out[13] > 0.3, out[3] > 0.5, out[5] > 0.2, out[6] > 0.3, out[16] > 0.15
    )
    at = np.fromiter((zlib.crc32(w.lower().encode()) & (BUCKETS - 1) for w in seen), np.int64, len(seen))
    counts = np.fromiter(map(log1p, seen.values()), np.float32, len(seen))
    hashed = np.bincount(at, weights=counts, minlength=BUCKETS)
    out[DENSE:] = hashed / sqrt(float(hashed @ hashed))
    return out


@dataclass(frozen=True)
class Model:
    """Weights over standardised features; ``prior`` is the estimated share of positives among unlabelled texts."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        g = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(g, -30, 30)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_risk(p: np.ndarray, u: np.ndarray, prior: float, turns: int = TURNS) -> tuple[np.ndarray, float]:
    """Minimise prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) for logistic l over linear g.

    Where the second part is negative, the step undoes it instead of following it down.
    """
    w = np.zeros(p.shape[1] + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    p1, u1 = np.c_[p, np.ones(len(p))], np.c_[u, np.ones(len(u))]
    for t in range(1, turns + 1):
        gp, gu = p1 @ w, u1 @ w
        negative = _softplus(gu).mean() - prior * _softplus(gp).mean()
        pull = -prior * (p1.T @ _sigmoid(-gp)) / len(p1)
        push = (u1.T @ _sigmoid(gu)) / len(u1) - prior * (p1.T @ _sigmoid(gp)) / len(p1)
        step = pull + push if negative >= 0 else -push
        step[:-1] += RIDGE * w[:-1]
        first = 0.9 * first + 0.1 * step
        second = 0.999 * second + 0.001 * step * step
        w -= RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(p_scores: np.ndarray, u_scores: np.ndarray, doubt: float = 0.1) -> float:
    """Share of positives in the unlabelled rows: the least ratio of unlabelled to positive mass above a threshold.

    A confidence term keeps thresholds that few positives pass from deciding.
    """
    p, u = np.sort(p_scores), np.sort(u_scores)
    over_p = 1.0 - np.searchsorted(p, p, "left") / len(p)
    over_u = 1.0 - np.searchsorted(u, p, "left") / len(u)
    slack = sqrt(log(4 / doubt) / (2 * len(u))) + sqrt(log(4 / doubt) / (2 * len(p)))
    best = np.argmin((over_u + slack) / over_p)
    return float(np.clip(over_u[best] / over_p[best], 0.01, 0.99))


def fit(p: np.ndarray, u: np.ndarray) -> Model:
    """Prior from a first fit on one half, scored on the other; then the fit with that prior on all rows."""
    both = np.r_[p, u]
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-3
    scale[DENSE:] = HASHED_SCALE
    p, u = (p - mean) / scale, (u - mean) / scale
    if len(p) < 4 or len(u) < 4:
        prior = 0.5
    else:
        w, b = fit_risk(p[::2], u[::2], 0.5, TURNS // 2)
        prior = estimate_prior(p[1::2] @ w + b, u[1::2] @ w + b)
    w, b = fit_risk(p, u, prior)
    return Model(mean, scale, w, b, prior)


def train(
    docs: DataFrame,
    positives: DataFrame,
    labelled: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    most_positive: int = MOST_POSITIVE,
    most_unlabelled: int = MOST_UNLABELLED,
) -> Model | None:
    """Fit on ``docs`` whose key is in ``positives`` (a single column), against all of ``docs``, labelled or not.

    The samples are bounded by the two parameters. How many documents are in ``labelled`` does not change the fit:
    all rows are the mixture whose prior is estimated. None without positives or documents.
    """
    ids = docs.select(own(key).alias("id"))
    known = positives.select(F.col(positives.columns[0]).alias("id")).distinct().withColumn("kind", F.lit(1))
    trusted = ids.join(known, "id")
    if trusted.isEmpty():
        return None
    chosen = trusted.transform(sampled, "kind", most_positive).union(
        ids.withColumn("kind", F.lit(0)).transform(sampled, "kind", most_unlabelled)
    )
    # Bounded by the two parameters.
    chosen = F.broadcast(chosen.groupBy("id").agg(F.max("kind").alias("p"), F.min("kind").alias("u")))
    read = docs.select(own(key).alias("at"), own(text).alias("text"))
    # Rows that share a key count once, by the first of their texts.
    picked = read.join(chosen, F.col("at").eqNullSafe(F.col("id"))).groupBy("id", "p", "u").agg(F.min("text").alias("text"))

    @F.pandas_udf("binary")
    def described(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([describe(t).tobytes() for t in texts], dtype=object)

    rows = picked.select(described("text").alias("x"), "p", "u").toPandas()
    if rows.empty:
        return None
    x = np.stack([np.frombuffer(b, np.float32) for b in rows["x"]])
    order = np.argsort([zlib.crc32(b) for b in rows["x"]], kind="stable")
    x, p, u = x[order], rows["p"].to_numpy()[order], rows["u"].to_numpy()[order]
    if not (p == 1).any() or not (u == 0).any():
        return None
    return fit(x[p == 1], x[u == 0])


def classify(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows of ``docs`` with ``score`` (0 to 1, higher for better texts) and ``predicted`` (1 from ``threshold`` on).

    NULL texts score as empty ones. Without a model every score is 0.5. Repeated rows stay and score alike; only the
    text decides. Input columns of the two names are replaced. An empty table gives an empty table.
    """
    columns = carried(docs, ["score", "predicted"])

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.full(len(texts), 0.5)
            for i, t in enumerate(texts if model is not None else ()):
                out[i] = model.score(describe(t))
            yield pd.Series(out)

    out = docs.select(packed(docs, columns).alias("row"), scored(own(text)).alias("score"))
    return out.select(*unpacked(columns), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
