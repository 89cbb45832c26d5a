"""Quality classifier by non-negative positive-unlabelled learning.

Trusted positives are documents that ``labels`` marks quality 1, outside the
held-out fold; unlabelled text is every document outside that fold. No document
marked bad is learnt from. The model minimises the non-negative unbiased risk
(Kiryo et al., 2017) with logistic loss,

    prior * R+(P) + max(0, R-(U) - prior * R-(P)),

by Newton steps. Where the second part is positive, the risk is convex: the mean
of log(1 + exp f) over U less prior times the mean of f over P. A step after
which the second part, the estimated risk on bad text, would fall below zero is
halved until it does not, so the fit ends at the latest where that risk is zero.

The class prior is estimated from positives and unlabelled scores alone (Garg et
al., 2021): a first model tells P from U, and of all cuts of its score the one is
taken where the share of U above it over the share of P above it is least, with
a margin for the size of both sides.

A document is described by its hashed n-gram log ratio between trusted and
unlabelled text and by plain measurements of the whole text (symbols, capitals,
repeats, length, ...). Labels, language, source and id are never inputs. Ratios
are counted over all documents outside the fold, in two halves; the fit describes
each document by the ratios of the other half, scores use both.

Trusted documents are at most ``MAX_POSITIVE``, those of smallest id hash; the
unlabelled side has no bound. Descriptions are written once as a table, and every
step of the fit is one pass over it in which tasks send sums as long as the
model.

Defined results: null text is empty and scored like any; a null doc_id counts
as an empty one in the fold rule and is never trusted; rows that repeat count as
often as they occur; without trusted documents or without unlabelled ones every
score is ``DEFAULT_PRIOR``; an empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ngrams, textstats
from .common import Scratch

FOLDS, HELD_OUT = 4, 2
CUT = 0.7
#: Most trusted documents in the fit; they alone are bounded.
MAX_POSITIVE = 100_000
#: The score of everything where there is nothing to learn from.
DEFAULT_PRIOR = 0.8
STEPS, HALVINGS, DECAY = 25, 8, 1e-3
#: Bins of the first model's score, and the prior's bounds.
BINS, PRIORS = 1000, (0.02, 0.98)
N_FEATURES = 12
_UPPER = bytes(range(65, 91))


@dataclass
class Model:
    prior: float
    ratios: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None  # the last one is the intercept

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return sigmoid(design(x, self.mean, self.scale) @ self.weights)


def sigmoid(f: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(f, -40, 40)))


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def describe(text: bytes, ratios: np.ndarray) -> list[float]:
    """Measurements of one whole text."""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    total, grams = ngrams.score(text, ratios)
    llr = total / ngrams.SCALE / max(1, grams)
    capitals = size - len(text.translate(None, _UPPER))
    digits = size - len(text.translate(None, b"0123456789"))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = max(1, text.count(b"\n") + 1)
    root = [same / n, 1 - len(set(words)) / n, capitals / size, textstats.symbols(text) / n, text.count(b"!") / n, digits / size, textstats.repeat_words(words) / n, textstats.dup_lines(text) / lines]
    return [max(-3.0, min(llr, 0.0)), max(0.0, llr), *np.sqrt(root).tolist(), np.log1p(len(words)), np.log1p(size / n)]


def design(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([z, z * z / 8, np.ones((len(z), 1))])


# ------------------------------------------------------------------------ fit

#: (features, whether trusted) -> vector, to be summed over all rows
Part = Callable[[np.ndarray, np.ndarray], np.ndarray]
Sums = Callable[[Part], np.ndarray]


def moments(sums: Sums) -> tuple[float, float, np.ndarray, np.ndarray]:
    """(trusted rows, unlabelled rows, mean, scale) of the unlabelled side."""

    def part(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        u = x[~p]
        return np.concatenate(([p.sum(), len(u)], u.sum(axis=0), (u * u).sum(axis=0)))

    s = sums(part)
    n = max(1.0, s[1])
    mean = s[2 : 2 + N_FEATURES] / n
    return float(s[0]), float(s[1]), mean, np.sqrt(np.maximum(s[2 + N_FEATURES :] / n - mean * mean, 0.0)) + 1e-6


def separate(sums: Sums, mean: np.ndarray, scale: np.ndarray, n_p: float, n_u: float) -> np.ndarray:
    """Weights of a logistic model that tells trusted rows from unlabelled ones,
    both sides of equal weight."""
    k, w = 2 * N_FEATURES + 1, np.zeros(2 * N_FEATURES + 1)
    for _ in range(STEPS):

        def part(x: np.ndarray, p: np.ndarray, w: np.ndarray = w) -> np.ndarray:
            d, weight = design(x, mean, scale), np.where(p, 0.5 / n_p, 0.5 / n_u)
            s = sigmoid(d @ w)
            return np.concatenate((d.T @ (weight * (s - p)), ((d * (weight * s * (1 - s))[:, None]).T @ d).ravel()))

        s = sums(part)
        move = np.linalg.solve(s[k:].reshape(k, k) + DECAY * np.eye(k), s[:k] + DECAY * w)
        w = w - np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-3:
            break
    return w


def estimate_prior(sums: Sums, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, n_p: float, n_u: float) -> float:
    """Share of good documents among the unlabelled ones."""

    def part(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        at = np.minimum((sigmoid(design(x, mean, scale) @ w) * BINS).astype(int), BINS - 1)
        return np.concatenate((np.bincount(at[p], minlength=BINS), np.bincount(at[~p], minlength=BINS))).astype(float)

    s = sums(part)
    above_p, above_u = (np.cumsum(h[::-1]) / n for h, n in ((s[:BINS], n_p), (s[BINS:], n_u)))
    margin = np.sqrt(np.log(400) / 2 / n_p) + np.sqrt(np.log(400) / 2 / n_u)
    some = above_p > 0
    best = np.argmin((above_u[some] + margin) / above_p[some])
    return float(np.clip((above_u[some] / above_p[some])[best], *PRIORS))


def fit(sums: Sums, prior: float, mean: np.ndarray, scale: np.ndarray, n_p: float, n_u: float) -> tuple[np.ndarray, list[float]]:
    """(weights, second part of the risk after every step) of the model that
    minimises the non-negative unbiased risk."""
    k = 2 * N_FEATURES + 1

    def at(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(x: np.ndarray, p: np.ndarray) -> np.ndarray:
            d = design(x, mean, scale)
            f = d @ w
            weight, side = np.where(p, -prior / n_p, 1 / n_u), sigmoid(f)
            # the risk of calling a row good: of U, less the share that P explains
            negative = (weight * np.logaddexp(0, f)).sum()
            g = d.T @ np.where(p, -prior / n_p, side / n_u)
            h = (d * np.where(p, 0.0, side * (1 - side) / n_u)[:, None]).T @ d
            return np.concatenate(([negative], g, h.ravel()))

        s = sums(part)
        return s[0], s[1 : 1 + k], s[1 + k :].reshape(k, k)

    w = np.zeros(k)
    w[-1] = np.log(prior / (1 - prior))
    negative, g, h = at(w)
    seen = [negative]
    for _ in range(STEPS):
        move = np.clip(np.linalg.solve(h + DECAY * np.eye(k), g + DECAY * w), -4, 4)
        for _ in range(HALVINGS):
            after = at(w - move)
            if after[0] >= 0:
                break
            move = move / 2
        else:
            break  # at the border
        w = w - move
        negative, g, h = after
        seen.append(negative)
        if np.abs(move).max() < 1e-3:
            break
    return w, seen


def sums_over(rows: DataFrame) -> Sums:
    """Sums over a table (x array<double>, trusted boolean)."""

    def run(part: Part) -> np.ndarray:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    v = part(x, batch.column(1).to_numpy(zero_copy_only=False).astype(bool))
                    total = v if total is None else total + v
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

        found = rows.mapInArrow(task, "v array<double>")
        # one vector a task is too many for the driver with many tasks: add by place
        added = found.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(max((r["i"] for r in added), default=-1) + 1)
        for r in added:
            out[r["i"]] = r["v"]
        return out

    return run


# ------------------------------------------------------------------- operator


def _describe_column(text: Column, half: Column, ratios: list[np.ndarray]) -> Column:
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def measures(texts: pa.Array, halves: pa.Array) -> pa.Array:
        rows = [describe(t.as_py(), ratios[h]) for t, h in zip(texts, halves.to_pylist(), strict=True)]
        return pa.array(rows, pa.list_(pa.float64()))

    return measures(text, half)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_positive: int = MAX_POSITIVE) -> Model:
    """The model of all documents outside the held-out fold."""
    scratch = Scratch(docs.sparkSession, "classifier")
    learn = labels.where((fold(F.col("doc_id")) != HELD_OUT) & (F.col("quality") == 1) & F.col("doc_id").isNotNull())
    ids = learn.select(F.col("doc_id").alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(max_positive)
    ids = scratch.keep(ids, "ids")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")
    half = (F.pmod(F.xxhash64(F.col(id_col)), F.lit(2))).cast("int").alias("half")
    rows = docs.where(fold(F.col(id_col)) != HELD_OUT).select(F.col(id_col).alias("_id"), text, half)
    trusted = scratch.keep(ngrams.trusted_rows(rows, ids), "trusted")
    raw = ngrams.count(rows.select("text", F.col("half").alias("part")), 2)
    target = ngrams.count(trusted.select("text", F.col("half").alias("part")), 2)
    ratios = ngrams.log_ratio(target.sum(axis=0), raw.sum(axis=0))
    # each half is described by the other's ratios
    crossed = [ngrams.log_ratio(target[1 - h], raw[1 - h]) for h in (0, 1)]
    told = lambda df, p: df.select(_describe_column(F.col("text"), F.col("half"), crossed).alias("x"), F.lit(p).alias("trusted"))
    sums = sums_over(scratch.keep(told(rows, False).unionByName(told(trusted, True)), "described"))
    n_p, n_u, mean, scale = moments(sums) if target.sum() + trusted.count() and not rows.isEmpty() else (0.0, 0.0, np.zeros(1), np.ones(1))
    if not n_p or not n_u:
        return Model(DEFAULT_PRIOR, ratios, np.zeros(1), np.ones(1), None)
    prior = estimate_prior(sums, mean, scale, separate(sums, mean, scale, n_p, n_u), n_p, n_u)
    return Model(prior, ratios, mean, scale, fit(sums, prior, mean, scale, n_p, n_u)[0])


def score_column(text: Column, model: Model) -> Column:
    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        x = np.array([describe(t.as_py(), model.ratios) for t in texts])
        return pa.array(model.scores(x) if len(x) else [], pa.float64())

    return score(F.coalesce(text, F.lit("")).cast("binary"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col)) == HELD_OUT).alias("held_out"), score_column(F.col(text_col), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
