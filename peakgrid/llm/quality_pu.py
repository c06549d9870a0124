"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of quality 1; the unlabelled sample is drawn from all documents of the learning fold,
whatever their labels. A linear function over binned document statistics minimises the non-negative unbiased risk
(Kiryo et al., Positive-Unlabeled Learning with Non-Negative Risk Estimator, 2017). The class prior is estimated from these two
samples alone, by the threshold above which unlabelled documents are scarcest against positives (Garg et al., Mixture Proportion
Estimation and PU Learning, 2021), on scores of documents that the scoring function wasn't fitted on. Labels of quality 0 are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, textstats
from .quality_rules import stat_rows

#: Positives, and unlabelled documents, that the model is fitted on, at most.
TRAIN_MAX = 20_000
BINS = 16


@dataclass
class Model:
    edges: list[np.ndarray]
    weights: np.ndarray
    offset: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return expand(x, self.edges) @ self.weights + self.offset


def expand(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """For each statistic, which of its edges it passes (a step function of any shape is linear in these)."""
    return np.concatenate([(x[:, f, None] > e[None, :]).astype(np.float32) for f, e in enumerate(edges)], 1) if len(edges) else np.zeros((len(x), 0), np.float32)


def in_fold(doc_id: F.Column) -> F.Column:
    """Held out: CRC-32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def nn_risk(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 2.5) -> tuple[np.ndarray, float]:
    """Weights and offset that minimise prior * R(p, +) + max(0, R(u, -) - prior * R(p, -)) with sigmoid loss; where the second term is negative, only it is pushed back up. The ridge weighs less the more positives there are."""
    w, m, v, decay = np.zeros(p.shape[1] + 1), 0.0, 0.0, ridge / len(p)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    with_one = lambda a: np.c_[a, np.ones(len(a), np.float32)]
    p, u = with_one(p), with_one(u)
    for t in range(1, steps + 1):
        sp, su = sig(p @ w), sig(u @ w)
        dp, du = sp * (1 - sp) / len(p), su * (1 - su) / len(u)
        negative = su.mean() - prior * sp.mean()
        g_negative = du @ u - prior * (dp @ p)
        g = (-prior * (dp @ p) + g_negative if negative >= 0 else -g_negative) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def prior_of(p: np.ndarray, u: np.ndarray, sure: float = 0.1) -> float:
    """The class prior from scores of held-out positives and unlabelled rows: the least ratio of the shares above a score, each with its confidence bound."""
    cuts = np.unique(np.quantile(p, np.linspace(0, 0.99, 100)))
    qp = 1 - np.searchsorted(np.sort(p), cuts, side="left") / len(p)
    qu = 1 - np.searchsorted(np.sort(u), cuts, side="left") / len(u)
    slack = np.sqrt(np.log(4 / sure) / (2 * len(u))) + np.sqrt(np.log(4 / sure) / (2 * len(p)))
    best = np.argmin((qu + slack) / np.maximum(qp, 1e-9))
    return float(np.clip(qu[best] / max(qp[best], 1e-9), 0.05, 0.99))


def estimated_prior(z: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 4) -> float:
    """The class prior of the unlabelled rows of z: the mean of so many estimates. In each, rows are split into halves at random, each half is scored by what is fitted on the other, and the scores of both are put together."""
    found = []
    for seed in range(rounds):
        half = np.random.default_rng(seed).random(len(z)) < 0.5
        score = np.zeros(len(z))
        for part in (half, ~half):
            p, u = z[~part & positive], z[~part & unlabelled]
            if len(p) and len(u):
                w, b = nn_risk(p, u, 0.5, steps=200)
                score[part] = z[part] @ w + b
        found.append(prior_of(score[positive], score[unlabelled]))
    return float(np.mean(found))


def fit(docs: DataFrame, labels: DataFrame, train_max: int = TRAIN_MAX) -> Model:
    """Fit on at most train_max trusted positives and train_max unlabelled documents outside the held-out fold, both chosen by a hash of their ids. With fewer than ten of either every document is predicted to be good."""
    fold = F.col("doc_id").isNotNull() & ~in_fold(F.col("doc_id"))
    learn = lambda df: df.where(fold).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_max).distinct()
    good = learn(common.pick(labels, "doc_id", "quality").where("quality = 1").select("doc_id")).withColumn("kind", F.lit(1))
    web = learn(common.pick(docs, "doc_id")).withColumn("kind", F.lit(0))
    x, got = stat_rows(docs, good.unionByName(web).groupBy("doc_id").agg(F.bit_or(F.when(F.col("kind") == 1, 1).otherwise(2)).alias("kinds")))
    order = np.lexsort(x.T)
    x, kinds = x[order], got["kinds"][order].astype(int)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])] if len(x) else []
    z = expand(x, edges)
    positive, unlabelled = kinds & 1 > 0, kinds & 2 > 0
    if positive.sum() < 10 or unlabelled.sum() < 10:
        return Model(edges, np.zeros(z.shape[1]), 1.0, 1.0)
    prior = estimated_prior(z, positive, unlabelled)
    w, b = nn_risk(z[positive], z[unlabelled], prior)
    return Model(edges, w, b, prior)


def apply(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns keep of docs, then score (0 to 1) and predicted (1 if score >= 0.5), a row per row of docs, from the text alone.

    A null or empty text is scored as one without words; equal texts, and so repeated rows, score alike; a score of just 0.5 is predicted
    1. Very long texts are measured whole, in blocks. An empty table gives no rows. Columns of docs named score or predicted may be kept
    and stand before the new ones.
    """

    def fn(rows: list[bytes]) -> list[pa.Array]:
        score = 1 / (1 + np.exp(-np.clip(model.margin(textstats.measure_all(rows)[1]), -40, 40)))
        return [pa.array(score.astype(np.float64)), pa.array((score >= 0.5).astype(np.int32))]

    return common.append(docs, "text", fn, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], keep)
