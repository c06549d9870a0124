"""Classical outlier detectors over dense feature vectors (column x, array<double>, beside spectrum_id).

Models whose fit needs all pairs or many passes are fitted on a bounded sample, drawn by a hash of the id, on the driver, and score all
rows in numpy over Arrow batches. All return df with score (higher: more normal) and outlier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import table
from . import knn, quantiles
from .splits import draw

#: Rows that models are fitted on, at most.
SAMPLE = 10_000
#: Rows that the pair of subspaces is fitted on, at most.
SUBSPACE_SAMPLE = 20_000
#: Columns of the kernel that are kept, 80 MB of SAMPLE rows.
COLUMNS = 1_000


def features(binned: DataFrame, bins: int, value: str = "intensity") -> DataFrame:
    """(spectrum_id, x): binned values as arrays of a fixed length, absent bins 0."""
    maps = binned.groupBy("spectrum_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", value))).alias("m"))
    return maps.select("spectrum_id", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("x"))


def log_features(df: DataFrame, magnitude: bool = False) -> DataFrame:
    """x as log1p; with magnitude, log1p of the sum of x behind it."""
    logs = F.transform("x", lambda v: F.log1p(v))
    total = F.log1p(F.aggregate("x", F.lit(0.0), lambda a, v: a + v))
    return df.withColumn("x", F.concat(logs, F.array(total)) if magnitude else logs)


def sample(df: DataFrame, n: int = SAMPLE) -> np.ndarray:
    rows = df.select("spectrum_id", "x").orderBy(draw("spectrum_id"), "spectrum_id").limit(n).toArrow().column("x").to_pylist()
    return np.array(rows, float).reshape(len(rows), -1)


def scored(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """df with score: fn of the rows' vectors, batch by batch."""
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    at = df.columns.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.asarray(fn(x), float))], names=schema.names)

    return df.mapInArrow(run, schema)


def flag_share(df: DataFrame, contamination: float) -> DataFrame:
    """df with outlier: whether the score is below the linear percentile of this share."""
    df = table(df)  # scored once
    return df.withColumn("outlier", F.col("score") < F.lit(quantiles.percentile(df, "score", contamination)))


# ---- principal components ---------------------------------------------------------------------------------------------------


def pca(df: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (n rows) and their shares of the variance, from all rows."""
    v = df.select(array_to_vector("x").alias("v"))
    mean = v.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray()
    model = PCA(k=min(n, len(mean)), inputCol="v", outputCol="p").fit(v)
    return mean, model.pc.toArray().T, model.explainedVariance.toArray()


def project(df: DataFrame, mean: np.ndarray, parts: np.ndarray) -> DataFrame:
    """x as coordinates on the components, centred first."""
    at = df.columns.index("x")
    schema = T.StructType([f if f.name != "x" else T.StructField("x", T.ArrayType(T.DoubleType())) for f in df.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = (b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) - mean) @ parts.T
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([c if i != at else lists for i, c in enumerate(b.columns)], names=schema.names)

    return df.mapInArrow(run, schema)


def one_class_pca(df: DataFrame, contamination: float, n: int = 5) -> DataFrame:
    """Score: minus the distance between a row and its reconstruction; outliers lie beyond the percentile of 1 - contamination."""
    mean, parts, _ = pca(df, n)

    def fn(x: np.ndarray) -> np.ndarray:
        z = x - mean
        return -np.linalg.norm(z - z @ parts.T @ parts, axis=1)

    return flag_share(scored(df, fn), contamination)


# ---- isolation forest -------------------------------------------------------------------------------------------------------


def path_length(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def isolation_forest(df: DataFrame, contamination: float, trees: int = 100, each: int = 256, seed: int = 42) -> DataFrame:
    """Isolation forest with trees of `each` sampled rows; score is minus 2^(-depth / expected depth)."""
    rows = sample(df)
    rng = np.random.default_rng(seed)
    size = min(each, len(rows))
    limit = int(np.ceil(np.log2(max(size, 2))))
    feature, cut, left, right, depth, roots = [], [], [], [], [], []

    def grow(x: np.ndarray, d: int) -> int:
        at = len(feature)
        for column, v in ((feature, 0), (cut, 0.0), (left, at), (right, at), (depth, d + float(path_length(len(x))))):
            column.append(v)
        span = np.ptp(x, axis=0) if len(x) > 1 else np.zeros(1)
        if d < limit and len(x) > 1 and span.any():
            f = int(rng.choice(np.flatnonzero(span)))
            c = float(rng.uniform(x[:, f].min(), x[:, f].max()))
            feature[at], cut[at] = f, c
            left[at] = grow(x[x[:, f] <= c], d + 1)
            right[at] = grow(x[x[:, f] > c], d + 1)
        return at

    for _ in range(trees if size else 0):
        roots.append(grow(rows[rng.choice(len(rows), size, replace=False)], 0))
    f, c, lo, hi, dep, root = np.array(feature, int), np.array(cut), np.array(left, int), np.array(right, int), np.array(depth), np.array(roots, int)
    expected = max(float(path_length(size)), 1e-9)

    def fn(x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(root, (len(x), len(root)))
        line = np.arange(len(x))[:, None]
        for _ in range(limit):
            at = np.where(x[line, f[at]] <= c[at], lo[at], hi[at])
        return -(2.0 ** (-dep[at].mean(1) / expected))

    return flag_share(scored(df, fn), contamination)


# ---- one-class support vector machine ---------------------------------------------------------------------------------------


def one_class_svm(df: DataFrame, contamination: float, most: int = SAMPLE, steps: int = 1_000_000) -> DataFrame:
    """One-class machine with a radial kernel, gamma 1 / (columns * variance) and nu the contamination, fitted on `most` sampled rows at most by pairwise steps on the dual; score is the decision function, outliers are below 0.

    Columns of the kernel are made as steps need them and the latest are kept, so that the driver never holds the whole matrix. Steps
    go on until the dual's conditions hold within the tolerance; `steps` only ends a fit that never would, with an error.
    """
    rows = sample(df, most)
    n = len(rows)
    nu = float(np.clip(contamination, 1e-5, 1 - 1e-5))
    gamma = 1.0 / max(rows.shape[1] * rows.var(), 1e-12) if n else 1.0

    def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))

    top = 1.0 / max(nu * n, 1.0)
    alpha = np.zeros(n)
    whole = int(nu * n)
    alpha[:whole] = top
    if whole < n:
        alpha[whole] = 1 - alpha.sum()
    first = np.flatnonzero(alpha)
    g = np.zeros(n)
    for s in range(0, n, 1_000):
        g[s : s + 1_000] = kernel(rows[s : s + 1_000], rows[first]) @ alpha[first]
    squares = (rows * rows).sum(1)
    columns: dict[int, np.ndarray] = {}

    def column(i: int) -> np.ndarray:
        if i in columns:
            columns[i] = columns.pop(i)
        else:
            if len(columns) >= COLUMNS:
                del columns[next(iter(columns))]
            columns[i] = np.exp(-gamma * np.maximum(squares + squares[i] - 2 * rows @ rows[i], 0))
        return columns[i]

    for _ in range(steps if n else 0):  # move weight from the point of greatest gradient to that of the least
        up, down = np.where(alpha < top - 1e-12, g, np.inf), np.where(alpha > 1e-12, g, -np.inf)
        i, j = int(up.argmin()), int(down.argmax())
        if g[j] - g[i] < 1e-4 * max(abs(g).mean(), 1e-12):
            break
        ki, kj = column(i), column(j)
        move = min((g[j] - g[i]) / max(ki[i] + kj[j] - 2 * ki[j], 1e-12), top - alpha[i], alpha[j])
        alpha[i] += move
        alpha[j] -= move
        g += move * (ki - kj)
    else:
        if n:
            raise RuntimeError(f"the machine didn't settle in {steps} steps")
    free = (alpha > 1e-9) & (alpha < top - 1e-9)
    rho = float(g[free].mean()) if free.any() else float((g[alpha > 1e-12].max() if (alpha > 1e-12).any() else 0) + g.min()) / 2 if n else 0.0
    keep = alpha > 1e-12
    sv, weight = rows[keep], alpha[keep]
    out = scored(df, lambda x: kernel(x, sv) @ weight - rho)
    return out.withColumn("outlier", F.col("score") < 0)


# ---- local outlier factor ---------------------------------------------------------------------------------------------------


def local_outlier_factor(df: DataFrame, contamination: float, k: int = 20) -> DataFrame:
    """Local outlier factor of the distinct vectors (rounded to 6 places), given back to all rows; score is minus the factor. k is at most the number of distinct vectors less 1; a single one has score -1."""
    rounded = df.withColumn("_key", F.transform("x", lambda v: F.round(v, 6) + 0.0))
    points = table(rounded.groupBy("_key").agg(F.min("spectrum_id").alias("point")).select("point", F.col("_key").alias("x")))
    k = min(k, points.count() - 1)
    if k < 1:
        return df.withColumn("score", F.lit(-1.0)).withColumn("outlier", F.lit(False))
    near = table(knn.nearest(points, k))
    reach = near.groupBy("point").agg(F.max("d").alias("kd"))
    dist = near.join(reach.select(F.col("point").alias("other"), F.col("kd").alias("_okd")), "other").withColumn("_r", F.greatest("d", "_okd"))
    lrd = dist.groupBy("point").agg((F.lit(1.0) / (F.avg("_r") + 1e-10)).alias("lrd"))
    factor = near.join(lrd.select(F.col("point").alias("other"), F.col("lrd").alias("_olrd")), "other").groupBy("point").agg(F.avg("_olrd").alias("_m")).join(lrd, "point")
    by_key = points.join(factor.select("point", (-F.col("_m") / F.col("lrd")).alias("score")), "point").select(F.col("x").alias("_key"), "score")
    by_key = table(by_key)
    return rounded.join(by_key, "_key").withColumn("outlier", F.col("score") < F.lit(quantiles.percentile(by_key, "score", contamination))).drop("_key")


# ---- pairs of orthonormal subspaces -----------------------------------------------------------------------------------------


def subspace_pair(df: DataFrame, k: int = 5, eta: float = 0.01, ridge: float = 0.1, most: int = SUBSPACE_SAMPLE, steps: int = 1_000, seed: int = 42) -> DataFrame:
    """One-class classifier by two orthonormal frames: rows, at their own length, should lie above the first and below the second. score: the lesser margin; outliers are at or beyond either.

    The cost (squared hinge of the least and of the greatest projection, and a ridge) is lowered on `most` sampled rows by conjugate
    gradients on the manifold of pairs of frames: the last direction is carried to the new place by projection, its share is the
    non-negative one of Polak and Ribiere, a step is halved until the cost falls enough, and QR leads back to frames.
    """
    x = sample(df, most)
    n, d = x.shape if len(x) else (0, 1)
    k = min(k, d)
    rng = np.random.default_rng(seed)
    w = [np.linalg.qr(rng.standard_normal((d, k)))[0] for _ in range(2)]
    b = [np.zeros(k), np.zeros(k)]

    def cost(w: list[np.ndarray], b: list[np.ndarray]) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
        total, gw, gb = 0.0, [], []
        for side, sign in ((0, -1.0), (1, 1.0)):
            z = x @ w[side] + b[side]
            worst = z.argmin(1) if sign < 0 else z.argmax(1)
            at = np.arange(n)
            h = np.maximum(0, eta + sign * z[at, worst])
            g = 2 * ridge * z
            g[at, worst] += 2 * sign * h
            total += (h * h).sum() + ridge * (z * z).sum()
            gw.append(x.T @ g / max(n, 1))
            gb.append(g.sum(0) / max(n, 1))
        return total / max(n, 1), gw, gb

    def tangent(w: list[np.ndarray], v: list[np.ndarray]) -> list[np.ndarray]:
        """The parts of v along the manifold at w: of the frames without what would stretch them, of the offsets all."""
        return [*[g - f @ (f.T @ g + g.T @ f) / 2 for f, g in zip(w, v, strict=False)], *v[2:]]

    def dot(u: list[np.ndarray], v: list[np.ndarray]) -> float:
        return float(sum((a * b).sum() for a, b in zip(u, v, strict=True)))

    def moved(w: list[np.ndarray], b: list[np.ndarray], way: list[np.ndarray], t: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
        out = []
        for f, g in zip(w, way, strict=False):
            q, r = np.linalg.qr(f + t * g)
            out.append(q * np.where(np.diag(r) < 0, -1.0, 1.0))
        return out, [v + t * g for v, g in zip(b, way[2:], strict=True)]

    now, gw, gb = cost(w, b)
    g = tangent(w, [*gw, *gb])
    way, rate = [-v for v in g], 0.5
    for _ in range(steps if n else 0):
        slope = dot(g, way)
        if slope >= 0:  # no way down any more: begin again with the gradient
            way, slope = [-v for v in g], -dot(g, g)
        if -slope < 1e-12:
            break
        t = rate
        while True:
            trial_w, trial_b = moved(w, b, way, t)
            then, gw, gb = cost(trial_w, trial_b)
            if then <= now + 1e-4 * t * slope or t < 1e-14:
                break
            t /= 2
        if then >= now:
            break
        w, b, now, rate = trial_w, trial_b, then, min(2 * t, 1e3)
        new = tangent(w, [*gw, *gb])
        old, carried = tangent(w, g), tangent(w, way)  # transported to the new place
        beta = max(0.0, (dot(new, new) - dot(new, old)) / max(dot(g, g), 1e-300))
        way, g = [-v + beta * c for v, c in zip(new, carried, strict=True)], new

    def fn(v: np.ndarray) -> np.ndarray:
        return np.minimum((v @ w[0] + b[0]).min(1), -(v @ w[1] + b[1]).max(1))

    return scored(df, fn).withColumn("outlier", F.col("score") <= 0)
