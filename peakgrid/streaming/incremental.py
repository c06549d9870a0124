"""Incremental detection on streams: the batch operator per micro-batch over a table of representatives, or state kept per charge and bucket."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import anomaly
from ..params import Params
from ..plans import scratch

BLOCK = 1 << 22  # distances held at once
#: Representatives in one entry of the state.
CHUNK = 256
GROUP = anomaly.GROUP
STATE = "precursor_charge int, bucket int, rep_id long, cluster long, precursor_mz double, hv array<long>, size long, flagged boolean, near double"
RESULT = "precursor_charge int, bucket int, spectrum_id long, best_rep long, best_dist double, anomaly_eps double, cluster long, is_representative boolean, anomaly boolean"


def start(stream: DataFrame, history: DataFrame, p: Params, dim: int, path: str, checkpoint: str) -> StreamingQuery:
    """Assign each micro-batch to history and to all batches before it. Results go to path/batch=<number>, and what is carried on, the representatives with their nearest distances and the range of precursors, to path/_state and path/_range.

    A batch reads its spectra and the state after the batch before it, not the results; one that is run again overwrites its own tables.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        with scratch.scope(spark):
            if number:
                state = spark.read.schema(STATE).parquet(f"{path}/_state/batch={number - 1}")
                span = spark.read.schema("_low double, _high double").parquet(f"{path}/_range/batch={number - 1}")
            else:
                state = anomaly.start_state(history, p, dim).select(*[F.col(f.name).cast(f.dataType) for f in spark.createDataFrame([], STATE).schema])
                span = history.agg(F.min("precursor_mz").alias("_low"), F.max("precursor_mz").alias("_high"))
            span = scratch.table(span)
            new = scratch.table(batch)
            got = anomaly.assign_to(new.crossJoin(F.broadcast(span)), state, p, dim)  # one row
            got.write.mode("overwrite").parquet(f"{path}/batch={number}")
            got = spark.read.schema(got.schema).parquet(f"{path}/batch={number}")
            anomaly.grown(state, got, p, dim).write.mode("overwrite").parquet(f"{path}/_state/batch={number}")
            wider = span.unionByName(new.agg(F.min("precursor_mz").alias("_low"), F.max("precursor_mz").alias("_high")))
            wider.agg(F.min("_low").alias("_low"), F.max("_high").alias("_high")).write.mode("overwrite").parquet(f"{path}/_range/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB, which stateful() needs; the setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def stateful(stream: DataFrame, history: DataFrame | None, p: Params, dim: int, low: float, high: float, ttl_ms: int | None = None) -> DataFrame:
    """RESULT as a stream, which is what anomaly.fold_batches() makes of the same batches, with each group's representatives as state. Start it inside keyed_state().

    history is the table that anomaly.start_state() makes, or None; low and high are the range of precursors of the history, which decides
    about groups that have none. All settings of p hold as they do for batches. Within a micro-batch a group's spectra are compared
    with the state as it was before the batch. The state is a map by precursor band: vectors, which are only added to, and beside them
    nearest distances, sizes and clusters, so that a batch reads the vectors of its spectra's bands and writes in proportion to what is new.
    With ttl_ms a representative is forgotten so long after the last one was added to its entry; such a stream makes empty batches while
    nothing comes, and doesn't end by itself. Clusters of history without a marked representative
    keep the one of their least id.
    """
    keyed = stream.select(*GROUP, "spectrum_id", "precursor_mz", "hv").groupBy(*GROUP)
    begin = None if history is None else history.select(*GROUP, "rep_id", "cluster", "precursor_mz", "hv", "size", "flagged", "near").groupBy(*GROUP)
    return keyed.transformWithStateInPandas(Detector(p, dim, low, high, ttl_ms), RESULT, "append", "ProcessingTime" if ttl_ms else "None", begin)


class Detector(StatefulProcessor):
    """One group's representatives. `vectors` and `light` are maps by band and number of the entry within it."""

    def __init__(self, p: Params, dim: int, low: float, high: float, ttl_ms: int | None) -> None:
        self.p, self.dim, self.low, self.high, self.ttl = p, dim, low, high, ttl_ms
        self.step = 2 * math.log1p(p.precursor_tol * 1e-6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        key = "band long, entry int"
        self.vectors = handle.getMapState("vectors", key, "mz array<double>, hv array<long>", self.ttl)
        self.light = handle.getMapState("light", key, "ids array<long>, clusters array<long>, near array<double>, sizes array<long>, flagged array<boolean>, born long", self.ttl)

    def close(self) -> None:
        pass

    def bands(self, mz: np.ndarray) -> np.ndarray:
        return np.floor(np.log(mz) / self.step).astype(np.int64)

    def now(self, timer) -> int:  # noqa: ANN001
        return timer.getCurrentProcessingTimeInMs() if self.ttl else 0

    def load(self, now: int) -> dict[tuple[int, int], dict]:
        """All entries without their vectors; those that are too old are removed."""
        found, gone = {}, []
        for k, v in self.light.iterator():
            k = (int(k[0]), int(k[1]))
            if self.ttl and now - v[5] > self.ttl:
                gone.append(k)
            else:
                found[k] = {"ids": list(v[0]), "clusters": list(v[1]), "near": list(v[2]), "sizes": list(v[3]), "flagged": list(v[4]), "born": v[5]}
        for k in gone:
            self.light.removeKey(k)
            self.vectors.removeKey(k)
        return found

    def save(self, key: tuple[int, int], e: dict) -> None:
        self.light.updateValue(key, (e["ids"], e["clusters"], e["near"], e["sizes"], e["flagged"], e["born"]))

    def seen(self, state: dict, bands: set[int]) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the entries of bands, and of their representatives the entry's place among the keys, m/z and vectors."""
        keys = sorted(k for k in state if k[0] in bands)
        at, mz, hv = [], [], []
        for n, k in enumerate(keys):
            v = self.vectors.getValue(k)
            at += [n] * len(v[0])
            mz += list(v[0])
            hv += list(v[1])
        return keys, np.array(at, int), np.array(mz, float), np.array(hv, np.int64).reshape(len(mz), self.dim // 32)

    def add(self, state: dict, now: int, ids: np.ndarray, clusters: np.ndarray, mz: np.ndarray, hv: np.ndarray, sizes: np.ndarray, flagged: np.ndarray, near: np.ndarray) -> set[tuple[int, int]]:
        """Put representatives into the last entries of their bands, new ones where these are full; returns the keys."""
        touched = set()
        bands = self.bands(mz)
        for band in np.unique(bands):
            rows = np.flatnonzero(bands == band)
            entry = max((e for b, e in state if b == band), default=-1)
            while len(rows):
                key = (int(band), max(entry, 0))
                e = state.get(key)
                if e is not None and len(e["ids"]) >= CHUNK:
                    entry += 1
                    continue
                old = ([], []) if e is None else self.vectors.getValue(key)
                e = state.setdefault(key, {"ids": [], "clusters": [], "near": [], "sizes": [], "flagged": [], "born": now})
                some, rows = rows[: CHUNK - len(e["ids"])], rows[CHUNK - len(e["ids"]) :]
                for name, values in (("ids", ids), ("clusters", clusters), ("near", near), ("sizes", sizes), ("flagged", flagged)):
                    e[name] += values[some].tolist()
                e["born"] = now
                self.vectors.updateValue(key, (list(old[0]) + mz[some].tolist(), list(old[1]) + hv[some].ravel().tolist()))
                touched.add(key)
                entry = key[1]
        return touched

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: ANN001, N802, N803
        pdf, now = initialState, self.now(timerValues)
        state = self.load(now)
        hv = np.array(pdf.hv.tolist(), np.int64).reshape(len(pdf), -1)
        near = pdf.near.fillna(1.0).to_numpy(float)
        touched = self.add(state, now, pdf.rep_id.to_numpy(), pdf.cluster.to_numpy(), pdf.precursor_mz.to_numpy(float), hv, pdf["size"].to_numpy(), pdf.flagged.to_numpy(bool), near)
        for k in touched:
            self.save(k, state[k])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        now, p = self.now(timerValues), self.p
        pdf = pd.concat(list(rows)).sort_values("spectrum_id")
        hv, mz = np.array(pdf.hv.tolist(), np.int64).reshape(len(pdf), self.dim // 32), pdf.precursor_mz.to_numpy(float)
        ids, n = pdf.spectrum_id.to_numpy(), len(pdf)
        state = self.load(now)
        known = bool(state)
        marked = any(any(e["flagged"]) for e in state.values())
        best, dist, eps = [None] * n, [None] * n, None
        sizes = np.ones(n, np.int64)
        touched: set[tuple[int, int]] = set()
        if (not known and p.no_history == "cluster") or (known and not marked):
            cluster, new = fresh(ids, mz, hv, p, self.dim)
            flag = np.zeros(n, bool)
            sizes = np.array([int((cluster == c).sum()) if c is not None else 1 for c in cluster])
        elif not known:
            cluster, new = np.array([None] * n, object), np.ones(n, bool)
            flag = np.full(n, bool(mz[0] > self.high or mz[0] < self.low))
        else:
            everyone = list(state.values())
            eps = threshold(np.concatenate([e["near"] for e in everyone]), np.concatenate([e["sizes"] for e in everyone]), p)
            first, joined = min((i, c) for e in everyone for i, c in zip(e["ids"], e["clusters"], strict=True))
            here = self.bands(mz)
            keys, _, rmz, rhv = self.seen(state, {int(b) + k for b in here for k in (-1, 0, 1)})
            rid = np.array([i for k in keys for i in state[k]["ids"]], np.int64)
            rcluster = np.array([c for k in keys for c in state[k]["clusters"]], np.int64)
            who, least = np.full(n, first), np.ones(n)
            to = np.full(n, joined)
            if len(rid):
                at, d = closest(rid, rmz, rhv, mz, hv, p.precursor_tol, self.dim)
                nearer = (d < 1) | ((d == 1) & (rid[at] < first))
                who, least, to = np.where(nearer, rid[at], who), np.where(nearer, d, least), np.where(nearer, rcluster[at], to)
            new = least > eps
            best, dist = who.tolist(), least.tolist()
            cluster, flag = np.where(new, ids, to).astype(object), new
            more = pd.Series(to[~new]).value_counts()
            for k, e in state.items():
                for r, c in enumerate(e["clusters"]):
                    if c in more.index:
                        e["sizes"][r] += int(more[c])
                        touched.add(k)
        named = np.array([i if c is None else c for i, c in zip(ids, cluster, strict=True)], np.int64)
        if new.any():
            touched |= self.found(state, now, ids[new], named[new], mz[new], hv[new], sizes[new])
        for k in touched:
            self.save(k, state[k])
        yield pd.DataFrame({
            "precursor_charge": key[0], "bucket": key[1], "spectrum_id": ids, "best_rep": pd.array(best, "Int64"), "best_dist": pd.array(dist, "Float64"),
            "anomaly_eps": pd.array([eps] * n, "Float64"), "cluster": pd.array(list(cluster), "Int64"), "is_representative": new, "anomaly": flag,
        })

    def found(self, state: dict, now: int, ids: np.ndarray, clusters: np.ndarray, mz: np.ndarray, hv: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int]]:
        """Add marked representatives and bring nearest distances up to date, of them and of those near them."""
        keys, at, rmz, rhv = self.seen(state, {int(b) + k for b in self.bands(mz) for k in (-1, 0, 1)})
        rid = np.array([i for k in keys for i in state[k]["ids"]], np.int64)
        old = np.array([x for k in keys for x in state[k]["near"]], float)
        near = np.minimum(nearest(old, np.concatenate([rid, ids]), np.concatenate([rmz, mz]), np.concatenate([rhv, hv]), self.p.precursor_tol, self.dim), 1.0)
        touched = set()
        for n in np.unique(at[near[: len(rid)] < old]):
            state[keys[n]]["near"] = near[: len(rid)][at == n].tolist()
            touched.add(keys[n])
        return touched | self.add(state, now, ids, clusters, mz, hv, sizes, np.ones(len(ids), bool), near[len(rid) :])


def fresh(ids: np.ndarray, mz: np.ndarray, hv: np.ndarray, p: Params, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Clusters (None: noise) and marks of a group's spectra, in order of their ids, among themselves: components within p.eps, each with its medoid, as anomaly.afresh() makes them."""
    n = len(ids)
    up = list(range(n))
    similar = np.zeros(n)

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    step = max(1, BLOCK // max(n, 1))
    blocks = []
    for at in range(0, n, step):
        d = masked(hv, mz, hv[at : at + step], mz[at : at + step], p.precursor_tol, dim)
        # the tolerance is in ppm of the later one
        later = np.arange(n)[None] > np.arange(at, at + len(d))[:, None]
        d = np.where(later, np.where(np.abs(mz[None] - mz[at : at + len(d), None]) / mz[None] < p.precursor_tol * 1e-6, hamming(hv, hv[at : at + len(d)], dim), 1.0), d)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        for i, j in zip(*np.nonzero(d <= p.eps), strict=True):
            a, b = root(at + int(i)), root(int(j))
            up[max(a, b)] = min(a, b)
        blocks.append(d)
    of = np.array([root(i) for i in range(n)])
    at = 0
    for d in blocks:
        same = of[at : at + len(d), None] == of[None]
        similar[at : at + len(d)] = np.where(same & np.isfinite(d), 1.0 - np.where(np.isfinite(d), d, 1.0), 0.0).sum(1)
        at += len(d)
    cluster, mark = np.array([None] * n, object), np.zeros(n, bool)
    for r in np.unique(of):
        rows = np.flatnonzero(of == r)
        if len(rows) == 1:
            mark[rows] = True
            continue
        cluster[rows] = int(ids[rows[0]])
        mean = np.round((len(rows) - 1 - similar[rows]) / len(rows), 9)
        mark[rows[0] if len(rows) == 2 else rows[int(mean.argmin())]] = True
    return cluster, mark


def masked(a_hv: np.ndarray, a_mz: np.ndarray, b_hv: np.ndarray, b_mz: np.ndarray, tol: float, dim: int) -> np.ndarray:
    """Distances, a row per b and a column per a; 1 beyond the tolerance, in ppm of b."""
    return np.where(np.abs(a_mz[None] - b_mz[:, None]) / b_mz[:, None] < tol * 1e-6, hamming(a_hv, b_hv, dim), 1.0)


def closest(rid: np.ndarray, rmz: np.ndarray, rhv: np.ndarray, mz: np.ndarray, hv: np.ndarray, tol: float, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """For each new spectrum the place of the nearest representative, that of the least id among equals, and its distance."""
    order, step = np.argsort(rid), max(1, BLOCK // len(rid))
    best, least = np.empty(len(mz), np.int64), np.empty(len(mz))
    for at in range(0, len(mz), step):
        d = masked(rhv[order], rmz[order], hv[at : at + step], mz[at : at + step], tol, dim)
        first = d.argmin(1)
        best[at : at + step], least[at : at + step] = order[first], d[np.arange(len(d)), first]
    return best, least


def hamming(a: np.ndarray, b: np.ndarray, dim: int) -> np.ndarray:
    """Shares of differing bits, a row per b and a column per a; word by word, so that no array has more than len(a) * len(b) entries."""
    d = np.zeros((len(b), len(a)), np.int32)
    for word in range(a.shape[1]):
        d += np.bitwise_count(b[:, None, word] ^ a[None, :, word])
    return d / dim


def nearest(near: np.ndarray, ids: np.ndarray, mz: np.ndarray, hv: np.ndarray, tol: float, dim: int) -> np.ndarray:
    """The distance from each to the nearest other one (infinity if there is none), where near has it for the first len(near) among themselves. Tolerances are in ppm of the one with the larger id."""
    n, out = len(near), np.concatenate([near, np.full(len(ids) - len(near), np.inf)])
    step = max(1, BLOCK // len(ids))
    for at in range(n, len(ids), step):
        b = np.arange(at, min(at + step, len(ids)))
        of = np.where(ids[b, None] > ids[None], mz[b, None], mz[None])
        d = np.where(np.abs(mz[None] - mz[b, None]) / of < tol * 1e-6, hamming(hv, hv[b], dim), 1.0)
        d[np.arange(len(b)), b] = np.inf
        out[b] = np.minimum(out[b], d.min(1))
        out = np.minimum(out, d.min(0))
    return out


def weighted(values: np.ndarray, weights: np.ndarray, percent: float) -> float:
    """The least value up to which at least this percentage of the weight lies."""
    order = np.argsort(values, kind="stable")
    return float(values[order][np.searchsorted(np.cumsum(weights[order]), percent / 100.0 * weights.sum())])


def threshold(near: np.ndarray, sizes: np.ndarray, p: Params) -> float:
    """As anomaly.thresholds for one group, from its representatives' nearest distances and clusters' sizes."""
    kind, cap = p.anomaly_threshold, p.anomaly_cap
    if kind == "fixed":
        return p.anomaly_eps
    if kind not in ("percentile", "weighted", "mean", "median", "mad"):
        raise ValueError(f"unknown threshold {kind!r}")
    if len(near) < 2:
        return cap
    if kind == "percentile":
        at = float(np.percentile(near, p.anomaly_percentile)) + p.anomaly_margin
    elif kind == "mean":
        m = float((near * sizes).sum() / sizes.sum())
        at = m + math.sqrt(max(float((near * near * sizes).sum() / sizes.sum()) - m * m, 0.0))
    else:
        at = weighted(near, sizes, p.anomaly_percentile if kind == "weighted" else 50)
        if kind == "mad":
            at += 3 * 1.4826 * weighted(np.abs(near - at), sizes, 50)
    return min(at, cap)


def labelled(results: DataFrame) -> DataFrame:
    """Results of stateful() with noise named by its own spectrum, as batch results name it."""
    return results.withColumn("cluster", F.coalesce("cluster", "spectrum_id"))
