"""Clusters of spectra: components and hierarchical linkage of distance edges, refinement, medoids and labels."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import cut, table
from .graph import components

GROUP = ["precursor_charge", "bucket"]
#: Spectra in one linkage matrix, 32 MB. Larger components are linked by joins, with the same result.
LINKAGE_MAX = 2_000
#: Steps of a similarity in average linkage; exact for shares of a power of two of bits.
STEPS = 1 << 24


def dbscan(df: DataFrame, edges: DataFrame, eps: float, min_samples: int = 2) -> DataFrame:
    """df with cluster: DBSCAN with min_samples of 1 or 2 on the distances in edges (id_a, id_b, dist), which are the components of those up to eps.

    The cluster is its least spectrum_id. A spectrum without a neighbour is noise (null) for min_samples = 2, else its own cluster.
    """
    if min_samples not in (1, 2):
        raise ValueError("min_samples must be 1 or 2")
    near = components(edges.where(F.col("dist") <= eps).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    alone = F.lit(None) if min_samples == 2 else F.col("spectrum_id")
    return df.join(near.withColumnRenamed("node", "spectrum_id"), "spectrum_id", "left").withColumn("cluster", F.coalesce("root", alone)).drop("root")


def linkage_labels(dist: np.ndarray, eps: float, how: str, copies: np.ndarray | None = None) -> np.ndarray:
    """Flat clusters of a dense distance matrix by single, complete or average linkage, cut at eps (a merge at exactly eps still counts). Labels are the least member's place. copies: how many equal members a place stands for.

    The pair of clusters that merges next is that with the least (distance, least place, other place), a cluster's place being its least
    member's. Nearest-neighbour chains in that order find the same merges, since no merge brings a third cluster forward in it.
    Averages are quotients of whole numbers (similarities in steps of 2^-24), so that equal ones are equal however they come about.
    """
    n = len(dist)
    size = np.ones(n, np.int64) if copies is None else copies.astype(np.int64)
    if how == "average":
        d = similarity(dist) * size[:, None] * size[None]
        np.fill_diagonal(d, 0)
    else:
        d = dist.astype(float).copy()
        np.fill_diagonal(d, np.inf)
    live = np.ones(n, bool)
    chain: list[int] = []
    merges: list[tuple[float, int, int]] = []

    def row(a: int) -> np.ndarray:
        far = 1.0 - d[a] / (size[a] * size * STEPS) if how == "average" else d[a]
        far = np.where(live, far, np.inf)
        far[a] = np.inf
        return far

    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(live)[0]))
        while True:
            a = chain[-1]
            far = row(a)
            b = int(far.argmin())  # the least place of equally near ones, which makes the least pair
            if len(chain) > 1 and b == chain[-2]:
                break
            if not np.isfinite(far[b]):
                return flat(merges, n, eps)
            chain.append(b)
        chain = chain[:-2]
        merges.append((float(far[b]), min(a, b), max(a, b)))
        keep, gone = min(a, b), max(a, b)
        d[keep] = d[a] + d[b] if how == "average" else np.maximum(d[a], d[b]) if how == "complete" else np.minimum(d[a], d[b])
        d[:, keep] = d[keep]
        d[keep, keep] = 0 if how == "average" else np.inf
        size[keep] += size[gone]
        live[gone] = False
    return flat(merges, n, eps)


def similarity(dist: np.ndarray) -> np.ndarray:
    """1 less the distance in whole steps of 1 / STEPS."""
    return np.rint((1.0 - dist) * STEPS).astype(np.int64)


def flat(merges: list[tuple[float, int, int]], n: int, eps: float) -> np.ndarray:
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for height, a, b in sorted(merges):
        if height <= eps + 1e-12:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return np.array([root(i) for i in range(n)])


def by_group(df: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType) -> DataFrame:
    """fn of each group's rows, as applyInPandas, but many small groups share an Arrow batch: rows are dealt and sorted by key and cut where it changes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            k = pdf[key].to_numpy()
            at = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
            return pd.concat([fn(pdf.iloc[s:e]) for s, e in zip(at, at[1:], strict=False)], ignore_index=True)

        for b in batches:
            if not len(b):
                continue
            k = b[key].to_numpy()
            if rest and rest[-1][key].iloc[-1] == k[-1]:
                rest.append(b)  # one group goes on through the whole batch
                continue
            last = int(np.searchsorted(k, k[-1], side="left"))
            done = pd.concat([*rest, b.iloc[:last]], ignore_index=True)
            rest = [b.iloc[last:]]
            if len(done):
                yield solve(done)
        if rest:
            yield solve(pd.concat(rest, ignore_index=True))

    return df.repartition(key).sortWithinPartitions(key).mapInPandas(run, schema)


def hierarchical(df: DataFrame, edges: DataFrame, eps: float, how: str = "complete") -> DataFrame:
    """df with cluster: hierarchical linkage of the group's masked distances, cut at eps < 1; the cluster is its least spectrum_id.

    A merge at height up to eps needs at least one pair within eps, so that no cluster leaves its component of the graph of such pairs.
    Each component is linked on its own, in one task, instead of each bucket; one of over LINKAGE_MAX is linked by joins, in the same
    order of merges: by (distance, least id, other id). Single linkage is the component itself. Pairs that edges doesn't hold have distance 1. A column copies of df counts how many spectra a row stands for.
    """
    if eps >= 1:
        raise ValueError("eps must be less than 1, the distance of masked pairs")
    parts = cut(components(edges.where(F.col("dist") <= eps).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))))
    if how == "single":
        named = parts.select(F.col("node").alias("spectrum_id"), F.col("root").alias("cluster"))
    else:
        # a pair on its own is a cluster; only larger components need linking
        size = parts.groupBy("root").agg(F.count("*").alias("n"))
        sized = parts.join(size, "root")
        if "copies" in df.columns:
            sized = sized.join(df.select(F.col("spectrum_id").alias("node"), F.col("copies").cast("long").alias("m")), "node")
        else:
            sized = sized.withColumn("m", F.lit(1).cast("long"))
        sized = cut(sized)
        more = sized.where("n > 2")
        # for complete linkage a pair beyond eps is as good as none
        given = edges.where(F.col("dist") <= F.lit(eps + 1e-12)) if how == "complete" else edges
        inner = given.join(more.select(F.col("node").alias("id_a"), F.col("root").alias("part"), "n", F.col("m").alias("m_a")), "id_a").join(more.select(F.col("node").alias("id_b"), F.col("root").alias("_p"), F.col("m").alias("m_b")), "id_b").where("part = _p")

        def link(pdf: pd.DataFrame) -> pd.DataFrame:
            ids = np.unique(np.r_[pdf.id_a.to_numpy(), pdf.id_b.to_numpy()])
            d, m = np.ones((len(ids), len(ids))), np.ones(len(ids))
            i, j = np.searchsorted(ids, pdf.id_a), np.searchsorted(ids, pdf.id_b)
            d[i, j] = d[j, i] = pdf.dist
            m[i], m[j] = pdf.m_a, pdf.m_b
            return pd.DataFrame({"spectrum_id": ids, "cluster": ids[linkage_labels(d, eps, how, m)]})

        linked = by_group(inner.where(F.col("n") <= LINKAGE_MAX).select("part", "id_a", "id_b", "dist", "m_a", "m_b"), "part", link, "spectrum_id long, cluster long")
        named = linked.unionByName(sized.where("n = 2").select(F.col("node").alias("spectrum_id"), F.col("root").alias("cluster")))
        if not size.where(F.col("n") > LINKAGE_MAX).isEmpty():
            large = F.col("n") > LINKAGE_MAX
            named = named.unionByName(link_by_joins(inner.where(large).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "dist", F.col("m_a").alias("na"), F.col("m_b").alias("nb")), sized.where(large).select(F.col("node").alias("spectrum_id")), eps, how))
    return df.join(named, "spectrum_id", "left").withColumn("cluster", F.coalesce("cluster", "spectrum_id"))


def link_by_joins(pairs: DataFrame, nodes: DataFrame, eps: float, how: str) -> DataFrame:
    """(spectrum_id, cluster) of nodes by complete or average linkage of pairs (a < b, dist, na and nb spectra), cut at eps; absent pairs have distance 1.

    In each round all pairs of clusters that are each other's nearest in the order of (distance, least id, other id) merge. Neither
    linkage brings a third cluster forward in that order, so that this makes the same tree as one merge at a time and as linkage_labels().
    The steps are joins and grouped sums: no task holds a component. Complete linkage needs only pairs within eps, and a pair of
    clusters stays while all its pairs are there; average linkage adds up the similarities of the pairs, in whole steps.
    """
    top = F.lit(eps + 1e-12)
    complete = how == "complete"
    if complete:
        now = cut(pairs.where(F.col("dist") <= top).withColumnRenamed("dist", "s"))
        dist = F.col("s")
    else:
        now = cut(pairs.withColumn("s", F.rint((F.lit(1.0) - F.col("dist")) * STEPS).cast("long") * F.col("na") * F.col("nb")).drop("dist"))
        dist = F.lit(1.0) - F.col("s") / (F.col("na") * F.col("nb") * STEPS)
    named = cut(nodes.withColumn("cluster", F.col("spectrum_id")))
    while True:
        pair = F.struct(dist.alias("d"), "a", "b", (F.col("na") + F.col("nb")).alias("n"))
        ends = now.select(F.col("a").alias("end"), pair.alias("p")).unionByName(now.select(F.col("b").alias("end"), pair.alias("p")))
        best = ends.groupBy("end").agg(F.min("p").alias("p")).where(F.col("p.d") <= top)
        merged = cut(best.groupBy("p.a", "p.b").agg(F.count("*").alias("c"), F.max("p.n").alias("n")).where("c = 2").drop("c"))
        if merged.isEmpty():
            return named
        moved = merged.select(F.explode(F.array("a", "b")).alias("node"), F.col("a").alias("to"), "n")
        at_a, at_b = (moved.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
        both = now.join(at_a, "a", "left").join(at_b, "b", "left")
        both = both.select("s", *[F.coalesce(f"to_{c}", c).alias(c) for c in "ab"], *[F.coalesce(f"n_{c}", f"n{c}").alias(f"n{c}") for c in "ab"], (F.when(F.col("to_a").isNull(), 1).otherwise(2) * F.when(F.col("to_b").isNull(), 1).otherwise(2)).alias("whole")).where("a <> b")
        turned = F.col("a") > F.col("b")
        both = both.select("s", "whole", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("nb")).otherwise(F.col("na")).alias("na"), F.when(turned, F.col("na")).otherwise(F.col("nb")).alias("nb"))
        new = both.groupBy("a", "b").agg((F.max("s") if complete else F.sum("s")).alias("s"), F.max("na").alias("na"), F.max("nb").alias("nb"), F.count("*").alias("c"), F.max("whole").alias("whole"))
        now = cut((new.where("c = whole") if complete else new).drop("c", "whole"))
        named = cut(named.join(merged.select(F.col("b").alias("cluster"), F.col("a").alias("to")), "cluster", "left").select("spectrum_id", F.coalesce("to", "cluster").alias("cluster")))


def collapse(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points (group, spectrum_id, precursor_mz, hv, copies) that stand for all spectra of equal group, precursor and vector, and (spectrum_id, point). A point's spectrum_id is its least. Spectra without a vector or positive precursor stand for themselves."""
    key = [*GROUP, "precursor_mz", "hv"]
    good = F.coalesce((F.col("precursor_mz") > 0) & ~F.isnan("precursor_mz") & F.col("hv").isNotNull() & F.col(GROUP[0]).isNotNull() & F.col(GROUP[1]).isNotNull(), F.lit(False))
    points = table(df.where(good).groupBy(*key).agg(F.min("spectrum_id").alias("spectrum_id"), F.count("*").alias("copies")))
    member = df.where(good).select("spectrum_id", *key).join(points.select(*key, F.col("spectrum_id").alias("point")), key).select("spectrum_id", "point")
    other = df.where(~good)
    return points.unionByName(other.select(*key, "spectrum_id", F.lit(1).cast("long").alias("copies"))), member.unionByName(other.select("spectrum_id", F.col("spectrum_id").alias("point")))


def hierarchical_of_copies(df: DataFrame, pairs: Callable[[DataFrame], DataFrame], eps: float, how: str = "complete") -> DataFrame:
    """As hierarchical() with the edges that pairs makes, but spectra of equal group, precursor and vector, which merge at height 0, are one weighted point, so that their pairs are never made. A pair's precursors are compared as those of the points."""
    points, member = collapse(df)
    found = hierarchical(points, pairs(points), eps, how).select(F.col("spectrum_id").alias("point"), "cluster")
    return df.join(member.join(found, "point").select("spectrum_id", "cluster"), "spectrum_id")


def split_1d(values: np.ndarray, tol: float, mode: str | None = None) -> np.ndarray:
    """Groups of values on a line by complete linkage, cut at tol: neighbours with the least span are merged first. In ppm the span is measured against the group's least value. Labels rise with the values."""
    order = np.argsort(values, kind="stable")
    low = values[order].astype(float).tolist()
    n = len(low)
    high, after, before = low[:], list(range(1, n + 1)), list(range(-1, n - 1))  # of the group that begins at a place
    first = [True] * n

    def span(i: int) -> float:
        if after[i] >= n:
            return np.inf
        gap = high[after[i]] - low[i]
        return gap / low[i] * 1e6 if mode == "ppm" else gap

    now = [span(i) for i in range(n)]
    heap = [(s, i) for i, s in enumerate(now) if s <= tol]
    heapq.heapify(heap)
    while heap:
        s, i = heapq.heappop(heap)
        if not first[i] or s != now[i]:
            continue  # one of the two has grown since
        j = after[i]
        high[i], after[i], first[j] = high[j], after[j], False
        if after[i] < n:
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0:
                now[k] = span(k)
                if now[k] <= tol:
                    heapq.heappush(heap, (now[k], k))
    label = np.empty(n, int)
    label[order] = np.cumsum(first) - 1
    return label


def spans(low: np.ndarray, high: np.ndarray, line: np.ndarray, tol: float, mode: str | None) -> np.ndarray:
    """Of neighbours on a line the span of both, infinite if it is over tol or they lie on different lines."""
    with np.errstate(all="ignore"):
        span = high[1:] - low[:-1]
        span = span / low[:-1] * 1e6 if mode == "ppm" else span
    return np.where((line[1:] == line[:-1]) & (span <= tol), span, np.inf)


def split_lines(values: np.ndarray, group: np.ndarray, tol: float, mode: str | None = None, rounds: int = 100) -> np.ndarray:
    """Labels of split_1d() of the values of each group, all groups at once and no label in two of them; group ascends.

    In a round all pairs of neighbours merge that come before both neighbouring pairs in the order of (span, place); lines that
    take more rounds are left to split_1d().
    """
    n, order = len(values), np.lexsort((values, group))
    first, line = np.arange(n), group[order]
    low = values[order]
    high = low.copy()
    for _ in range(rounds):
        span = spans(low, high, line, tol, mode)
        joins = np.flatnonzero((span < np.inf) & (span < np.r_[np.inf, span][:-1]) & (span <= np.r_[span, np.inf][1:]))
        if not len(joins):
            break
        high[joins] = high[joins + 1]
        first, line, low, high = (np.delete(x, joins + 1) for x in (first, line, low, high))
    begins = np.zeros(n, bool)
    begins[first] = True
    for g in np.unique(line[:-1][spans(low, high, line, tol, mode) < np.inf]):
        s, e = np.searchsorted(group, [g, g + 1])
        label = split_1d(values[order[s:e]], tol, mode)
        begins[s:e] = np.r_[True, label[1:] != label[:-1]]
    out = np.empty(n, np.int64)
    out[order] = begins.cumsum() - 1
    return out


def refine(df: DataFrame, mz_tol: float, mode: str = "ppm", rt_tol: float | None = None, min_samples: int = 2) -> DataFrame:
    """df with cluster split where precursors, and if rt_tol is given retention times, lie too far apart.

    Parts of under min_samples become noise (null). If all parts are single spectra, the whole cluster is noise. The new cluster is the
    least spectrum_id of its part. A cluster is one group; long ones are sorted lines, not matrices. With rt_tol a part is a pair of
    one part by m/z and one by retention time.
    """
    from .strips import by_strip

    schema = T.StructType([*[f for f in df.schema.fields if f.name != "cluster"], T.StructField("cluster", T.LongType())])

    def run(b: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        values = lambda c: b.column(c).to_numpy(zero_copy_only=False).astype(float)
        part = split_lines(values("precursor_mz"), group, mz_tol, mode)
        if rt_tol is not None:
            two = split_lines(values("retention_time"), group, rt_tol)
            part = np.unique(part * (two.max(initial=0) + 1) + two, return_inverse=True)[1].ravel()
        ids, count = b.column("spectrum_id").to_numpy(), np.bincount(part)
        least, of = np.full(len(count), np.iinfo(np.int64).max), np.zeros(len(count), np.int64)
        np.minimum.at(least, part, ids)
        of[part] = group
        alone = (count[part] < min_samples) & (np.bincount(of)[group] > 1) | (np.bincount(group)[group] < min_samples)
        return pa.RecordBatch.from_arrays([*[b.column(c) for c in schema.names[:-1]], pa.array(least[part], mask=alone)], names=schema.names)

    some = by_strip(df.where("cluster is not null"), run, schema, ["cluster"])
    none = df.where("cluster is null").select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    return some.unionByName(none)


def refine_by_gaps(df: DataFrame, tol: float, mode: str = "ppm") -> DataFrame:
    """df with cluster split where a sorted precursor is more than tol beyond the one before: single linkage on a line, in window functions alone. The new cluster is its least spectrum_id; noise stays."""
    w = Window.partitionBy("cluster").orderBy("precursor_mz", "spectrum_id")
    before = F.lag("precursor_mz").over(w)
    gap = F.col("precursor_mz") - before
    wide = (gap / before * 1e6 > tol) if mode == "ppm" else (gap > tol)
    part = df.where("cluster is not null").withColumn("_cut", F.coalesce(wide, F.lit(False)).cast("int")).withColumn("_part", F.sum("_cut").over(w))
    named = part.withColumn("cluster", F.min("spectrum_id").over(Window.partitionBy("cluster", "_part"))).drop("_cut", "_part")
    return named.select(*df.columns).unionByName(df.where("cluster is null"))


def medoids(df: DataFrame, edges: DataFrame) -> DataFrame:
    """df with is_representative: noise always; of a cluster of one or two the least id; else the member with the least mean distance to the cluster's members (pairs that edges doesn't hold count 1), the least id of equal ones."""
    member = df.where("cluster is not null").select("spectrum_id", "cluster")
    size = member.groupBy("cluster").agg(F.count("*").alias("n"), F.min("spectrum_id").alias("_first"))
    both = edges.select("id_a", "id_b", "dist").unionByName(edges.select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"), "dist"))
    inner = both.join(member.select(F.col("spectrum_id").alias("id_a"), F.col("cluster").alias("_ca")), "id_a").join(member.select(F.col("spectrum_id").alias("id_b"), F.col("cluster").alias("_cb")), "id_b").where("_ca = _cb")
    near = inner.groupBy(F.col("id_a").alias("spectrum_id")).agg(F.sum(F.lit(1.0) - F.col("dist")).alias("_near"))
    scored = member.join(size, "cluster").join(near, "spectrum_id", "left").withColumn("_mean", F.round((F.col("n") - 1 - F.coalesce("_near", F.lit(0.0))) / F.col("n"), 9))
    best = scored.where("n > 2").groupBy("cluster").agg(F.min(F.struct("_mean", "spectrum_id")).alias("_b")).select("cluster", F.col("_b.spectrum_id").alias("rep"))
    reps = best.unionByName(size.where("n <= 2").select("cluster", F.col("_first").alias("rep")))
    return df.join(reps, "cluster", "left").withColumn("is_representative", F.col("cluster").isNull() | (F.col("spectrum_id") == F.col("rep"))).drop("rep").select(*df.columns, "is_representative")


def global_labels(df: DataFrame) -> DataFrame:
    """df with label: clusters numbered from 0 over charges and buckets, within a bucket by their least spectrum_id, then each noise spectrum as a cluster of its own.

    Only one row per bucket, its number of clusters, is put in order over the whole table.
    """
    keyed = df.withColumn("_noise", F.col("cluster").isNull()).withColumn("_c", F.coalesce("cluster", "spectrum_id"))
    own = keyed.withColumn("_rank", F.dense_rank().over(Window.partitionBy(*GROUP).orderBy("_noise", "_c")))
    sizes = own.groupBy(*GROUP).agg(F.max("_rank").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy(*GROUP)) - F.col("_n")).drop("_n")
    return own.join(before, GROUP).withColumn("label", (F.col("_before") + F.col("_rank") - 1).cast("long")).select(*df.columns, "label")


def enough(df: DataFrame, least: int = 5) -> DataFrame:
    """Rows of charges with at least so many spectra."""
    few = df.groupBy("precursor_charge").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return df.join(few, "precursor_charge", "left_semi")


#: Edges of the bucket size histogram.
SIZE_EDGES = [0, 300, 1000, 5000, 10000, 20000, 30000]


def size_histogram(df: DataFrame, edges: list[int] | None = None) -> DataFrame:
    """(low, high, n_buckets): buckets by their size; a size beyond the last edge counts in none, the last edge itself in the last bin."""
    edges = SIZE_EDGES if edges is None else edges
    sizes = df.groupBy(*GROUP).agg(F.count("*").alias("n"))
    bins = list(zip(edges, edges[1:], strict=False))
    cases = F.lit(None).cast("int")
    for k, (a, b) in enumerate(bins):
        inside = (F.col("n") >= a) & ((F.col("n") <= b) if k == len(bins) - 1 else (F.col("n") < b))
        cases = F.when(inside, k).otherwise(cases)
    counted = sizes.groupBy(cases.alias("k")).agg(F.count("*").alias("n_buckets")).where("k is not null")
    all_bins = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("low"), F.lit(b).alias("high")) for k, (a, b) in enumerate(bins)]))
    frame = df.sparkSession.range(1).select(all_bins.alias("b")).select("b.k", "b.low", "b.high")
    return frame.join(counted, "k", "left").select("low", "high", F.coalesce("n_buckets", F.lit(0)).cast("long").alias("n_buckets"))


def cluster_summary(df: DataFrame) -> DataFrame:
    """One row: numbers of clusters, buckets and noise spectra, and the greatest, least, mean and median cluster size."""
    sizes = df.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("n"))
    whole = sizes.agg(F.count("*").alias("n_clusters"), F.max("n").alias("max_size"), F.min("n").alias("min_size"), F.avg("n").alias("mean_size"), F.percentile("n", 0.5).alias("median_size"))
    buckets = df.agg(F.countDistinct(*GROUP).alias("n_buckets"), F.count_if(F.col("cluster").isNull()).alias("n_noise"))
    return whole.crossJoin(buckets)
