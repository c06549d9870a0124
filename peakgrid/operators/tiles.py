"""DBSCAN and medoids without a row per pair: pairs are compared inside strips of precursor bands, or inside tiles where a band is hot, which return labels, links of a forest or sums.

Pairs of bands of up to HOT points are looked at in strips (see there). Points of a hotter
band, and of the bands beside it, are dealt into chunks of TILE; a tile is two chunks of one band, or of a band and the next, and holds every
pair within tolerance once. So a band may hold any share of the spectra: a task sees two chunks at most, each point goes to as many tiles as
its band and its neighbours have chunks, and what comes out of a tile is in proportion to its points. Where a band is hot, spectra of equal
group, precursor and vector are one weighted point.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import table
from . import strips
from .clustering import GROUP, by_group, collapse, link_by_joins
from .distances import band, masked_pairs
from .graph import components

#: Points of a band that lies in a strip, at most, and points in one chunk of a larger one.
HOT, TILE = 4_096, 1_024
#: Distances that are held at once.
BLOCK = 1 << 20


def usable() -> F.Column:
    good = (F.col("precursor_mz") > 0) & ~F.isnan("precursor_mz") & F.col("hv").isNotNull() & F.col(GROUP[0]).isNotNull() & F.col(GROUP[1]).isNotNull()
    return F.coalesce(good, F.lit(False))


def hot_bands(df: DataFrame, tol: float, mode: str, hot: int) -> DataFrame | None:
    """(group, _band, _m): bands of over `hot` rows; None if there is none."""
    size = df.where(usable()).groupBy(*GROUP, band(F.col("precursor_mz"), tol, mode).alias("_band")).agg(F.count("*").alias("_n")).where(F.col("_n") > hot)
    return None if size.isEmpty() else table(size)


def parted(df: DataFrame, hot: DataFrame | None, tol: float, mode: str) -> tuple[DataFrame, DataFrame]:
    """The usable rows of bands that aren't hot, and those of hot ones."""
    good = df.where(usable())
    if hot is None:
        return good, good.limit(0)
    keyed, key = good.withColumn("_band", band(F.col("precursor_mz"), tol, mode)), [*GROUP, "_band"]
    return tuple(keyed.join(hot.select(*key), key, how).select(*df.columns) for how in ("left_anti", "left_semi"))  # type: ignore[return-value]


def dealt(points: DataFrame, hot: DataFrame, tol: float, mode: str, tile: int, *more: str) -> DataFrame:
    """(tile, side, group, spectrum_id, precursor_mz, hv, *more): the points of hot bands and of those beside them in their tiles. Tiles of one chunk have side -1."""
    src = points.where(usable()).select(*GROUP, "spectrum_id", "precursor_mz", "hv", *more, band(F.col("precursor_mz"), tol, mode).alias("_band"))
    near_hot = hot.select(*GROUP, F.explode(F.array(F.col("_band") - 1, F.col("_band"), F.col("_band") + 1)).alias("_band")).distinct()
    src = table(src.join(near_hot, [*GROUP, "_band"], "left_semi"))
    size = src.groupBy(*GROUP, "_band").agg(F.ceil(F.count("*") / tile).cast("int").alias("_m"))
    size = table(size.join(hot.select(*GROUP, "_band", F.lit(True).alias("_hot")), [*GROUP, "_band"], "left").withColumn("_hot", F.coalesce("_hot", F.lit(False))))
    at = lambda k, name: size.select(*GROUP, (F.col("_band") + k).alias("_band"), F.col("_m").alias(name), F.col("_hot").alias(f"{name}_hot"))
    both = src.join(size, [*GROUP, "_band"]).join(at(-1, "_up"), [*GROUP, "_band"], "left").join(at(1, "_down"), [*GROUP, "_band"], "left")
    both = both.withColumn("_c", F.pmod(F.xxhash64("spectrum_id"), F.col("_m")).cast("int"))
    one = lambda b, kind, i, j, side: F.struct(b.cast("long").alias("b"), F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).cast("int").alias("side"))
    upto = lambda n: F.when(n.isNotNull() & (n > 0), F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    here, c = F.col("_band"), F.col("_c")
    some = lambda n, flag: F.when(flag, n)
    same = F.transform(upto(some(F.col("_m"), F.col("_hot"))), lambda k: F.when(k >= c, one(here, "same", c, k, 0)).otherwise(one(here, "same", k, c, 1)))
    left = F.transform(upto(some(F.col("_up"), F.col("_hot") | F.col("_up_hot"))), lambda k: one(here, "next", c, k, 0))
    right = F.transform(upto(some(F.col("_down"), F.col("_hot") | F.col("_down_hot"))), lambda k: one(here - 1, "next", k, c, 1))
    rows = both.select(*GROUP, "spectrum_id", "precursor_mz", "hv", *more, F.explode(F.concat(same, left, right)).alias("t"))
    key = F.xxhash64(*GROUP, "t.b", "t.kind", "t.i", "t.j")
    whole = (F.col("t.kind") == "same") & (F.col("t.i") == F.col("t.j"))
    return rows.select(key.alias("tile"), F.when(whole, -1).otherwise(F.col("t.side")).alias("side"), F.xxhash64(*GROUP).alias("group"), "spectrum_id", "precursor_mz", "hv", *more)


def near(pdf: pd.DataFrame, tol: float, dim: int, mode: str):  # noqa: ANN201
    """Of a tile's rows blocks (rows, columns, distances), places among the rows; pairs that aren't within tolerance, of one group or of this tile have infinity. A pair is in one block once."""
    ids, mz, group = pdf.spectrum_id.to_numpy(), pdf.precursor_mz.to_numpy(float), pdf.group.to_numpy()
    packed = len(pdf) and isinstance(pdf.hv.iloc[0], bytes | bytearray)
    hv = (np.frombuffer(b"".join(pdf.hv), np.uint32) if packed else np.array(pdf.hv.tolist(), np.int64)).reshape(len(pdf), dim // 32)
    side = pdf.side.to_numpy()
    for a, b, own in ((np.flatnonzero(side == -1),) * 2 + (True,), (np.flatnonzero(side == 0), np.flatnonzero(side == 1), False)):
        step = max(1, BLOCK // max(len(b), 1))
        for s in range(0, len(a), step):
            r = a[s : s + step]
            if not len(b):
                continue
            d = np.zeros((len(r), len(b)), np.int32)
            for w in range(hv.shape[1]):
                d += np.bitwise_count(hv[r, None, w] ^ hv[None, b, w])
            gap = np.abs(mz[r, None] - mz[None, b])
            if mode == "ppm":  # of the one with the larger id
                gap = gap / np.where(ids[r, None] > ids[None, b], mz[r, None], mz[None, b]) * 1e6
                good = gap / 1e6 < tol * 1e-6
            else:
                good = gap < tol
            good &= group[r, None] == group[None, b]
            if own:
                good &= ids[r, None] < ids[None, b]
            yield r, b, np.where(good, d / dim, np.inf)


def links(points: DataFrame, hot: DataFrame, tol: float, dim: int, eps: float, mode: str = "ppm", tile: int = TILE) -> DataFrame:
    """(a, b): links of pairs within eps of which one lies in a hot band: enough of each tile to join what its pairs join."""

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, up, out = pdf.spectrum_id.to_numpy(), np.arange(len(pdf)), []

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for r, b, d in near(pdf, tol, dim, mode):
            hit = d <= eps
            for i in np.flatnonzero(hit.any(1)):
                others = b[np.flatnonzero(hit[i])]
                x = root(int(r[i]))
                # what has the same root already is joined; the rest is looked at once per root
                for y in {root(int(o)) for o in others[up[others] != x]}:
                    x = root(x)
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        out.append((ids[x], ids[y]))
        ab = np.array(out, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": ab[:, 0], "b": ab[:, 1]})

    return by_group(dealt(points, hot, tol, mode, tile), "tile", forest, "a long, b long")


def dbscan(df: DataFrame, tol: float, dim: int, eps: float, mode: str = "ppm", min_samples: int = 2, tile: int = TILE, hot: int = HOT) -> DataFrame:
    """As clustering.dbscan() with the pairs that distances.masked_pairs() makes, which aren't made here. Strips are labelled on their own; only labels that meet at their edges, or in tiles, are joined over the whole table."""
    if min_samples not in (1, 2):
        raise ValueError("min_samples must be 1 or 2")
    bands = hot_bands(df, tol, mode, hot)
    few, many = parted(df, bands, tol, mode)
    marked = strips.labelled(few, tol, dim, eps, mode)
    edges = strips.crossing(marked)
    named = marked.where("_own > 0").select(*df.columns, "_label", "_lone")
    if bands is not None:
        points, member = collapse(many)
        points = table(points)
        beside = named.select(*GROUP, "precursor_mz", "hv", "spectrum_id", F.lit(1).cast("long").alias("copies"))
        found = table(links(points.unionByName(beside), bands, tol, dim, eps, mode, tile))
        for c in "ab":
            found = found.join(named.select(F.col("spectrum_id").alias(c), F.col("_label").alias(f"_{c}")), c, "left")
        edges = edges.unionByName(found.select(*[F.coalesce(f"_{c}", c).alias(c) for c in "ab"]))
        copies = points.select(F.col("spectrum_id").alias("_label"), (F.col("copies") == 1).alias("_lone"))
        named = named.unionByName(many.join(member.withColumnRenamed("point", "_label"), "spectrum_id").join(copies, "_label").select(*named.columns))
    edges = table(edges)
    # a label that meets itself is reached from beside, but has no edge
    same = edges.where("a = b").select(F.col("a").alias("_label"), F.col("a").alias("root"))
    roots = table(components(edges).select(F.col("node").alias("_label"), "root").unionByName(same).groupBy("_label").agg(F.min("root").alias("root")))
    alone = F.lit(None).cast("long") if min_samples == 2 else F.col("_label")
    named = named.join(roots, "_label", "left").withColumn("cluster", F.coalesce("root", F.when(F.col("_lone"), alone).otherwise(F.col("_label"))))
    rest = df.where(~usable()).withColumn("cluster", F.lit(None).cast("long") if min_samples == 2 else F.col("spectrum_id"))
    return named.select(*df.columns, "cluster").unionByName(rest)


#: Pairs within tolerance of a component that one task links, at most: these take it minutes. Its memory grows with the square of a band, of HOT points at most.
PAIRS = 1 << 31


def hierarchical(df: DataFrame, tol: float, dim: int, eps: float, how: str = "complete", mode: str = "ppm", most: int = PAIRS) -> DataFrame:
    """As clustering.hierarchical_of_copies() with the pairs that distances.masked_pairs() makes, which aren't made here: points of a component of pairs within eps lie in one task, which compares and links them.

    Of a component of too many pairs, by its points in each band, or with a band of over HOT points, a table of pairs is made, and it is linked by joins.
    """
    if eps >= 1:
        raise ValueError("eps must be less than 1, the distance of masked pairs")
    if how == "single":
        return dbscan(df, tol, dim, eps, mode, min_samples=1)
    points, member = collapse(df)
    points = table(dbscan(points, tol, dim, eps, mode, min_samples=1).withColumnRenamed("cluster", "part"))
    in_band = points.groupBy("part", band(F.col("precursor_mz"), tol, mode).alias("_band")).agg(F.count("*").alias("_c"))
    # of c points in a band and k in the next at most c * c / 2 + c * k pairs, and c * k is at most half of both squares
    bound = in_band.groupBy("part").agg(F.sum("_c").alias("n"), F.ceil(1.5 * F.sum(F.col("_c") * F.col("_c"))).cast("long").alias("pairs"), F.max("_c").alias("widest")).where("n > 2")
    bound = table(bound)
    fits = (F.col("pairs") <= most) & (F.col("widest") <= HOT)
    sized = points.join(bound, "part")
    named = strips.linked(sized.where(fits), tol, dim, eps, how, mode)
    if not bound.where(~fits).isEmpty():
        large = table(sized.where(~fits))
        edges = masked_pairs(large, tol, dim, mode, [*GROUP, "part"])
        if how == "complete":
            edges = edges.where(F.col("dist") <= F.lit(eps + 1e-12))
        m = large.select("spectrum_id", "copies")
        for end, id_col in (("a", "id_a"), ("b", "id_b")):
            edges = edges.join(m.select(F.col("spectrum_id").alias(id_col), F.col("copies").alias(f"n{end}")), id_col)
        edges = edges.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "dist", "na", "nb")
        named = named.unionByName(link_by_joins(edges, large.select("spectrum_id"), eps, how))
    few = points.join(bound, "part", "left_anti").select("spectrum_id", F.col("part").alias("cluster"))
    found = table(named.unionByName(few)).select(F.col("spectrum_id").alias("point"), "cluster")
    return df.join(member.join(found, "point").select("spectrum_id", "cluster"), "spectrum_id").select(*df.columns, "cluster")


def sums(held: DataFrame, tol: float, dim: int, mode: str = "ppm", tile: int = TILE, hot: int = HOT, fresh: str | None = None) -> DataFrame:
    """(spectrum_id, cluster, s): each clustered spectrum's similarities to its cluster within tolerance, added up along its strip, or tile by tile; 0 or no row if there is none. Of copies in a hot band the least alone has a row.

    With fresh, a column of booleans, only pairs of which one is count, and all copies have rows.
    """
    bands = hot_bands(held, tol, mode, hot)
    few, many = parted(held, bands, tol, mode)
    found = strips.sums(few, tol, dim, mode, fresh)
    if bands is None:
        return found

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        cluster, copies = pdf.cluster.to_numpy(), pdf.copies.to_numpy(float)
        total = np.zeros(len(pdf))
        new = pdf[fresh].to_numpy(bool) if fresh else None
        for r, b, d in near(pdf, tol, dim, mode):
            good = (cluster[r, None] == cluster[None, b]) & np.isfinite(d)
            if fresh:
                good &= new[r, None] | new[None, b]
            s = np.where(good, 1.0 - np.where(np.isfinite(d), d, 1.0), 0.0)
            total[r] += s @ copies[b]
            total[b] += s.T @ copies[r]
        some = np.flatnonzero(total)
        return pd.DataFrame({"spectrum_id": pdf.spectrum_id.to_numpy()[some], "cluster": cluster[some], "s": total[some]})

    # copies that lie in different clusters are different points, and so are old and fresh ones
    more = ["cluster", *([fresh] if fresh else [])]
    key = [*GROUP, "precursor_mz", "hv", *more]
    points = table(many.groupBy(*key).agg(F.min("spectrum_id").alias("spectrum_id"), F.count("*").alias("copies")))
    both = points.unionByName(few.select(*key, "spectrum_id", F.lit(1).cast("long").alias("copies")))
    tiled = by_group(dealt(both, bands, tol, mode, tile, *more, "copies"), "tile", add_up, "spectrum_id long, cluster long, s double")
    copied = points.select("spectrum_id", "cluster", (F.col("copies") - 1).cast("double").alias("s"), *more[1:])
    if fresh:
        copied = copied.withColumn("s", F.when(F.col(fresh), F.col("s")).otherwise(0.0)).drop(fresh)
    found = found.unionByName(tiled).unionByName(copied).groupBy("spectrum_id", "cluster").agg(F.sum("s").alias("s"))
    if not fresh:
        return found
    member = many.select(F.col("spectrum_id").alias("_id"), *key).join(points.select(*key, "spectrum_id"), key).select("spectrum_id", "_id")
    return found.join(member, "spectrum_id", "left").select(F.coalesce("_id", "spectrum_id").alias("spectrum_id"), "cluster", "s")


def medoids(df: DataFrame, tol: float, dim: int, mode: str = "ppm", tile: int = TILE, hot: int = HOT) -> DataFrame:
    """As clustering.medoids() with the pairs that distances.masked_pairs() makes, which aren't made here: each spectrum's similarities to its cluster come from sums()."""
    held = df.where("cluster is not null")
    rest = held.where(~usable()).select("spectrum_id", "cluster", F.lit(0.0).alias("s"))
    near_all = table(sums(held, tol, dim, mode, tile, hot).unionByName(rest))
    size = table(held.groupBy("cluster").agg(F.count("*").alias("n")))
    mean = F.when(F.col("n") > 2, F.round((F.col("n") - 1 - F.col("s")) / F.col("n"), 9)).otherwise(0.0)
    best = near_all.join(size, "cluster").groupBy("cluster").agg(F.min(F.struct(mean.alias("m"), "spectrum_id")).alias("_b"))
    reps = table(best.select(F.col("_b.spectrum_id").alias("spectrum_id"), F.lit(True).alias("_rep")))
    marked = df.join(reps, "spectrum_id", "left")
    return marked.withColumn("is_representative", F.col("cluster").isNull() | F.coalesce("_rep", F.lit(False))).select(*df.columns, "is_representative")


def nearest(df: DataFrame, tol: float, dim: int, mode: str = "ppm", tile: int = TILE, hot: int = HOT) -> DataFrame:
    """(spectrum_id, d): of each usable spectrum the least distance of the pairs that distances.masked_pairs() makes, which aren't made here; null, or no row, if there is none."""
    bands = hot_bands(df, tol, mode, hot)
    few, many = parted(df, bands, tol, mode)
    found = strips.least(few, tol, dim, mode)
    if bands is None:
        return found

    def closest(pdf: pd.DataFrame) -> pd.DataFrame:
        best = np.full(len(pdf), np.inf)
        for r, b, d in near(pdf, tol, dim, mode):
            best[r] = np.minimum(best[r], d.min(1))
            best[b] = np.minimum(best[b], d.min(0))
        some = np.isfinite(best)
        return pd.DataFrame({"spectrum_id": pdf.spectrum_id.to_numpy()[some], "d": best[some]})

    tiled = by_group(dealt(few.unionByName(many), bands, tol, mode, tile), "tile", closest, "spectrum_id long, d double")
    return found.unionByName(tiled).groupBy("spectrum_id").agg(F.min("d").alias("d"))
