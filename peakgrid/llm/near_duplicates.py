"""Groups of documents whose sets of word shingles overlap: long SimHash fingerprints in BK-trees find candidates, the sets decide.

The short fingerprints of simhash.py can't tell texts of similarity 0.8 from others. Here a text has 256 bits, on which such texts
differ in 39 places on average and seldom in more than RADIUS, and texts of similarity 0.5 in 69. BK-trees prune little at that radius, so that each
tree stands over a small shard: texts that share the least shingle under one of MINIMA hash functions. Two texts of similarity s
miss each other in all of them with probability (1 - s)^MINIMA.

A shard is dealt into tiles, each a pair of blocks of bounded count and size. First the tiles show which texts have a candidate
at all; only their sets are dealt to the tiles then. A tile goes through its candidates, nearest first, and compares the sets of two texts that no link
joins yet. It returns a forest of links, so that a group of many near copies never gives all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .simhash import word_blocks

WIDTH, LEAST = 5, 0.8
BITS, RADIUS, MINIMA = 256, 56, 5
#: Most fingerprints in one tree, and queries that are followed through it at once.
TILE, QUERIES = 512, 64
#: Bytes of the sets of one block.
TILE_BYTES = 16 << 20
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = _ODD * np.arange(1, BITS // 64 + 1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (the finaliser of SplitMix64, Steele et al., 2014)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the shingles, words A-Z lower-cased. Under width words the whole sequence is the only one; no words: none."""
    found = [np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) for words in word_blocks(text)]
    w = np.concatenate(found) if found else np.zeros(0, np.uint64)
    n = len(w)
    if not n:
        return w
    size = min(width, n)
    h = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        h = mix(h * _ODD + w[i : n - size + 1 + i])
    return np.unique(h)


def fingerprint(h: np.ndarray) -> np.ndarray:
    """BITS bits, as bytes; a bit is 1 if it is set in over half of the shingles' hashes."""
    count = np.zeros((BITS // 8, 256), np.int64)
    for s in range(0, len(h), 1 << 16):
        some = np.stack([mix(h[s : s + (1 << 16)] + seed) for seed in _SEEDS], 1)
        some = some.view(np.uint8).reshape(len(some), -1).astype(np.int64) + 256 * np.arange(BITS // 8)
        count += np.bincount(some.ravel(), minlength=32 * BITS).reshape(-1, 256)
    return np.packbits(2 * (count @ _ONES).ravel() > len(h))


def minima(h: np.ndarray) -> np.ndarray:
    """A shard for each hash function, named after the least shingle; texts without words share theirs."""
    if not len(h):
        return np.arange(MINIMA, dtype=np.int64)
    return np.array([mix(h ^ mix(np.uint64([1000 + k]))).min() ^ np.uint64(k) for k in range(MINIMA)], np.uint64).view(np.int64)


class Tree:
    """A BK-tree over distinct fingerprints (rows of 64-bit words) in flat arrays, built and searched level by level. A child is keyed by its distance to its parent."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        rest, parent = np.arange(1, len(values)), np.zeros(max(len(values) - 1, 0), np.int64)
        keys, kids = [], []
        while len(rest):
            key = parent * (BITS + 1) + self.distance(values[rest], parent)
            edge, first, group = np.unique(key, return_index=True, return_inverse=True)
            keys.append(edge)
            kids.append(rest[first])
            later = np.ones(len(rest), bool)
            later[first] = False
            rest, parent = rest[later], rest[first][group.ravel()][later]
        key, kid = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, kids))
        order = np.argsort(key)
        self.key, self.kid = key[order], kid[order]

    def distance(self, some: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        return np.bitwise_count(some ^ self.values[nodes]).sum(1, dtype=np.int64)

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, distance) of all pairs within the radius; only edges within it of the distance to the parent are followed."""
        found = []
        for s in range(0, len(queries) if len(self.values) else 0, QUERIES):
            q = np.arange(s, min(s + QUERIES, len(queries)))
            at = np.zeros(len(q), np.int64)
            while len(q):
                d = self.distance(queries[q], at)
                hit = d <= radius
                found.append((q[hit].astype(np.int32), at[hit].astype(np.int32), d[hit].astype(np.int16)))
                low = np.searchsorted(self.key, at * (BITS + 1) + np.maximum(d - radius, 0))
                n = np.searchsorted(self.key, at * (BITS + 1) + np.minimum(d + radius, BITS), side="right") - low
                q = np.repeat(q, n)
                at = self.kid[np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3  # type: ignore[return-value]


def pairs_of_tile(fps: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (u, v, distance) of a tile within the radius, u < v, between its two sides if it has both. Rows are sorted by side and fingerprint; a node is all rows of one side and fingerprint."""
    first = np.flatnonzero(np.r_[True, (fps[1:] != fps[:-1]).any(1) | (side[1:] != side[:-1])]).astype(np.int32)
    size = np.diff(np.r_[first, len(fps)])
    both = bool(side[-1]) and not side[0]
    left = np.flatnonzero(~side[first]) if both else np.arange(len(first))
    right = np.flatnonzero(side[first]) if both else left
    x, y, d = Tree(fps[first[left]]).near(fps[first[right]], radius)
    x, y = left[y], right[x]
    some = x <= y
    x, y, d = x[some], y[some], d[some]
    if size.max() == 1:
        return x[x < y], y[x < y], d[x < y]
    times = size[x] * size[y]  # rows of equal fingerprints: each with each
    at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    wide = np.repeat(size[y], times)
    u, v, d = first[np.repeat(x, times)] + at // wide, first[np.repeat(y, times)] + at % wide, np.repeat(d, times)
    return u[u < v], v[u < v], d[u < v]


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least `least`; that of two empty ones is 1."""
    m, n = len(x), len(y)
    if min(m, n) < least * max(m, n):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # two sorted runs
    met = int((both[1:] == both[:-1]).sum())
    return met >= least * (m + n - met) - 1e-9


def links_of_tile(fps: np.ndarray, sets: list[bytes], side: np.ndarray, radius: int, least: float) -> list[tuple[int, int]]:
    """A forest of links between similar rows of a tile that joins all that its links join."""
    u, v, d = pairs_of_tile(fps, side, radius)
    order = np.argsort(d, kind="stable")
    up, out = np.arange(len(fps)), []
    held = [np.frombuffer(x, np.uint32) for x in sets]
    for s in range(0, len(order), 1 << 14):
        part = order[s : s + (1 << 14)]
        part = part[up[u[part]] != up[v[part]]]  # most of a group's pairs are joined already
        for x, y in zip(u[part].tolist(), v[part].tolist(), strict=True):
            a, b = up[x], up[y]
            if a != b and similar(held[x], held[y], least):
                up[up == max(a, b)] = min(a, b)
                out.append((x, y))
    return out


def tiles(dealt: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn of each tile's rows, sorted by side, fingerprint and key; many small tiles share an Arrow batch. Tiles of one row are left out."""
    at = ["shard", "i", "j"]
    parts = dealt.repartition(*at).sortWithinPartitions(*at, "q", "fp", "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def solve(df: pd.DataFrame, last: bool) -> tuple[list[pd.DataFrame], pd.DataFrame | None]:
            k = df[at].to_numpy()
            starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(1)])
            ends = np.r_[starts[1:], len(k)]
            tail = None
            if not last:
                tail, starts, ends = df.iloc[starts[-1] :], starts[:-1], ends[:-1]
            made = [fn(df.iloc[s:e]) for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True)]
            return [pd.concat(made, ignore_index=True)] if made else [], tail

        for b in batches:
            rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if len(rest):
                out, rest = solve(rest, False)
                yield from out
        if rest is not None and len(rest):
            yield from solve(rest, True)[0]

    return parts.mapInPandas(run, schema)


def bits_of(df: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(df.fp), np.uint64).reshape(len(df), -1)


def links(shared: DataFrame, src: DataFrame, radius: int, least: float, width: int) -> DataFrame:
    """(a, b): links between similar texts, enough to join all that such links join. shared has shard, m (its blocks), key and fp of texts in shards of several; src has key and text."""
    dealt = shared.withColumn("c", F.pmod(F.xxhash64("key", F.lit(7)), F.col("m")).cast("int")).select("*", F.expr("explode(sequence(0, m - 1))").alias("o"))
    dealt = dealt.select("shard", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("c") > F.col("o")).alias("q"), "fp", "key")

    def busy(df: pd.DataFrame) -> pd.DataFrame:
        u, v, _ = pairs_of_tile(bits_of(df), df.q.to_numpy(bool), radius)
        return df.iloc[np.unique(np.concatenate([u, v]))]

    met = common.table(tiles(dealt, busy, "shard long, i int, j int, q boolean, fp binary, key string"))

    def sets(rows: list[bytes]) -> list[pa.Array]:
        return [pa.array([np.unique((shingles(t, width) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in rows], pa.binary())]

    texts = src.join(met.select("key").distinct(), "key").dropDuplicates(["key"])
    held = common.table(common.append(texts, "text", sets, [T.StructField("set", T.BinaryType())], ["key"]))

    def link(df: pd.DataFrame) -> pd.DataFrame:
        key = df.key.to_numpy()
        found = links_of_tile(bits_of(df), df.set.tolist(), df.q.to_numpy(bool), radius, least)
        return pd.DataFrame([(min(key[x], key[y]), max(key[x], key[y])) for x, y in found], columns=["a", "b"], dtype=object)

    return tiles(met.join(held, "key").select("shard", "i", "j", "q", "fp", "key", "set"), link, "a string, b string").distinct()


def text_key(text: str) -> F.Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def text_groups(docs: DataFrame, width: int = WIDTH, least: float = LEAST, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(key, root): for each distinct text that is similar to another one, by its MD5, the least key of its group. Sets hold 32 bits of a shingle's hash, by which a text of 20,000 words is off by less than one shingle."""
    src = common.pick(docs, "text").withColumn("key", text_key("text"))

    def fn(rows: list[bytes]) -> list[pa.Array]:
        sets = [shingles(t, width) for t in rows]
        shards = np.concatenate([minima(h) for h in sets]) if sets else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * MINIMA, pa.int32()), pa.array(shards))
        return [pa.array([fingerprint(h).tobytes() for h in sets], pa.binary()), lists, pa.array([4 * len(h) for h in sets], pa.int64())]

    fields = [T.StructField("fp", T.BinaryType()), T.StructField("shards", T.ArrayType(T.LongType())), T.StructField("size", T.LongType())]
    made = common.append(src, "text", fn, fields, ["key"])
    keyed = common.table(made.select(F.explode("shards").alias("shard"), "key", "fp", "size").distinct())
    blocks = F.ceil(F.greatest(F.col("n") / tile, F.col("size") / TILE_BYTES)).cast("int")
    more = keyed.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("size")).where("n > 1").select("shard", blocks.alias("m"))
    shared = common.table(keyed.drop("size").join(more, "shard"))
    return common.components(links(shared, src, radius, least, width)).select(F.col("node").alias("key"), "root")


def keep_one(docs: DataFrame, width: int = WIDTH, least: float = LEAST, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """docs with one document of each group of similar texts: that with the least doc_id, or one without an id where none has one.

    Texts are similar if their sets of shingles overlap by `least` (Jaccard); a group is what such links join. Texts without words, null
    ones among them, are one group; under width words the whole sequence is the only shingle. Repeated rows fall to one, and so do rows of
    equal doc_id and text that differ elsewhere. Texts of any length are read whole. An empty table stays empty; other columns, whatever
    their names, are kept as they are.
    """
    cols = docs.columns
    at, text = f"_{cols.index('doc_id')}", f"_{cols.index('text')}"
    keyed = common.numbered(docs).withColumn("key", text_key(text))
    roots = common.table(text_groups(docs, width, least, radius, tile))
    ids = keyed.groupBy("key", at).agg(F.count("*").alias("n"))
    named = ids.join(roots, "key", "left").groupBy(F.coalesce("root", "key").alias("group"))
    first = common.table(named.agg(F.min(F.struct(F.col(at).isNull().alias("none"), F.col(at).alias("id"), "key", "n")).alias("f")).select("f.id", F.col("f.key").alias("k"), "f.n"))
    same = (F.col("key") == F.col("k")) & F.col(at).eqNullSafe(F.col("id"))
    once = keyed.join(first.where("n = 1"), same).select(cols_of(cols))
    more = keyed.join(first.where("n > 1"), same).dropDuplicates(["k", "id"]).select(cols_of(cols))
    return once.unionByName(more).toDF(*cols)


def cols_of(cols: list[str]) -> list[str]:
    return [f"_{i}" for i in range(len(cols))]
