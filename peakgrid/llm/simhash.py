"""SimHash near-duplicates, linked through BK-trees over shards of fingerprints.

Fingerprints that differ in at most r bits agree wholly on at least two of r + 2 disjoint bit blocks. A shard holds the distinct
fingerprints that agree on one pair of blocks, so every link lies inside some shard, and none is lost. Inside a shard a BK-tree
(children keyed by their integer Hamming distance to the parent) is searched along those edges only that lie within the radius.
The trees aren't broadcast through the driver, since together they hold all fingerprints and grow with the corpus: each is
built in the task that searches it. A shard over TREE_MAX fingerprints is dealt out in blocks, and each pair of blocks is one tree and
one query set in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Most fingerprints in one tree.
TREE_MAX = 2048
#: Text bytes that are split into words at once.
BLOCK = 1 << 20


def word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, a block of about BLOCK bytes at a time. No word is cut."""
    for part in common.blocks(text, BLOCK):
        yield part.lower().split()


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """64 bits; a bit is 1 if it is set in over half of the hashes of the shingles. No word: 0. Under width words: the sequence is the only shingle."""
    ones, n, tail = np.zeros(64, np.int64), 0, []
    for words in word_blocks(text):
        words = tail + words
        if len(words) >= width:
            joined = map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False))
            h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in joined), np.uint64, len(words) - width + 1)
            n += len(h)
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            tail = words[len(words) - width + 1 :]
        else:
            tail = words
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(tail), seed) if tail else 0
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > n))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): one row per row of docs; fp is the fingerprint's 64 bits as a signed long."""

    def fn(rows: list[bytes]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, width) for t in rows], np.uint64).view(np.int64))]

    return common.append(docs, "text", fn, [T.StructField("fp", T.LongType())], ["doc_id"])


class BKTree:
    """Integers by Hamming distance; a node's children are keyed by their distance to it, so that one child at most stands at each."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.kids: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        at = 0
        if self.value:
            while d := (self.value[at] ^ x).bit_count():
                kids = self.kids[at]
                if d not in kids:
                    kids[d] = len(self.value)
                    break
                at = kids[d]
            else:
                return
        self.value.append(x)
        self.kids.append({})

    def near(self, x: int, radius: int) -> list[int]:
        """All values within the radius. By the triangle inequality only edges from d - radius to d + radius can lead to one."""
        found, todo = [], [0] if self.value else []
        while todo:
            at = todo.pop()
            d = (self.value[at] ^ x).bit_count()
            if d <= radius:
                found.append(self.value[at])
            todo += [k for e, k in self.kids[at].items() if d - radius <= e <= d + radius]
        return found


def forest(left: list[int], right: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links that join what left (and right, if given: each of right against left) joins, without the ones that close a circle."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    tree, out = BKTree(), []

    def join(x: int) -> None:
        for y in tree.near(x, radius):
            if (a := root(x)) != (b := root(y)):
                up[max(a, b)] = min(a, b)
                out.append((x, y))

    for x in left:
        if right is None:
            join(x)
        tree.add(x)
    for x in right or ():
        join(x)
    return out


def shard_keys(fp: str, radius: int) -> F.Column:
    """Array of keys: for each pair of radius + 2 blocks its number and its bits."""
    cuts = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    block = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.xxhash64(F.lit(n), block[i], block[j]) for n, (i, j) in enumerate(combinations(range(radius + 2), 2))])


def links(distinct: DataFrame, radius: int = 3, tree_max: int = TREE_MAX) -> DataFrame:
    """(a, b): links between the values of distinct.fp at radius or fewer differing bits, enough to join all that such links join."""
    keyed = distinct.select("fp", F.explode(shard_keys("fp", radius)).alias("shard"))
    hot = keyed.groupBy("shard").count().where(F.col("count") > tree_max).select("shard", F.ceil(F.col("count") / tree_max).cast("int").alias("m"))
    dealt = keyed.join(hot, "shard", "left").withColumn("m", F.coalesce("m", F.lit(1))).withColumn("c", F.pmod(F.xxhash64("fp", F.lit(7)), F.col("m")).cast("int"))
    # block c meets each block j >= c as the tree and each block j < c as the query set
    other = F.expr("explode(sequence(0, m - 1))")
    dealt = dealt.select("shard", "fp", "c", other.alias("o")).select("shard", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("c") > F.col("o")).alias("q"), "fp")
    parts = dealt.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "q", "fp")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def solve(df: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame | None]:
            k = df[["shard", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(1)])
            ends = np.r_[starts[1:], len(k)]
            tail = None
            if not last:
                tail, starts, ends = df.iloc[starts[-1] :], starts[:-1], ends[:-1]
            fps, q, tile = df.fp.to_numpy(), df.q.to_numpy(), k[:, 1] != k[:, 2]
            found: set[tuple[int, int]] = set()
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
                x = [int(v) & (1 << 64) - 1 for v in fps[s:e]]
                n = int((~q[s:e]).sum())
                found.update(forest(x[:n], x[n:] if tile[s] else None, radius))
            ab = np.array(sorted(found), np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"a": ab[:, 0], "b": ab[:, 1]}), tail

        for b in batches:
            rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if len(rest):
                out, rest = solve(rest, False)
                yield out
        if rest is not None and len(rest):
            yield solve(rest, True)[0]

    return parts.mapInPandas(run, "a long, b long").distinct()


def groups(docs: DataFrame, width: int = 3, radius: int = 3, tree_max: int = TREE_MAX) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of docs.

    component_id is the least doc_id that links reach. A null or empty text has fingerprint zero and is linked like any other;
    repeated rows share all values; a null doc_id is kept and counts for no component_id, which is null if a component has no other.
    """
    fps = common.table(fingerprints(docs, width))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = common.components(links(distinct.select("fp"), radius, tree_max))
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.join(named, "root").select("fp", "component_id")
    return fps.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
