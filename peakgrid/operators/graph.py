"""Connected components by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the undirected graph with edges (a, b): rows (node, root), root the least node that can be reached.

    Alternates large-star and small-star steps (Kiveris et al., Connected Components in MapReduce and Beyond, 2014): after some
    logarithmic number of rounds every node hangs from its component's least node. All steps are joins and grouped minima; nothing
    is gathered in one place, and each round is cut off in the shared folder. Nodes without edges don't appear; nulls are ignored.
    """

    def flat(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = cut(flat(edges))
    seen = state(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = flat(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = cut(flat(small.select("e.a", "e.b")))
        before, seen = seen, state(now)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
