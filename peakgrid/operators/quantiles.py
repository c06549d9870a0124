"""Exact percentiles of whole tables and of large groups, without a task that sees more than its own share of the values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import running, table

#: Pivots that a round narrows by.
PIVOTS = 64
#: Distinct values that are read to the driver at the end, at most.
LAST = 10_000


def nth(values: DataFrame, rank: int, last: int = LAST) -> tuple[float, int]:
    """The value at this rank (from 0) of the ascending column v, a table without nulls, and how many values are up to it.

    In each round pivots are taken from the values between two bounds by mergeable sketches, values below and up to each pivot are
    counted, and the bounds close in on the two pivots around the rank. Few distinct values, or a pivot that holds the rank itself,
    end it. A round is two passes over one column and no shuffle but of the pivots' counts.
    """
    low: float | None = None
    high: float | None = None
    below = 0  # values up to low
    while True:
        part = values
        if low is not None:
            part = part.where(F.col("v") > low)
        if high is not None:
            part = part.where(F.col("v") < high)
        if part.limit(last + 1).count() <= last:
            for r in sorted(part.groupBy("v").agg(F.count("*").alias("n")).collect(), key=lambda r: (r["v"] != r["v"], r["v"])):
                if below + r["n"] > rank:
                    return r["v"], below + r["n"]
                below += r["n"]
            raise ValueError("rank beyond the values")
        asked = [(i + 1) / (PIVOTS + 1) for i in range(PIVOTS)]
        pivots = sorted(set(part.agg(F.percentile_approx("v", asked, 10_000).alias("p")).first()["p"]))
        counts = part.agg(*[F.count_if(F.col("v") < p).alias(f"b{i}") for i, p in enumerate(pivots)], *[F.count_if(F.col("v") <= p).alias(f"u{i}") for i, p in enumerate(pivots)]).first()
        at = next((i for i in range(len(pivots)) if below + counts[f"u{i}"] > rank), None)
        if at is not None and below + counts[f"b{at}"] <= rank:
            return pivots[at], below + counts[f"u{at}"]
        before = len(pivots) - 1 if at is None else at - 1
        if at is not None:
            high = pivots[at]
        if before >= 0:
            low, below = pivots[before], below + counts[f"u{before}"]


def percentile(df: DataFrame, column: str, share: float, last: int = LAST) -> float | None:
    """The linear percentile of all rows' column, as F.percentile gives it; nulls are left out, NaN is the greatest value. None without values."""
    values = table(df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")))
    n = values.count()
    if not n:
        return None
    place = share * (n - 1)
    rank = int(place)
    value, upto = nth(values, rank, last)
    if place == rank or upto > rank + 1:
        return value
    after = values.where(F.col("v") > value).agg(F.min("v")).first()[0]
    return value + (place - rank) * (after - value)


def percentile_by(df: DataFrame, keys: list[str], column: str, share: float) -> DataFrame:
    """(keys, at): the linear percentile of each group. Values are counted, and ranked by a sort in ranges over all groups, so that a group may hold any share of the rows. Nulls are left out; a group without values has no row (without keys, a row of null)."""
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    ranked = table(running(counted, [*keys, "_v"], {"_upto": "_n"}))
    span = ranked.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.min(F.col("_upto") - F.col("_n")).alias("_before"))
    same = [F.col(f"_k{i}").eqNullSafe(F.col(k)) for i, k in enumerate(keys)]
    span = span.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before", (F.lit(share) * (F.col("_all") - 1)).alias("_place"))
    both = ranked.join(span, same) if keys else ranked.crossJoin(span)  # one row
    upto, first = F.col("_upto") - F.col("_before"), F.col("_upto") - F.col("_before") - F.col("_n")
    rank = F.floor("_place")
    near = both.withColumn("_lo", (first <= rank) & (rank < upto)).withColumn("_hi", (first <= rank + 1) & (rank + 1 < upto)).where("_lo or _hi")
    picked = near.groupBy(*keys).agg(F.max(F.when(F.col("_lo"), F.col("_v"))).alias("_a"), F.max(F.when(F.col("_hi"), F.col("_v"))).alias("_b"), F.max(F.col("_place") - rank).alias("_f"))
    return picked.select(*keys, (F.col("_a") + F.when(F.col("_f") > 0, F.col("_f") * (F.col("_b") - F.col("_a"))).otherwise(0.0)).alias("at"))
