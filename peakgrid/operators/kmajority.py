"""k-majority: k-means on packed binary vectors, with Hamming distances and majority vectors as centres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import table
from . import encoding

#: Bits of all centres together, at most; they go to every task.
CENTRE_BITS = 1 << 26
#: Rounds of seeding, and candidates that each of them draws for a centre, about.
SEED_ROUNDS, OVER = 5, 2.0
#: Distances that are held at once.
BLOCK = 1 << 22


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits, a row per a and a column per b."""
    d = np.zeros((len(a), len(b)), np.int32)
    for w in range(a.shape[1]):
        d += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    return d


def nearest(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """df with centre, the number of the nearest centre, the first of equally near ones, and far, the differing bits. hv mustn't be null."""
    at, words = df.columns.index("hv"), centres.shape[1]
    schema = T.StructType([*df.schema.fields, T.StructField("centre", T.IntegerType()), T.StructField("far", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK // max(len(centres), 1))
        for b in batches:
            hv = b.column(at).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, words)
            best, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int32)
            for s in range(0, b.num_rows, step):
                d = hamming(hv[s : s + step], centres)
                best[s : s + step] = d.argmin(1)
                far[s : s + step] = d.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best), pa.array(far)], names=schema.names)

    return df.mapInArrow(run, schema)


def majorities(assigned: DataFrame, dim: int) -> DataFrame:
    """(centre, hv, members): the majority vector of each centre's members."""
    return encoding.bundle(assigned, ["centre"], dim)


def draw(number: int) -> F.Column:
    """A number from 0 to 1 for each row's id, another one in each round."""
    return F.pmod(F.xxhash64("spectrum_id", F.lit(number)), F.lit(1 << 52)) / float(1 << 52)


def seeds(df: DataFrame, k: int, rounds: int = SEED_ROUNDS, over: float = OVER) -> np.ndarray:
    """k-means||: in each round every vector is a candidate with a chance in proportion to its distance to those so far; the candidates, weighted by whom they are nearest to, are thinned to k on the driver. About over * k * rounds candidates come there."""
    ids = F.struct(draw(0).alias("u"), "spectrum_id", "hv")
    first = df.agg(F.min(ids).alias("f")).first()["f"]
    if first is None:
        return np.zeros((0, 0), np.int64)
    found = np.array([first["hv"]], np.int64)
    for r in range(1, rounds + 1):
        far = table(nearest(df, found).select("spectrum_id", "hv", "far"))
        whole = far.agg(F.sum("far")).first()[0]
        if not whole:
            break
        more = far.where(draw(r) < F.least(F.lit(1.0), F.col("far") * (over * k / whole))).orderBy("spectrum_id").limit(int(4 * over * k) + 16).select("hv").collect()
        if more:
            found = np.unique(np.concatenate([found, np.array([m["hv"] for m in more], np.int64)]), axis=0)
    if len(found) <= k:
        return found
    weight = np.zeros(len(found))
    for r in nearest(df, found).groupBy("centre").agg(F.count("*").alias("n")).collect():  # a row per candidate
        weight[r["centre"]] = r["n"]
    d = hamming(found, found).astype(float)
    chosen = [int(weight.argmax())]
    least = d[chosen[0]]
    while len(chosen) < k:
        at = int((least * weight).argmax())
        if not least[at]:
            break
        chosen.append(at)
        least = np.minimum(least, d[at])
    return found[chosen]


def cluster(df: DataFrame, k: int, dim: int, rounds: int = 20, start: np.ndarray | None = None) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(df with centre and far, the centres, the cost of each round): the cost is the sum of differing bits and falls until it stays. Rows without a vector are left out; a centre without members keeps its vector. start: the first centres, else seeds()."""
    if k < 1 or k * dim > CENTRE_BITS:
        raise ValueError(f"k must be 1 to {CENTRE_BITS // dim} for vectors of {dim} bits")
    df = table(df.where("hv is not null"))
    centres = seeds(df, k) if start is None else start
    costs: list[int] = []
    if not len(centres):
        none = F.lit(None).cast("int")
        return df.select("*", none.alias("centre"), none.alias("far")), centres, costs
    while True:
        got = table(nearest(df, centres))
        costs.append(int(got.agg(F.sum("far")).first()[0]))
        if len(costs) > rounds or len(costs) > 1 and costs[-1] >= costs[-2]:
            return got, centres, costs
        centres = centres.copy()
        for r in majorities(got, dim).collect():  # a row per centre
            centres[r["centre"]] = r["hv"]
