"""Exact nearest neighbours of all points among all points.

Points are dealt to their nearest pivot. A block of points first looks at itself, which bounds the distance of each point's k-th
neighbour; by the triangle inequality it then needs the cells of only those pivots that can hold something nearer. Cells travel as
chunks, a few kilobytes of points to a row, and a block takes them one after the other, nearest first, while its bounds tighten. Where no
bound helps (independent coordinates in many dimensions) every block needs every cell, and the work is the square of the points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import table
from .splits import draw

#: Pivots, and numbers in them, at most.
PIVOTS, PIVOT_NUMBERS = 1_024, 1 << 20
#: Blocks that are aimed at, and points in one, at least and at most.
BLOCKS, LEAST, MOST = 48, 512, 16_384
#: Bytes of one chunk of points.
CHUNK_BYTES = 16 << 10
#: Points of a cell that are compared at once.
STEP = 512


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def chain(pivots: np.ndarray) -> np.ndarray:
    """An order of the pivots in which neighbours are near."""
    left, order = list(range(len(pivots))), []
    while left:
        last = order[-1] if order else 0
        d = ((pivots[left] - pivots[last]) ** 2).sum(1)
        order.append(left.pop(int(d.argmin())))
    return np.array(order)


class Nearest:
    """The k nearest points found so far of each point of a block, by distance, then id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.middle = x.mean(0) if len(x) else 0.0
        self.low = (x - self.middle).astype(np.float32)
        self.square = (self.low.astype(np.float64) ** 2).sum(1)
        self.far = np.full(len(ids), np.inf)
        self.who = np.empty(0, np.int64)  # rows of the block, with other and d beside
        self.other, self.d = np.empty(0, np.int64), np.empty(0)
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.seen = 0
        self.held, self.most = 0, max(1 << 14, k * len(ids))  # candidates are sorted out when they are as many as what is kept

    def see(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Candidates by single-precision products, with room for their rounding; kept by the exact distance."""
        s = 0
        while s < len(ids):
            step = min(STEP, max(2 * self.k, self.seen))  # few points give a first bound
            self.seen += step
            y, names = x[s : s + step], ids[s : s + step]
            s += step
            low = (y - self.middle).astype(np.float32)
            square = (low.astype(np.float64) ** 2).sum(1)
            slack = 4e-7 * (len(self.middle) + 8) * (self.square + square.max())
            room = (self.far**2 - self.square + slack).astype(np.float32)
            part = np.hstack([self.low, np.ones((len(self.low), 1), np.float32)]) @ np.vstack([-2 * low.T, square.astype(np.float32)[None]])
            i, j = np.nonzero(part <= room[:, None])
            for t in range(0, len(i), 1 << 18):
                a, b = i[t : t + (1 << 18)], j[t : t + (1 << 18)]
                d = np.sqrt(((self.x[a] - y[b]) ** 2).sum(1))
                ok = (d <= self.far[a]) & (self.ids[a] != names[b])
                self.more.append((a[ok], names[b[ok]], d[ok]))
                self.held += int(ok.sum())
                if self.held > self.most or step < STEP:
                    self.settle()

    def done(self) -> Nearest:
        self.settle()
        return self

    def settle(self) -> None:
        if not self.held:
            return
        who = np.concatenate([self.who, *[m[0] for m in self.more]])
        other = np.concatenate([self.other, *[m[1] for m in self.more]])
        d = np.concatenate([self.d, *[m[2] for m in self.more]])
        order = np.lexsort((other, d, who))
        who, other, d = who[order], other[order], d[order]
        start = np.searchsorted(who, np.arange(len(self.ids)))
        place = np.arange(len(who)) - start[who]
        keep = place < self.k
        last = place == self.k - 1
        self.far[who[last]] = d[last]
        self.who, self.other, self.d = who[keep], other[keep], d[keep]
        self.more, self.held = [], 0


def nearest(points: DataFrame, k: int, blocks: int = BLOCKS, least: int = LEAST) -> DataFrame:
    """(point, other, d): the k nearest other points of each, by Euclidean distance, then id. points is a table of point (unique longs) and x (arrays of equal length)."""
    n = points.count()
    if not n:
        return points.select("point", F.lit(0).cast("long").alias("other"), F.lit(0.0).alias("d"))
    width = len(points.select("x").first()["x"])
    many = max(1, min(PIVOTS, PIVOT_NUMBERS // max(width, 1), int(n**0.5)))
    taken = points.orderBy(draw("point"), "point").limit(many).select("x").collect()  # a bounded number of pivots
    pivots = np.array([r["x"] for r in taken], float).reshape(many, width)
    pivots = pivots[chain(pivots)]
    size = min(MOST, max(least, -(-n // blocks)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                d = distances(x, pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(np.sqrt(((x - pivots[cell]) ** 2).sum(1)))], names=["point", "x", "cell", "dp"])

    dealt = table(points.select("point", F.col("x").cast("array<double>").alias("x")).mapInArrow(deal, "point long, x array<double>, cell int, dp double"))
    count, radius, inner = np.zeros(many, np.int64), np.zeros(many), np.full(many, np.inf)
    for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("dp").alias("u"), F.min("dp").alias("l")).collect():  # a row per pivot
        count[r["cell"]], radius[r["cell"]], inner[r["cell"]] = r["n"], r["u"], r["l"]
    # neighbouring small cells share a block, large ones are split by a hash
    first, splits, block, held = np.zeros(many, int), np.ones(many, int), -1, size
    for c in range(many):
        if count[c] > size:
            splits[c] = -(-count[c] // size)
            first[c], block, held = block + 1, block + splits[c], size
        else:
            if held + count[c] > size:
                block, held = block + 1, 0
            first[c], held = max(block, 0), held + count[c]
    look = lambda a: F.get(F.array(*[F.lit(int(v)) for v in a]), F.col("cell"))
    rows = table(dealt.withColumn("block", (look(first) + F.pmod(F.xxhash64("point"), look(splits))).cast("int")))
    per = max(1, CHUNK_BYTES // (8 * max(width, 1)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, cell, blk = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy()
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            cuts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (blk[1:] != blk[:-1])]) if len(ids) else np.empty(0, int)
            at = [(s, min(s + per, e)) for a, e in zip(cuts, [*cuts[1:], len(ids)], strict=True) for s in range(a, e, per)]
            yield pa.RecordBatch.from_arrays([pa.array([int(cell[s]) for s, _ in at], pa.int32()), pa.array([int(blk[s]) for s, _ in at], pa.int32()), pa.array([ids[s:e].tobytes() for s, e in at], pa.binary()), pa.array([np.ascontiguousarray(x[s:e]).tobytes() for s, e in at], pa.binary())], names=["cell", "block", "ids", "x"])

    chunks = table(rows.select("point", "x", "cell", "block").repartition("block").sortWithinPartitions("block", "cell").mapInArrow(pack, "cell int, block int, ids binary, x binary"))

    def unpack(ids: list[bytes], x: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(ids), np.int64), np.frombuffer(b"".join(x), float).reshape(-1, width)

    between = distances(pivots, pivots)

    def need(pdf: pd.DataFrame) -> pd.DataFrame:
        """The cells that a block needs, and their rank by nearness."""
        cells = np.repeat(pdf.cell.to_numpy(), [len(i) // 8 for i in pdf.ids])
        ids, x = unpack(pdf.ids.tolist(), pdf.x.tolist())
        own = Nearest(ids, x, k)
        own.see(ids, x)
        own.done()
        wanted, near = np.zeros(many, bool), np.full(many, np.inf)
        for s in range(0, len(ids), STEP):
            d = distances(x[s : s + STEP], pivots)
            c = cells[s : s + STEP]
            mine = d[np.arange(len(d)), c]
            plane = (d**2 - mine[:, None] ** 2) / (2 * np.maximum(between[c], 1e-300))
            plane[np.arange(len(d)), c] = 0
            least = np.maximum(np.maximum(d - radius, inner - d), plane)
            wanted |= (least <= own.far[s : s + STEP, None] * (1 + 1e-9) + 1e-6 * (1 + mine[:, None])).any(0)
            near = np.minimum(near, d.min(0))
        wanted &= count > 0
        rank = np.empty(many, np.int64)
        rank[np.argsort(near, kind="stable")] = np.arange(many)
        at = np.flatnonzero(wanted)
        return pd.DataFrame({"to": pdf.block.iloc[0], "cell": at.astype(np.int32), "rank": rank[at].astype(np.int32)})

    wanted = table(chunks.groupBy("block").applyInPandas(need, "to int, cell int, rank int"))
    mine = chunks.select(F.col("block").alias("to"), F.lit(-1).alias("rank"), F.lit(True).alias("own"), "ids", "x")
    others = chunks.join(wanted, "cell").where(F.col("block") != F.col("to")).select("to", "rank", F.lit(False).alias("own"), "ids", "x")
    flow = mine.unionByName(others).repartition("to").sortWithinPartitions("to", "rank")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        ids: list[bytes] = []
        x: list[bytes] = []
        found: Nearest | None = None

        def begin() -> Nearest:
            made = Nearest(*unpack(ids, x), k)
            made.see(made.ids, made.x)
            return made

        def end() -> Iterator[pa.RecordBatch]:
            if now is not None:
                got = (found or begin()).done()
                for s in range(0, len(got.who), 1 << 17):
                    yield pa.RecordBatch.from_arrays([pa.array(got.ids[got.who[s : s + (1 << 17)]]), pa.array(got.other[s : s + (1 << 17)]), pa.array(got.d[s : s + (1 << 17)])], names=["point", "other", "d"])

        for b in batches:
            to, own = b.column(0).to_pylist(), b.column(2).to_pylist()
            names, points_of = b.column(3).to_pylist(), b.column(4).to_pylist()
            seen: tuple[list[bytes], list[bytes]] = ([], [])
            for r in range(b.num_rows):
                if to[r] != now:
                    if seen[0]:
                        found.see(*unpack(*seen))
                        seen = ([], [])
                    yield from end()
                    now, ids, x, found = to[r], [], [], None
                if own[r]:
                    ids.append(names[r])
                    x.append(points_of[r])
                    continue
                if found is None:
                    found = begin()
                seen[0].append(names[r])
                seen[1].append(points_of[r])
                if len(seen[0]) * per >= STEP:
                    found.see(*unpack(*seen))
                    seen = ([], [])
            if seen[0]:
                found.see(*unpack(*seen))
        yield from end()

    return flow.mapInArrow(search, T.StructType([T.StructField("point", T.LongType()), T.StructField("other", T.LongType()), T.StructField("d", T.DoubleType())]))
