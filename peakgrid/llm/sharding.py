"""Sharding along a Hilbert curve over several quantised metadata dimensions, cut into runs of equal row counts.

Rows that are near in all dimensions are near on the curve, so that a shard, and a row group within it, spans a narrow range of
each, and readers that filter on any of them skip most files.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import running
from . import common

SHARDS = 16
#: Bits of each dimension.
BITS = 5


@lru_cache(maxsize=8)
def curve(dims: int) -> tuple[list[int], list[int]]:
    """The curve as a state machine: for state * 2^dims + the cell's bits at one level, the curve's digit and the next state. A state is an entry corner and a direction."""
    n, size = dims, 1 << dims
    turn = lambda x, k: (x >> k % n | x << (n - k % n)) & size - 1
    gray = [i ^ i >> 1 for i in range(size)]
    rank = {g: i for i, g in enumerate(gray)}
    ones = lambda i: ((i + 1) & ~i).bit_length() - 1  # trailing ones of i
    entry = [0] + [gray[2 * ((i - 1) // 2)] for i in range(1, size)]
    way = [0] + [ones(i - 1) % n if i % 2 == 0 else ones(i) % n for i in range(1, size)]
    digit, after = [], []
    for e in range(size):
        for d in range(n):
            for bits in range(size):
                w = rank[turn(bits ^ e, d + 1)]
                digit.append(w)
                after.append((e ^ turn(entry[w], n - (d + 1))) * n + (d + way[w] + 1) % n)
    return digit, after


def index(cells: list[F.Column], bits: int = BITS) -> F.Column:
    """Place on the curve of a cell whose coordinates have so many bits each."""
    digit, after = (F.array(*map(F.lit, t)) for t in curve(len(cells)))
    level = lambda b: sum((F.shiftright(c, b).bitwiseAND(F.lit(1)) * (1 << i) for i, c in enumerate(cells)), F.lit(0))
    steps = F.array(*[level(b).cast("int") for b in reversed(range(bits))])
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("s"))

    def step(a: F.Column, x: F.Column) -> F.Column:
        k = a["s"] * (1 << len(cells)) + x
        return F.struct((a["h"] * (1 << len(cells)) + F.get(digit, k)).cast("long").alias("h"), F.get(after, k).alias("s"))

    return F.aggregate(steps, start, step)["h"]


def ordinal(df: DataFrame, name: str) -> F.Column:
    """A column that orders as the given one does: a string itself, else a number."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.col(name)
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.unix_timestamp(name).cast("double")
    return F.col(name).cast("double")


def string_quantiles(df: DataFrame, name: str, points: int) -> list[str]:
    """Values of a string column at evenly spaced places in the order of all its non-null rows, whole strings being compared. Only they come to the driver."""
    values = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))
    ordered = common.table(running(values, ["v"], {"upto": "n"}))
    total = ordered.agg(F.max("upto")).first()[0] or 0
    at = F.expr(f"transform(sequence(1, {points}), k -> cast(ceil(k * {total} / {points + 1}) as bigint))")
    met = ordered.select("v", F.explode(F.filter(at, lambda x: (x > F.col("upto") - F.col("n")) & (x <= F.col("upto")))))
    return sorted(r["v"] for r in met.select("v").collect())  # a row per point


def place(docs: DataFrame, dims: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Per row of docs: doc_id, size (UTF-8 bytes of the text, and 1), text_crc32, hilbert, shard and slot.

    Each dimension is cut at its quantiles (approximate ones of numbers, exact ones of whole strings) into 2^bits - 1 cells, so that the
    values of a column of few are spread over the cells by their shares of the rows; null is a cell of its own. Rows in the order of the
    curve, then of doc_id and checksum, are cut into runs whose counts differ by one at most. A null text has no bytes and checksum 0;
    texts of any length are read whole. Repeated rows follow each other. An empty table gives no rows. A column that isn't named in dims
    is left alone, whatever its name.
    """
    src = common.pick(docs, "doc_id", "text", *[d for d in dims if d not in ("doc_id", "text")])
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    src = src.select("doc_id", F.octet_length(text).cast("long").alias("size"), F.crc32(text).alias("crc"), *[ordinal(src, d).alias(f"d{i}") for i, d in enumerate(dims)])
    meta = common.table(src.withColumn("size", F.col("size") + 1))
    points = (1 << bits) - 2
    numbers = [i for i in range(len(dims)) if meta.schema[f"d{i}"].dataType.typeName() != "string"]
    asked = [F.percentile_approx(f"d{i}", [(k + 1) / (points + 1) for k in range(points)], 10_000).alias(f"d{i}") for i in numbers]
    cuts = dict(zip(numbers, meta.agg(*asked).first(), strict=True)) if numbers else {}
    cells = []
    for i in range(len(dims)):
        bounds = (cuts[i] or []) if i in cuts else string_quantiles(meta, f"d{i}", points)
        above = sum((F.when(F.col(f"d{i}") > b, bounds.count(b)).otherwise(0) for b in sorted(set(bounds))), F.lit(1))
        cells.append(F.when(F.col(f"d{i}").isNull(), 0).otherwise(above).cast("int"))
    curved = meta.select("doc_id", "size", "crc", *[c.alias(f"c{i}") for i, c in enumerate(cells)])
    curved = curved.select("doc_id", "size", "crc", index([F.col(f"c{i}") for i in range(len(dims))], bits).alias("hilbert"))
    order = ["hilbert", "doc_id", "crc", "size"]
    run = curved.repartitionByRange(*order).sortWithinPartitions(*order)
    run = common.table(run.withColumn("part", F.spark_partition_id()).withColumn("own", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = {r["part"]: r["n"] for r in run.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(k, 0)
    rank = F.get(F.array(*[F.lit(b).cast("long") for b in before or [0]]), F.col("part")) + F.col("own")
    ranked = run.withColumn("rank", rank).withColumn("shard", F.expr(f"cast((rank * {shards}) div {max(total, 1)} as int)"))
    slot = F.col("rank") - F.expr(f"(cast(shard as long) * {total} + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", F.col("crc").alias("text_crc32"), "hilbert", "shard", slot.alias("slot"))


def write(docs: DataFrame, path: str, dims: list[str], shards: int = SHARDS) -> None:
    """The documents themselves under path, in one folder per shard, along the curve.

    The folders' column is _shard, with as many more underscores as make it differ from all columns of docs. Rows are found again by doc_id and
    checksum, nulls included; a null text stays null. Repeated rows, which are told apart by nothing, all lie in the first shard that has one.
    Tasks take ranges of the curve, so that a shard may be several files, and none holds more than its range. An empty table writes no folder.
    Names of columns must differ by more than case, as Parquet files want it.
    """
    at = place(docs, dims, shards).groupBy("doc_id", "text_crc32").agg(F.min("hilbert").alias("hilbert"), F.min("shard").alias("shard"))
    cols, name = docs.columns, "_shard"
    while name in {c.lower() for c in cols}:
        name += "_"
    keyed = common.numbered(docs).withColumn("crc", F.crc32(F.coalesce(F.col(f"_{cols.index('text')}"), F.lit("")).cast("binary")))
    both = keyed.join(at, F.col(f"_{cols.index('doc_id')}").eqNullSafe(F.col("doc_id")) & (F.col("crc") == F.col("text_crc32")))
    line = ["shard", "hilbert", "doc_id", "crc"]
    out = common.table(both).repartitionByRange(*line).sortWithinPartitions(*line)
    out.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(cols)], F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
