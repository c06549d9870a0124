"""Hyperdimensional encoding of spectra as binary vectors, packed into 32-bit words held in longs, least bit first.

Two codebooks exist. The portable one draws bits from md5 and is built and used by column expressions alone; any SQL engine gives the
same vectors. The production one correlates neighbouring levels and m/z as the method wants, in numpy over Arrow batches; its draws come from md5 too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import Params
from ..plans.scratch import table


# ---- portable codebook ------------------------------------------------------------------------------------------------------


def md5_words(name: F.Column, dim: int) -> F.Column:
    """The packed vector of a name: bit d is the lowest bit of the first eight hex digits of md5('name:d')."""
    bit = lambda d: F.conv(F.substring(F.md5(F.concat(name, F.lit(":"), d.cast("string"))), 8, 1), 16, 10).cast("long").bitwiseAND(F.lit(1).cast("long"))
    word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda a, i: a + bit(i + 32 * w) * F.pow(F.lit(2.0), i).cast("long"))
    return F.array(*[word(w) for w in range(dim // 32)])


def level_codebook(df: DataFrame, dim: int, q: int) -> DataFrame:
    """(level, hv) for levels 0 to q; df gives the session."""
    levels = df.sparkSession.range(q + 1).select(F.col("id").cast("int").alias("level"))
    return levels.withColumn("hv", md5_words(F.concat(F.lit("lv"), F.col("level").cast("string")), dim))


#: Spreads four bits over four lanes of 16 bits.
SPREAD, LANES = 1 + (1 << 15) + (1 << 30) + (1 << 45), 1 + (1 << 16) + (1 << 32) + (1 << 48)


def lane_sums(words: list[F.Column], lanes: int) -> list[F.Column]:
    """Sums of bits, 2 or 4 dimensions to a long: dimension lanes * k + j in lane j of s{k}. Lanes of 32 bits hold two thousand million, of 16 bits 32,767; a sum beyond that is an error, not a wrong count."""
    one = F.lit(1).cast("long")

    def spread(w: F.Column, d: int) -> F.Column:
        if lanes == 4:
            return (F.shiftright(w, d).bitwiseAND(F.lit(15).cast("long")) * F.lit(SPREAD)).bitwiseAND(F.lit(LANES))
        return F.shiftright(w, d).bitwiseAND(one).bitwiseOR(F.shiftleft(F.shiftright(w, d + 1).bitwiseAND(one), 32))

    return [F.sum(spread(w, d)).alias(f"s{(32 * i + d) // lanes}") for i, w in enumerate(words) for d in range(0, 32, lanes)]


def majority(dim: int, lanes: int, on) -> list[F.Column]:
    """Words whose bits are set where on(count) holds of the counts in lane_sums."""
    width = 64 // lanes
    count = lambda d: F.shiftright(F.coalesce(F.col(f"s{d // lanes}"), F.lit(0).cast("long")), width * (d % lanes)).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    zero = F.lit(0).cast("long")
    return [sum((F.when(on(count(d)), F.lit(1 << d % 32).cast("long")).otherwise(zero) for d in range(32 * w, 32 * w + 32)), zero) for w in range(dim // 32)]


def encode_portable(df: DataFrame, dim: int = 64, q: int = 16) -> DataFrame:
    """df with hv: in dimension d the majority of level vector times m/z vector over the peaks (bits 1 as +1, 0 as -1), ties 0.

    Only the m/z and levels that occur get a vector, once each; one aggregation counts all dimensions.
    """
    peaks = df.select("spectrum_id", F.explode_outer("peaks").alias("p")).select("spectrum_id", F.floor("p.mz").cast("int").alias("mz_index"), F.floor(F.col("p.intensity") * q).cast("int").alias("level"))
    peaks = table(peaks)  # read three times; what made the spectra runs once
    levels = peaks.select("level").distinct().where("level is not null").withColumn("lv", md5_words(F.concat(F.lit("lv"), F.col("level").cast("string")), dim))
    ids = peaks.select("mz_index").distinct().where("mz_index is not null").withColumn("iv", md5_words(F.concat(F.lit("id"), F.col("mz_index").cast("string")), dim))
    both = peaks.join(levels, "level", "left").join(ids, "mz_index", "left")
    agree = [F.bitwise_not(F.get("lv", F.lit(w)).bitwiseXOR(F.get("iv", F.lit(w)))) for w in range(dim // 32)]
    named = both.select("spectrum_id", *[a.alias(f"w{w}") for w, a in enumerate(agree)])
    summed = named.groupBy("spectrum_id").agg(F.count("w0").alias("n"), *lane_sums([F.col(f"w{w}") for w in range(dim // 32)], 4))
    words = majority(dim, 4, lambda c: 2 * c > F.col("n"))
    return df.join(summed.select("spectrum_id", F.array(*words).alias("hv")), "spectrum_id")


# ---- production codebook ----------------------------------------------------------------------------------------------------


#: Words of vectors that are added up at once.
WORDS = 1 << 16


def codebook_length(low: float, high: float, width: float) -> tuple[int, float, float]:
    """Number of m/z bins and the range that they cover: low and high are moved out to whole bins."""
    start, end = low - low % width, high + width - high % width
    return int(np.ceil((end - start) / width)), start, end


def digests(names: Iterable[str]) -> np.ndarray:
    """The four unsigned 32-bit numbers in each name's md5, as rows."""
    return np.frombuffer(b"".join(hashlib.md5(n.encode()).digest() for n in names), ">u4").reshape(-1, 4).astype(np.int64)


@lru_cache(maxsize=4)
def codebooks(dim: int, q: int, bins: int, flip: float) -> tuple[np.ndarray, np.ndarray]:
    """Level and m/z vectors as int8 of -1 and 1, all draws by md5, so that any engine makes the same ones.

    Level 0 is -1 in the half of the dimensions whose md5('level:d') come first; level i has the sign of its first int(i/q * dim) // 2
    dimensions turned. Bit d of the first m/z vector is the first number of md5('mz:d') modulo 2; each further vector i is the one before
    with dim // flip positions, drawn with replacement as the numbers of md5('flip:i:0'), md5('flip:i:1'), ... modulo dim, turned.
    """
    rank = sorted(range(dim), key=lambda d: hashlib.md5(f"level:{d}".encode()).digest())
    base = np.ones(dim, np.int8)
    base[rank[: dim // 2]] = -1
    levels = np.repeat(base[None], q + 1, 0)
    for i in range(q + 1):
        levels[i, : int(i / q * dim) // 2] *= -1
    ids = np.empty((bins, dim), np.int8)
    ids[0] = 2 * (digests(f"mz:{d}" for d in range(dim))[:, 0] & 1) - 1
    turns = int(dim // flip)
    for i in range(1, bins):
        ids[i] = ids[i - 1]
        at = np.unique(digests(f"flip:{i}:{k}" for k in range(-(-turns // 4))).ravel()[:turns] % dim)
        ids[i, at] *= -1
    return levels, ids


@lru_cache(maxsize=4)
def md5_codebooks(dim: int, q: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """The portable codebook as int8 of -1 and 1."""
    bit = lambda name, d: int(hashlib.md5(f"{name}:{d}".encode()).hexdigest()[7], 16) & 1
    book = lambda kind, n: np.array([[2 * bit(f"{kind}{i}", d) - 1 for d in range(dim)] for i in range(n)], np.int8)
    return book("lv", q + 1), book("id", bins)


def pack(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 32-bit words in int64, least bit first."""
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").astype(np.int64)


def unpack(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words.astype("<u4")).view(np.uint8), axis=1, bitorder="little").astype(bool)


def signs(levels: np.ndarray, ids: np.ndarray, lv: np.ndarray, m: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per spectrum, whose peaks are `count` places from `start` on, the sum of level vector times m/z vector: first peaks of all spectra, then second ones, and so on."""
    most = int(count.max(initial=0))
    out = np.zeros((len(count), levels.shape[1]), np.int16 if most < 1 << 15 else np.int32)
    for k in range(most):
        some = np.flatnonzero(count > k)
        at = start[some] + k
        out[some] += levels[lv[at]] * ids[m[at]]
    return out


def lanes(bits: np.ndarray) -> np.ndarray:
    """Rows of 1 and other values as rows of 64-bit words (32-bit ones if these don't come out even), bit 1 where it is 1."""
    return np.packbits(bits == 1, axis=1, bitorder="little").view("<u4" if bits.shape[1] % 64 else "<u8")


def majorities(levels: np.ndarray, ids: np.ndarray, lv: np.ndarray, m: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Where signs() are positive, in lanes. A peak's product is 1 where its two vectors agree; the peaks' bits are added up in binary numbers that lie across words, for all spectra of as many peaks at once."""
    out = np.zeros((len(count), levels.shape[1]), levels.dtype)
    step = max(1, WORDS // levels.shape[1])
    order = np.argsort(count, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(count[order])) + 1):
        c = int(count[group[0]]) if len(group) else 0
        for s in range(0, len(group) if c else 0, step):
            rows = group[s : s + step]
            digits: list[np.ndarray] = []
            for k in range(c):
                at = start[rows] + k
                carry = ~(levels[lv[at]] ^ ids[m[at]])
                for n, digit in enumerate(digits):
                    digits[n], carry = digit ^ carry, digit & carry
                if k + 1 == 1 << len(digits):  # as high a sum was not possible before
                    digits.append(carry)
            more, same = np.zeros_like(digits[0]), ~np.zeros_like(digits[0])
            for n in reversed(range(len(digits))):  # more than half
                if c // 2 >> n & 1:
                    same &= digits[n]
                else:
                    more |= same & digits[n]
                    same &= ~digits[n]
            out[rows] = more
    return out


def encode(df: DataFrame, p: Params, portable: bool = False, width: float | None = None, packed: bool = False) -> DataFrame:
    """df with hv, of hd_dim bits from the production codebook, or from the portable one. m/z beyond the codebook take its last vector; a spectrum without peaks has only zeros.

    An m/z is looked up by its whole part, or with width by its bin between p.min_mz and p.max_mz, moved out to whole bins. With packed hv is
    the words' bytes, a quarter to a half of the size, which strips and tiles read as well.

    Arrow batches pass through numpy without a shuffle; each Python worker builds the codebook once.
    """
    bins, start, step = int(p.max_mz) + 2, 0.0, 1.0
    if width:
        bins, start, _ = codebook_length(p.min_mz, p.max_mz, width)
        step = width
    dim, q, flip = p.hd_dim, p.hd_q, p.hd_id_flip_factor
    n = len(df.columns)
    schema = T.StructType([*df.schema.fields, T.StructField("hv", T.BinaryType() if packed else T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, ids = (lanes(b) for b in (md5_codebooks(dim, q, bins) if portable else codebooks(dim, q, bins, flip)))
        for b in batches:
            peaks = b.column(n)
            count = np.diff(peaks.offsets.to_numpy())
            ends = count.cumsum()
            flat = peaks.flatten()
            mz, level = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            m = np.clip(((mz - start) / step).astype(np.int64) if width else mz.astype(np.int64), 0, bins - 1)
            lv = np.clip((level * q).astype(np.int64), 0, q)
            out = majorities(levels, ids, lv, m, ends - count, count)
            if packed:
                ends = pa.py_buffer((np.arange(b.num_rows + 1) * (dim // 8)).astype(np.int32))
                hv = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, ends, pa.py_buffer(out)])
            else:
                hv = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * (dim // 32), pa.int32()), pa.array(out.view("<u4").astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], hv], names=schema.names)

    return df.select("*", F.coalesce("peaks", F.array().cast(df.schema["peaks"].dataType)).alias("_peaks")).mapInArrow(run, schema)


# ---- bundles ----------------------------------------------------------------------------------------------------------------


def bundle(df: DataFrame, keys: list[str], dim: int, ties: int = 0) -> DataFrame:
    """(keys, hv, members): the majority of the vectors of each group, bit by bit. Where half of an even number of bits are 1, the bit is `ties`."""
    summed = df.groupBy(*keys).agg(F.count("hv").alias("members"), *lane_sums([F.get("hv", F.lit(w)) for w in range(dim // 32)], 2))
    words = majority(dim, 2, lambda c: 2 * c >= F.col("members") if ties else c > F.floor(F.col("members") / 2))
    return summed.select(*keys, F.array(*words).alias("hv"), "members")


def bit_counts(df: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """(keys, members, ones): of each group the vectors, nulls left out, and for each bit how many of them have it. Counts of parts of a group add up to the group's."""
    summed = df.groupBy(*keys).agg(F.count("hv").alias("members"), *lane_sums([F.get("hv", F.lit(w)) for w in range(dim // 32)], 2))
    one = lambda d: F.shiftright(F.coalesce(F.col(f"s{d // 2}"), F.lit(0).cast("long")), 32 * (d % 2)).bitwiseAND(F.lit((1 << 32) - 1).cast("long"))
    return summed.select(*keys, "members", F.array(*[one(d) for d in range(dim)]).alias("ones"))


def majority_of_counts(ones: F.Column, members: F.Column, dim: int) -> F.Column:
    """The vector that bundle() makes, from bit_counts(): a bit is 1 if more than half of the members, rounded down, have it."""
    bit = lambda d, i: F.when(F.get(ones, d) > F.floor(members / 2), F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))
    word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda a, i: a + bit(i + 32 * w, i))
    return F.array(*[word(w) for w in range(dim // 32)])


def cluster_bundles(df: DataFrame, keys: list[str], dim: int) -> DataFrame:
    """Majority vectors with the precursor of one member, the least spectrum_id's."""
    one = df.groupBy(*keys).agg(F.min_by("precursor_mz", "spectrum_id").alias("precursor_mz"))
    return bundle(df, keys, dim).join(one, keys)
