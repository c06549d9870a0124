"""Packing along a space-filling curve.

A document's token ids are hashed into a vector of counts, which a fixed random matrix projects to a few dimensions. Each dimension is
cut into cells at its quantiles, a cell's place on the Hilbert curve is the document's key, and documents are sorted by ranges of
keys. The tokens of all documents, in that order, are one line, which is cut at every multiple of a sequence's length: a sequence
holds neighbours on the curve, and none but the last has room left. What is left for the last is cut into powers of two, so that nothing
is padded. Only keys and lengths are sorted; positions on the line come from one total per range and are joined to the ids.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, sharding

CAPACITY = 1024
END_ID = 0
#: Cells of the hashed count vector, dimensions that it is projected to, and bits of each on the curve.
HASHED, DIMS, BITS = 512, 4, 6
#: Fixed grid on which a projected value is counted before quantiles are taken. Projections of unit vectors lie in -SPAN to SPAN but for rare ones, which fall into the outer steps.
GRID, SPAN = 4096, 4.0
#: Fixed value: how byte-level BPE files of this kind part a text before they merge bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes without white space, or of nothing else, from which on a text is left to the slower encoder, whose time isn't quadratic in them.
LONG = 4096
_LONG = re.compile(rb"[^ \t-\r]{%d}|[ \t-\r]{%d}" % (LONG, LONG))


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for themselves, the others are numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteEncoder:
    """Ids of texts by a `tokenizers` file of byte-level BPE without a normaliser, whose ids rise in the order of its merges.

    Its vocabulary is given to `tiktoken`, which finds the same ids in a fifth of the time. Texts with what could be a special token, or
    with very long runs, are left to `tokenizers`.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        vocab, byte = self.tokenizer.get_vocab(), byte_of()
        ranks = {bytes(byte[c] for c in w): i for w, i in vocab.items() if w not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: Ids are kept in two bytes if they fit.
        self.kind = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"
        self.special = [w.encode() for w in special]

    def encode(self, text: bytes) -> bytes:
        """The text's ids, in bytes of self.kind."""
        if any(w in text for w in self.special) or len(text) >= LONG and _LONG.search(text):
            ids = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text.decode())
        return np.array(ids, self.kind).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


@lru_cache(maxsize=2)
def matrix(dims: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((HASHED, dims))


def project(ids: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Places on the grid, 0 to GRID - 1, of a document's ids: damped counts of hashed ids, scaled to length one and projected. No ids: the middle."""
    if not len(ids):
        return np.full(dims, GRID // 2, np.int64)
    cell = ids.astype(np.uint32) * np.uint32(2654435769) >> np.uint32(32 - HASHED.bit_length() + 1)
    count = np.log1p(np.bincount(cell, minlength=HASHED))
    value = count / np.sqrt(count @ count) @ matrix(dims)
    return np.clip((value + SPAN) * (GRID / (2 * SPAN)), 0, GRID - 1).astype(np.int64)


def tokenised(docs: DataFrame, tokenizer: str, dims: int = DIMS) -> DataFrame:
    """(doc_id, row, n, g0, g1, ..., ids): ids end with the end id and n counts it; row is a number that no other row has once this is written."""
    src = common.pick(docs, "doc_id", "text")
    schema = T.StructType([src.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("row", "n")], *[T.StructField(f"g{i}", T.ShortType()) for i in range(dims)], T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        last, at = np.array([END_ID], known.kind).tobytes(), TaskContext.get().partitionId() << 40
        for whole in batches:
            for b in common.slices(whole, 1):
                made = [known.encode(t) for t in common.texts(b.column(1))]
                grid = np.array([project(np.frombuffer(x, known.kind), dims) for x in made], np.int16).reshape(-1, dims)
                n = [len(x) // len(last) + 1 for x in made]
                row = pa.array(np.arange(at, at + len(made)))
                at += len(made)
                yield pa.RecordBatch.from_arrays([b.column(0), row, pa.array(n, pa.int64()), *[pa.array(grid[:, i]) for i in range(dims)], pa.array([x + last for x in made], pa.binary())], names=schema.names)

    return src.mapInArrow(run, schema)


def cells(made: DataFrame, dims: int = DIMS, bits: int = BITS) -> list[F.Column]:
    """For each dimension the cell of a row, 0 to 2^bits - 1: documents are counted per step of the grid, and steps are dealt to cells by the share of documents below them."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"g{i}").alias("g")) for i in range(dims)])).alias("s")
    count = np.zeros((dims, GRID), np.int64)
    for r in made.select(steps).groupBy("s.i", "s.g").agg(F.count("*").alias("n")).collect():  # dims * GRID rows at most
        count[r["i"], r["g"]] = r["n"]
    below = np.cumsum(count, 1) - count
    cell = below * (1 << bits) // np.maximum(count.sum(1, keepdims=True), 1)
    return [F.get(F.array(*[F.lit(int(c)) for c in cell[i]]), F.col(f"g{i}").cast("int")) for i in range(dims)]


def line(made: DataFrame, dims: int = DIMS, bits: int = BITS) -> tuple[DataFrame, dict[int, int]]:
    """A table (row, hilbert, part, own), made by a sort of a few numbers per document by ranges of the curve: own is the tokens before a document in its part; and the tokens of each part."""
    keyed = made.select("doc_id", "row", "n", sharding.index(cells(made, dims, bits), bits).alias("hilbert"))
    order = ["hilbert", "doc_id", "row"]
    spread = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("row", "n", "hilbert", "part", "own")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.column(1).to_numpy()
            own = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(n), part, np.int64)), pa.array(own)], names=schema.names)

    run = common.table(spread.select("row", "n", "hilbert").mapInArrow(count, schema))
    return run, {r["part"]: r["n"] for r in run.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row per partition


def bounds(total: int, capacity: int = CAPACITY) -> tuple[int, np.ndarray]:
    """How many full sequences there are, and where those of the rest start, which have lengths of falling powers of two, then the end."""
    full = total // capacity
    rest, at, starts = total - full * capacity, full * capacity, []
    while rest:
        size = 1 << rest.bit_length() - 1
        starts.append(at)
        at, rest = at + size, rest - size
    return full, np.array([*starts, at], np.int64)


def placed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, dims: int = DIMS, bits: int = BITS) -> DataFrame:
    """Pieces of docs with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, hilbert[, ids].

    Sequences hold capacity tokens each but for those of the rest, whose lengths are powers of two. A null or empty text is the end id
    alone. Very long texts go on through as many sequences as they need. Ties on the curve are broken by doc_id, nulls first, then by
    the place in the table that was read; so repeated rows, and copies under other ids, follow each other, each with places of its
    own. An empty table gives no rows. Other columns of docs, whatever their names, are left alone. ids are little-endian unsigned
    32-bit integers.
    """
    made = common.table(tokenised(docs, tokenizer, dims))
    run, totals = line(made, dims, bits)
    before, total = [], 0
    for k in range(max(totals, default=-1) + 1):
        before.append(total)
        total += totals.get(k, 0)
    first = F.get(F.array(*[F.lit(x).cast("long") for x in before or [0]]), F.col("part").cast("int")) + F.col("own")
    both = made.select("doc_id", "row", "n", "ids").join(run.select("row", first.alias("first"), "hilbert").hint("shuffle_hash"), "row").select("doc_id", "n", "ids", "hilbert", "first")
    full, tail = bounds(total, capacity)
    longs = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "hilbert")
    schema = T.StructType([made.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in longs], *[T.StructField("ids", T.BinaryType())] * with_ids])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(tokenizer).kind
        for whole in batches:
            for b in common.slices(whole, 2):
                row, cols, ids = [], [], []
                n, key, first = (b.column(i).to_numpy() for i in (1, 3, 4))
                for i, held in enumerate(b.column(2)):
                    ids_of = np.frombuffer(held.as_buffer(), kind).astype("<u4", copy=False)
                    begun = at = int(first[i])
                    end = begun + int(n[i])
                    while at < end:
                        if at < full * capacity:
                            number, begin = at // capacity, at // capacity * capacity
                            stop = begin + capacity
                        else:
                            k = int(np.searchsorted(tail, at, side="right")) - 1
                            number, begin, stop = full + k, int(tail[k]), int(tail[k + 1])
                        upto = min(stop, end)
                        piece = ids_of[at - begun : upto - begun].tobytes()
                        row.append(i)
                        cols.append((at - begun, upto - at, zlib.crc32(piece), end - begun, number, at - begin, int(key[i])))
                        if with_ids:
                            ids.append(piece)
                        at = upto
                made_cols = np.array(cols, np.int64).reshape(-1, len(longs))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *[pa.array(made_cols[:, j]) for j in range(len(longs))], *[pa.array(ids, pa.binary())] * with_ids], names=schema.names)

    return both.mapInArrow(cut, schema)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, n, pieces): the sequences themselves, pieces an array of (offset, length, doc_id, start, ids) in their order. A sequence's group holds capacity tokens, and so at most as many pieces. Cases as in placed()."""
    piece = F.struct("offset", "length", "doc_id", "start", "ids")
    return placed(docs, tokenizer, capacity, True).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.array_sort(F.collect_list(piece)).alias("pieces"))
