"""Best-fit packing of token sequences by minimum bin slack.

Documents are tokenised, ended with one id and cut only where they are longer than a sequence. Packing is planned on the histogram of
piece lengths alone, which has no more rows than a sequence has tokens, however many pieces there are: for one bin, the longest
length left is taken and a bitset dynamic program over the lengths left finds the fullest combination with it; that combination is
removed as often as the counts allow, and so on. Pieces are then ranked within their length, in salted parts, and a rank names the
place.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CAPACITY = 4096
END_ID = 1
#: Words whose ids a worker keeps, at most.
CACHE_MAX = 600_000
#: Text bytes whose words are looked up at once.
BLOCK = 8 << 20
#: Pieces in one salted part of a length, about.
PART = 1_000
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Encoder:
    """Ids of texts by a `tokenizers` file whose pre-tokeniser splits at white space, each white-space-delimited word looked up once.

    The file's normaliser and pre-tokeniser never join what ASCII white space parts, so that the ids of a text are those of its words
    in a row. A-Z may be lower-cased beforehand if the normaliser lower-cases; words that could hold a special token are left alone.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def one_by_one(self, words: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]

    def letters(self, words: list[bytes]) -> list[bytes]:
        """Words of letters alone: each is one pre-token, whose last token alone ends a word, so that many can be encoded in one text."""
        if not words:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return self.one_by_one(words)
        whole, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [whole[a:b] for a, b in zip(at, at[1:], strict=False)]

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of all the words."""
        got: dict[bytes, bytes] = {}
        split = {}
        for w in words:
            core = w.rstrip(_MARKS)
            if core and core != w and core[-1:].isalpha() and b"<|" not in w:
                split[w] = core, w[len(core) :]
        need = {p for both in split.values() for p in both if p not in self.known} | (words - split.keys())
        plain = [w for w in need if w.decode().isalpha()]
        got.update(zip(plain, self.letters(plain), strict=True))
        odd = list(need - got.keys())
        got.update(zip(odd, self.one_by_one(odd), strict=True))
        either = lambda p: self.known[p] if p in self.known else got[p]
        got.update((w, either(a) + either(b)) for w, (a, b) in split.items())
        return got

    def encode(self, rows: list[bytes]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in rows]
        block: list[tuple[int, list[bytes]]] = []
        size = 0

        def flush() -> None:
            nonlocal block, size
            used = set().union(*[w for _, w in block])
            more = self.learn(used - self.known.keys())
            if len(self.known) + len(more) <= CACHE_MAX:
                self.known.update(more)
            # words recur within a block: a small table of its own is read faster than the large one
            near = {w: self.known.get(w) or more[w] for w in used} if more else dict(zip(used, map(self.known.__getitem__, used), strict=True))
            for i, words in block:
                out[i].append(b"".join(map(near.__getitem__, words)))
            block, size = [], 0

        for i, text in enumerate(rows):
            for part in common.blocks(text, BLOCK):
                block.append((i, part.split() if b"<|" in part else part.lower().split()))
                size += len(part)
                if size >= BLOCK:
                    flush()
        flush()
        return [b"".join(x) for x in out]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) per piece; ids are little-endian unsigned 32-bit integers. A null text is empty: its one piece holds the end id alone. Repeated rows give repeated pieces; a null doc_id stays null."""
    src = common.pick(docs, "doc_id", "text")
    fields = [src.schema["doc_id"], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    fields += [T.StructField("ids", T.BinaryType())] * with_ids
    last = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for whole in batches:
            for b in common.slices(whole, 1):
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, made in enumerate(known.encode(common.texts(b.column(1)))):
                    made += last
                    for k, s in enumerate(range(0, len(made), 4 * capacity)):
                        cut = made[s : s + 4 * capacity] if len(made) > 4 * capacity else made
                        row.append(i)
                        piece.append(k)
                        start.append(s // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            ids.append(cut)
                arrays = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
                yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(ids, pa.binary())] * with_ids], names=[f.name for f in fields])

    return src.mapInArrow(run, T.StructType(fields))


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """Of the lengths with counts, a combination (length -> times) whose sum is the greatest of at most room."""
    if counts.get(room):
        return {room: 1}
    reach, steps = 1, []
    mask = (1 << room + 1) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0:
            times = min(part, left)
            steps.append((length, times, reach))
            reach |= reach << length * times & mask
            left -= times
            part *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            at -= length * times
            out[length] = out.get(length, 0) + times
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(combination, times) until no length is left."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        top = max(left)
        left[top] -= 1
        best = fullest({k: v for k, v in left.items() if v}, capacity - top)
        left[top] += 1
        best[top] = best.get(top, 0) + 1
        times = min(left[k] // n for k, n in best.items())
        out.append((best, times))
        for k, n in best.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. cut must give the same rows each time it is read (a written table)."""
    hist = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    seg, base, used = [], 0, dict.fromkeys(hist, 0)
    for best, times in plan(hist, capacity):
        offset = 0
        for length in sorted(best, reverse=True):
            n = best[length]
            seg.append((length << 40 | used[length], used[length], n, base, offset))
            used[length] += n * times
            offset += n * length
        base += times
    table = np.array(sorted(seg), np.int64).reshape(-1, 5)
    salts = F.get(F.array(*[F.lit(hist.get(k, 0) // PART + 1) for k in range(capacity + 1)]), F.col("length").cast("int"))
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts))
    before = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("_own", own).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1).select(*cut.columns, "_rank")
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    n = len(cut.columns)
    at = cut.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(at).to_numpy(), b.column(n).to_numpy()
            row = table[np.searchsorted(table[:, 0], length << 40 | rank, side="right") - 1] if len(table) else np.zeros((0, 5), np.int64)
            k = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(row[:, 3] + k // row[:, 2]), pa.array(row[:, 4] + k % row[:, 2] * length)], names=schema.names)

    return ranked.mapInArrow(run, schema)


def placed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of docs with their places: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A null or empty text is one piece of the end id alone; a very long one is cut into pieces of capacity tokens; repeated rows give
    repeated pieces, each with a place of its own; pieces of equal length, the ties, take places in the order of doc_id, piece and
    checksum within salted parts. An empty table gives no rows. Other columns of docs, whatever their names, are left alone.
    """
    return pack(common.table(pieces(docs, tokenizer, capacity, with_ids)), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences themselves. A group holds capacity tokens at most."""

    def fn(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("offset")
        return pd.DataFrame({"sequence_id": df.sequence_id.iloc[:1], "ids": [np.frombuffer(b"".join(df.ids), "<u4").astype(np.int32)], "doc_ids": [df.doc_id.tolist()]})

    return placed(docs, tokenizer, capacity, True).groupBy("sequence_id").applyInPandas(fn, "sequence_id long, ids array<int>, doc_ids array<long>")
