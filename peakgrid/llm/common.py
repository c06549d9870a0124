"""What the corpus operators share: picking columns and Arrow plumbing; scratch tables and graph components are the library's."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import components
from ..plans.scratch import cut, release, scratch, shared_dir, table

__all__ = ["append", "blocks", "components", "cut", "numbered", "pick", "read", "release", "scratch", "shared_dir", "slices", "table", "texts"]

#: Text bytes that one Python step handles at once; longer batches are sliced by rows.
SLICE_BYTES = 8 << 20
#: Bytes of one text that are worked on at once.
BLOCK_BYTES = 4 << 20
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """The same columns under the names _0, _1, ..., so that no given name can clash with ours."""
    return df.toDF(*[f"_{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, found by their exact names (the first of several equal ones)."""
    cols = df.columns
    return numbered(df).select(*[F.col(f"_{cols.index(n)}").alias(n) for n in names])


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """batch in row slices whose texts hold about SLICE_BYTES; a single longer text is a slice of its own."""
    n = batch.num_rows
    if not n or batch.column(column).nbytes <= SLICE_BYTES:
        if n:
            yield batch
        return
    at = 0
    while at < n:
        step = n - at
        while step > 1 and batch.column(column).slice(at, step).nbytes > SLICE_BYTES:
            step = (step + 1) // 2
        yield batch.slice(at, step)
        at += step


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(text: bytes, size: int = BLOCK_BYTES) -> Iterator[bytes]:
    """A text in pieces of about so many bytes, each of which ends with a character of ASCII white space if the text goes on. A word longer than that stays whole."""
    at, n = 0, len(text)
    while n - at > size:
        m = _SPACE.search(text, at + size)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    if at < n or not n:
        yield text[at:] if at else text


def append(df: DataFrame, over: str, fn: Callable[[list[bytes]], list[pa.Array]], fields: list[T.StructField], keep: list[str]) -> DataFrame:
    """Columns keep of df and, after them, what fn makes of the texts in column over. fn gets whole texts, a slice of rows at a time."""
    src = pick(df, *dict.fromkeys([*keep, over]))
    n, at = len(keep), list(src.columns).index(over)
    schema = T.StructType([*[T.StructField(f"_{i}", src.schema[i].dataType) for i in range(n)], *[T.StructField(f"__{f.name}", f.dataType) for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, at):
                made = fn(texts(b.column(at)))
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *made], names=schema.names)

    return numbered(src).mapInArrow(run, schema).toDF(*keep, *[f.name for f in fields])
