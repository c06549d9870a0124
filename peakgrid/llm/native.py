"""Column expressions that the native operators share. Nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: what parts words once A-Z is lower-cased, as a Java pattern.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes up to which a side whose size was counted is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def words(text: str) -> F.Column:
    """The words of a text, A-Z lower-cased; a null text has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER), NOT_WORD), "")


def shingle(array: str, at: F.Column, width: int) -> F.Column:
    """64-bit hash of the width words from at on."""
    return F.xxhash64(*[F.get(array, at + k) for k in range(width)])


def few(df: DataFrame, row_bytes: int, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df's counted rows, at row_bytes each, are within the limits of a broadcast."""
    n = df.limit(rows + 1).count()
    return n <= rows and n * row_bytes <= BROADCAST_BYTES
