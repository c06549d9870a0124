"""SQL functions of the library. Scalar ones are SQL expressions, which the optimizer inlines; Python is used only where a group or a table is made."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..operators.encoding import pack, unpack

#: name -> (arguments, result, expression)
EXPRESSIONS = {
    "hv_hamming": ("a ARRAY<BIGINT>, b ARRAY<BIGINT>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0, (s, n) -> s + n) / (32D * size(a))"),
    "mz_bucket": ("mz DOUBLE, width DOUBLE", "INT", "CAST(floor(CAST(mz * 10 AS BIGINT) / width) AS INT)"),
    "ppm_gap": ("x DOUBLE, y DOUBLE", "DOUBLE", "abs(x - y) / y * 1e6"),
}


@F.pandas_udf(ArrayType(LongType()))
def hv_bundle(hv: pd.Series) -> list[int]:
    """Majority vector of a group: a bit is 1 if it is 1 in more than half, rounded down, of the vectors."""
    if not len(hv):
        return []
    bits = unpack(np.array(hv.tolist()))
    return pack((bits.sum(0) > len(bits) // 2)[None])[0].tolist()


class MgfPeaks:
    """Rows (mz, intensity) of the peak lines of an MGF block."""

    def eval(self, block: str):  # noqa: ANN201
        for line in (block or "").splitlines():
            parts = line.split()
            if len(parts) >= 2 and "=" not in line and line[0] != "#":
                try:
                    yield float(parts[0]), float(parts[1])
                except ValueError:
                    continue


def register(spark: SparkSession) -> None:
    """Register hv_hamming, mz_bucket, ppm_gap (expressions), hv_bundle (aggregate) and mgf_peaks (table function)."""
    for name, (arguments, result, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    spark.udf.register("hv_bundle", hv_bundle)
    spark.udtf.register("mgf_peaks", F.udtf(MgfPeaks, returnType="mz double, intensity double"))
