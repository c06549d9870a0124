"""Quality rules: base limits on counts, then gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, gbt, textstats

#: Labelled rows that the trees are fitted on, at most.
TRAIN_MAX = 20_000
#: More of these may only lower the score.
FALLING = ("symbol_share", "dup_line_share", "repeat_share", "adjacent_share", "pipe_share", "bang_share")
#: Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50


def stat_rows(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """FEATURES and the other columns of the documents that the bounded frame ids (doc_id, ...) names. ids is broadcast; its size is its caller's limit. Of repeated ids the least text is taken, so that no more rows than ids come to the driver."""
    rest = [c for c in ids.columns if c != "doc_id"]
    few = common.pick(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", *rest).agg(F.min("text").alias("text"))

    def fn(rows: list[bytes]) -> list[pa.Array]:
        return [pa.array([x.tobytes() for x in textstats.measure_all(rows)[1]], pa.binary())]

    got = common.append(few, "text", fn, [T.StructField("x", T.BinaryType())], rest).toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float64).reshape(-1, len(textstats.FEATURES))
    return x, {c: got.column(c).to_numpy() for c in rest}


def fit(docs: DataFrame, labels: DataFrame, train_max: int = TRAIN_MAX) -> gbt.Trees | None:
    """Trees fitted on at most train_max labelled documents, chosen by a hash of their ids. None if labels has not both classes."""
    ids = common.pick(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)")
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_max).groupBy("doc_id").agg(F.min("quality").alias("y"))
    x, got = stat_rows(docs, ids)
    order = np.lexsort(x.T)
    x, y = x[order], got["y"][order].astype(float)
    if not 0 < y.sum() < len(y):
        return None
    return gbt.fit(x, y, {textstats.FEATURES.index(f): -1 for f in FALLING})


def apply(docs: DataFrame, model: gbt.Trees | None, least: float = 0.5) -> DataFrame:
    """Per row of docs: doc_id, the base counts, base_failed, score and kept (false if base_failed, else score >= least).

    A null text has no words and fails; without a model the base rules alone decide. Equal texts, and so repeated rows, get equal results
    in a row each; a score of just `least` is kept; a null doc_id stays null. Very long texts are counted whole, in blocks. An empty table
    gives no rows. Other columns of docs, whatever their names, are left alone.
    """

    def fn(rows: list[bytes]) -> list[pa.Array]:
        base, x = textstats.measure_all(rows)
        failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > MOST_REPEATED * base[:, 0])
        score = model.probability(x) if model else np.ones(len(rows))
        return [*[pa.array(base[:, i]) for i in range(len(textstats.BASE))], pa.array(failed), pa.array(score), pa.array(~failed & (score >= least))]

    fields = [*[T.StructField(c, T.LongType()) for c in textstats.BASE], T.StructField("base_failed", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())]
    return common.append(docs, "text", fn, fields, ["doc_id"])


#: The base counts of documents, straight from the definition.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
line AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY r),
win AS (SELECT r, p, w[p], w[p + 1], w[p + 2], count(*) OVER (PARTITION BY r, w[p], w[p + 1], w[p + 2]) AS times FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM d)),
rep AS (SELECT r, count(DISTINCT p + k) AS n_repeat_words FROM win, range(3) t(k) WHERE times > 1 GROUP BY r),
c AS (
  SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, cast(length(array_to_string(w, '')) AS BIGINT) AS word_chars, cast(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    cast(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, cast(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN line USING (r) LEFT JOIN rep USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c
"""
