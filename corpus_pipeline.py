"""A corpus pipeline: each stage calls one corpus operator on all that the stage before it kept.

All stages but the last return the columns of documents. A null text is an empty one: the quality stage scores it, and the language
stage, which keeps only texts with letters, rejects it. Repeated rows and copies fall to one in the near-duplicate stage. Very long texts
are read whole by every stage, empty tables give empty results, and columns beside those of documents, whatever their names, pass through
all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakgrid.llm import common, decontaminate, language, near_duplicates, packing, quality_pu
from peakgrid.llm.queries import tokenizer
from peakgrid.plans import scratch


def kept(judged: DataFrame, cols: list[str], column: int, verdict) -> DataFrame:
    """The first columns of judged, where verdict holds of the column at this place after them."""
    return common.numbered(judged).where(verdict(F.col(f"_{len(cols) + column}"))).select(*[f"_{i}" for i in range(len(cols))]).toDF(*cols)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier predicts to be good (a score of 0.5 or more). Equal texts, and so repeated rows, share their fate."""
    model = quality_pu.fit(docs, common.read(spark, sf_dir, "labels"))
    return kept(quality_pu.apply(docs, model, docs.columns), docs.columns, 1, lambda predicted: predicted == 1)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, with what the classifier found as their lang. Texts without a letter go, and those that no family's machine claims (a score below 0.5)."""
    cols = docs.columns
    found = common.numbered(language.apply(docs, language.fit(docs), cols))
    lang, score = F.col(f"_{len(cols)}"), F.col(f"_{len(cols) + 1}")
    return found.where((lang != "und") & (score >= 0.5)).select(*[lang.alias("lang") if c == "lang" else F.col(f"_{i}").alias(c) for i, c in enumerate(cols)])


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles overlap by 0.8: that with the least doc_id. SimHash finds the candidates, in BK-trees."""
    return near_duplicates.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated, as op4 judges them. One without words isn't; repeated rows are judged alike."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, in sequences, as op10 packs them: its columns, not those of documents. Repeated rows give repeated pieces."""
    return packing.placed(docs, tokenizer())


STAGES = [("quality classifier", quality), ("language ID", languages), ("SimHash near-dedup", near_duplicates_stage), ("benchmark decontamination", benchmark), ("best-fit packing", pack)]

#: Fitted models and tokenisers can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents. A stage's own tables are deleted once its result is written, and that result once the next one is."""
    docs, before = common.read(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{scratch.scratch(spark)}/stage-{k}-{uuid.uuid4().hex}"
        with scratch.scope(spark):
            docs = scratch.table(stage(spark, docs, sf_dir), path)
        if before:
            scratch.delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
