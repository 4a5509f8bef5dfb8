"""Corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir), with docs in the columns of `documents`, and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last keep those columns:

- toxicity: documents that score at least THRESHOLD go; learned from `labels` joined with the stage's own docs.
- line_dedup: lines of later repeated runs go; documents of which nothing is left go.
- ngram_join: of each group of near duplicates the document with the smallest doc_id stays, with all rows of that doc_id.
- decontaminate: documents that cover a benchmark item go.
- byte_bpe: token counts and digests of what is left.

Documents with a null doc_id pass stages that decide by doc_id. Empty tables give empty results with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import byte_bpe, decontaminate, line_dedup, ngram_join
from folioscope.llm import toxicity as tox
from folioscope.llm.common import table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    index = tox.fit_held_out(docs, table(spark, sf_dir, "labels"))
    return tox.without_toxic(docs, index)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = ngram_join.ngram_join(docs)
    later = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(leaks.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.bpe(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", dedup_lines),
    ("ngram_join", dedup_near),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", tokenize),
]

#: Learning, tiling and BPE aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; between stages Parquet in the shared checkpoint folder."""
    from folioscope.llm.common import written

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
