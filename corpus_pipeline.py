"""From raw documents to tokens in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's ``docs``; all but the last return the columns of ``documents``.

Defined results: documents of null, empty or blank text have no words and go in the first stage; texts of
any length are read whole; null ids are no copies of anything and stay if nothing else is wrong with them; rows of one id
are judged one by one, but by near-duplicates as one document, so all of them stay or go; of near copies
the smallest id stays, of recurring lines those of the smallest id; extra columns pass through all stages but the
last; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quernel.llm import bpe, decontamination, line_dedup, near_duplicates, quality_rules
from quernel.llm.common import erase, scope, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.Cascade().fit(docs).keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from the texts, and with them documents of nothing else."""
    return line_dedup.dedup_lines(docs, emptied=False)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document of the smallest id stays."""
    return near_duplicates.keep(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, encoded and decoded again: number of tokens and digests."""
    return bpe.round_trip(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_duplicates", copies), ("decontamination", benchmarks), ("bpe", tokens)]

#: SQL cannot express byte-pair encoding; tests/llm compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage wrote on its way goes when its result is written,
    and a stage's result when the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scope() as made:
            docs = written(stage(spark, docs, sf_dir), name)
        erase(spark, before + made[:-1])
        before = made[-1:]
    return docs
