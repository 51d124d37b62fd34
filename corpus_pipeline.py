"""Documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralag.llm import decontaminate, langid, line_dedup, packing, simhash_dedup
from terralag.llm.common import free_name, stage, table

#: Below this probability no language stands out. Documents in two languages score higher and stay.
MIN_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language with a probability of ``MIN_SCORE``, go."""
    pred, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    found = langid.predict(docs, langid.fit(docs), (pred, score))
    return found.where((F.col(pred) != "und") & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 code points or more found in three documents stay in the largest doc_id only."""
    return line_dedup.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id: equal texts, and texts with a similarity
    of 0.8 or more over 5-word shingles."""
    return simhash_dedup.drop_near_copies(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens."""
    return packing.pieces(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), size=1024))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: Languages, similarities and tokens can't be told in SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
