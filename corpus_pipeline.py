"""From raw documents to packed training sequences: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
``documents``; the last returns one row per packed piece. ``run`` writes each result
to the shared folder and reads it back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm.bands import kept_documents
from tabulith.llm.joins import by_ids
from tabulith.llm.minhash import near_duplicates
from tabulith.llm.packing import pack
from tabulith.llm.positions import decontaminate
from tabulith.llm.repeats import without_repeats
from tabulith.llm.words import documents
from tabulith.session import cut_lineage, small_batches


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or leave their compression bands go."""
    small_batches(spark)
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, once."""
    small_batches(spark)
    gone = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    left = by_ids(docs, cut_lineage(gone), "left_anti")
    twice = cut_lineage(docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id"))
    if twice.isEmpty():
        return left
    return by_ids(left, twice, "left_anti").unionByName(by_ids(left, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


def suffix_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document has are cut out."""
    small_batches(spark)
    return without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    small_batches(spark)
    gone = decontaminate(docs, documents(spark, sf_dir, "benchmark")).filter("contaminated").select("doc_id").distinct()
    return by_ids(docs, cut_lineage(gone), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids packed into sequences of 4096."""
    small_batches(spark)
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_words=False)


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("suffix-array dedup", suffix_repeats),
    ("decontamination", benchmark_leaks),
    ("packing", packing),
]

#: The bands, the packing and the suffix order are beyond SQL; the tests compare ``run`` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
