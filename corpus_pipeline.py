"""From raw documents to token ids, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all documents that its predecessor kept; the result is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from patronlens.llm import bpe, chains, decontaminate, simhash, toxicity
from patronlens.llm.queries import RANKS, bpe_digest
from patronlens.llm.store import forget, keep, limit_batches, read, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: The stages train models and hash with functions that SQL does not have; tests hold them against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject, row by row."""
    limit_batches(spark)
    return toxicity.drop_toxic(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: that with the smallest id, of several rows one."""
    limit_batches(spark)
    return simhash.drop_near_duplicates(docs.select(*COLUMNS))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one keeps."""
    limit_batches(spark)
    return chains.remove_passages(docs.select(*COLUMNS))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark items; those that consist of them for the most part go."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, decoded again, as counts and digests."""
    return bpe_digest(bpe.round_trip(docs.select("doc_id", "text"), RANKS, public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("benchmark_decontamination", cut_benchmark),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents").select(*COLUMNS), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            docs, path = keep(stage(spark, docs, sf_dir), name)
            kept.append(path)
        if before:
            forget(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
