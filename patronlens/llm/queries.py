"""The registered queries of this subpackage; each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens.llm import attention, bpe, chains, decontaminate, filter_audit, forest, licenses, mtree, simhash, spelling, toxicity, urls, warc
from patronlens.llm.store import limit_batches, read
from patronlens.staging import new_path

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    limit_batches(spark)
    found = chains.find_passages(read(spark, folder, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("first").alias("first_word"), F.col("last").alias("last_word"),
        F.col("anchor").alias("kept_doc_id"), F.col("anchor_first").alias("kept_first_word"), F.col("anchor_last").alias("kept_last_word"),
        "n_words", "identity",
    )


def op2_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.summary(licenses.scan_licenses(read(spark, folder, "documents")))


# The list and the days of the captures are made from the pages: digits of a digest of the host or the URL.
def digest_part(column: F.Column, start: int, modulus: int) -> F.Column:
    return F.conv(F.substring(F.md5(column), start, 6), 16, 10).cast("long") % modulus


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for a third of all hosts, parent domains and starts of paths of any depth: added, often removed, sometimes added again."""
    keys = pages.select(F.explode(urls.keys(F.col("url"))).alias("key")).distinct()
    first, gap, again = digest_part(F.col("key"), 1, 500), digest_part(F.col("key"), 7, 120), digest_part(F.col("key"), 13, 90)
    listed = keys.where(digest_part(F.col("key"), 19, 3) == 0)
    category = F.element_at(F.array(*map(F.lit, ("adult", "gambling", "malware", "spam"))), (digest_part(F.col("key"), 25, 4) + 1).cast("int"))

    def entry(days, action):
        return F.struct(days.alias("days"), F.lit(action).alias("action"))

    log = F.array(entry(first, "add"), entry(first + gap + 1, "remove"), entry(first + gap + again + 2, "add"))
    kept = F.slice(log, 1, (digest_part(F.col("key"), 27, 3) + 1).cast("int"))
    rows = listed.select("key", category.alias("category"), F.explode(kept).alias("e"))
    day = F.date_add(F.lit("2023-01-01").cast("date"), F.col("e.days").cast("int"))
    return rows.select("key", day.alias("day"), F.col("e.action").alias("action"), "category")


def op3_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2023-01-01").cast("date"), digest_part(F.col("url"), 1, 730).cast("int"))
    captures = pages.select(F.col("page_id").alias("id"), "url", day.alias("day"))
    return urls.filter_urls(captures, list_entries(pages)).withColumnRenamed("id", "page_id")


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = forest.quality_rules(read(spark, folder, "documents"), read(spark, folder, "labels"))
    return found.select("doc_id", *forest.COUNTS[:5], "base_failed", "kept", "anomaly")


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return attention.score_quality(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(read(spark, folder, "pages"), path)
    captures = warc.assemble(warc.read_archives(spark, path, payloads=False))
    return captures.select(
        "page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_page").alias("refers_to")
    )


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return bpe_digest(bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN))


def bpe_digest(decoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings")
    found = mtree.top_k(vectors, vectors.where("vec_id % 20 = 0"))
    return found.withColumnRenamed("id", "vec_id")


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(read(spark, folder, "documents"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(filter_audit.mask_counts(read(spark, folder, "documents"), read(spark, folder, "labels")))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, folder)


REGISTERED: list[Callable[[SparkSession, str], DataFrame]] = [
    op1_substring_dedup, op2_license_scans, op3_url_filters, op4_simhash, op5_toxicity, op6_decontamination,
    op7_quality_rules, op8_quality_classifier, op9_warc, op10_bpe, op11_top_k, op12_spelling, op13_filter_audit, pipeline,
]
