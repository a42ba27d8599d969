"""Queries of the training-data operators, one for each, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard, lm, oracles, packed, pii, quality, secrets, urls, warc
from tessera.llm.common import table

#: The tokenizer's vocabulary file.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: The query's block list: the canonical URLs of all pages on hosts with such a word, in the place of a maintained list.
UNWANTED = ("casino", "ads", "spam", "adult", "bets", "pills")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, urls.LIST_SCHEMA)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.url_verdicts(pages, rules, urls.listed_by_words(pages, UNWANTED)).drop("url")


def count_of(column: str, kind: str):
    return F.size(F.filter(column, lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    found = secrets.find_secrets(versions, secrets.BlobLedger(spark, packed.fresh_folder(spark, "ledger")))
    base = F.filter("findings", lambda f: f["kind"].isin(*secrets.BASE_KINDS))
    counts = [count_of("findings", k) for k in secrets.BASE_KINDS]
    return found.select(F.col("path").alias("doc_id"), *counts, F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("findings")).alias("spans"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = packed.fresh_folder(spark, "tokens")
    manifest = packed.write_token_files(table(spark, sf_dir, "documents"), TOKENIZER, folder)
    return packed.read_token_files(spark, manifest, folder)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(table(spark, sf_dir, "documents"))


def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: In the fixity audit's second replica one stored byte of each such page is flipped.
DECAY_EVERY, DECAY_AT = 97, 13


def decay(page_id: int, stored: bytes, replica: int) -> bytes:
    if replica == 0 or page_id is None or page_id % DECAY_EVERY != DECAY_AT:
        return stored
    at = len(stored) // 2
    return stored[:at] + bytes([stored[at] ^ 1]) + stored[at + 1 :]


def op2_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of an archive of all pages, one decayed: every record as read back, and whether the audit found it intact."""
    folders = [packed.fresh_folder(spark, f"warc-{k}") for k in range(2)]
    files = warc.write_archive(table(spark, sf_dir, "pages"), folders, decay)
    damaged = warc.audit(*[warc.merkle_tree(spark, files, f) for f in folders]).select("file", "idx", F.lit(True).alias("bad"))
    records = warc.read_records(spark, files, folders[0])
    out = records.join(damaged, ["file", "idx"], "left")
    return out.select("page_id", "url", "n_bytes", "sha256", F.col("bad").isNull().alias("intact"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_warc_audit": op2_warc_audit,
    "op3_secrets": op3_secrets,
    "op4_bpe": op4_bpe,
    "op5_decontamination": op5_decontamination,
    "op6_packed_ids": op6_packed_ids,
    "op7_quality": op7_quality,
    "op8_class_lm": op8_class_lm,
    "op9_url_filter": op9_url_filter,
    "op10_jaccard": op10_jaccard,
}

#: The others (a tagger, span offsets, tokenizers, edit matching, clustering) are beyond SQL and are tested against brute force.
ORACLES: dict[str, str] = {
    "op2_warc_audit": oracles.WARC,
    "op7_quality": oracles.QUALITY,
    "op9_url_filter": oracles.urls(RULES, UNWANTED),
    "op10_jaccard": oracles.JACCARD,
}
