"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dartminhash, decontamination, langid, licences, line_spread, media, merkle, mixing, packing, pii, prefix_trie, spelling, url_reputation


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_duplicates(_documents(spark, sf_dir))


def op3_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_spread.remove_boilerplate(_documents(spark, sf_dir)).select("doc_id", "n_lines", "n_removed", "text")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = url_reputation.page_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return url_reputation.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), labels, page_label=url_reputation.document_of())


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"].isin(*pii.BASE))
    return pii.private_spans(_documents(spark, sf_dir)).select(
        "doc_id", *[count(k) for k in pii.BASE], F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(spans).alias("spans")
    )


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.fingerprints(_documents(spark, sf_dir))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.array_join("changed", ",").alias("changed"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(_documents(spark, sf_dir))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "intact")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = langid.identify(_documents(spark, sf_dir))
    return told.select("doc_id", langid.in_fold().alias("held_out"), "lang_pred", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_dartminhash": op1_dartminhash,
        "op2_url_reputation": op2_url_reputation,
        "op3_line_spread": op3_line_spread,
        "op4_mixing": op4_mixing,
        "op5_licences": op5_licences,
        "op6_pii": op6_pii,
        "op7_merkle": op7_merkle,
        "op8_packing": op8_packing,
        "op9_media": op9_media,
        "op10_langid": op10_langid,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_decontamination": op12_decontamination,
        "op13_spelling": op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_reputation": url_reputation.ORACLE,
        "op3_line_spread": line_spread.ORACLE,
        "op4_mixing": mixing.oracle_sql(),
        "op5_licences": licences.ORACLE,
        "op7_merkle": merkle.ORACLE,
        "op11_prefix_trie": prefix_trie.ORACLE,
        "op12_decontamination": decontamination.ORACLE,
        "op13_spelling": spelling.ORACLE,
    }
