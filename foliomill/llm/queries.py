"""The registered queries of the subpackage, each over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import language, mil
from foliomill.llm.conversations import audited
from foliomill.llm.decontaminate import contaminated
from foliomill.llm.licenses import known_digests, license_scan
from foliomill.llm.merkle import manifest, proof_text
from foliomill.llm.oracles import ORACLES as ORACLES
from foliomill.llm.packing import pack_documents
from foliomill.llm.near_dedup import near_duplicates
from foliomill.llm.quality_rules import quality_rules
from foliomill.llm.substring import remove_repeats
from foliomill.llm.suffixes import remove_repeated_bytes
from foliomill.llm.tables import table
from foliomill.llm.warc import archive_pages
from foliomill.llm.wrapper import extract_text

def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LANGUAGE_VOCABULARY = "piece_bpe_32k.model"
PACKING_VOCABULARY = "word_bpe_49k.json"


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    labelled = docs.where("not held_out").select(F.col("doc_id").alias("id"), "lang", "text")
    model = language.learn(labelled, public_tokenizers.path(LANGUAGE_VOCABULARY))
    return language.predict(docs.select("doc_id", "held_out", "text"), model)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_VOCABULARY))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archived = archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return archived.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return quality_rules(docs).select(*columns)


def _training_row(modulus: int, held_out: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus != held_out, F.lit(False))


def quality_model(spark: SparkSession, sf_dir: str) -> mil.Model | None:
    """Learnt from the labelled documents that are not held out."""
    labels = table(spark, sf_dir, "labels").where(_training_row(3, 1)).select("doc_id", F.col("quality").alias("label"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mil.learn(docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), "text", "label"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (~_training_row(3, 1)).alias("held_out"), "text")
    return mil.score(docs, quality_model(spark, sf_dir))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"), known_digests(spark))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_chars = F.col("n_chars").cast("decimal(20,0)")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    tree = manifest(table(spark, sf_dir, "documents"), F.when(tampered, n_chars + 1).otherwise(n_chars))
    proof = F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256")
    return tree.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontamination, op2_language_id, op3_best_fit_packing, op4_substring_dedup, op5_near_dedup, op6_warc,
        op7_wrapper_induction, op8_quality_rules, op9_quality_classifier, op10_license_scan, op11_merkle_manifest,
        op12_suffix_array_dedup, op13_conversation_repair,
    )
}
