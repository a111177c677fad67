"""The queries of this subpackage: one opN_<name> for each operator, over its whole table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontamination import contamination, items_digest
from .filter_audit import filter_audit
from .jaccard_join import near_duplicates
from .licenses import license_scan
from .minhash import near_copies
from .mixing import mixed
from .oracles import ORACLE_SQL
from .pitman_yor import language_scores
from .prefix_trie import prefix_trie
from .quality import quality
from .shared import table
from .suffix_dedup import without_repeats
from .tokens import token_files
from .toxicity import fit, remainder, toxicity
from .warc import capture_index


def word_vocabulary() -> str:
    """The public word-level BPE vocabulary, as JSON text."""
    import public_tokenizers

    return Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingles and component of near duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures and verdicts of every document."""
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes without strings of 400 bytes that start elsewhere too."""
    cut = without_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"], with_text=False)
    return cut.select("row.doc_id", "found.n_bytes", "found.n_removed", F.size("found.removed").cast("bigint").alias("n_spans"), "found.kept_sha256")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the token files."""
    return token_files(table(spark, sf_dir, "documents"), word_vocabulary())


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, from the merged index of the archives."""
    return capture_index(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "history", "url_key", "timestamp"
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice in every document; documents without one have a row of nulls."""
    found = license_scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", F.explode_outer("found.matches").alias("m")).select(
        "doc_id", F.col("m.license").alias("license"), F.col("m.start").alias("start_word"), F.col("m.stop").alias("stop_word"), F.col("m.containment").alias("containment")
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share in the mix and its copies' places in the curriculum, in training order of the first."""
    return (
        mixed(table(spark, sf_dir, "documents"), keep=["doc_id"])
        .select("row.doc_id", "size", "source_size", "target", "taken", "position", "positions")
        .orderBy(F.col("position").asc_nulls_last(), "doc_id")
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being toxic, learnt from the labels that aren't held out."""
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 4) != 2))
    return toxicity(documents, model, keep=["doc_id"]).select(
        "row.doc_id", (remainder(F.col("row.doc_id"), 4) == 2).alias("held_out"),
        "found.score", (F.col("found.score") >= 0.3).cast("int").alias("predicted"),
        F.size("found.passages").cast("bigint").alias("n_passages"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's benchmark hits."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "row.doc_id", "found.n_words", "found.n_hit",
        F.size("found.items").cast("bigint").alias("n_items"),
        items_digest(F.col("found.items")).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"), "found.longest",
    )


def op10_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the model of the documents that aren't held out."""
    scores = language_scores(table(spark, sf_dir, "documents"), remainder(F.col("doc_id"), 5) != 1)
    return scores.select(
        F.col("id").alias("doc_id"), (remainder(F.col("id"), 5) == 1).alias("held_out"),
        "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity",
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in every order, for every source."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingles, component of near copies, and whether it stays."""
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


QUERIES = {q.__name__: q for q in (op1_jaccard_join, op2_quality_rules, op3_suffix_dedup, op4_token_files, op5_warc_index, op6_license_scan, op7_source_mixing, op8_toxicity, op9_decontamination, op10_pitman_yor, op11_prefix_trie, op12_filter_audit, op13_minhash_dedup)}

__all__ = ["ORACLE_SQL", "QUERIES", "word_vocabulary"]
