"""One query for each operator of this subpackage, with production parameters over the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorlake.llm import align, decontaminate, flat_tokens, html_blocks, language, neighbours, orc_tokens, pieces, prefix_trie, secrets, simhash
from motorlake.llm.common import table
from motorlake.llm.line_dedup import line_dedup
from motorlake.llm.oracle import ORACLE_SQL  # noqa: F401  read by the entry
from motorlake.llm.quality import quality
from motorlake.llm.vocabulary import tokenizer_file


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each document after line dedup."""
    out = line_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base kinds and confirmed spans of each document."""
    out = secrets.scan_secrets(_documents(spark, sf_dir))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "n_confirmed")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document, learned from those that aren't held out."""
    return language.language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document of flat token files, documents in ascending order of doc_id."""
    return flat_tokens.token_counts(_documents(spark, sf_dir), tokenizer_file())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for each document."""
    out = quality(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of each document and what they decode to."""
    out = pieces.encode_decode(_documents(spark, sf_dir), pieces.Pieces(pieces.model_file()))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids_crc32", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "round_trip")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of each document."""
    return simhash.simhash_groups(_documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op8_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of each document as read back from ORC files."""
    return orc_tokens.token_orc(_documents(spark, sf_dir), tokenizer_file())


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of each page."""
    return html_blocks.extract(table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    return decontaminate.leaks(_documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two public vocabularies in each document."""
    return align.align(_documents(spark, sf_dir))


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five rows nearest to each vector whose id is divisible by 50."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_secret_scans, op3_language_id, op4_token_counts, op5_quality_rules, op6_sentencepiece, op7_simhash, op8_token_orc, op9_html_extraction, op10_decontamination, op11_token_alignment, op12_nearest_vectors, op13_prefix_trie)
}

