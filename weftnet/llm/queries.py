"""The registered queries of this folder: opN_<name>, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.llm import exact_dedup, language_id, line_dedup, mixing, ngram_jaccard, sentence_pieces, simhash, substring_dedup, token_counts, token_files
from weftnet.llm.base import read_documents


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(read_documents(spark, sf_dir))
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "n_lines", "n_removed", digest.alias("kept_sha256"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_fingerprints(read_documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_documents(spark, sf_dir)).drop("_th")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_documents(spark, sf_dir))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(read_documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(read_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def _vocabulary(name: str) -> str:
    """Place of a public tokenizer file; it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_documents(spark, sf_dir)
    return token_counts.section_tokens(docs, _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = sentence_pieces.load_pieces(spark, _vocabulary("piece_bpe_32k.model"))
    return sentence_pieces.encoded_documents(read_documents(spark, sf_dir), pieces)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.temporary_path(spark)
    token_files.encode_documents(read_documents(spark, sf_dir), path, _vocabulary("word_bpe_49k.json"))
    return token_files.document_digests(spark, path)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_line_dedup": op3_line_dedup,
        "op4_document_fingerprints": op4_document_fingerprints,
        "op5_language_id": op5_language_id,
        "op6_mixing": op6_mixing,
        "op7_ngram_jaccard": op7_ngram_jaccard,
        "op8_sentence_pieces": op8_sentence_pieces,
        "op9_token_files": op9_token_files,
        "op10_substring_dedup": op10_substring_dedup,
        "pipeline": pipeline,
    }
