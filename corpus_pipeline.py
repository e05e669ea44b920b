"""A corpus pipeline of five stages over ``documents``; each calls one operator of weftnet.llm.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and
returns a DataFrame; all but the last return the columns of ``documents``. ``run``
writes each stage's result as Parquet and reads it again as the next one's input.

1. language: documents go that have no language (null text, no letter) or of whose
   n-grams less than a fifth belong to the language found; it learns from the
   documents' own labels. Documents in any known language stay.
2. lines: runs of three or more lines, and single lines of eight or more words, that
   occur earlier go from the text; a document that loses all its lines goes.
3. near: of documents linked by five-word shingles (Jaccard of 0.75 or more) the one
   of the smallest doc_id stays; rows of null doc_id stay.
4. mix: documents are repeated, cut or left out so that sources weigh 5, 2, 1,
   repeating, none more than three times. A repeated document is repeated rows.
5. pieces: every row is encoded and decoded: (doc_id, n_pieces, pieces_hash,
   round_trip), the number of its SentencePiece ids, a hash of them in their order,
   and whether they decode to the text. ``sentence_pieces.encode`` gives the ids
   themselves, at the price of a shuffle of all of them.

n_chars follows the text in stages that change it. Empty input gives empty output.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftnet.llm import language_id, line_dedup, mixing, ngram_jaccard, sentence_pieces
from weftnet.llm.base import bounded_batches, driver_gives_back, executors_give_back, read_documents, shared_dir


#: Words from which a repeated line is no chance repeat.
LONG_LINE = 8


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def _begin(spark: SparkSession) -> None:
    """Give back what the stage before left behind; results don't depend on it."""
    driver_gives_back(spark)
    executors_give_back(spark)
    bounded_batches(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return language_id.accepted_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return _counted(line_dedup.kept_documents(docs, long_words=LONG_LINE))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return ngram_jaccard.kept_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    return _counted(mixing.mixed_documents(docs))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _begin(spark)
    import public_tokenizers

    table = sentence_pieces.load_pieces(spark, public_tokenizers.path("piece_bpe_32k.model"))
    return sentence_pieces.document_pieces(docs, table)


STAGES = [("language", language), ("lines", lines), ("near", near), ("mix", mix), ("pieces", pieces)]

#: Stages 1, 3 and 5 are beyond SQL: a fitted classifier, components, BPE. Tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
