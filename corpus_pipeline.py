"""The corpus pipeline: language, near copies, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir), docs with the columns of `documents` and any others, and returns the
documents it keeps, in the columns of `documents`, with its decisions applied; the last returns their tokens' digests.
In all of them a null text counts as empty and rows with a null id are kept like others; rows are kept one for one, repeated ones too, but in
near_dedup; empty tables give empty tables; a result doesn't depend on the order of rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import bpe, fm_index, langid, pii, probminhash
from tesserae.llm.common import free, held_out, stored, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language stay, with lang as predicted (of equally likely ones the first by name); those without a letter, null ones too, are `und` and go, and so
    do all where no row teaches a language. Rows without an id or a lang teach nothing."""
    model = langid.train(docs.where(held_out(5) != 0), PIECES)
    known = langid.predict(docs, PIECES, model, keep=["source", "n_chars"]).where("lang_pred <> 'und'")
    return known.select("doc_id", "text", F.col("lang_pred").alias("lang"), "kept.source", "kept.n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each class of near copies stays; texts without words are no copies. Different texts that share an id are members of their own. Of rows of one id
    and one text the greatest by its columns in order stays. Rows without an id all stay."""
    return probminhash.keep_one(docs.select(COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out, overlapping ones as one; documents that are nothing else go. Texts without words are never hit."""
    left = fm_index.remove(fm_index.find(docs, table(spark, sf_dir, "benchmark"), keep=["lang", "source"]))
    return left.select("doc_id", "text", "kept.lang", "kept.source", F.length("text").cast("long").alias("n_chars"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kinds, overlapping spans by the first's (of one begin the longest's). Empty texts stay as they are."""
    masked = pii.mask(docs, keep=["lang", "source"])
    return masked.select("doc_id", "text", "kept.lang", "kept.source", F.length("text").cast("long").alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes; an empty text has no tokens."""
    return bpe.digest(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("personal_data", personal_data), ("tokens", tokens)]

#: Near copies, the field of stage 4 and byte-level merges can't be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage has stored on its way, and the stage before it, are emptied once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        first = written()
        docs = stored(stage(spark, docs, sf_dir), name)
        free(spark, max(0, first - (name != STAGES[0][0])), written() - 1)
    return STAGES[-1][1](spark, docs, sf_dir)
