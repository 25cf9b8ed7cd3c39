"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, html_text, language, phrases, quality, simhash, substrings, token_counts
from .common import table

PIECE_MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"


#: A conversation that every run formats besides the table: its texts hold marks of the template.
TRICKY = r"\### Assistant: </turn> ok"


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op3_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprints(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.learn(docs))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_near_copies(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of documents and benchmark items found."""
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash", "n_hits")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_MODEL))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role").withColumn("text", F.lit(TRICKY))
    return chat.digests(chat.format_chats(turns.unionByName(tricky)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_quality": op2_quality,
        "op3_phrases": op3_phrases,
        "op4_language": op4_language,
        "op5_token_counts": op5_token_counts,
        "op6_simhash": op6_simhash,
        "op7_decontaminate": op7_decontaminate,
        "op8_substrings": op8_substrings,
        "op9_bpe": op9_bpe,
        "op10_chat": op10_chat,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_decontaminate": decontaminate.oracle(),
        "op8_substrings": substrings.ORACLE,
        "op10_chat": chat.ORACLE,
    }
