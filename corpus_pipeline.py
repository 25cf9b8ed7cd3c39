"""A corpus pipeline of the operators in ``lacuna.llm``.

Language ID, SimHash near-dedup, substring dedup, benchmark decontamination and
BPE encoding. Each stage takes all that the one before kept.

Cases, for all stages: columns but the documents' five are not read, whatever
their names; texts of any length are read whole; an empty table gives an empty
one; null languages, sources and lengths are carried or replaced as others are.
A null text is kept as an empty one is. Null ids are documents like others: in
near-dedup they lose to any id, in substring dedup they come last, and no stage
removes a row because of another row's id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import bpe, decontaminate, language, simhash, substrings
from lacuna.llm.common import table
from lacuna.operators.graph import cut

#: The stages hold custom operators that SQL cannot express.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language with a lower score than this is not believed.
LEAST_SCORE = 0.4


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; ``lang`` becomes the predicted one.

    Texts that are null or have no letter have none, and go; ties between
    languages go to the first in alphabetical order; repeated rows are repeated.
    """
    found = language.identify(docs, language.learn(docs), keep=["text", "source", "n_chars"])
    known = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return known.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id, then the least digest.

    Near copies share 0.8 of their five-word shingles or more. A document is a
    row's id and text, so that rows of one id but other texts are judged each
    for itself, and of equal rows one stays. Texts without words are copies of
    each other.
    """
    groups = simhash.group_loose_copies(docs).where("first").select(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key"), "n")
    rows = docs.select(*COLUMNS, F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    stays = rows.join(groups, rows["doc_id"].cast("long").eqNullSafe(F.col("own_id")) & (rows["key"] == F.col("own_key")))
    repeated = stays.where("n > 1").dropDuplicates(["own_id", "own_key"])
    return stays.where("n = 1").unionByName(repeated).select(COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id has too.

    Rows of equal ids do not cut each other; a text that loses nothing stays as
    it was, null included; one that loses all is empty, and stays.
    """
    left = substrings.dedup(docs, keep=["lang", "source"], with_text=True)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item (by id and text; repeated rows go or stay together)."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document left; a null text has no ids and decodes to an empty one."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("substrings", cut_repeats),
    ("benchmark", drop_benchmark),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
