"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.

Defined cases of all stages: texts of any length are handled whole; an empty table gives an empty one; columns beyond those
a stage reads pass through, whatever their names.  Null, empty and letterless texts go in the first stage; rows repeated
whole, or with equal texts under several ids or none, leave one row in the second; texts that differ but have equal
shingles leave one in the third; rows alike in id, source and size are taken together by the fourth, null source being a
source of its own; the fifth gives a row for every row of the mix, null ids included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixeltide.llm import bpe, exact_dedup, language_id, mixing, simhash
from pixeltide.llm.common import new_path
from pixeltide.llm.queries import BYTE_VOCABULARY, vocabulary


#: Share of words of its leading language below which a text counts as in none.
LEAST_SHARE = 1 / 3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or in which no learned language has a third of the words, go; all others stay unchanged.

    A share must miss the third by two standard errors, so short texts stay unless they clearly fit no learned language.
    Words that fit no learned language count for none, so texts in other languages and of random letters go too; with a
    single learned language nothing tells which words those are, and only texts without letters go.
    """
    model = language_id.train(docs.where(language_id.fold(F.col("doc_id")) != 0))
    return language_id.filter_language(docs, model, low=LEAST_SHARE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


#: Texts that share this part of their five-word shingles are near-duplicates.
NEAR_SHINGLE, NEAR_SIMILARITY = 5, 0.8


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row of the smallest doc_id stays.

    Fingerprints of five-word shingles within the radius that the similarity stands for, verified on the shingles.
    """
    return simhash.drop_near_duplicates(docs, shingle=NEAR_SHINGLE, similarity=NEAR_SIMILARITY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times."""
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of the mix."""
    return bpe.round_trip(docs, vocabulary(BYTE_VOCABULARY)).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("bpe", encode)]

#: The first stage is a trained model and the third hashes shingles with XXH64, so SQL cannot express the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
