"""From raw documents to token ids: quality, exact copies, near copies, mixture, pieces.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. No stage needs a document's whole group in one place.

A row is known by its id and a digest of its text, so ids that repeat or are missing are no trouble. Rows that repeat both
are one document; the exact stage keeps one of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from boxloom.llm.common import ascii_lower, cut, documents, table, whole_text
from boxloom.llm.exact_dedup import exact_dedup
from boxloom.llm.mixing import domain_of, mix
from boxloom.llm.pieces import Vocabulary, sentencepiece
from boxloom.llm.quality import keep_good
from boxloom.llm.simhash import simhash_dedup
from boxloom.scale import shared_dir

#: Nine tenths of the tokens go on, no text more than once; sources of a language, and languages of a domain, weigh alike.
WEIGHTS = {"domain": {"web": 4, "books": 3, "news": 2, "code": 1}}
PART, EPOCHS, SEED = (9, 10), 1, 11
#: The classifier and the pieces are not for SQL; tests hold every stage against plain Python.
ORACLE_SQL = None


def _key(text: Column) -> Column:
    return F.struct("doc_id", F.xxhash64(text).alias("digest"))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``gone`` (column ``key``)."""
    return docs.join(gone.select(F.col("key").alias("_gone")).distinct(), _key(whole_text()).eqNullSafe(F.col("_gone")), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id."""
    found = cut(exact_dedup(docs).select(F.struct("doc_id", F.col("text_sha256").alias("digest")).alias("key"), "kept"))
    digest = F.struct("doc_id", F.sha2(ascii_lower(whole_text()), 256).alias("digest"))
    gone = found.filter("NOT kept").select(F.col("key").alias("_gone")).distinct()
    left = docs.join(gone, digest.eqNullSafe(F.col("_gone")), "left_anti")
    if found.filter("kept").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return left
    return left.withColumn("_digest", digest).dropDuplicates(["_digest"]).drop("_digest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    found = simhash_dedup(docs.select(_key(whole_text()).alias("key"), "text"), "key")
    return _without(docs, found.filter("doc_id <> component_id").select(F.col("doc_id").alias("key")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that begin inside their source's token budget; the last one of a source stays whole."""
    keyed = docs.select(_key(whole_text()).alias("key"), "lang", "source", "text")
    levels = [domain_of(F.coalesce("source", F.lit(""))), F.col("lang"), F.col("source")]
    found = mix(keyed, levels, WEIGHTS, PART, EPOCHS, SEED, id_col="key")
    return _without(docs, found.filter("taken_tokens = 0").select(F.col("doc_id").alias("key")))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    return sentencepiece(docs, Vocabulary.load())


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/pipeline_{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
