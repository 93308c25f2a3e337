"""A corpus pipeline of five stages, each one operator of mvspark.llm, over the whole of what the stage before kept.

The filtering stages give rows of their input as they are: all its columns and no others, whatever their names. A null id is an id like
any other. An empty table passes all stages empty.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mvspark.llm import bitslice_simhash, decontamination, kneser_ney, language_mixture, segment_bpe
from mvspark.llm.common import judged, shared_folder, table

#: A text whose main language has a smaller share is rejected.
MIN_SHARE = 0.5
#: Texts are near-duplicates if their sets of so many words have this Jaccard similarity or more.
NEAR_SHINGLE, NEAR_SIMILARITY = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose perplexity passes their language's threshold, and null and empty ones. Repeated rows are judged each, and alike."""
    labels = table(spark, sf_dir, "labels")
    return judged(docs, kneser_ney.ADDED, lambda df: kneser_ney.classify(df, labels), F.col("kept"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters (null and empty ones too) or without a main language: none of a share of MIN_SHARE. Of languages of the same share
    the first by name is the main one. Repeated rows are judged each, and alike."""
    model = language_mixture.learn(docs.filter(~language_mixture.held_out()))
    keep = (F.col("lang_pred") != language_mixture.UNKNOWN) & (F.col("score") >= MIN_SHARE)
    return judged(docs, language_mixture.ADDED, lambda df: language_mixture.predict(df, model), keep)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates, of least id (a null id is the greatest). Of equal rows one stays, as of null, empty
    and blank texts, which are one class."""
    return bitslice_simhash.representatives(docs, shingle=NEAR_SHINGLE, similarity=NEAR_SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item. Null and empty ones hold none. Repeated rows are judged each, and alike."""
    items = table(spark, sf_dir, "benchmark")
    return judged(docs, decontamination.ADDED, lambda df: decontamination.contamination(df, items), F.size("spans") == 0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document, counted and digested with what they decode to. A null text has none."""
    return segment_bpe.digests(docs, segment_bpe.vocabulary_path())


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("tokens", tokens)]
#: SQL expresses neither the perplexities, the mixtures nor the byte-pair merges; tests hold each stage's operator against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each stage's rows are written to the shared folder of spark.checkpoint.dir and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
