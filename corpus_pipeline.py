"""A corpus pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the
shared scratch folder and reads again as the next stage's docs. All but the last return the columns
of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import discard, fresh, read_table, stored
from strandline.llm.mixing import mix
from strandline.llm.quality_model import THRESHOLD, fit, with_scores
from strandline.llm.queries import tokenizer_path
from strandline.llm.simhash import placed_components
from strandline.llm.substring import remove_passages, repeated_passages
from strandline.llm.unigram import encode_documents, load_unigram


def _same_columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; fitted on labelled documents that aren't held out.

    Null and empty texts are scored like any other, rows without an id too; repeated rows stay or go together; a score at
    the threshold is accepted.
    """
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return _same_columns(with_scores(docs, model, score).where(F.col(score) >= THRESHOLD), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id, and of its texts the least hash.

    Rows without a doc_id have no component of their own to stand for and stay; of identical rows
    that are chosen one stays.
    """
    own = placed_components(docs).where("doc_id = component_id").groupBy("label", "doc_id").agg(F.min("version").alias("version"), F.count(F.lit(1)).alias("n"))
    chosen = stored(own.select("doc_id", "version", "n"), "chosen")
    key, version = fresh(docs, "chosen_id"), fresh(docs, "chosen_version")
    ids = chosen.select(F.col("doc_id").alias(key), F.col("version").alias(version)).hint("shuffle_hash")  # texts need no sort
    one = docs.where(F.col("doc_id").isNotNull()).join(ids, (F.col("doc_id") == F.col(key)) & (F.xxhash64(F.col("text").cast("string")) == F.col(version)), "left_semi")
    if not chosen.where("n > 1").isEmpty():
        text = fresh(docs, "version")
        one = one.withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text])
    return _same_columns(one, docs).unionByName(docs.where(F.col("doc_id").isNull()))


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier document holds.

    Rows without an id and null, empty or short texts stay as they are; identical rows are one document; documents that are left
    without a word go; very long texts are cut whole.
    """
    return remove_passages(docs, repeated_passages(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks.

    A null source is a source; empty texts weigh nothing and come as often as their source's other documents; repeated rows are documents of their own.
    """
    return mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row; null and empty texts have no ids."""
    encoded = encode_documents(docs, load_unigram(tokenizer_path("piece_bpe_32k.model")))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_text),
    ("mixing", mixture),
    ("sentencepiece", pieces),
]

#: SQL can't express the classifier, fingerprints, chains and Viterbi paths; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
