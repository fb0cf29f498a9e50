"""A corpus pipeline of the training-data operators, stage by stage over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from configlens.llm import lang_id, near_dedup, packing, quality, substring_dedup
from configlens.llm.common import Workspace, broadcast_if_small, released, table

#: Documents go of whose letters a smaller share is in scripts of any learned language, besides those without a letter.
LEAST_EXPLAINED = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language or several; those without text or letters, and those in scripts of no language, go.

    lang_score isn't asked: it is low where a text has two languages.
    """
    found = lang_id.identify(docs, lang_id.fit(docs), share=True)
    name, _, share = found.columns[-3:]
    return found.where((F.col(name) != lang_id.UNDETERMINED) & (F.col(share) >= LEAST_EXPLAINED)).select(docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on docs and the labels table, predicts to be good."""
    found = quality.score(docs, quality.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))
    return found.where(F.col(found.columns[-1]) == 1).select(docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, that of the smallest id.

    Rows without id stay; of rows that share an id, all stay if one is kept.
    """
    work = Workspace(spark, "kept")
    found = work.write(near_dedup.near_duplicates(docs.select("doc_id", "text")).select("doc_id", "kept"), "found")
    removed = found.where("NOT kept").select("doc_id").distinct().join(found.where("kept").select("doc_id"), "doc_id", "left_anti")
    return docs.join(broadcast_if_small(work.write(removed, "removed")), "doc_id", "left_anti").select(docs.columns)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the words that repeat earlier windows; n_chars follows the text where it is a column."""
    found = substring_dedup.dedup_substrings(docs)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return found.select(*(new.get(c, F.col("rest").getField(c)).alias(c) for c in docs.columns))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", minhash_near_dedup),
    ("substring dedup", substring_dedup_stage),
    ("best-fit packing", best_fit_packing),
]

#: Trained models and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        with released():
            docs = work.write(stage(spark, docs, sf_dir), f"stage{number}")
        if number:
            work.drop(f"stage{number - 1}")
    return docs
