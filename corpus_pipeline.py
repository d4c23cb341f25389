"""Corpus pipeline: language ID, quality, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. The first three return the columns of ``docs``, filtered;
the last returns one row for each piece of each packed sequence.

Cases, in every stage: rows of ``docs`` are dropped or kept whole, with all their columns, whatever their names; a null text
counts as empty; long texts are read whole; repeated rows are decided alike, and of equal or near rows one stays from
near_dedup on; null doc_ids stay, never linked; an empty table gives an empty result. language_id drops texts without a letter;
quality takes the share of good labels for a text that it cannot place.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import langid, neardup, packing, quality
from pulsegrid.llm.common import documents, free_name, materialise, small_batches

#: Below this calibrated probability a language is not told apart from another.
LEAST_CONFIDENCE = 0.4
#: Documents whose sets of shingles are so many percent alike, or more, are near duplicates.
SIMILAR = 80


def columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known: some letter, and a prediction of at least LEAST_CONFIDENCE."""
    model = langid.train(docs.where(langid.remainder(4) != 2))
    language, confidence = free_name(docs.columns, "language"), free_name(docs.columns, "confidence")
    predicted = langid.predict(docs, model, (language, confidence))
    return predicted.where((F.col(language) != "und") & (F.col(confidence) >= LEAST_CONFIDENCE)).select(*columns(docs))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose quality score reaches quality.THRESHOLD."""
    model = quality.train(docs, quality.labels_to_learn(spark, sf_dir))
    score, keep = free_name(docs.columns, "score"), free_name(docs.columns, "keep")
    return quality.score_documents(docs, model, (score, keep)).where(F.col(keep)).select(*columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that of the least doc_id.

    Documents without words, or without a doc_id, all stay.
    """
    return neardup.deduplicate(docs, SIMILAR)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, keep_words=False)


STAGES = [("language_id", language_id), ("quality", quality_filter), ("near_dedup", near_dedup), ("packing", best_fit_packing)]

#: SQL can express neither the classifiers nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read back as the next one's input."""
    docs = documents(spark, sf_dir)
    with small_batches(spark):
        for name, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
