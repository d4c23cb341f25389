"""Operator 2: language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else becomes one space, and n-grams of 1 to 3 characters are hashed to 2**15 features.
Document frequencies count every training document. The weights are learned from at most ``sample_rows`` training rows
(a documented bound; rows are picked by hash, evenly over languages) by follow-the-regularised-leader with an elastic-net
penalty: tasks learn on shards of the sample and their models are averaged. A fifth of the sample is kept out of training
to fit the softmax temperature. Prediction is map-only.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be learned; a null
lang is never learned; a null doc_id counts as the empty string in the split; repeated rows count each time and get equal
results; equal probabilities go to the language that is first in alphabetical order; a long text is read whole, its n-grams
counted some 200 000 characters at a time; predict() keeps extra columns, whatever their names, except the two that it sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import as_rows, column, documents, small_batches
from pulsegrid.llm.features import counted_ngrams, document_frequencies, inverse, weighted

BITS, ORDERS = 15, (1, 2, 3)
NOT_LETTERS = regex.compile(r"\P{L}+")
LETTER = regex.compile(r"\p{L}")


def remainder(n: int) -> Column:
    """crc32 of the doc_id as text, modulo ``n``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    return counted_ngrams(" " + NOT_LETTERS.sub(" ", text.lower()).strip() + " ", ORDERS, BITS)


def _present(text: str) -> np.ndarray:
    return _counts(text)[0]


class FTRL:
    """Follow the regularised leader, per coordinate, for softmax regression; l1 keeps most weights at zero."""

    def __init__(self, features: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.z, self.n = np.zeros((features, classes), np.float32), np.zeros((features, classes), np.float32)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)).astype(np.float32)

    def learn(self, index: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(index)
        p = softmax(values @ w)
        p[label] -= 1
        g = values[:, None] * p[None, :]
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[index] = n + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""

    def loss(log_t: float) -> float:
        return float(-np.log(softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels] + 1e-12).mean())

    low, high, ratio = np.log(0.02), np.log(20), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class LanguageModel:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float = 1.0):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def logits(self, text: str) -> np.ndarray:
        index, values = weighted(_counts(text), self.idf)
        return values @ self.weights[index]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not LETTER.search(text):
            return "und", 0.0
        p = softmax(self.logits(text) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def sampled(rows: DataFrame, label: str, counts: dict, limit: int) -> DataFrame:
    """About ``limit`` rows, evenly over labels, picked by a hash of doc_id and text."""
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, limit / len(counts) / n))])
    return rows.where((F.abs(F.xxhash64("doc_id", "text")) % 1_000_000) / 1e6 < share[F.col(label)])  # null, so false, for values that are not learned


def train(docs: DataFrame, sample_rows: int = 12_000, shards: int = 4, epochs: int = 2, most_languages: int = 200) -> LanguageModel:
    """Learn from ``docs`` (doc_id, text, lang); the driver gets document frequencies, weights and calibration logits.

    The weights are a block of 2**BITS x languages; of more than ``most_languages`` values of lang the most frequent are learned.
    """
    with small_batches(docs.sparkSession):
        return _train(docs.select("doc_id", "text", "lang"), sample_rows, shards, epochs, most_languages)


def _train(docs: DataFrame, sample_rows: int, shards: int, epochs: int, most_languages: int) -> LanguageModel:
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    languages = sorted(counts)
    idf = inverse(*document_frequencies(rows, _present, BITS))
    if not languages:
        return LanguageModel([], idf, np.zeros((2**BITS, 0), np.float32))
    number = {language: i for i, language in enumerate(languages)}
    sample = sampled(rows, "lang", counts, sample_rows).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id", "text"), F.lit(5)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held = FTRL(2**BITS, len(languages)), []
        for batch in batches:
            held += [(number[lang], *weighted(_counts(text), idf)) for text, lang in zip(column(batch, "text"), column(batch, "lang"))]
        for epoch in range(epochs):
            for i in np.random.default_rng(epoch).permutation(len(held)):
                label, index, values = held[i]
                model.learn(index, values, label)
        if held:  # weights in units of 2**-20, so that their sum does not depend on its order; the last row counts the rows
            weights = np.rint(model.weights(slice(None)).astype(float) * len(held) * 2**20).astype(np.int64)
            feature, label = np.nonzero(weights)
            parts = (np.append(feature, -1), np.append(label, 0), np.append(weights[feature, label], len(held)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(parts, (pa.int32(), pa.int32(), pa.int64()))], ["feature", "label", "weight"])

    trained = sample.where("fold > 0").repartition(shards, F.xxhash64("doc_id", "text")).sortWithinPartitions(F.xxhash64("doc_id", "text")).mapInArrow(learn, "feature int, label int, weight long")
    summed = trained.groupBy("feature", "label").agg(F.sum("weight").alias("weight")).toArrow()  # one row a weight that is not zero, however many shards
    feature, label, weight = (summed[c].to_numpy() for c in ("feature", "label", "weight"))
    weights, known = np.zeros((2**BITS, len(languages)), np.float32), feature >= 0
    weights[feature[known], label[known]] = weight[known] / (2**20 * max(1, weight[~known].sum()))
    model = LanguageModel(languages, idf, weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"label": pa.array([number[x] for x in column(batch, "lang")], pa.int32()), "logits": pa.array([model.logits(t).tolist() for t in column(batch, "text")], pa.list_(pa.float64()))})

    if calibration := sample.where("fold = 0").mapInArrow(score, "label int, logits array<double>").collect():
        model.temperature = temperature(np.array([r["logits"] for r in calibration]), np.array([r["label"] for r in calibration]))
    return model


def predict(docs: DataFrame, model: LanguageModel, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its probability under ``names`` (columns of these names are replaced), map-only.

    Python gets the texts alone and returns the two values.
    """

    @F.arrow_udf("struct<label:string,score:double>")
    def classify(texts: pa.Array) -> pa.Array:
        found = [model.predict(t) for start in range(0, len(texts), 500) for t in texts.slice(start, 500).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["label", "score"])

    told = as_rows(docs, "text").select("row", classify("text").alias("found"))
    others = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in names]
    return told.select(*others, F.col("found.label").alias(names[0]), F.col("found.score").alias(names[1]))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(remainder(4) != 2))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (F.coalesce(remainder(4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")
