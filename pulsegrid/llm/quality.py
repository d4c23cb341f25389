"""Operator 3: quality by nearest-neighbour voting in a latent semantic space.

Texts become vectors of two halves, each of length 1: TF-IDF of character n-grams (case and punctuation kept, hashed to
2**13 features, document frequencies over all documents), and the square roots of the shares of the word repeats: how
long ago each word last occurred, in 8 classes, alone and together with the class of the word before. A truncated singular value decomposition of at most ``basis_rows`` labelled texts gives
``rank`` latent dimensions. At most ``reference_rows`` labelled texts, evenly from both labels, are mapped there; these
vectors are sent to every task (reference_rows x rank floats: 2 MB as set here, whatever the size of the corpus). Each
document's cosine with every reference is computed exactly, in blocks; the ``neighbours`` nearest vote with weight
similarity**power, times the label's share among all labels over its share among the references.

Cases: a null text counts as empty; a text without n-grams, or a corpus without labels of both kinds, gets the share of
label 1 among the labels (1.0 without any); null labels are not learned; a doc_id labelled twice takes its lower label; a
labelled doc_id that several rows bear is learned once, with the least of their texts in byte order; repeated rows get equal
scores; of references that are equally near at the last place, which differ in label only if their vectors are the same, any
may vote; a long text is read whole, its n-grams counted some 200 000 characters at a time; extra columns are kept by
score_documents(), whatever their names, except the two that it sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm.common import as_rows, column, documents, release_memory, small_batches
from pulsegrid.llm.features import counted_ngrams, document_frequencies, inverse, weighted
from pulsegrid.llm.langid import remainder

BITS, ORDERS = 13, (1, 2, 3)
REPEATS = 8
FEATURES = 2**BITS + REPEATS + REPEATS**2
THRESHOLD = 0.3
# Class of a word by the number of words since it last occurred: 1, 2, up to 4, 8, 16, 64, more; 0 for a new word.
CLASS_OF_GAP = np.array([0, 1, 2, 3, 3, *[4] * 4, *[5] * 8, *[6] * 48, 7], dtype=np.int64)


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    return counted_ngrams(text, ORDERS, BITS)


def _present(text: str) -> np.ndarray:
    return _counts(text)[0]


def _repeats(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of word repeats and their weights, at length 1."""
    last, gaps = {}, []
    for i, word in enumerate(text.split()):
        gaps.append(min(i - last[word], 65) if word in last else 0)
        last[word] = i
    kinds = CLASS_OF_GAP[np.array(gaps, dtype=np.int64)]
    counts = np.bincount(np.concatenate([kinds, REPEATS + kinds[:-1] * REPEATS + kinds[1:]]), minlength=FEATURES - 2**BITS)
    found = np.flatnonzero(counts)
    values = np.sqrt(counts[found]).astype(np.float32)
    return found + 2**BITS, values / max(np.sqrt(counts.sum()), 1)


def _vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index, values = weighted(_counts(text), idf)
    repeats, shares = _repeats(text)
    return np.concatenate([index, repeats]), np.concatenate([values, shares])


class NeighbourModel:
    def __init__(self, idf: np.ndarray, projection: np.ndarray, prior: float, neighbours: int = 25, power: float = 8.0, block: int = 2048):
        self.idf, self.projection, self.prior = idf, projection, prior
        self.neighbours, self.power, self.block = neighbours, power, block
        self.references, self.votes, self.labels = np.zeros((0, projection.shape[1]), np.float32), np.zeros(0), np.zeros(0)

    def latent(self, texts: list[str | None]) -> np.ndarray:
        """Unit vectors in the latent space; zero where a text has no weight there."""
        out = np.zeros((len(texts), self.projection.shape[1]), np.float32)
        for i, text in enumerate(texts):
            index, values = _vector(text or "", self.idf)
            out[i] = values @ self.projection[index]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=np.zeros_like(out), where=length > 1e-9)

    def fit(self, vectors: np.ndarray, labels: np.ndarray) -> None:
        share = labels.mean() if len(labels) else 0.5
        self.references, self.labels = vectors.astype(np.float32), labels.astype(float)
        self.votes = np.where(labels == 1, self.prior / max(share, 1e-9), (1 - self.prior) / max(1 - share, 1e-9))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Weighted share of label 1 among the nearest references of each text."""
        vectors, n = self.latent(texts), len(self.references)
        if not n or not 0 < self.labels.mean() < 1:
            return np.full(len(texts), self.prior)
        k = min(self.neighbours, n)
        best, place = np.full((len(texts), k), -2.0, np.float32), np.zeros((len(texts), k), np.int64)
        for start in range(0, n, self.block):
            cosines = vectors @ self.references[start : start + self.block].T
            both = np.concatenate([best, cosines], axis=1)
            where = np.concatenate([place, np.broadcast_to(np.arange(start, start + cosines.shape[1]), cosines.shape)], axis=1)
            top = np.argpartition(-both, k - 1, axis=1)[:, :k]
            best, place = np.take_along_axis(both, top, 1), np.take_along_axis(where, top, 1)
        weight = np.clip(best, 0, 1).astype(float) ** self.power * self.votes[place]
        total = weight.sum(axis=1)
        share = np.divide((weight * self.labels[place]).sum(axis=1), total, out=np.full(len(texts), self.prior), where=total > 0)
        return np.where(np.abs(vectors).sum(axis=1) > 0, share, self.prior)


def _basis(rows: list[tuple[np.ndarray, np.ndarray]], rank: int) -> np.ndarray:
    """Right singular vectors of the sparse rows, from the small Gram matrix."""
    if not rows:
        return np.zeros((FEATURES, rank), np.float32)
    x = np.zeros((len(rows), FEATURES), np.float32)
    for i, (index, values) in enumerate(rows):
        x[i, index] = values
    size, left = np.linalg.eigh(x @ x.T)
    keep = [i for i in np.argsort(size)[::-1][:rank] if size[i] > 1e-6]
    right = x.T @ (left[:, keep] / np.sqrt(size[keep]))
    del x
    return np.pad(right, ((0, 0), (0, rank - right.shape[1]))).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, basis_rows: int = 1500, reference_rows: int = 8000, rank: int = 64) -> NeighbourModel:
    """Learn from the rows of ``labels`` (doc_id, quality) given; document frequencies count all of ``docs``."""
    with small_batches(docs.sparkSession):
        return _train(docs.select("doc_id", "text"), labels, basis_rows, reference_rows, rank)


def _train(docs: DataFrame, labels: DataFrame, basis_rows: int, reference_rows: int, rank: int) -> NeighbourModel:
    idf = inverse(*document_frequencies(docs, _present, BITS))
    labelled = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 1.0
    unit = (F.abs(F.xxhash64(F.lit("reference"), "doc_id")) % 1_000_000) / 1e6

    def share(limit: int):
        return F.element_at(F.create_map(*[F.lit(x) for k in (0, 1) for x in (k, min(1.0, limit / 2 / max(counts.get(k, 1), 1)))]), F.col("label"))

    chosen = docs.join(F.broadcast(labelled.where(unit < share(reference_rows))), "doc_id")  # at most about reference_rows labels
    chosen = chosen.groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))  # and one text a label

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_vector(t or "", idf) for t in column(batch, "text")]
            yield pa.RecordBatch.from_pydict({"index": pa.array([i.astype("<i4").tobytes() for i, _ in rows], pa.binary()), "weight": pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())})

    sample = chosen.where(unit < share(basis_rows)).sort("doc_id").mapInArrow(vectors, "index binary, weight binary").collect()
    model = NeighbourModel(idf, _basis([(np.frombuffer(r["index"], "<i4"), np.frombuffer(r["weight"], "<f4")) for r in sample], rank), prior)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"label": batch.column(batch.schema.get_field_index("label")), "vector": pa.array([v.tobytes() for v in model.latent(column(batch, "text"))], pa.binary())})

    references = chosen.mapInArrow(project, "label int, vector binary").collect()
    references = sorted((r["vector"], r["label"]) for r in references)
    model.fit(np.array([np.frombuffer(v, np.float32) for v, _ in references]).reshape(len(references), rank), np.array([y for _, y in references]))
    del sample, references
    release_memory()  # the driver's
    return model


def score_documents(docs: DataFrame, model: NeighbourModel, names: tuple[str, str] = ("quality_score", "quality_keep")) -> DataFrame:
    """``docs`` with the score and the decision under ``names`` (columns of these names are replaced), map-only.

    Python gets the texts alone and returns the score.
    """

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        found = [model.score(texts.slice(start, 500).to_pylist()) for start in range(0, len(texts), 500)]
        return pa.array(np.concatenate(found) if found else [], pa.float64())

    told = as_rows(docs, "text").select("row", score("text").alias("found"))
    others = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in names]
    return told.select(*others, F.col("found").alias(names[0]), (F.col("found") >= THRESHOLD).alias(names[1]))


def labels_to_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(remainder(5) != 0)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = score_documents(docs, train(docs, labels_to_learn(spark, sf_dir)))
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_keep").cast("int").alias("predicted"))
