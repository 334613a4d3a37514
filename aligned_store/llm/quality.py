"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

The vectors of hashed words, word pairs and character n-grams are averaged per document; a softmax over a linear map of
the average gives the score. Vectors and map are learned together on a bounded sample of labelled
documents (``per_label`` of each label, ``sample_rows`` in all), each from its whole text; sample weights restore the
label shares of all labelled rows. As the map is linear, it is folded into one number per bucket for
scoring, which is exact.

Defined results: null and empty text have no features and score as the bias says. Without training
rows of both labels every score is the share of label 1 (1.0 without labels). Repeated rows are each
scored; a document with several label rows counts once for each label that it has. Ties at the threshold are
predicted 1. An empty table gives no rows. Texts of any length are read whole, window by window. Extra columns
are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, held_out, map_batches, small_join, utf8, with_columns
from .hashing import mean_scores
from .samples import balanced, collect_features

BITS, DIM, PER_LABEL, SAMPLE_ROWS, EPOCHS, BATCH, RATE = 15, 8, 1000, 2400, 10, 32, 0.08
THRESHOLD, FLOOR = 0.3, 3e-3


@dataclass
class QualityModel:
    table: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        mean, _ = mean_scores(texts, self.table[:, None], pairs=True)
        return 1 / (1 + np.exp(-np.clip(mean[:, 0] + self.bias, -40, 40)))


@dataclass
class Network:
    """Vectors of buckets, how they are scaled, and the linear map of their mean to the two labels."""

    vectors: np.ndarray
    scale: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def probabilities(self, some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, tuple]:
        """documents x labels, of (buckets, shares) of each; and what the gradients need."""
        who = np.repeat(np.arange(len(some)), [len(b) for b, _ in some])
        buckets = np.concatenate([b for b, _ in some])
        share = np.concatenate([v for _, v in some]) * self.scale[buckets] / 16
        hidden = np.stack([np.bincount(who, self.vectors[buckets, d] * share, len(some)) for d in range(self.vectors.shape[1])], 1)
        logits = hidden @ self.out + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True), (who, buckets, share, hidden)

    def gradients(self, some: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        """Of the weighted mean cross entropy, by vectors, map and bias."""
        p, (who, buckets, share, hidden) = self.probabilities(some)
        wrong = p.copy()
        wrong[np.arange(len(some)), y] -= 1
        wrong *= w[:, None] / len(some)
        back = wrong @ self.out.T
        size, dim = self.vectors.shape
        return [np.stack([np.bincount(buckets, back[who, d] * share, size) for d in range(dim)], 1), hidden.T @ wrong, wrong.sum(0)]

    def folded(self) -> QualityModel:
        """One number for each bucket: the map is linear, so it may be applied to the vectors beforehand."""
        return QualityModel((self.vectors @ (self.out[:, 1] - self.out[:, 0])) * self.scale / 16, float(self.bias[1] - self.bias[0]))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], counts: dict[int, int], bits: int = BITS, **kw) -> QualityModel:
    total = sum(counts.values())
    prior = (counts.get(1, 0) / total) if total else 1.0
    if len({y for y, _, _ in rows}) < 2:
        return QualityModel(np.zeros(1 << bits), float(np.clip(np.log((prior + 1e-9) / (1 - prior + 1e-9)), -20, 20)))
    return learn(rows, counts, bits, **kw).folded()


def learn(rows: list[tuple[int, np.ndarray, np.ndarray]], counts: dict[int, int], bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Network:
    total = sum(counts.values())
    rng = np.random.default_rng(seed)
    size = 1 << bits
    labels = np.array([y for y, _, _ in rows])
    of = {y: counts.get(y, 1) / total / max(1, (labels == y).sum()) * len(rows) for y in (0, 1)}
    weight = np.array([of[y] for y in labels])
    # buckets are scaled by how much they vary, so rarer telling ones move as fast as common ones; the floor keeps
    # the rarest, of which a short or stuttering text may be full, from outweighing what was learned
    scale = np.zeros(size)
    for _, b, v in rows:
        scale[b] += v * v
    scale = np.where(scale > 0, 1 / np.sqrt(scale / len(rows) + FLOOR), 0.0)
    net = Network(rng.normal(0, 0.3, (size, dim)), scale, rng.normal(0, 0.3, (dim, 2)), np.zeros(2))
    learned, decay = (net.vectors, net.out, net.bias), (1e-4, 1e-4, 0.0)
    seen = [np.full(x.shape, 1e-6) for x in learned]
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            part = order[at : at + BATCH]
            grads = net.gradients([rows[i][1:] for i in part], labels[part], weight[part])
            for x, g, s, d in zip(learned, grads, seen, decay, strict=True):
                g = g + d * x
                s += g * g
                x -= rate * g / np.sqrt(s)
    return net


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 5, remainder: int = 0, bits: int = BITS, per_label: int = PER_LABEL, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Train on labelled rows that aren't held out."""
    # ids are compared as text, of whatever types they are
    known = labels.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out(F.col("id"), modulus, remainder))
    some, counts = balanced(known, "y", "id", per_label)
    # a hash share of each label; an id whose labels are repeated without end is one row in it
    some = cut(some.select("id", "y").distinct(), "labels")
    texts = small_join(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")), some, ["id"], "inner")
    return train(collect_features(texts, "y", "t", "id", bits, sample_rows, pairs=True), counts, bits)


def with_scores(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = shared.value.score(utf8(batch.column(batch.schema.get_field_index(text_col))))
            return with_columns(batch, list(names), [pa.array(score), pa.array((score >= threshold).astype(np.int32))])

        return step

    return map_batches(docs, make, schema)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    model = fit(docs, labels, id_col, text_col, **kw)
    scored = with_scores(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id"), kw.get("modulus", 5), kw.get("remainder", 0)).alias("held_out"), "score", "predicted")


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without those predicted 0; columns unchanged."""
    model = fit(docs, labels, id_col, text_col, **kw)
    names = (fresh(docs.columns, "score"), fresh(docs.columns, "predicted"))
    return with_scores(docs, model, text_col, names=names).where(F.col(names[1]) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
