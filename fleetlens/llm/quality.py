"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes. Every passage of the whole text is
encoded; gated attention weights, learned from document labels alone, say how much each passage
counts; the weighted passage representation is scored. The model is small and is trained on the
driver from at most ``TRAIN_ROWS`` labelled documents (the documented bound of the sample, taken
by a hash of doc_id); scoring reads every document once and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import bound_batches, utf8

PASSAGE = 512
TRAIN_ROWS = 6_000
THRESHOLD = 0.3
FEATURES = 260
SIZES = (32, 16)  # passage code, attention
EPOCHS = 30
PARTS = ("W", "b", "V", "U", "w", "c", "c0")


def passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of each passage, and how many passages each row has (an empty text has one, all zero)."""
    data, bounds = utf8(column)
    sizes = np.diff(bounds)
    per_row = np.maximum(1, -(-sizes // PASSAGE))
    heads = np.append(0, np.cumsum(per_row))
    total = int(heads[-1])
    rows = np.repeat(np.arange(len(sizes)), sizes)
    passage = heads[rows] + (np.arange(len(data)) - bounds[rows]) // PASSAGE
    counts = np.bincount(passage * 256 + data, minlength=total * 256).reshape(total, 256)
    size = counts.sum(1)
    share = counts / np.maximum(size, 1)[:, None]
    # Letters beside a change of case, and repeats of the byte before, tell shouting and runs.
    upper = (data >= 65) & (data <= 90)
    inner = np.append(False, passage[1:] == passage[:-1]) if len(data) else np.zeros(0, bool)
    turns = np.bincount(passage[inner & np.append(False, upper[1:] & upper[:-1])], minlength=total) if len(data) else np.zeros(total)
    again = np.bincount(passage[inner & np.append(False, data[1:] == data[:-1])], minlength=total) if len(data) else np.zeros(total)
    dense = np.stack([turns / np.maximum(size, 1), again / np.maximum(size, 1), np.log1p(size) / 7, np.log1p(np.repeat(per_row, per_row)) / 7], 1)
    return np.concatenate([np.sqrt(share), dense], 1).astype(np.float32), per_row


class Model:
    """Passage encoder, gated attention and the document's logistic score."""

    def __init__(self, weights: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.weights, self.mean, self.scale = weights, mean, scale

    def forward(self, x: np.ndarray, heads: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        h = np.tanh(((x - self.mean) / self.scale) @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        energy = (t * s) @ w["w"]
        a = np.exp(energy - np.maximum.reduceat(energy, heads)[rows])
        a /= np.add.reduceat(a, heads)[rows]
        z = np.add.reduceat(a[:, None] * h, heads)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["c0"], -30, 30)))}

    def gradients(self, x: np.ndarray, heads: np.ndarray, rows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, heads, rows)
        h, t, s, a = f["h"], f["t"], f["s"], f["a"]
        d_logit = (f["p"] - y) / len(y)
        d_z = (d_logit[:, None] * w["c"])[rows]
        d_a = (h * d_z).sum(1)
        d_energy = a * (d_a - np.add.reduceat(a * d_a, heads)[rows])
        d_gate = d_energy[:, None] * w["w"]
        d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
        d_pre = (a[:, None] * d_z + d_t @ w["V"].T + d_s @ w["U"].T) * (1 - h * h)
        return {
            "W": ((x - self.mean) / self.scale).T @ d_pre, "b": d_pre.sum(0), "V": h.T @ d_t, "U": h.T @ d_s,
            "w": (t * s).T @ d_energy, "c": f["z"].T @ d_logit, "c0": d_logit.sum(),
        }

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        x, per_row = passages(column)
        heads = np.append(0, np.cumsum(per_row)[:-1])
        return self.forward(x, heads, np.repeat(np.arange(len(per_row)), per_row))["p"].astype(np.float64)


def fit(x: np.ndarray, per_row: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, seed: int = 1) -> Model:
    """Adam on the log loss of whole documents. Without both labels the score is the share of 1."""
    random = np.random.default_rng(seed)
    code, attention = SIZES
    shapes = {"W": (FEATURES, code), "b": (code,), "V": (code, attention), "U": (code, attention), "w": (attention,), "c": (code,), "c0": ()}
    weights = {k: np.float32(random.normal(0, 1 / np.sqrt(max(1, (v or (1,))[0])), v)) for k, v in shapes.items()}
    prior = (y.sum() + 1) / (len(y) + 2)
    weights["b"], weights["c0"] = weights["b"] * 0, np.float32(np.log(prior / (1 - prior)))
    if len(set(y.tolist())) < 2:
        return Model(weights | {"c": weights["c"] * 0}, np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32))
    model = Model(weights, x.mean(0), x.std(0) + np.float32(0.01))
    heads = np.append(0, np.cumsum(per_row))
    first = {k: np.zeros_like(v) for k, v in weights.items()}
    second = {k: np.zeros_like(v) for k, v in weights.items()}
    step = 0
    for epoch in range(epochs):
        order = random.permutation(len(y))
        for at in range(0, len(y), batch):
            chosen = order[at : at + batch]
            sizes = per_row[chosen]
            inside = np.concatenate([np.arange(heads[i], heads[i + 1]) for i in chosen])
            bag_heads = np.append(0, np.cumsum(sizes)[:-1])
            found = model.gradients(x[inside], bag_heads, np.repeat(np.arange(len(chosen)), sizes), y[chosen])
            step += 1
            rate = 0.01 * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in PARTS:
                g = found[k] + 1e-4 * weights[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = np.float32(weights[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8))
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, per_row = passages(batch.column("text"))
        heads = np.append(0, np.cumsum(per_row))
        bags = [x[heads[i] : heads[i + 1]].astype(np.float16).tobytes() for i in range(len(per_row))]
        yield batch.select(["doc_id", "quality"]).append_column("bag", pa.array(bags, pa.binary()))


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on labelled documents outside the held-out fold, at most ``rows`` of them."""
    bound_batches(documents.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    bounded = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``rows`` ids
    kind = documents.schema["doc_id"].dataType.simpleString()
    found = bounded.mapInArrow(_bags, f"doc_id {kind}, quality int, bag binary").collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["bag"])))
    bags = [np.frombuffer(r["bag"], np.float16).reshape(-1, FEATURES) for r in found[:rows]]
    x = np.concatenate(bags).astype(np.float32) if bags else np.zeros((0, FEATURES), np.float32)
    y = np.array([r["quality"] for r in found[:rows]], np.float32)
    return fit(x, np.array([len(b) for b in bags], np.int64), y)


def scored(documents: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """All documents with a score from 0 to 1 of their whole text.

    Only the text is an input of the score. A null or empty text is one empty passage; repeated
    rows score alike; a text of any length has all its passages read; an empty table is fine.
    """
    bound_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(held.value.score(column), pa.float64())

    return documents.withColumn(out, score(F.col("text")))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(documents, labels, rows)
    found = scored(documents.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
