"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the distinct character 3- to 5-grams of a whole text, hashed to 2^BITS. For each, r is the log
ratio of its smoothed document shares among toxic and other training rows; a logistic regression is fitted on
presence x r, with an L2 penalty, with both labels weighing the same, and its intercept moves halfway to the labels' true shares.

It is fitted on about TRAIN_ROWS labelled rows, as evenly over the two labels as their numbers allow, drawn
by a hash of doc_id, or on a part of them whose grams take about TRAIN_BYTES. Scores see text alone.

Null and empty texts get the score of a text without grams; without labelled rows every score is 0. Rows
whose label is null aren't used; a document labelled twice counts twice. Repeated rows each get theirs; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._chars import grams
from ._session import ship, table
from ._text import slices
from .language import bounded, drawn, features, remainder, shares_of

SIZES, BITS, TRAIN_ROWS, L2, LEAST_DOCS, STEPS = (3, 4, 5), 20, 8000, 1e-5, 5, 400
#: Bytes of gram ids that a fit brings to the driver at most, nearly.
TRAIN_BYTES = 128 << 20


@dataclass
class Model:
    slot: np.ndarray
    weights: np.ndarray
    bias: float


def fit(rows: list[tuple[int, bytes]], shares: dict[int, float], l2: float = L2) -> Model:
    """rows: (label, gram ids); shares: the part of each label's rows that was drawn."""
    nothing = Model(np.full(1 << BITS, -1, np.int32), np.zeros(0, np.float32), -50.0)
    if not rows:
        return nothing
    y = np.array([r[0] for r in rows], np.float64)
    size = np.array([len(r[1]) // 4 for r in rows])
    doc_count = np.zeros((2, 1 << BITS))
    for label, raw in rows:
        doc_count[int(label)][np.frombuffer(raw, "<i4")] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    vocab = np.flatnonzero(doc_count.sum(0) >= LEAST_DOCS)
    p, q = (doc_count[1][vocab] + 1) / (n[1] + 2), (doc_count[0][vocab] + 1) / (n[0] + 2)
    del doc_count
    ratio = np.log(p / q)
    # Grams that tell the classes apart by little only add noise and work.
    strong = np.abs(ratio) >= 0.5
    vocab, ratio = vocab[strong], ratio[strong]
    if not len(vocab) or n.min() == 0:
        nothing.bias = float(np.log((n[1] + 0.5) / (n[0] + 0.5)))
        return nothing
    slot = np.full(1 << BITS, -1, np.int32)
    slot[vocab] = np.arange(len(vocab))
    parts, size = [], np.zeros(len(rows), np.int64)
    for i, (_, raw) in enumerate(rows):
        at = slot[np.frombuffer(raw, "<i4")]
        parts.append(at[at >= 0])
        size[i] = len(parts[-1])
    flat, at = np.concatenate(parts), np.repeat(np.arange(len(rows)), size)
    del parts
    value = ratio[flat] / np.sqrt(np.maximum(size, 1))[at]
    weight = (len(y) / 2 / n)[y.astype(int)]
    weight /= weight.sum()
    # Accelerated gradient descent; the step follows from the largest possible curvature.
    norm = np.bincount(at, value * value, len(rows)).max(initial=1e-9) + 1
    step = 1 / (0.25 * norm + l2)
    w, b, w0, b0 = np.zeros(len(vocab)), 0.0, np.zeros(len(vocab)), 0.0
    for k in range(STEPS):
        mw, mb = w + (w - w0) * k / (k + 3), b + (b - b0) * k / (k + 3)
        z = np.bincount(at, value * mw[flat], len(rows)) + mb
        g = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
        w0, b0 = w, b
        w, b = mw - step * (np.bincount(flat, value * g[at], len(vocab)) + l2 * mw), mb - step * g.sum()
    # The two labels weigh the same in the fit; the intercept leans halfway to their true shares.
    true = np.log((n[1] / shares.get(1, 1)) / (n[0] / shares.get(0, 1)))
    return Model(slot, (w * ratio).astype(np.float32), float(b + 0.5 * true))


def scores(model: Model, column: pa.Array) -> np.ndarray:
    out = np.empty(len(column))
    for i, (ids, _) in enumerate(grams(column, SIZES, BITS, model.slot)):
        out[i] = model.weights[ids].sum(dtype=np.float64) / np.sqrt(max(len(ids), 1)) + model.bias
    return 1 / (1 + np.exp(-np.clip(out, -50, 50)))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """docs: doc_id, text; labels: doc_id, label (0 or 1) of training rows."""
    labels = labels.where(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label"))
    counts = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    if not counts:
        return fit([], {})
    shares = shares_of(counts, most)
    few = labels.where(drawn(shares))
    # At most about `most` rows: their ids go to the scan, and only drawn texts leave it.
    rows = docs.join(F.broadcast(few), "doc_id").where("text IS NOT NULL").select("label", "text")
    got = rows.mapInArrow(features(SIZES, BITS), "label int, ids binary")
    return fit(bounded(got, TRAIN_BYTES), shares)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    shared = spark.sparkContext.broadcast(train(docs, labels))  # 2^BITS slots and as many weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s = scores(shared.value, part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
