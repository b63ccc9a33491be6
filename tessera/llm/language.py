"""Language identification by string-kernel classification.

Kernel: the blended-spectrum presence kernel, k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|), where G holds a
text's distinct character 1- to 3-grams (lower-cased letters, other characters as spaces), over the grams that
two landmarks at least share. Nystrom features of N_LANDMARKS landmark texts feed one-versus-rest kernel ridge
regression. As k(x, Z) is a product of presence vectors, presence x (Z' K^-1/2 W) scores a batch of texts in
one matrix product.

The classifier is fitted on about TRAIN_ROWS labelled rows, dealt evenly over the languages by a hash of
doc_id, or on a part of them whose grams take about TRAIN_BYTES (bounded()). Only text and lang of training rows are read for it; a prediction sees text alone.

Null texts and texts without a letter get `und` with score 0; without any labelled row every text is `und`.
Repeated rows each get theirs; ties go to the language that sorts first; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._chars import grams
from ._session import discard, ship, table, written
from ._text import slices

SIZES, BITS, N_LANDMARKS, TRAIN_ROWS, RIDGE, BATCH = (1, 2, 3), 18, 256, 3000, 1e-2, 64
#: Bytes of gram ids that a fit brings to the driver at most, nearly: an expectation over hashed rows.
TRAIN_BYTES = 128 << 20
#: In the pipeline, a text goes if it is `und` or if its best language has less than this share of the scores.
LEAST_SCORE = 0.4


@dataclass
class Model:
    languages: list[str]
    slot: np.ndarray  # gram hash -> row of weights, or -1
    weights: np.ndarray  # one column for each language


def remainder(doc_id: Column, by: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def features(sizes: tuple[int, ...], bits: int):
    """Map (label, text) rows to (label, gram ids as little-endian int32 bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = [g.astype("<i4").tobytes() for g, _ in grams(part.column("text"), sizes, bits)]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(ids, pa.binary())], names=["label", "ids"])

    return run


def shares_of(counts: dict, most: int) -> dict:
    """The part of each label's rows to draw for about `most` rows, as evenly over the labels as their numbers allow."""
    return {k: min(1.0, most / len(counts) / n) for k, n in counts.items()}


def drawn(shares: dict) -> Column:
    """Whether a row of (label, doc_id) is in the sample: by a hash of doc_id, the same in every run."""
    share = F.create_map(*(x for k, v in shares.items() for x in (F.lit(k), F.lit(v))))
    return F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1 << 20)) / float(1 << 20) < share[F.col("label")]


def bounded(taken: DataFrame, most_bytes: int) -> list[tuple]:
    """(label, gram ids) of the drawn rows, in a fixed order; where they take over most_bytes, of a hashed share of them."""
    every = written(taken, "training-grams")
    size = every.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    part = F.pmod(F.xxhash64("ids", F.lit(9)), F.lit(1 << 20)) < int((1 << 20) * most_bytes / max(size, 1))
    rows = sorted((r[0], bytes(r[1])) for r in (every.where(part) if size > most_bytes else every).toLocalIterator())
    discard(every)
    return rows


def fit(rows: list[tuple[str, bytes]], n_landmarks: int = N_LANDMARKS, ridge: float = RIDGE) -> Model:
    """rows: (language, gram ids)."""
    languages = sorted({r[0] for r in rows})
    if not rows:
        return Model([], np.full(1 << BITS, -1, np.int32), np.zeros((0, 0), np.float32))
    ids = [np.frombuffer(r[1], "<i4") for r in rows]
    y = np.array([languages.index(r[0]) for r in rows])
    each = max(1, n_landmarks // len(languages))
    marks = np.concatenate([np.flatnonzero(y == k)[:: max(1, (y == k).sum() // each)][:each] for k in range(len(languages))])
    df = np.bincount(np.concatenate([ids[i] for i in marks]), minlength=1 << BITS)
    vocab = np.flatnonzero(df >= min(2, len(marks)))
    slot = np.full(1 << BITS, -1, np.int32)
    slot[vocab] = np.arange(len(vocab))

    def presence(which: np.ndarray) -> np.ndarray:
        out = np.zeros((len(which), len(vocab)), np.float32)
        for r, i in enumerate(which):
            at = slot[ids[i]]
            out[r, at[at >= 0]] = 1
        return out / np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))

    z = presence(marks)
    value, vector = np.linalg.eigh((z @ z.T).astype(np.float64))
    good = value > 1e-6 * value.max(initial=0)
    root = (vector[:, good] / np.sqrt(value[good])) if good.any() else vector[:, :0]
    phi = np.concatenate([(presence(np.arange(a, min(a + 256, len(rows)))) @ z.T) @ root for a in range(0, len(rows), 256)])
    target = np.eye(len(languages))[y]
    count = np.bincount(y, minlength=len(languages))
    w = np.sqrt(len(y) / len(languages) / count[y])[:, None]
    a = (phi * w).T @ (phi * w) + ridge * len(y) * np.eye(phi.shape[1]) / max(phi.shape[1], 1)
    beta = np.linalg.solve(a, (phi * w).T @ (target * w)) if phi.shape[1] else np.zeros((0, len(languages)))
    return Model(languages, slot, (z.T @ (root @ beta)).astype(np.float32))


def scored(model: Model, column: pa.Array) -> tuple[list[str], list[float]]:
    names, scores, block, rows = ["und"] * len(column), [0.0] * len(column), [], []

    def flush() -> None:
        if not rows:
            return
        x = np.zeros((len(rows), len(model.weights)), np.float32)
        for r, g in enumerate(block):
            x[r, g] = 1
        f = (x @ model.weights).astype(np.float64) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        f = np.maximum(f, 0)
        total = f.sum(1)
        best = f.argmax(1)
        for r, i in enumerate(rows):
            names[i] = model.languages[best[r]]
            scores[i] = float(f[r, best[r]] / total[r]) if total[r] > 0 else 1.0 / len(model.languages)
        block.clear()
        rows.clear()

    if model.languages:
        for i, (g, letter) in enumerate(grams(column, SIZES, BITS, model.slot)):
            if letter:
                block.append(g)
                rows.append(i)
            if len(rows) == BATCH:
                flush()
        flush()
    return names, scores


def train(docs: DataFrame, most: int = TRAIN_ROWS) -> Model:
    rows = docs.where((remainder(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").alias("label"), "doc_id", "text")
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}  # as many rows as there are languages
    if not counts:
        return fit([])
    taken = rows.where(drawn(shares_of(counts, most))).select("label", "text").mapInArrow(features(SIZES, BITS), "label string, ids binary")
    return fit(bounded(taken, TRAIN_BYTES))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred and score added; text must be among the columns and neither of these."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS slots and at most as many rows of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            names, scores = scored(shared.value, part.column("text"))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names), pa.array(scores, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language is told with at least LEAST_SCORE stay."""
    ship(spark)
    model = train(docs)
    names = docs.columns
    renamed = docs.toDF(*(f"c{i}" if c != "text" else c for i, c in enumerate(names)))  # own names never clash
    kept = identify(renamed, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return kept.toDF(*names)
