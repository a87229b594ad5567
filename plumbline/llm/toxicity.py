"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import fold, sampled, stored, text_blocks
from plumbline.llm.hashing import mix, word_hashes

#: Features are hashed to 2 ** BITS coordinates; weights that L1 keeps are a few thousand of them.
BITS = 24
#: At most so many labelled rows of each label are learnt from (those whose hashed id is smallest): the bound of the one training task.
MAX_POSITIVE, MAX_NEGATIVE = 6_000, 14_000
EPOCHS, MIN_DOCS = 4, 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1.5, 1.0
#: A coordinate's L1 penalty is at least so many standard deviations of what its examples' gradients would add up to if it told nothing.
NOISE = 8.0
#: At most so many non-zero weights are broadcast (the largest); the model is far below it in practice, and a fit beyond it fails.
MAX_WEIGHTS = 1 << 20
THRESHOLD = 0.3


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of all words, word pairs and pairs with one word skipped, and the text each is of. Not yet distinct."""
    words, at = word_hashes(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(at))
    out, of = [], []
    with np.errstate(over="ignore"):
        for step, salt in ((0, 0x51ED2701), (1, 0x7F4A7C15), (2, 0x1CE4E5B9)):
            n = max(0, len(words) - step)
            x = mix(words[:n] * np.uint64(salt) + (words[step:] if step else np.uint64(0))) >> np.uint64(64 - BITS)
            same = text[:n] == text[step:]
            out.append(x[same].astype(np.int32))
            of.append(text[:n][same])
    return np.concatenate(out), np.concatenate(of)


@dataclass
class Model:
    """Sparse weights: sorted coordinates, their weights, and the bias."""

    at: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        """Probability per text, in 0..1; a text without words gets that of the bias. Each feature counts once per text."""
        x, of = features(texts)
        spot = np.searchsorted(self.at, x) if len(self.at) else np.zeros(len(x), np.int64)
        hit = np.flatnonzero(self.at[np.minimum(spot, len(self.at) - 1)] == x) if len(self.at) else np.zeros(0, np.int64)
        pair = np.unique(of[hit].astype(np.int64) * (1 << 32) + spot[hit])
        total = np.bincount(pair >> 32, self.weight[pair & 0xFFFFFFFF], minlength=len(texts)) if len(pair) else np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> Model:
    """FTRL-proximal with per-coordinate rates, in the rows' order, EPOCHS times. rows: distinct coordinates of each example.

    The penalty is per coordinate too: L1, or NOISE times sqrt(q * b * (1 - b)) if that is more, with q the sum of its examples' squared
    weights and b the weighted share of label 1. So a coordinate that many examples have needs more than chance for a weight, and
    with few examples the rare words of a long text, which are most of its coordinates, get none.
    """
    count = np.zeros(1 << BITS, np.uint16)
    for r in rows:
        count[r] += 1  # a row's coordinates are distinct, and there are fewer rows than 2 ** 16
    at = np.flatnonzero(count >= MIN_DOCS).astype(np.int32)
    del count
    place = np.full(1 << BITS, -1, np.int32)
    place[at] = np.arange(len(at), dtype=np.int32)
    own = []
    for r in rows:
        spot = place[r]
        own.append(np.append(spot[spot >= 0], np.int32(len(at))))  # the last is the bias
    del place
    z, n, squares = (np.zeros(len(at) + 1) for _ in range(3))
    for i, s in zip(own, weights, strict=True):
        squares[i] += s * s
    share = float((labels * weights).sum() / max(weights.sum(), 1e-9))
    l1 = np.maximum(L1, NOISE * np.sqrt(squares * share * (1 - share)))
    l1[-1] = 0

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1[i], 0.0, -(zi - np.sign(zi) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for i, y, s in zip(own, labels, weights, strict=True):
            w = weight(i)
            g = s * (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y)
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weight(np.arange(len(at) + 1))
    keep = np.flatnonzero(w[:-1])
    return Model(at[keep], w[keep], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: tuple[int, int] | None = None) -> Model:
    """Learns from labelled rows of docs, without those whose crc32 of doc_id modulo held_out[0] is held_out[1].

    Labels other than 0 and 1 are left out; a doc_id with several labels takes the largest, one with several texts that of its
    examples that comes first as bytes. The sample is bounded by
    MAX_POSITIVE and MAX_NEGATIVE; examples of a label that the bound thins weigh more by as much. Without any example the
    model has no weights and a bias of 0.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    if held_out:
        known = known.where(fold("doc_id", held_out[0]) != held_out[1])
    known = stored(known.join(docs.select("doc_id").distinct(), "doc_id"), "labelled")
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [sampled(known.where(F.col("y") == y), most, "doc_id") for y, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]
    sample = stored(picked[0].union(picked[1]), "label-sample")
    share = {y: max(1.0, total.get(y, 0) / most) for y, most in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            x, of = features(texts)
            pair = np.unique(of.astype(np.int64) * (1 << 32) + x)
            cut = np.searchsorted(pair >> 32, np.arange(1, len(texts)))
            rows = [p.astype(np.int32).tobytes() for p in np.split(pair & 0xFFFFFFFF, cut)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])

    # the sample has at most MAX_POSITIVE + MAX_NEGATIVE ids: a broadcast of bounded size
    examples = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", F.col("y").cast("int").alias("y"), "text").mapInArrow(featured, "doc_id long, y int, x binary")
    examples = stored(examples.groupBy("doc_id", "y").agg(F.min("x").alias("x")), "examples")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(o=mix(pdf.doc_id.to_numpy().astype(np.uint64))).sort_values(["o", "doc_id"])
        y = pdf.y.to_numpy()
        m = ftrl([np.frombuffer(x, np.int32) for x in pdf.x], y, np.where(y == 1, share[1], share[0]) / min(share.values()))
        return pd.DataFrame({"at": [m.at.astype(np.int32).tobytes()], "weight": [m.weight.tobytes()], "bias": [m.bias]})

    found = examples.groupBy(F.lit(1).alias("all")).applyInPandas(train, "at binary, weight binary, bias double").collect()
    if not found:
        return Model(np.zeros(0, np.int32), np.zeros(0), 0.0)
    model = Model(np.frombuffer(found[0]["at"], np.int32), np.frombuffer(found[0]["weight"]), found[0]["bias"])
    if len(model.at) > MAX_WEIGHTS:
        raise ValueError(f"{len(model.at)} weights are more than MAX_WEIGHTS")
    return model


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of docs and ``score``, the model's probability for the whole text, a row for each row of docs.

    A null text counts as empty, and an empty one has the score of the bias; a text of any length is taken whole; equal texts have equal
    scores, so repeated rows and ties stay as they are; an empty table gives no rows. Other columns, whatever their names, are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.scores(texts), pa.float64())], [*keep, "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*[kept] * bool(keep), "score double"]))


def filtered(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] | None = (4, 2), threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold; columns unchanged. Scored in place: each row needs its own text only.

    A score equal to the threshold goes. Nulls, empty and long texts, repeated rows and empty tables are as in scored(); without any usable label
    the model has no weights and scores everything 0.5, so a threshold up to that keeps nothing and the caller has to give labels.
    """
    model = fit(docs, labels, held_out=held_out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            yield batch.filter(pa.array(shared.value.scores(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = scored(docs, fit(docs, labels, held_out=(4, 2)), ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
