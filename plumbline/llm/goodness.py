"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities (operator 11).

Each term has a fixed sparse index vector of a few +1 and -1; a term's vector is the sum of the index vectors of its neighbours over all
documents, so it is learnt in one pass without labels. Terms are lower-cased words and, beside each word, its shape (classes of
characters with runs made one, "HASH!!" is "A!"; a word that one of the few before it repeats has a shape of its own), both hashed to
slots. A document is the mean of its words' vectors, rare ones
weighing more, and the mean of its shapes' vectors. A network with one hidden layer learns the label from a bounded sample of labelled
documents; its logit is divided by a temperature that a part of the sample, which the network has not seen, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import dropped, fold, sampled, stored, text_blocks
from plumbline.llm.hashing import mix, word_hashes

#: A word repeats another one that is at most so many words before it.
NEARBY = 3
#: Slots of words and of shapes, numbers of a vector, non-zero numbers of an index vector, neighbours on each side.
WORDS, SHAPES, DIM, NONZERO, WINDOW = 1 << 15, 1 << 12, 32, 4, 2
SLOTS = WORDS + SHAPES
#: Tables of sums are added up in slices of slots, at most FAN tables at a time.
SLICES, FAN = 48, 64
#: A slot's vector is its sum over its count and SHRINK; a word weighs RARE / (RARE + its share of all words).
SHRINK, RARE = 3.0, 1e-4
#: At most so many labelled rows of each label are learnt from (smallest hashed ids): the bound of the one training task.
MAX_POSITIVE, MAX_NEGATIVE = 12_000, 8_000
HIDDEN, STEPS, BATCH, RATE, DECAY, NOISE = 24, 3_000, 256, 3e-3, 2e-3, 0.1
#: One in so many training rows is left out of the network's fit for the temperature.
CALIBRATION = 5
THRESHOLD = 0.3
BLOCK = 1 << 20

_CLASSES = bytes(0x61 if chr(b).islower() or b >= 0x80 else 0x41 if chr(b).isupper() else 0x30 if chr(b).isdigit() else 0x20 if b in b" \t\n\r\x0b\x0c" else b for b in range(256))


def terms(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all words and of their shapes, and the offsets (len(texts) + 1) of each text's words."""
    words, at = word_hashes(texts)
    shapes = []
    for t in texts:
        data = np.frombuffer((t or b"").translate(_CLASSES), np.uint8)
        shapes.append(data[np.append(True, data[1:] != data[:-1])].tobytes() if len(data) else b"")
    shape, _ = word_hashes(shapes, lower=False)
    again, text = np.zeros(len(words), bool), np.repeat(np.arange(len(texts)), np.diff(at))
    for step in range(1, min(NEARBY, len(words) - 1) + 1):
        again[step:] |= (words[step:] == words[:-step]) & (text[step:] == text[:-step])
    shapes = np.where(again, 0, 1 + (shape % np.uint64(SHAPES - 1)).astype(np.int32))
    return (words % np.uint64(WORDS)).astype(np.int32), (shapes + WORDS).astype(np.int32), at


def index_vectors() -> np.ndarray:
    """[SLOTS, DIM] sparse vectors that depend on the slot only."""
    h = mix(np.arange(SLOTS * NONZERO, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019) + np.uint64(1))
    out = np.zeros((SLOTS, DIM), np.int16)
    np.add.at(out, (np.repeat(np.arange(SLOTS), NONZERO), ((h >> np.uint64(40)) % np.uint64(DIM)).astype(np.int64)), np.where(h & np.uint64(1), 1, -1).astype(np.int16))
    return out


class Sums:
    """[SLOTS, DIM + 1]: each slot's sum of its neighbours' index vectors, and how often it occurs."""

    def __init__(self) -> None:
        self.index, self.table = index_vectors(), np.zeros((SLOTS, DIM + 1), np.int64)

    def add(self, texts: list[bytes | None]) -> None:
        words, shapes, at = terms(texts)
        if not len(words):
            return
        text = np.repeat(np.arange(len(texts)), np.diff(at))
        own = self.index[words] + self.index[shapes]
        around = np.zeros(own.shape, np.int32)
        for step in range(1, min(WINDOW, len(own) - 1) + 1):
            same = (text[step:] == text[:-step])[:, None]
            around[:-step] += own[step:] * same
            around[step:] += own[:-step] * same
        for slots in (words, shapes):
            order = np.argsort(slots, kind="stable")
            start = np.flatnonzero(np.diff(slots[order], prepend=-1))
            each = slots[order[start]]
            self.table[each, :DIM] += np.add.reduceat(around[order], start, axis=0)
            self.table[each, DIM] += np.diff(np.append(start, len(slots)))


def _packed(table: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(table.astype("<i8").tobytes())


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<i8").reshape(-1, DIM + 1)


def context_sums(docs: DataFrame) -> np.ndarray:
    """[SLOTS, DIM + 1] over all texts of docs: a table a task, added up in slices, FAN tables at a time. Whole numbers: the same in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for _, texts in text_blocks(batches, block=BLOCK):
            sums.add(texts)
        rows = [(TaskContext.get().partitionId(), k, _packed(x)) for k, x in enumerate(np.array_split(sums.table, SLICES)) if x.any()]
        yield pa.RecordBatch.from_pydict({"sender": [r[0] for r in rows], "slice": [r[1] for r in rows], "sums": [r[2] for r in rows]}, schema=pa.schema([("sender", pa.int64()), ("slice", pa.int32()), ("sums", pa.binary())]))

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(map(_unpacked, rows["sums"]))
        return pd.DataFrame({"sender": rows.sender.iloc[:1] // FAN, "slice": rows.slice.iloc[:1], "sums": [_packed(total)]})

    kind = "sender long, slice int, sums binary"
    now = stored(docs.select("text").mapInArrow(run, kind), "index-sums")
    n = (now.agg(F.max("sender")).first()[0] or 0) + 1
    while True:
        old, now = now, stored(now.groupBy("slice", F.floor(F.col("sender") / FAN)).applyInPandas(add, kind), "index-sums")
        dropped(old)
        if n <= FAN:
            break
        n = -(-n // FAN)
    parts = np.array_split(np.zeros((SLOTS, DIM + 1), np.int64), SLICES)
    for r in now.collect():  # SLICES rows, of SLOTS * (DIM + 1) numbers in all
        parts[r["slice"]] = _unpacked(r["sums"])
    dropped(now)
    return np.concatenate(parts)


@dataclass
class Vectors:
    """A vector and a weight a slot."""

    vector: np.ndarray
    weight: np.ndarray

    def __post_init__(self) -> None:
        self.weighted = self.vector * self.weight[:, None]

    @staticmethod
    def of(sums: np.ndarray) -> Vectors:
        """Means of neighbours, without what all terms of a kind have in common, of about equal length."""
        count = sums[:, DIM].astype(np.float64)
        vector = sums[:, :DIM] / (count + SHRINK)[:, None]
        weight = np.ones(SLOTS)
        for kind in (slice(0, WORDS), slice(WORDS, SLOTS)):
            own = count[kind]
            common = (vector[kind] * own[:, None]).sum(axis=0) / max(own.sum(), 1)
            vector[kind] = np.where(own[:, None] > 0, vector[kind] - common, 0)
        weight[:WORDS] = RARE / (RARE + count[:WORDS] / max(count[:WORDS].sum(), 1))
        return Vectors(vector.astype(np.float32), weight.astype(np.float32))

    def pooled(self, texts: list[bytes | None]) -> np.ndarray:
        """[texts, 2 * DIM]: weighted means of the words' and of the shapes' vectors; zeros without words."""
        words, shapes, at = terms(texts)
        n = np.diff(at)
        full = np.flatnonzero(n)
        out = np.zeros((len(texts), 2 * DIM))
        for k, slots in enumerate((words, shapes)):
            if len(full):
                total = np.add.reduceat(self.weighted[slots], at[:-1][full], axis=0)
                out[full, k * DIM : (k + 1) * DIM] = total / np.add.reduceat(self.weight[slots], at[:-1][full])[:, None]
        return out


@dataclass
class Network:
    """Standardised inputs, one hidden layer, a logit over a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))


def temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The t that gives logits / t the least cross-entropy, by golden section over its logarithm. 1 without both labels."""
    if len(np.unique(y)) < 2:
        return 1.0
    loss = lambda u: float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * logits * np.exp(-u))).sum())
    low, high, r = np.log(0.25), np.log(8.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def trained(x: np.ndarray, y: np.ndarray, weight: np.ndarray, held: np.ndarray) -> Network:
    """A network fitted to the rows that are not held, by Adam over shuffled batches with weight decay and noise on the inputs; its
    temperature is from the held rows (1 if they are fewer than 40)."""
    rng = np.random.default_rng(11)
    fit = np.flatnonzero(~held)
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    z, t, s = (x[fit] - mean) / scale, y[fit].astype(float), weight[fit] / weight[fit].mean()
    share = float(np.clip(np.average(t, weights=s), 0.01, 0.99))
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.array(np.log(share / (1 - share)))]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for step in range(1, STEPS + 1):
        at = rng.integers(0, len(fit), min(BATCH, len(fit)))
        own = z[at] + rng.normal(0, NOISE, (len(at), z.shape[1]))
        h = np.tanh(own @ p[0] + p[1])
        g = s[at] * (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -35, 35))) - t[at]) / len(at)
        back = np.outer(g, p[2]) * (1 - h * h)
        grads = [own.T @ back + DECAY * p[0], back.sum(axis=0), h.T @ g + DECAY * p[2], g.sum()]
        rate = RATE * (1 - step / (STEPS + 1))
        for k, d in enumerate(grads):
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.999 * v[k] + 0.001 * d * d
            p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3]))
    if held.sum() >= 40:
        net.temperature = temperature(net.logits(x[held]), y[held], weight[held])
    return net


@dataclass
class Model:
    vectors: Vectors
    network: Network

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return self.network.scores(self.vectors.pooled(texts))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: tuple[int, int] | None = None) -> Model:
    """Word vectors of all docs, and a network of the labelled ones without those whose crc32 of doc_id modulo held_out[0] is held_out[1].

    Labels other than 0 and 1 are left out; a doc_id with several labels takes the smallest, one with several texts the one whose
    pooled vector comes first as bytes. The sample is bounded by MAX_POSITIVE and MAX_NEGATIVE; examples of a label that the
    bound thins weigh more by as much. With no example, or all of one label, every score is the share of 1 (0.5 with none).
    """
    vectors = Vectors.of(context_sums(docs))
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"))
    if held_out:
        known = known.where(fold("doc_id", held_out[0]) != held_out[1])
    known = stored(known.join(docs.select("doc_id").distinct(), "doc_id"), "labelled")
    total = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    most = {1: MAX_POSITIVE, 0: MAX_NEGATIVE}
    picked = [sampled(known.where(F.col("y") == y), n, "doc_id") for y, n in most.items()]
    sample = stored(picked[0].union(picked[1]), "label-sample")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches, block=BLOCK):
            rows = [x.astype("<f8").tobytes() for x in shared.value.pooled(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])

    # the sample has at most MAX_POSITIVE + MAX_NEGATIVE ids: a broadcast of bounded size
    examples = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "y", "text").mapInArrow(featured, "doc_id long, y int, x binary")
    examples = stored(examples.groupBy("doc_id", "y").agg(F.min("x").alias("x")), "examples")

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        order = mix(pdf.doc_id.to_numpy().astype(np.uint64))
        pdf = pdf.assign(o=order, held=(order >> np.uint64(32)) % np.uint64(CALIBRATION) == 0).sort_values(["o", "doc_id"])
        y = pdf.y.to_numpy()
        weight = np.array([max(1.0, total.get(v, 0) / most[v]) for v in (0, 1)])[y]
        x = np.stack([np.frombuffer(v, "<f8") for v in pdf.x])
        held = pdf.held.to_numpy() if len(np.unique(y[~pdf.held])) == 2 else np.zeros(len(y), bool)
        if len(np.unique(y)) < 2:
            net = Network(np.zeros(2 * DIM), np.ones(2 * DIM), np.zeros((2 * DIM, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 35.0 if y[0] else -35.0)
        else:
            net = trained(x, y, weight, held)
        flat = np.concatenate([net.mean, net.scale, net.w1.ravel(), net.b1, net.w2, [net.b2, net.temperature]])
        return pd.DataFrame({"model": [flat.tobytes()]})

    found = examples.groupBy(F.lit(1).alias("all")).applyInPandas(train, "model binary").collect()
    flat = np.frombuffer(found[0]["model"]) if found else np.concatenate([np.zeros(2 * DIM), np.ones(2 * DIM), np.zeros(2 * DIM * HIDDEN + 2 * HIDDEN), [0.0, 1.0]])
    cut = np.cumsum([2 * DIM, 2 * DIM, 2 * DIM * HIDDEN, HIDDEN, HIDDEN])
    mean, scale, w1, b1, w2, last = np.split(flat, cut)
    return Model(vectors, Network(mean, scale, w1.reshape(2 * DIM, HIDDEN), b1, w2, float(last[0]), float(last[1])))


def scored(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of docs and ``score``, the model's probability for the whole text. Null texts count as empty, and empty texts
    are scored like any other; rows that repeat a doc_id are each scored."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches, block=BLOCK):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(shared.value.scores(texts), pa.float64())], [*keep, "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, ", ".join([*[kept] * bool(keep), "score double"]))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = scored(docs, fit(docs, labels, held_out=(5, 0)), ["doc_id"])
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
