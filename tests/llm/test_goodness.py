"""Quality classifier: random indexing and pooling against plain Python, gradients' result on held-out rows, odd tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plumbline.llm import goodness as G


def rows(n, seed=1):
    """Plain prose, and three kinds of rubbish whose words are new in every text: shouted, decorated, repeated."""
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "in", "ed", "re", "st", "ti"]) for _ in range(rng.randint(1, 4)))
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 80))]
        kind = i % 4
        if kind == 1:
            w = [x.upper() + "!!" for x in w]
        elif kind == 2:
            w = [x + rng.choice(["###", "%%%", "&&&"]) for x in w]
        elif kind == 3:
            w = [x for x in w for _ in range(4)]
        out.append((i, " ".join(w), int(kind == 0)))
    return out


def test_sums_and_pooling_in_plain_python(spark):
    texts = [t.encode() for _, t, _ in rows(12)] + [None, b"", b"one", b"Same same SAME x"]
    index = G.index_vectors()
    assert (np.abs(index).sum(axis=1) <= G.NONZERO).all() and (index != 0).any(axis=1).mean() > 0.99
    want = np.zeros((G.SLOTS, G.DIM + 1), np.int64)
    for t in texts:
        words, shapes, at = G.terms([t])
        own = index[words].astype(int) + index[shapes]
        for i in range(at[-1]):
            around = sum((own[j] for j in range(max(0, i - G.WINDOW), min(len(own), i + G.WINDOW + 1)) if j != i), np.zeros(G.DIM, int))
            for slot in (words[i], shapes[i]):
                want[slot, :-1] += around
                want[slot, -1] += 1
    df = spark.createDataFrame([(None if t is None else t.decode(),) for t in texts], "text string").repartition(5)
    assert (G.context_sums(df) == want).all()
    v = G.Vectors.of(want)
    got = v.pooled(texts)
    for t, x in zip(texts, got, strict=True):
        words, shapes, at = G.terms([t])
        for k, slots in enumerate((words, shapes)):
            mean = np.average(v.vector[slots], axis=0, weights=v.weight[slots]) if len(slots) else np.zeros(G.DIM)
            assert np.allclose(x[k * G.DIM : (k + 1) * G.DIM], mean, atol=1e-5)
    assert len(G.terms([b"a a b a"])[1]) == 4 and (G.terms([b"a a b a"])[1] == G.WORDS).tolist() == [False, True, False, True]


def test_many_partitions_are_added_in_levels(spark, monkeypatch):
    df = spark.createDataFrame([(t,) for _, t, _ in rows(150)], "text string")
    assert (G.context_sums(df.repartition(70)) == G.context_sums(df.coalesce(1))).all()  # more than FAN tables


def test_held_out_quality(spark):
    data = rows(900)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data if i % 5] + [(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    model = G.fit(docs, labels)
    got = {r.doc_id: r.score for r in G.scored(docs, model, ["doc_id"]).collect()}
    held = [(got[i], y) for i, _, y in data if i % 5 == 0]
    assert min(s for s, y in held if y) > max(s for s, y in held if not y)
    assert np.mean([(s >= G.THRESHOLD) == y for s, y in held]) >= 0.98
    again = {r.doc_id: r.score for r in G.scored(docs, G.fit(docs.repartition(7), labels.repartition(3)), ["doc_id"]).collect()}
    assert max(abs(got[i] - again[i]) for i in got) < 1e-6


def test_temperature():
    """Over-confident logits are cooled down, timid ones warmed up; calibrated ones stay."""
    rng = np.random.default_rng(3)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-z))).astype(int)
    one = np.ones(len(z))
    assert G.temperature(z, y, one) == pytest.approx(1, abs=0.06)
    assert G.temperature(3 * z, y, one) == pytest.approx(3, rel=0.06) and G.temperature(z / 2, y, one) == pytest.approx(0.5, rel=0.06)
    assert G.temperature(z, np.ones(len(z), int), one) == 1


def test_odd_and_empty(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 12)] + [(1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    for docs, known in ((odd, labels), (none, labels), (odd, labels.limit(0)), (odd, labels.where("quality = 1"))):
        out = G.scored(docs, G.fit(docs, known), docs.columns[:1])
        scores = [r.score for r in out.collect()]
        assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)


def test_query_on_the_tables(spark, sf):
    out = entry.queries()["op11_quality_classifier"](spark, sf)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = out.join(labels, "doc_id").where("not held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and got >= 0.95
