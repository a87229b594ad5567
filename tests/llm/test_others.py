"""Chat formatting, vectors, components, the pipeline and its registration."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from plumbline.llm import chat, vectors
from plumbline.llm.common import components
from plumbline.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, sf, name):
    df = queries()[name](spark, sf)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in ("conversations", "documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = con.execute(oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in cols) for r in found.fetchall())


def test_chat_round_trip(spark):
    r = random.Random(5)
    bits = ["</s>", "<s>", "[INST]", "[/INST]", " [/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT] ", "\\", "\\\\", "[", "<", "<<", "a", "\n", "é", " "]
    rows = [(c, t, r.choice(["user", "assistant", "system", "tool", "[TEXT] x", None]), None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for c in range(150) for t in range(r.randint(1, 6))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(df).withColumn("back", chat.parsed(F.col("formatted"))).collect()
    for o in out:
        want = [(role or "", text or "") for _, _, role, text in sorted((x for x in rows if x[0] == o.conv_id), key=lambda x: x[1])]
        assert [(t.role, t.text) for t in o.back] == want
        loss = "".join(s.text for s in o.segments if s.loss)
        assert "".join(s.text for s in o.segments) == o.formatted and (loss != "") == any(a == "assistant" and b for a, b in want)


def test_chat_machine(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "user", "u"), (3, 1, "user", "u"), (3, 2, "assistant", "a"), (4, 0, "user", "u"), (None, 0, "user", "u"), (None, None, None, None)]
    got = {r.conv_id: (r.valid, r.first_error) for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: (True, None), 2: (False, 0), 3: (False, 1), 4: (False, None), None: (False, 0)}
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_vectors(spark):
    g = np.random.default_rng(2)
    base = g.normal(size=(40, 16))
    rows, k = [], 0
    for b in base:
        for s in (0.0, 0.02, 0.08, 0.1, 0.12, 0.3):
            rows.append((k, (b + s * g.normal(size=16)).astype(np.float32).tolist()))
            k += 1
    rows += [(k + i, rows[3][1]) for i in range(300)]  # one vector many times
    k += 300
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1e-30] * 16, [1e30] * 16]
    rows += [(k + i, v) for i, v in enumerate(odd)] + [(None, [1.0] * 16)]
    out = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("unit", F.lit(1)).withColumn("id", F.lit(2)))
    assert out.count() == len(rows)
    got = {r.vec_id: r for r in out.collect()}
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = dict.fromkeys(parent, 0)
    for dim in (2, 16):
        own = [(i, v / np.abs(v).max()) for i, v in ok if len(v) == dim]
        u = np.array([v / np.linalg.norm(v) for _, v in own])
        for a, row in enumerate(u @ u.T >= 0.95):
            for b in np.flatnonzero(row):
                if a != b:
                    n[own[a][0]] += 1
                    x, y = find(own[a][0]), find(own[b][0])
                    parent[max(x, y)] = min(x, y)
    found, all_ = sum(got[i].n_links for i in n), sum(n.values())
    assert 0.99 * all_ <= found <= all_ and all(got[i].n_links <= n[i] for i in n)
    assert sum(got[i].component_id == find(i) for i in n) >= 0.98 * len(n)
    assert all(got[i].kept == (got[i].component_id == i) for i in n) and got[None].component_id is None
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("flat,lists", [(1024, 400), (64, 900)])
def test_recall_of_probing(flat, lists, monkeypatch):
    """At 64 dimensions and hundreds of lists, of one level and of two, links at 0.95 and above are found from one of their sides."""
    monkeypatch.setattr(vectors, "FLAT", flat)
    g = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(g.normal(size=(lists * 24, 64)))
    side = g.normal(size=(6000, 64))
    a = base[:6000]
    side = unit(side - (side * a).sum(axis=1, keepdims=True) * a)
    cos = g.uniform(0.95, 0.97, size=(6000, 1))
    b = cos * a + np.sqrt(1 - cos**2) * side
    if lists <= flat:
        centres = vectors._means(base, lists)
        model = vectors.Quantiser(centres.mean(axis=0, keepdims=True), [centres])
    else:
        cells = vectors._means(base, 30)
        at = vectors._nearest(base, cells)
        model = vectors.Quantiser(cells, [vectors._means(base[at == c], max(1, round((at == c).sum() / 24))) for c in range(30)])
        assert len(model.coarse) > 800
    model.fit_codes(base[:5000])
    x, y = model.lists(a), model.lists(b)
    found = (x == y[:, :1]).any(axis=1) | (y == x[:, :1]).any(axis=1)
    assert found.mean() >= 0.97
    near, code, error, square = model.encode(b)
    passed = np.array([model.distances(a[i : i + 1], near[i : i + 1, 0], code[i : i + 1], square[i : i + 1])[0, 0] for i in range(300)])
    assert (passed <= 0.1**0.5 + error[:300] + 1e-6).all()  # codes lose nothing


def test_vectors_of_two_levels(spark, monkeypatch):
    monkeypatch.setattr(vectors, "FLAT", 8)
    g = np.random.default_rng(9)
    base = g.normal(size=(600, 32))
    rows = [(3 * i + k, (b + (0.0, 0.05, 0.12)[k] * g.normal(size=32)).tolist()) for i, b in enumerate(base) for k in range(3)]
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    found = sum(r.n_links for r in got.values())
    assert 0.97 * near.sum() <= found <= near.sum() and all(got[i].n_links <= n for i, n in enumerate(near.sum(axis=1)))


def test_vectors_cells(spark, monkeypatch):
    """A list that is dealt to many cells gives the same counts."""
    monkeypatch.setattr(vectors, "QUERIES", 7)
    monkeypatch.setattr(vectors, "ENTRIES", 11)
    g = np.random.default_rng(4)
    b = g.normal(size=8)
    rows = [(i, (b + 0.01 * g.normal(size=8)).tolist()) for i in range(60)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(59, 0)}


def test_components(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(9, 9)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = [{r.doc_id for r in docs.collect()}]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(out)
        docs = spark.read.parquet(out)
        ids.append({r.doc_id for r in docs.collect()})
        assert ids[-1] <= ids[-2]
        if name != "packing":
            assert docs.columns == columns
    assert ids[-1] == ids[-2]
    assert {(r.doc_id, r.start) for r in corpus_pipeline.run(spark, sf).collect()} == {(r.doc_id, r.start) for r in docs.collect()}


def test_pipeline_keeps_clean_documents(spark, sf):
    docs = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).cache()
    ids = [None, {r.doc_id for r in docs.collect()}, {r.doc_id for r in corpus_pipeline.toxic_documents(spark, docs, sf).collect()}]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = [i for i in ids[1] if labels.get(i) == 0]
    assert len(kept) and sum(i in ids[2] for i in kept) >= 0.97 * len(kept)


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_stages_on_odd_and_empty_tables(spark, odd, none, tmp_path):
    """Each stage takes nulls, empty and long texts, repeated rows, ids and columns of any name, and tables without rows."""
    labels = [(i, i % 2, i % 2) for i in range(1, 12)] + [(1, 0, 1), (None, 1, 1), (3, None, None)]
    for k, (docs, known) in enumerate(((odd, labels), (none, labels), (odd, []))):
        at = str(tmp_path / f"sf{k}")
        spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, at).write.parquet(f"{at}/{name}")
            out = spark.read.parquet(f"{at}/{name}")
            if name != "packing":
                assert out.columns == docs.columns and out.count() <= docs.count()
        docs.write.parquet(f"{at}/documents.parquet")
        assert {r.doc_id for r in corpus_pipeline.run(spark, at).collect()} <= {r.doc_id for r in docs.collect()}


def test_tables_are_deleted(spark, sf):
    from pathlib import Path

    from plumbline.llm import common

    common.clean()
    out = common.stored(spark.range(5), "some")
    more = common.stored(out, "more")
    at = Path(more._plumbline_table.path.removeprefix("file:"))
    assert at.exists() and more.count() == 5
    common.dropped(more)
    assert not at.exists() and common.clean() == 1
