"""Embedding near duplicates by product quantisation (operator 4).

Coarse inverted lists hold residual codes of the vectors; a vector is compared with the codes of the list that it is nearest
to, by sums of table look-ups, and what passes is compared again by exact cosine in double precision. Every vector's code is
in its nearest PROBES lists. A code passes when the looked-up distance is at most the largest distance of a link plus the
code's own stored error, so by the triangle inequality quantisation loses nothing: only probing can.

The number of lists is the square root of the number of vectors, so lists grow as slowly as they can. Beyond FLAT lists the coarse
quantiser has two levels: cells fitted on a small sample, and in each cell, in a task of its own, centres by the cell's share of the
vectors; a vector looks for its lists in its nearest DESCENTS cells.

Vectors are taken as double unit vectors. Equal vectors are one class, which counts with its size. A list is worked on in
cells of bounded numbers of queries and codes, so a list that very many vectors share is many tasks; a cell sends on counts
and a forest of its links, not pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import components, sampled, stored

#: Lists that a code is in; subspaces; codes of a subspace; Lloyd rounds.
PROBES, SUBSPACES, CODES, ROUNDS = 8, 16, 64, 6
#: Lists: the square root of the number of vectors, within these bounds (the largest model broadcast is LISTS[1] centres of 4 bytes a
#: dimension; it is reached at 7e10 vectors). Vectors fitted on: so many a list, those whose hashed id is smallest.
LISTS, FITTED = (4, 1 << 18), 24
#: Most lists of a quantiser of one level; cells that a vector looks for lists in.
FLAT, DESCENTS = 1024, 12
#: Queries and codes of a cell.
QUERIES, ENTRIES = 512, 4096


def _means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's k-means from evenly spaced rows; an empty cluster keeps its centre."""
    centre = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(x, centre)
        count = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        cut = np.concatenate([[0], np.cumsum(count)])[:-1]
        full = count > 0
        centre[full] = np.add.reduceat(x[order], cut[full]) / count[full, None]
    return centre


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centre.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


class Quantiser:
    """Coarse centres by cell, the cells' centres, and the code books of the residuals' subspaces (the last ones padded with zeros)."""

    def __init__(self, cells: np.ndarray, centres: list[np.ndarray]) -> None:
        self.dim = cells.shape[1]
        self.width = -(-self.dim // SUBSPACES)
        self.cells, self.at = cells, np.cumsum([0, *map(len, centres)])
        self.coarse = np.concatenate(centres).astype(np.float32)
        self.half = (self.coarse.astype(np.float64) ** 2).sum(axis=1) / 2

    def fit_codes(self, sample: np.ndarray) -> None:
        """The code books, from the residuals of a sample."""
        rest = self._split(sample - self.coarse[self.lists(sample)[:, 0]])
        self.books = np.stack([_means(rest[:, m], min(CODES, len(sample))) for m in range(SUBSPACES)])

    def _split(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.width * SUBSPACES - self.dim))).reshape(len(x), SUBSPACES, self.width)

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The nearest PROBES lists of each row (or all, if there are fewer), the nearest first."""
        many = min(PROBES, len(self.coarse))
        apart = (self.cells**2).sum(axis=1) / 2 - x @ self.cells.T
        first = np.argsort(apart, axis=1, kind="stable")[:, :DESCENTS]
        best, place = np.full((len(x), many), np.inf), np.full((len(x), many), -1)
        for c in np.unique(first):
            rows = np.flatnonzero((first == c).any(axis=1))
            s, e = self.at[c], self.at[c + 1]
            d = np.concatenate([best[rows], self.half[s:e] - x[rows] @ self.coarse[s:e].T.astype(np.float64)], axis=1)
            i = np.concatenate([place[rows], np.broadcast_to(np.arange(s, e), (len(rows), e - s))], axis=1)
            order = np.argsort(d, axis=1, kind="stable")[:, :many]
            best[rows], place[rows] = np.take_along_axis(d, order, axis=1), np.take_along_axis(i, order, axis=1)
        # a vector whose cells have fewer lists than it probes has its nearest again
        return np.where(place < 0, place[:, :1], place).astype(np.int32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest lists (the home first), codes, the error's norm, and the squared norm of what the code stands for."""
        near = self.lists(x)
        rest = self._split(x - self.coarse[near[:, 0]])
        code = np.stack([_nearest(rest[:, m], self.books[m]) for m in range(SUBSPACES)], axis=1).astype(np.uint8)
        back = self.decode(near[:, 0], code)
        return near, code, np.sqrt(((x - back) ** 2).sum(axis=1)), (back**2).sum(axis=1)

    def decode(self, home: np.ndarray, code: np.ndarray) -> np.ndarray:
        return self.coarse[home].astype(np.float64) + self.books[np.arange(SUBSPACES), code].reshape(len(code), -1)[:, : self.dim]

    def distances(self, q: np.ndarray, home: np.ndarray, code: np.ndarray, square: np.ndarray) -> np.ndarray:
        """Asymmetric distances of full queries and codes, from tables of inner products."""
        table = np.einsum("qmw,mkw->mqk", self._split(q), self.books)
        each, at = np.unique(home, return_inverse=True)
        inner = (q @ self.coarse[each].T.astype(np.float64))[:, at]
        for m in range(SUBSPACES):
            inner += table[m][:, code[:, m]]
        return np.sqrt(np.maximum(0, 1 + square[None, :] - 2 * inner))


def _rows(column: pd.Series, kind, width: int = -1) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), width)


def _forest(near: np.ndarray, q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an id and the smallest id of its component within a cell; near[i, j]: q[i] and x[j] are linked."""
    ids, at = np.unique(np.concatenate([q, x]), return_inverse=True)
    i, j = np.nonzero(near)
    a, b = at[: len(q)][i], at[len(q) :][j]
    low = np.arange(len(ids))
    while True:
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = np.minimum(new, new[new])
        if (new == low).all():
            break
        low = new
    joined = np.flatnonzero(low != np.arange(len(ids)))
    return ids[joined], ids[low[joined]]


def _units(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, unit): the rows with ``dim`` components as double unit vectors."""

    def unit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.array(f.embedding.tolist(), np.float64).reshape(len(f), dim)
            x /= np.abs(x).max(axis=1, keepdims=True)  # so that no square is out of range
            yield pd.DataFrame({"id": f.vec_id, "unit": [r.tobytes() for r in x / np.sqrt((x * x).sum(axis=1, keepdims=True))]})

    return vectors.where(F.size("embedding") == dim).select("vec_id", "embedding").mapInPandas(unit, "id long, unit binary")


def _in_one_task(sample: DataFrame, work) -> object:
    """work(unit vectors by id) of a small bounded sample, done in one task."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"made": [pickle.dumps(work(_rows(f.sort_values("id").unit, np.float64)))]})

    return pickle.loads(sample.groupBy(F.lit(1).alias("all")).applyInPandas(run, "made binary").first()["made"])


def _fitted(classes: DataFrame, total: int) -> Quantiser:
    """The quantiser of total vectors (id, unit)."""
    lists = int(min(max(total**0.5, LISTS[0]), LISTS[1]))
    sample = stored(sampled(classes.select("id", "unit"), min(lists, FLAT) * FITTED, "id"), "vector-sample")
    if lists <= FLAT:
        centres = _in_one_task(sample, lambda x: _means(x, min(lists, len(x))))
        model = Quantiser(centres.mean(axis=0, keepdims=True), [centres])
    else:
        cells = _in_one_task(sample, lambda x: _means(x, min(round(lists**0.5), len(x))))

        def cell_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield f.assign(cell=_nearest(_rows(f.unit, np.float64), cells))

        # a sample that no task sees whole: about FITTED vectors a list
        whole = 1 << 30
        own = classes.select("id", "unit").where(F.pmod(F.xxhash64("id"), F.lit(whole)) < F.lit(int(whole * min(1.0, lists * FITTED / total))))
        own = stored(own.mapInPandas(cell_of, "id long, unit binary, cell int"), "vector-cells")
        counts = own.groupBy("cell").agg(F.count("*").alias("n"))
        most = 4 * lists // len(cells) + 1  # lists of a cell; a cell with more vectors than that fits a sample of them
        share = counts.withColumn("k", F.greatest(F.lit(1), F.least(F.lit(most), F.round(F.col("n") / FITTED).cast("int"))))
        picked = own.join(share, "cell").where(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(whole)) < F.col("k") * FITTED * F.lit(float(whole)) / F.col("n"))

        def centres_of(f: pd.DataFrame) -> pd.DataFrame:
            x = _rows(f.sort_values("id").unit, np.float64)
            return pd.DataFrame({"cell": [f.cell.iloc[0]], "centres": [_means(x, min(int(f.k.iloc[0]), len(x))).astype(np.float32).tobytes()]})

        found = {r.cell: np.frombuffer(r.centres, np.float32).reshape(-1, cells.shape[1]) for r in picked.groupBy("cell").applyInPandas(centres_of, "cell int, centres binary").collect()}  # LISTS[1] centres at most, about
        model = Quantiser(cells, [found.get(c, cells[c : c + 1]) for c in range(len(cells))])

    def with_codes(x: np.ndarray) -> Quantiser:
        model.fit_codes(x)
        return model

    return _in_one_task(sample, with_codes)


def _linked(classes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(a, b, n): with b null, n more linked rows for class a; else an edge of the links' forest."""
    spark = classes.sparkSession
    total = classes.count()
    model = spark.sparkContext.broadcast(_fitted(classes, total))
    far = (2 * (1 - threshold)) ** 0.5

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 2048):
                p = f.iloc[at : at + 2048]
                near, code, error, square = model.value.encode(_rows(p.unit, np.float64))
                yield pd.DataFrame({"id": p.id, "times": p.times, "unit": p.unit, "home": near[:, 0], "probes": [r.tobytes() for r in near], "near": [np.unique(r).tolist() for r in near], "code": [r.tobytes() for r in code], "error": error, "square": square})

    coded = stored(classes.mapInPandas(encode, "id long, times long, unit binary, home int, probes binary, near array<int>, code binary, error double, square double"), "vector-codes")
    entries = coded.select(F.explode("near").alias("list"), "id", "home", "code", "error", "square")
    sizes = coded.groupBy(F.col("home").alias("list")).agg(F.count("*").alias("q")).join(entries.groupBy("list").agg(F.count("*").alias("e")), "list")
    parts = F.broadcast(sizes.select("list", F.ceil(F.col("q") / QUERIES).cast("int").alias("qs"), F.ceil(F.col("e") / ENTRIES).cast("int").alias("es")))  # a row a list: at most LISTS[1]
    spread = lambda df, own, other, named: df.join(parts, "list").withColumn(named[0], F.pmod(F.xxhash64("id"), F.col(own)).cast("int")).withColumn(named[1], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("qs", "es")
    cell = ["list", "q", "e"]
    queries = spread(coded.select(F.col("home").alias("list"), "id", "times", "unit", "probes"), "qs", "es", ("q", "e"))
    entries = spread(entries, "es", "qs", ("e", "q"))

    entries = entries.select(*(F.col(c).alias(f"e_{c}") for c in entries.columns))
    other = ["e_list", "e_q", "e_e"]

    def search(key, q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(e):
            return pd.DataFrame({"e_list": [], "e_q": [], "e_e": [], "e_id": []})
        apart = model.value.distances(_rows(q.unit, np.float64), e.e_home.to_numpy(), _rows(e.e_code, np.uint8), e.e_square.to_numpy())
        found = (apart <= far + e.e_error.to_numpy() + 1e-6) & (q.id.to_numpy()[:, None] != e.e_id.to_numpy())
        return pd.DataFrame({"e_list": key[0], "e_q": key[1], "e_e": key[2], "e_id": e.e_id[found.any(axis=0)]})

    wanted = queries.groupBy(*cell).cogroup(entries.groupBy(*other)).applyInPandas(search, "e_list int, e_q int, e_e int, e_id long")
    wanted = wanted.join(coded.select(*(F.col(c).alias(f"e_{c}") for c in ("id", "times", "unit", "home"))), "e_id")

    def rerank(key, q: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(e):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        a, b = q.id.to_numpy(), e.e_id.to_numpy()
        near = (_rows(q.unit, np.float64) @ _rows(e.e_unit, np.float64).T >= threshold) & (a[:, None] != b)
        # a link is also found from its other side if this query's code is in the entry's list; if not, it counts for it here
        back = (_rows(q.probes, np.int32)[:, None, :] == e.e_home.to_numpy()[None, :, None]).any(axis=2)
        mine, its = near @ e.e_times.to_numpy(), q.times.to_numpy() @ (near & ~back)
        x, low = _forest(near, a, b)
        out = [(a[mine > 0], None, mine[mine > 0]), (b[its > 0], None, its[its > 0]), (x, low, np.zeros(len(x), np.int64))]
        return pd.concat([pd.DataFrame({"a": i, "b": pd.array(j if j is not None else [None] * len(i), "Int64"), "n": n}) for i, j, n in out])

    return stored(queries.groupBy(*cell).cogroup(wanted.groupBy(*other)).applyInPandas(rerank, "a long, b long, n long"), "vector-links")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding).

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing; vectors of different lengths
    do not link. A null vec_id has no links and a null component_id. Rows that repeat a vec_id are separate rows of one id.
    """
    numbers = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.coalesce(F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(numbers, lambda v: v != 0), F.lit(False))
    real = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), numbers.alias("embedding")).where(fine & F.col("vec_id").isNotNull())
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    found = []
    for dim in sorted(r[0] for r in real.select(F.size("embedding")).distinct().collect()):
        units = stored(_units(real, dim).withColumn("key", F.xxhash64("unit")), "vector-units")
        classes = stored(units.groupBy("key", "unit").agg(F.min("id").alias("id"), F.count("*").alias("times")), "vector-classes")
        links = _linked(classes, dim, threshold)
        counts = links.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
        comps = components(links.where("b is not null").select(F.col("a").alias("src"), F.col("b").alias("dst")))
        member = classes.join(counts, "id", "left").join(comps, "id", "left").select("key", "unit", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        found.append(units.join(member, ["key", "unit"]).select(F.col("id").alias("vec_id"), "n_links", "component_id"))
    if not found:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    linked = found[0]
    for more in found[1:]:
        linked = linked.union(more)
    linked = linked.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = out.join(linked, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_vector_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: The same in DuckDB's SQL, for tables small enough for all pairs.
OP4_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
fine as (select vec_id, e from v where len(e) > 0 and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
link as (select a.vec_id as a, b.vec_id as b from fine a join fine b on a.vec_id < b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.95),
edge as (select a, b from link union all select b, a from link),
reach as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a),
n as (select a, count(*) as n from edge group by a), low as (select a, least(a, min(b)) as c from reach group by a)
select vec_id, coalesce(n, 0) as n_links, coalesce(c, vec_id) as component_id, coalesce(c, vec_id) = vec_id as kept from v left join n on n.a = vec_id left join low on low.a = vec_id
"""
