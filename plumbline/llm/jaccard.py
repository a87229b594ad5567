"""N-gram Jaccard join by size: subsets of small sets, scanned inverted lists of large ones (operator 10).

Two documents link when the Jaccard similarity of their sets of word shingles is at least num / den. Sets are arrays of
64-bit shingle hashes; documents with one and the same set are one class, and only a class's smallest doc_id goes on.

* Light sets (up to a boundary size): sets of sizes n <= m link exactly when they share c(n, m) elements, so each emits the
  hashes of its subsets of that size, and a bucket with a set of size n links all its members to it.
* Heavy sets: each is put in the inverted lists of the first n - ceil(n * num / den) + 1 of its shingles, in an order that
  puts very frequent shingles last; two linked sets share one of those. The lists are scanned in square cells of bounded
  size. Pairs pass exact filters on set size and on a parity bitmap (whose Hamming distance never exceeds the symmetric
  difference). A scan at first sends on only each member's nearest, which joins most groups; lists that still hold several
  components are scanned again, at last for every pair of different components.
* The boundary is the size at which the rows of the two ways cost least, from the histogram of small sizes.

Every candidate pair is verified on the whole sets. Pairs already known to be in one component are not compared again: the
result is membership and components, not pairs, so a group of copies is never expanded to all its pairs.

Nulls and texts without words have empty sets and link with nothing; a null doc_id gets a null component; rows that repeat
a doc_id count as one document with all its texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import components, fresh, stored, text_blocks
from plumbline.llm.hashing import mix, shingle_sets

_U = np.uint64
#: Largest size for which subsets are considered at all.
LIGHT_MAX = 24
#: Shingles in more documents than this go last in the order; so many at most, the most frequent, are sent to all tasks (8 bytes each).
#: The order only decides how long lists get: any order gives the same result.
FREQUENT, FREQUENT_MAX = 12, 1 << 18
#: Members of an inverted list that are compared in one cell; bits of a set's parity bitmap, at least one an element up to the most.
CELL, BITS, MOST_BITS = 512, 512, 1 << 15
#: 64-bit words of bitmaps that a task compares at once.
WORDS = 1 << 21
#: Ids of documents in candidate pairs are sent to all tasks up to this number (16 MB); beyond it their texts are shuffled.
SENT_IDS = 1 << 20


def overlap(n: int, m: int, num: int, den: int) -> int:
    """Fewest common elements of sets of n and m elements with Jaccard similarity num / den or more."""
    return -(-num * (n + m) // (num + den))


def prefix(n: int, num: int, den: int) -> int:
    """How many of its first shingles a set of n elements is listed under."""
    return n - -(-num * n // den) + 1 if n else 0


def frequent_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Sorted hashes of shingles that are frequent in the documents, at most FREQUENT_MAX (with counts from a power of two on). Tasks count all their documents and
    send on what several of them have: a shingle that no task's block has twice is not put last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            x, count = np.unique(np.concatenate(held), return_counts=True)
            keep = count > 1
            return pa.RecordBatch.from_arrays([pa.array(x[keep].view(np.int64)), pa.array(count[keep])], ["token", "n"])

        for _, texts in text_blocks(batches):
            sets = shingle_sets(texts, width)
            held += sets
            n += sum(map(len, sets))
            if n > 4_000_000:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    counts = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT)
    counts = stored(counts, "frequent")
    log = F.floor(F.log2("n")).cast("int")
    sizes = sorted(((r.k, r.c) for r in counts.groupBy(log.alias("k")).agg(F.count("*").alias("c")).collect()), reverse=True)  # a row a power of two
    least, held = 1 << 62, 0
    for k, c in sizes:
        held += c
        if held > FREQUENT_MAX:
            break
        least = 1 << k
    top = counts.where(F.col("n") >= F.lit(least)).select("token").toArrow()
    return np.sort(top.column("token").to_numpy().view(_U))


def _bitmap(x: np.ndarray) -> bytes:
    """A power of two of bits; bit k is the parity of the number of elements that fall on it."""
    bits = min(MOST_BITS, max(BITS, 1 << max(0, len(x) - 1).bit_length()))
    return np.packbits(np.bincount((x & _U(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def sketches(docs: DataFrame, width: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, n, key, small, first, bits): set size, hash of the set, the set if n <= LIGHT_MAX, its prefix, its bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for batch, texts in text_blocks(batches):
            n, key, small, first, bits = [], [], [], [], []
            for x in shingle_sets(texts, width):
                n.append(len(x))
                y = mix(x ^ _U(0xA5A5A5A5A5A5A5A5))
                key.append(np.array([y.sum(dtype=_U), np.bitwise_xor.reduce(mix(y)) if len(y) else 0, len(y)], _U).tobytes())
                small.append(x.tobytes() if 0 < len(x) <= LIGHT_MAX else None)
                p = prefix(len(x), num, den)
                if len(last) and len(x):
                    rare = last[np.minimum(np.searchsorted(last, x), len(last) - 1)] != x
                    head = x[rare][:p]
                    head = np.concatenate([head, x[~rare][: p - len(head)]])
                else:
                    head = x[:p]
                first.append(head.tobytes())
                bits.append(_bitmap(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), *(pa.array(c, pa.binary()) for c in (key, small, first, bits))], ["doc_id", "n", "key", "small", "first", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n int, key binary, small binary, first binary, bits binary")


def boundary(sizes: dict[int, int], num: int, den: int) -> int:
    """The largest light size: least total of subset rows below and list rows (three for each: listing, counting, comparing) above."""
    light = {s: sum(comb(s, overlap(min(s, o), max(s, o), num, den)) for o in range(1, LIGHT_MAX + 1) if num * max(s, o) <= den * min(s, o)) for s in range(1, LIGHT_MAX + 1)}
    heavy = {s: 3 * prefix(s, num, den) for s in light}
    cost = lambda x: sum(c * (light[s] if s <= x else heavy[s]) for s, c in sizes.items())
    return min(range(LIGHT_MAX + 1), key=lambda x: (cost(x), -x))


@lru_cache(maxsize=None)
def _without(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64).reshape(comb(n, k), k)


def light_edges(small: DataFrame, most: int, num: int, den: int) -> DataFrame:
    """(src, dst) of light sets that share a bucket: each bucket's members with its smallest doc_id of the smaller size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for doc, raw in zip(part.column("doc_id").to_pylist(), part.column("small").to_pylist(), strict=True):
                    x = mix(np.frombuffer(raw, _U))
                    s = len(x)
                    for o in range(1, most + 1):
                        n, m = min(s, o), max(s, o)
                        if num * m <= den * n:
                            gone = _without(s, s - overlap(n, m, num, den))
                            with np.errstate(over="ignore"):
                                subsets = mix((x.sum(dtype=_U) - x[gone].sum(axis=1, dtype=_U)) ^ _U(n * 64 + m))
                            rows.append((subsets.view(np.int64), np.full(len(subsets), doc), np.full(len(subsets), s == n)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["bucket", "doc", "smaller"])

    rows = small.select("doc_id", "small").mapInArrow(run, "bucket long, doc long, smaller boolean")
    hubs = rows.groupBy("bucket").agg(F.min(F.when(F.col("smaller"), F.col("doc"))).alias("hub"), F.count("*").alias("n")).where("n > 1 and hub is not null").drop("n")
    return rows.join(hubs, "bucket").where("hub <> doc").select(F.least("hub", "doc").alias("src"), F.greatest("hub", "doc").alias("dst")).distinct()


def postings(heavy: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                first = part.column("first").to_pylist()
                many = np.fromiter((len(x) // 8 for x in first), np.int64, len(first))
                doc, n = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), many) for c in ("doc_id", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(first), np.int64)), pa.array(doc), pa.array(n)], ["token", "doc", "n"])

    return heavy.select("doc_id", "n", "first").mapInArrow(run, "token long, doc long, n int")


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (src, dst) whose sets have Jaccard similarity num / den or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for raw, other in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = np.frombuffer(raw.as_buffer(), _U), np.frombuffer(other.as_buffer(), _U)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(bool(common) and den * common >= num * (len(x) + len(y) - common))
            yield batch.select(["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    a, b = sets.select(F.col("doc_id").alias("src"), F.col("set").alias("a")), sets.select(F.col("doc_id").alias("dst"), F.col("set").alias("b"))
    return pairs.join(a, "src").join(b, "dst").select("src", "dst", "a", "b").mapInArrow(run, "src long, dst long")


def scanned(cells: DataFrame, num: int, den: int, nearest: bool) -> DataFrame:
    """Candidate pairs (src, dst) from rows (token, i, j, part, doc, n, comp, bits) sorted by token, i, j within partitions."""

    def distances(bits: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hamming distances of bitmaps. Of two lengths the longer is folded: its parts' bits are of equal places of the shorter."""
        words = np.array([len(b) // 8 for b in bits])
        least, out = np.minimum(words[i], words[j]), np.zeros(len(i), np.int64)
        for w in np.unique(least):
            sel = np.flatnonzero(least == w)
            used = np.unique(np.concatenate([i[sel], j[sel]]))
            table = np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[r], _U).reshape(-1, w), axis=0) for r in used])
            a, b = np.searchsorted(used, i[sel]), np.searchsorted(used, j[sel])
            for at in range(0, len(sel), max(1, WORDS // w)):
                part = slice(at, at + max(1, WORDS // w))
                out[sel[part]] = np.bitwise_count(table[a[part]] ^ table[b[part]]).sum(axis=1, dtype=np.int64)
        return out

    def pairs(t: pa.Table) -> pa.RecordBatch | None:
        doc, n, comp, part = (t.column(c).to_numpy() for c in ("doc", "n", "comp", "part"))
        lo, hi = t.column("i").to_numpy(), t.column("j").to_numpy()
        token = t.column("token").to_numpy()
        bits = t.column("bits").to_pylist()
        new = np.ones(len(doc), bool)
        new[1:] = (token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
        run = np.cumsum(new) - 1
        size = np.bincount(run)[run]
        left = start + size - np.arange(len(doc)) - 1
        rows, step, found, open_, n_open = np.flatnonzero(left > 0), 1, [], [], 0
        while len(rows):
            i, j = rows, rows + step
            a, b = n[i].astype(np.int64), n[j].astype(np.int64)
            ok = (comp[i] != comp[j]) & (num * np.maximum(a, b) <= den * np.minimum(a, b)) & ((lo[i] == hi[i]) | (part[i] != part[j]))
            open_.append((i[ok], j[ok], (a + b)[ok]))
            n_open += len(open_[-1][0])
            step += 1
            rows = rows[left[rows] >= step]
            if n_open > 500_000 or not len(rows):
                i, j, total = (np.concatenate(x) for x in zip(*open_, strict=True))
                apart = distances(bits, i, j)
                ok = apart <= total - 2 * (-(-num * total // (num + den)))
                found.append((i[ok], j[ok], apart[ok] / total[ok]))
                open_, n_open = [], 0
        if not found:
            return None
        i, j, far = (np.concatenate(x) for x in zip(*found, strict=True))
        if nearest:
            both, other, far = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([far, far])
            order = np.lexsort((doc[other], far, both))
            first = order[np.diff(both[order], prepend=-1) != 0]
            i, j = both[first], other[first]
        a, b = np.minimum(doc[i], doc[j]), np.maximum(doc[i], doc[j])
        pair = np.unique(np.stack([a, b]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            key = [t.column(c).to_numpy() for c in ("token", "i", "j")]
            last = np.flatnonzero((key[0] != key[0][-1]) | (key[1] != key[1][-1]) | (key[2] != key[2][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut and (out := pairs(t.slice(0, cut))) is not None:
                yield out
            held = t.slice(cut)
        if held is not None and held.num_rows and (out := pairs(held)) is not None:
            yield out

    return cells.mapInArrow(run, "src long, dst long").distinct()


def _cells(lists: DataFrame, bits: DataFrame) -> DataFrame:
    """Rows (token, doc, n, comp) of the lists that hold several components, dealt to cells of at most about 2 * CELL members."""
    open_ = lists.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("members")).where("a <> b").select("token", F.ceil(F.col("members") / CELL).cast("int").alias("parts"))
    rows = lists.join(open_, "token").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("token", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "doc", "n", "comp")
    return rows.join(bits, "doc").repartition(F.col("token"), F.col("i"), F.col("j")).sortWithinPartitions("token", "i", "j", "doc").select("token", "i", "j", "part", "doc", "n", "comp", "bits")


def _sets_of(docs: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(doc_id, set) of the documents in pairs (src, dst)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in shingle_sets(texts, width)], pa.binary())], ["doc_id", "set"])

    wanted = pairs.select(F.col("src").alias("doc_id")).union(pairs.select("dst")).distinct()
    if wanted.count() <= SENT_IDS:
        wanted = F.broadcast(wanted)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    return stored(own.mapInArrow(run, "doc_id long, set binary"), "sets")


def joined(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for each row of docs; see the module's text."""
    all_ = stored(sketches(docs, width, num, den, frequent_shingles(docs, width)), "sketches")
    classes = stored(all_.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n")), "classes")
    own = all_.join(classes.select("doc_id", "key"), ["doc_id", "key"])  # one row of each class, or equal ones
    sizes = {r.n: r.c for r in classes.where(F.col("n") <= LIGHT_MAX).groupBy("n").agg(F.count("*").alias("c")).collect()}
    most = boundary(sizes, num, den)
    rows = postings(own.where((F.col("n") > most) | (den * F.col("n") >= num * (most + 1))))
    several = rows.groupBy("token").agg(F.count("*").alias("members"), F.min("n").alias("low"), F.max("n").alias("high"))
    several = several.where((F.col("members") > 2) | ((F.col("members") == 2) & (num * F.col("high") <= den * F.col("low")))).select("token")
    lists = stored(rows.join(several, "token"), "lists")
    light = light_edges(own.where(F.col("n") <= most), most, num, den)

    # ids that repeat keep all their rows here, so no pair of texts is missed
    listed = lists.select("doc").distinct()
    bits = all_.select(F.col("doc_id").alias("doc"), "bits").join(listed, "doc").distinct()

    def linked(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = stored(found, "pairs")
        return found, stored(verified(found, _sets_of(docs, found, width), num, den), "links")

    nearest = scanned(_cells(lists.withColumn("comp", F.col("doc")), bits), num, den, nearest=True)
    tried, edges = linked(nearest.union(light).distinct())
    # a document that is in no pair now has no passing pair in any list
    paired = tried.select(F.col("src").alias("doc")).union(tried.select("dst")).distinct()
    lists = stored(lists.join(paired, "doc").select("token", "doc", "n"), "lists")
    for only_nearest in (True, False):
        comps = components(edges).select(F.col("id").alias("doc"), F.col("component").alias("comp"))
        now = lists.join(comps, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
        more, links = linked(scanned(_cells(now, bits), num, den, only_nearest).join(tried, ["src", "dst"], "left_anti"))
        tried, edges = tried.union(more), edges.union(links)
    comps = components(edges)
    member = classes.select("key", F.col("doc_id").alias("class_id")).join(comps, F.col("class_id") == F.col("id"), "left").select("key", "class_id", F.coalesce("component", "class_id").alias("component"))
    real = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return all_.select("doc_id", "n", "key").join(member, "key", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(real, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(real, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def deduplicated(docs: DataFrame, **how: int) -> DataFrame:
    """One document of each component stays, that with the smallest doc_id; columns unchanged. Rows with a null doc_id stay."""
    key = fresh(docs, "gone")
    groups = joined(docs, **how).where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(groups, docs["doc_id"] == F.col(key), "left_anti")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joined(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, num=85, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


#: The same in DuckDB's SQL, for tables small enough for all pairs that share a shingle.
OP10_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_sort(list_distinct(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as s from w),
c as (select s, min(doc_id) as id, len(s) as n from s where len(s) > 0 group by s),
x as (select id, n, unnest(s) as t from c),
link as (select a.id as a, b.id as b from x a join x b on a.t = b.t and a.id < b.id and 85 * greatest(a.n, b.n) <= 100 * least(a.n, b.n) group by a.id, b.id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edge as (select a, b from link union all select b, a from link),
reach as (select a, b from edge union select r.a, e.b from reach r join edge e on r.b = e.a),
low as (select a as id, least(a, min(b)) as component_id from reach group by a)
select s.doc_id, len(s.s) as n_shingles, coalesce(low.component_id, c.id, s.doc_id) as component_id from s left join c on c.s = s.s left join low on low.id = c.id
"""
