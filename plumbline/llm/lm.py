"""LM scoring: deleted interpolation of bigram, unigram and uniform estimates (operator 1).

P(w | u) = a[b] c(u w) / c(u) + b[b] c(w) / N + c[b] / (V + 1), where b is the bucket of the context's frequency c(u) and the
weights of a bucket are learnt by expectation-maximisation on counts of training documents that the estimates left out; the
final estimates then count them too.

Counting and looking up are one exchange by blocks. Documents are put in chunks of about a million tokens; a chunk sends each
distinct n-gram's hash and counts once to the bucket that its hash falls in (so a frequent n-gram costs a row per chunk, not
per token), the bucket adds up, and sends the totals back to the chunks that asked. Chunks are in groups of at most FAN, and each
group has buckets of its own, whose number follows the group's tokens: a bucket gets at most FAN messages. Where there are several
groups, their buckets' sums are added up by upper buckets, as many as follow all tokens, and the totals go back the same way. So
neither messages nor n-grams of a bucket grow with the input up to FAN groups, some 10 ** 14 tokens. Nothing of the model passes through
the driver but the weights, N and V.

Longer contexts are left out: a chunk of a million tokens of the check tables has 182,000 distinct tokens, 723,000 pairs and 884,000
triples, so triples would double the exchange, from about 3.1 to about 6 times the input, where 4 are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import dropped, stored, text_blocks
from plumbline.llm.hashing import mix, word_hashes

_U = np.uint64
_END, _BEGIN = _U(0x6A09E667F3BCC908), _U(0xBB67AE8584CAA73B)
#: Tokens of a chunk; distinct n-grams of a bucket, about; context-frequency buckets (powers of two, the last is open).
CHUNK, BUCKET, FREQUENCIES = 1_000_000, 2_000_000, 40
#: Chunks of a group: the most messages that a bucket gets.
FAN = 1 << 14
ROUNDS = 15
#: Roles of a document: counted, left out of the counts to learn the weights, not learnt from at all.
COUNTED, LEFT_OUT, UNSEEN = 0, 1, 2


def _roles(docs: DataFrame) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    role = F.when(crc % 5 == 1, UNSEEN).when(F.floor(crc / 5) % 10 == 0, LEFT_OUT).otherwise(COUNTED)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), role.cast("int").alias("role"), "text")


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, left_out, tokens, doc_ids, roles, ends, texts): documents by the chunk; those with the role LEFT_OUT have their own chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, tuple[list, list, list]] = {k: ([], [], []) for k in (False, True)}
        size = {False: 0, True: 0}
        pack = zstandard.ZstdCompressor(level=3)

        def flush(k: bool) -> pa.RecordBatch:
            ids, roles, texts = held[k]
            ends = np.cumsum([len(t) for t in texts])
            row = [[k], [size[k]], [ids], [roles], [ends.tolist()], [pack.compress(b"".join(texts))]]
            types = [pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
            held[k], size[k] = ([], [], []), 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], ["left_out", "tokens", "doc_ids", "roles", "ends", "texts"])

        for batch, texts in text_blocks(batches):
            for doc, role, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                k = role == LEFT_OUT
                for into, x in zip(held[k], (doc, role, t or b""), strict=True):
                    into.append(x)
                size[k] += len(t or b"") // 6 + 1
                if size[k] >= CHUNK:
                    yield flush(k)
        for k in held:
            if held[k][0]:
                yield flush(k)

    rows = _roles(docs).mapInArrow(run, "left_out boolean, tokens long, doc_ids array<long>, roles array<int>, ends array<long>, texts binary")
    return stored(rows.withColumn("chunk", F.monotonically_increasing_id()), "lm-chunks")


class Tokens:
    """A chunk's tokens: per token its document, hash and the hashes of the context and of the pair; the distinct ones, sorted."""

    def __init__(self, ends, texts: bytes) -> None:
        raw, ends = zstandard.ZstdDecompressor().decompress(texts), np.asarray(ends)
        words, at = word_hashes([raw[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)])
        self.doc = np.repeat(np.arange(len(ends)), np.diff(at) + 1)
        self.token = np.insert(words, at[1:], _END)
        self.context = np.empty_like(self.token)
        self.context[1:] = self.token[:-1]
        self.context[np.concatenate([[0], np.cumsum(np.diff(at) + 1)[:-1]])] = _BEGIN
        with np.errstate(over="ignore"):
            self.pair = mix(mix(self.context) * _U(3) + self.token)
        self.ones, self.token_at = np.unique(np.append(self.token, _BEGIN), return_inverse=True)
        self.token_at = self.token_at[:-1]
        self.context_at = np.searchsorted(self.ones, self.context)
        self.twos, self.pair_at = np.unique(self.pair, return_inverse=True)


def _slices(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where the sorted hashes are cut into equal ranges of hash values."""
    edges = [(k << 64) // buckets for k in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(hashes, np.array(edges, _U)), [len(hashes)]])


def _small(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<i8").tobytes())


def _large(counts: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), "<i8")


def _added(hashes: list[np.ndarray], counts: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct hashes of messages in order, the sums of their counts by row (0 counted, 1 left out), and each message's places.
    counts: of the k-th message, which row they belong to; messages have distinct hashes."""
    each, at = np.unique(np.concatenate(hashes), return_inverse=True)
    ends = np.cumsum([len(x) for x in hashes])
    places = [at[e - len(x) : e] for x, e in zip(hashes, ends, strict=True)]
    sums = np.zeros((2, len(each)), np.int64)
    for place, (row, c) in zip(places, counts, strict=True):
        sums[row, place] += c
    return each, sums, places


def _seen(each: np.ndarray, sums: np.ndarray, kind: int) -> tuple[int, int]:
    """Tokens and distinct tokens."""
    real = (each != _BEGIN) & (sums[0] + sums[1] > 0)
    return (int(sums[:, real].sum()), int(real.sum())) if kind == 1 else (0, 0)


def totals(parts: DataFrame, buckets: int, groups: int = 1) -> DataFrame:
    """(chunk, left_out, kind, bucket, kept, held, n, v): for the chunk's n-grams in hash order, in how many tokens of counted
    and of left-out documents they are. n and v: tokens and distinct tokens, in rows that add up to all."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                t, out = Tokens(row.ends, row.texts), []
                learnt = np.asarray(row.roles) != UNSEEN
                counted = learnt[t.doc]
                for kind, hashes, at in ((1, t.ones, t.token_at), (2, t.twos, t.pair_at)):
                    counts = np.bincount(at[counted], minlength=len(hashes))
                    if kind == 1:  # a text's beginning is a context too
                        counts[np.searchsorted(hashes, _BEGIN)] += np.count_nonzero(learnt)
                    cut = _slices(hashes, buckets)
                    for b in np.flatnonzero(np.diff(cut)):
                        s = slice(cut[b], cut[b + 1])
                        out.append((row.group, int(b), row.chunk, row.left_out, kind, hashes[s].tobytes(), _small(counts[s])))
                del t
                yield pd.DataFrame(out, columns=["group", "bucket", "chunk", "left_out", "kind", "hashes", "counts"])

    def messages(frame: pd.DataFrame) -> Iterator[tuple]:
        """Of each kind of n-grams: the kind, the rows of the messages, and what _added gives."""
        for kind, rows in frame.groupby("kind"):
            yield kind, rows, *_added([np.frombuffer(x, _U) for x in rows.hashes], [(int(r.left_out), _large(r.counts)) for r in rows.itertuples()])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, rows, each, sums, places in messages(frame):
            n, v = _seen(each, sums, kind)
            for row, place in zip(rows.itertuples(), places, strict=True):
                out.append((row.chunk, row.left_out, kind, row.bucket, _small(sums[0, place]), _small(sums[1, place]), n, v))
                n = v = 0
        return pd.DataFrame(out, columns=["chunk", "left_out", "kind", "bucket", "kept", "held", "n", "v"])

    def up(frame: pd.DataFrame) -> pd.DataFrame:
        """A group's sums, cut for the upper buckets."""
        out = []
        for kind, rows, each, sums, _ in messages(frame):
            cut = _slices(each, buckets * groups)
            for u in np.flatnonzero(np.diff(cut)):
                s = slice(cut[u], cut[u + 1])
                out.append((int(u), rows.group.iloc[0], rows.bucket.iloc[0], kind, each[s].tobytes(), _small(sums[0, s]), _small(sums[1, s])))
        return pd.DataFrame(out, columns=["upper", "group", "bucket", "kind", "hashes", "kept", "held"])

    def over(frame: pd.DataFrame) -> pd.DataFrame:
        """All groups' sums, sent back to the groups' buckets."""
        out = []
        for kind, rows in frame.groupby("kind"):
            hashes = [np.frombuffer(x, _U) for x in rows.hashes]
            each, sums, places = _added(hashes * 2, [(k, _large(c)) for k, column in enumerate((rows.kept, rows.held)) for c in column])
            n, v = _seen(each, sums, kind)
            for row, place in zip(rows.itertuples(), places, strict=False):
                out.append((row.group, row.bucket, kind, row.upper, _small(sums[0, place]), _small(sums[1, place]), n, v))
                n = v = 0
        return pd.DataFrame(out, columns=["group", "bucket", "kind", "upper", "kept", "held", "n", "v"])

    def down(key, asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        """The totals of a group's bucket, sent back to the chunks."""
        out = []
        for kind, rows, _, _, places in messages(asked):
            own = found[found.kind == kind].sort_values("upper")
            kept, held = (np.concatenate([_large(x) for x in own[c]]) for c in ("kept", "held"))
            n, v = int(own.n.sum()), int(own.v.sum())
            for row, place in zip(rows.itertuples(), places, strict=True):
                out.append((row.chunk, row.left_out, kind, row.bucket, _small(kept[place]), _small(held[place]), n, v))
                n = v = 0
        return pd.DataFrame(out, columns=["chunk", "left_out", "kind", "bucket", "kept", "held", "n", "v"])

    asked = parts.withColumn("group", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int")).mapInPandas(ask, "group int, bucket int, chunk long, left_out boolean, kind int, hashes binary, counts binary")
    answer = "chunk long, left_out boolean, kind int, bucket int, kept binary, held binary, n long, v long"
    if groups == 1:
        return stored(asked.groupBy("bucket").applyInPandas(add, answer), "lm-totals")
    asked = stored(asked, "lm-asked")
    own = asked.groupBy("group", "bucket")
    sums = own.applyInPandas(up, "upper int, group int, bucket int, kind int, hashes binary, kept binary, held binary")
    back = sums.groupBy("upper").applyInPandas(over, "group int, bucket int, kind int, upper int, kept binary, held binary, n long, v long")
    out = stored(own.cogroup(back.groupBy("group", "bucket")).applyInPandas(down, answer), "lm-totals")
    dropped(asked)
    return out


def _looked_up(rows: pd.DataFrame, answers: pd.DataFrame) -> Iterator[tuple]:
    """For each chunk: its row, its tokens, and counts (kept, held) of tokens, contexts and pairs."""
    for row in rows.itertuples():
        t, found = Tokens(row.ends, row.texts), {}
        for kind, hashes in ((1, t.ones), (2, t.twos)):
            own = answers[answers.kind == kind].sort_values("bucket")
            for c in ("kept", "held"):
                found[kind, c] = np.concatenate([_large(x) for x in own[c]])
                if len(found[kind, c]) != len(hashes):
                    raise ValueError(f"chunk {row.chunk}: {len(found[kind, c])} answers for {len(hashes)} n-grams")
        yield row, t, found


def frequency(context: np.ndarray) -> np.ndarray:
    """The bucket of a context's count: 0 if it was never seen, then by powers of two."""
    return np.minimum(np.ceil(np.log2(context + 1.0)), FREQUENCIES - 1).astype(np.int32)


def learnt_weights(parts: DataFrame, answers: DataFrame, n: int, v: int) -> np.ndarray:
    """[FREQUENCIES, 3] mixture weights (pair, token, uniform), by expectation-maximisation over the left-out documents' tokens."""

    def events(key, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, t, x in _looked_up(rows, found):
            context, pair, one = x[1, "kept"][t.context_at], x[2, "kept"][t.pair_at], x[1, "kept"][t.token_at]
            out.append(pd.DataFrame({"bucket": frequency(context), "context": context, "pair": pair, "one": one}).value_counts().reset_index(name="times"))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("bucket", "context", "pair", "one", "times")}, dtype="int64")

    own = parts.where("left_out").groupBy("chunk").cogroup(answers.where("left_out").groupBy("chunk"))
    seen = stored(own.applyInPandas(events, "bucket int, context long, pair long, one long, times long"), "lm-events")
    kept = max(1, n - (seen.agg(F.sum("times")).first()[0] or 0))
    p2 = F.when(F.col("context") > 0, F.col("pair") / F.col("context")).otherwise(0.0)
    seen = seen.select("bucket", "times", p2.alias("p2"), (F.col("one") / kept).alias("p1"))
    weights = np.tile([0.4, 0.4, 0.2], (FREQUENCIES, 1))
    weights[0] = [0.0, 0.7, 0.3]
    for _ in range(ROUNDS):
        each = [F.element_at(F.array(*(F.lit(float(x)) for x in weights[:, k])), F.col("bucket") + 1) for k in range(3)]
        parts_ = [each[0] * F.col("p2"), each[1] * F.col("p1"), each[2] / (v + 1)]
        share = [F.sum(F.col("times") * x / (parts_[0] + parts_[1] + parts_[2])).alias(f"s{k}") for k, x in enumerate(parts_)]
        rows = seen.groupBy("bucket").agg(*share).collect()  # at most FREQUENCIES rows
        for r in rows:
            s = np.array([r.s0, r.s1, r.s2]) + [0.0 if r.bucket == 0 else 0.01, 0.01, 0.01]
            weights[r.bucket] = s / s.sum()
    return weights


def learnt(docs: DataFrame) -> tuple[DataFrame, DataFrame, int, int, np.ndarray]:
    """The chunks of docs, their n-grams' totals, the numbers of tokens and of distinct tokens learnt from, and the weights."""
    parts = chunks(docs)
    n_chunks, tokens = parts.agg(F.count("*"), F.sum("tokens")).first()
    groups = max(1, -(-n_chunks // FAN))
    buckets = max(-(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // groups), (tokens or 0) // groups // BUCKET + 1)
    answers = totals(parts, buckets, groups)
    n, v = (x or 0 for x in answers.agg(F.sum("n"), F.sum("v")).first())
    return parts, answers, n, v, learnt_weights(parts, answers, n, v)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row; nulls and empty texts are an end token alone.

    Without any training document all counts are 0 and every token gets the uniform part. Rows that repeat a doc_id are each counted
    and scored; doc_id is cast to long (an id that is no number is an error), a null one counts as the empty text in the split.
    """
    parts, answers, n, v, weights = learnt(docs)

    def score(key, rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row, t, x in _looked_up(rows, found):
            ones, twos = x[1, "kept"] + x[1, "held"], x[2, "kept"] + x[2, "held"]
            one, context, pair = ones[t.token_at], ones[t.context_at], twos[t.pair_at]
            w = weights[frequency(context)]
            p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * one / max(n, 1) + w[:, 2] / (v + 1)
            sums = [np.bincount(t.doc, y, len(row.doc_ids)) for y in (None, one > 0, np.log10((one + 0.5) / (n + 0.5 * (v + 1))), np.log10(p))]
            out.append(pd.DataFrame({"doc_id": pd.array(row.doc_ids, "Int64"), "held_out": np.asarray(row.roles) == UNSEEN, "n_tokens": sums[0], "n_known": sums[1].astype(np.int64), "train_tokens": n, "base_score": sums[2], "score": sums[3]}))
        return pd.concat(out)

    both = parts.groupBy("chunk").cogroup(answers.groupBy("chunk"))
    return both.applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
