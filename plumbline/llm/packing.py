"""Packing: documents cut into pieces and packed into near-equal windows by Karmarkar-Karp differencing (operator 5)."""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import stored, text_blocks

CAPACITY, END = 2048, 1
#: What is left of a document after its full windows is cut into pieces of at most this many ids.
PIECE = 512
#: Pieces that are packed together, on average: the bound of a packing task's group.
GROUP = 768
_EOT, _EOT_ID = "<|endoftext|>", 50256


@lru_cache(maxsize=2)
def encoder(ranks: str = "byte_bpe_50k.tiktoken", exact: str = "byte_bpe_50k.json") -> Callable[[str], list[int]]:
    """ids of a text as the tokenizers library gives them from ``exact`` (its special string in a text is that token).

    The library itself needs some 1,100 CPU seconds a GB, more than the limit of operator 5 allows; the same vocabulary as ranks
    needs a fifth of that and gives the same ids (tests/llm compares them over a wide random corpus). A text that the ranks'
    encoder can't take goes to the library.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={_EOT: _EOT_ID})
    slow = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(public_tokenizers.path(exact)))

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all") if _EOT in text else fast.encode_ordinary(text)
        except (ValueError, OverflowError):  # the pattern's engine gives up on some very long runs
            return slow().encode(text, add_special_tokens=False).ids

    return encode


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full windows first, then equal pieces of at most ``piece``."""
    full = n // capacity * capacity
    rest, many = n - full, -(-(n - full) // piece)
    at = [full + rest * k // many for k in range(many + 1)] if many else []
    return [(s, capacity) for s in range(0, full, capacity)] + [(s, e - s) for s, e in zip(at, at[1:], strict=False)]


def pieces(docs: DataFrame, with_ids: bool = False, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) of all documents, a null text taken as empty. doc_id is cast to long
    (an id that is no number is an error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch, texts in text_blocks(batches):
            out = []
            for doc, t in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids = np.array([*encode((t or b"").decode()), end], "<u4")
                for s, n in cuts(len(ids)):
                    raw = ids[s : s + n].tobytes()
                    out.append((doc, s, n, zlib.crc32(raw), len(ids), raw))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 6 if with_ids else 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, zip(*out, strict=True), strict=False)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def differenced(lengths: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp multiway differencing: indexes of the lengths in k windows with near-equal sums.

    Each length begins as a partial partition of k windows, all but one empty. The two with the largest imbalance are merged,
    the fullest window of one with the emptiest of the other, until one is left.
    """
    heap: list = []
    for i, n in enumerate(lengths):
        heap.append((-n, i, np.array([n]), [[i]]))  # only windows with something are listed; the others hold 0
    heapq.heapify(heap)
    made = len(lengths)
    while len(heap) > 1:
        _, _, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        # a and b are descending; b's fullest go to a's emptiest
        if len(a) + len(b) <= k:
            sums, parts = np.concatenate([a, b]), in_a + in_b
        else:
            over = len(a) + len(b) - k
            sums = np.concatenate([a, np.zeros(k - len(a), a.dtype)])
            sums[k - len(b) :] += b[::-1]
            parts = in_a + [[] for _ in range(k - len(a))]
            for j, p in enumerate(in_b):
                at = k - 1 - j
                parts[at] = parts[at] + p
            assert over > 0
        order = np.argsort(-sums, kind="stable")
        sums, parts = sums[order], [parts[i] for i in order]
        made += 1
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == k else 0)), made, sums, parts))
    return heap[0][3] if heap else []


def windows(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``: their count starts at the least possible and rises while one is too full."""
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        out = differenced(lengths, k)
        if max((sum(lengths[i] for i in w) for w in out), default=0) <= capacity:
            return out
        k += 1


def packed(docs: DataFrame, with_ids: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """pieces() with sequence_id and offset. Full pieces are sequences of their own; the others are dealt, by a hash of
    (doc_id, start), to groups of about GROUP pieces, and each group is packed for itself.

    Rows that repeat a doc_id are packed each; an empty text is the end id alone. The number of groups follows the number of
    pieces, so a group's size does not grow with the input and no key is hot.
    """
    cut = stored(pieces(docs, with_ids).withColumn("row", F.monotonically_increasing_id()), "pieces")
    rest = cut.where(F.col("length") < capacity)
    groups = max(1, round(rest.count() / GROUP))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "row"], ascending=False)
        lengths = pdf["length"].tolist()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for w, inside in enumerate(windows(lengths, capacity)):
            at = 0
            for i in inside:
                sequence[i], offset[i] = w, at
                at += lengths[i]
        return pd.DataFrame({"row": pdf["row"], "sequence_id": (pdf["group"].to_numpy() << 20) + sequence, "offset": offset})

    small = rest.select("doc_id", "start", "length", "row", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(groups)).alias("group"))
    if with_ids:
        places = small.groupBy("group").applyInPandas(pack, "row long, sequence_id long, offset long")
        mixed = rest.join(places, "row")
    else:  # everything a piece has is a few numbers, so it goes with it
        small = rest.select("*", F.pmod(F.xxhash64("doc_id", "start", "row"), F.lit(groups)).alias("group"))
        names = [c for c in cut.columns if c != "row"]
        schema = ", ".join(f"{c} long" for c in [*names, "sequence_id", "offset"])
        mixed = small.groupBy("group").applyInPandas(lambda pdf: pd.concat([pdf[names], pack(pdf)[["sequence_id", "offset"]].reindex(pdf.index)], axis=1), schema)
    full = cut.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    return full.drop("row").unionByName(mixed.drop("row", "group"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
