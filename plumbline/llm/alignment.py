"""Cross-tokenizer alignment: tokens of two vocabularies linked where their bytes overlap (operator 13).

A text is cut before blanks and line feeds that follow a visible character: neither vocabulary has a token across such a place (tests hold
this against whole texts), so each distinct word of a batch is encoded once. Within a word the character offsets of tokenizers and
the spans of sentencepiece's proto are the coarse cuts; where a span is not as long as its token, in the middle of a character or of
bytes that sentencepiece falls back to, the token's decoded bytes give the cut. All tokens' decoded bytes have to be the text's.

A pair of ids is counted over the corpus by one exchange. Documents are put in chunks of about CHUNK links; a chunk sends each distinct
pair of ids once, with its count, to the bucket of its B id; the bucket adds up, tells which pairs are their B id's most frequent, and
answers the chunks that asked. Chunks are in groups of at most FAN; where there are several, a bucket's sums are added up over groups
first. So neither the messages nor the pairs that a task holds grow with the input.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import dropped, stored, text_blocks

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Links of a chunk; pairs of a bucket, about; chunks of a group; distinct words of a generation that a worker remembers.
CHUNK, BUCKET, FAN, KEPT_WORDS = 2_000_000, 2_000_000, 1 << 14, 3 << 16
#: Characters and documents that are aligned at once; a longer text is cut into slices.
BLOCK, BLOCK_DOCS = 1 << 21, 1 << 14
#: Distinct words that are encoded as one string.
JOINED = 512
#: Ids have at most so many bits.
_BITS = 24
_LOW = (1 << _BITS) - 1
_STIR = 0x9E3779B1

_PLAIN = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_UNSAFE = re.compile(r"[^!-~À-ÿ \n][ \n]")
_SAFE = frozenset(map(chr, [*range(0x21, 0x7F), *range(0xC0, 0x100)]))
_NEW = object()
_CUT = re.compile(r"(?<=[!-~À-ÿ])(?=[ \n])")


def words(text: str) -> list[str]:
    """The text in pieces that no token of either vocabulary crosses; joined they are the text."""
    return [x for x in _CUT.split(text) if x] if _UNSAFE.search(text) else _PLAIN.findall(text)


def slices(text: str, size: int = BLOCK) -> Iterator[str]:
    """The text in slices of about ``size`` characters, cut where words() cuts."""
    start = 0
    while start < len(text):
        found = _CUT.search(text, start + size) if len(text) - start > size else None
        stop = found.start() if found else len(text)
        yield text[start:stop]
        start = stop


def byte_ends(text: bytes, starts: np.ndarray, ends: np.ndarray, tokens: list[bytes]) -> np.ndarray | None:
    """Where each token ends in the text, in bytes, from spans (starts, ends) and the tokens' bytes. A span is taken where it is as
    long as its token and starts at the one before; else the bytes tell. None if the tokens' bytes are not the text's."""
    if b"".join(tokens) != text:
        return None
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    decoded = np.cumsum(sizes)
    return np.where((starts == decoded - sizes) & (ends - starts == sizes), ends, decoded)


def _byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: visible Latin-1 characters are themselves, the rest follow from 256."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Both libraries, and the distinct words seen lately with their ids and byte ends."""

    def __init__(self, a_file: str = A_FILE, b_file: str = B_FILE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(a_file))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=public_tokenizers.path(b_file))
        alphabet = _byte_alphabet()
        self.a_bytes = [bytes(alphabet[c] for c in self.a.id_to_token(i)) if all(c in alphabet for c in self.a.id_to_token(i)) else self.a.id_to_token(i).encode() for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.IsByte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.young: dict[str, bytes | None] = {}
        self.old: dict[str, bytes | None] = {}

    def tokens(self, texts: list[str]) -> Iterator[tuple[np.ndarray, ...] | None]:
        """Of each text: ids and byte ends of both sides; None if the bytes of a side are not the text's.

        sentencepiece puts a space before what it encodes; a line feed first keeps that space apart, since no piece has one.
        """
        for text, a, b in zip(texts, self.a.encode_batch(texts, add_special_tokens=False), self.b.encode_as_proto(["\n" + t for t in texts], num_threads=1), strict=True):
            raw = text.encode()
            chars = np.flatnonzero((np.frombuffer(raw + b" ", np.uint8) & 0xC0) != 0x80)
            spans = chars[np.array(a.offsets, np.int64).reshape(-1, 2)]
            pieces = b.pieces[2:]
            flat = np.array([x for p in pieces for x in (p.id, p.begin, p.end)], np.int64).reshape(-1, 3)
            a_id, b_id = np.array(a.ids, np.int64), flat[:, 0]
            a_ends = byte_ends(raw, spans[:, 0], spans[:, 1], [self.a_bytes[i] for i in a.ids])
            b_ends = byte_ends(raw, flat[:, 1] - 1, flat[:, 2] - 1, [self.b_bytes[i] for i in b_id.tolist()])
            yield None if a_ends is None or b_ends is None else (a_id, a_ends, b_id, b_ends)

    def encoded(self, new: list[str]) -> Iterator[bytes | None]:
        """Of each word: counts, ids and ends of both sides as 32-bit integers; None if the bytes of a side are not the word's.

        Words are encoded in strings of some hundred, as they stand beside each other in texts; a string of which a side's bytes are
        not the string's, and a word that no other can follow, are encoded word by word.
        """
        joined, held = [], []
        for k, word in enumerate(new):
            held.append(word)
            if len(held) == JOINED or k + 1 == len(new) or word[-1] not in _SAFE:
                joined.append(held)
                held = []
        for part, found in zip(joined, self.tokens(["".join(x) for x in joined]), strict=True):
            if found is None and len(part) > 1:
                for word, own in zip(part, self.tokens(part), strict=True):
                    yield from self._cut([word], own)
            else:
                yield from self._cut(part, found)

    def _cut(self, part: list[str], found: tuple[np.ndarray, ...] | None) -> Iterator[bytes | None]:
        if found is None:
            yield None
            return
        a_id, a_ends, b_id, b_ends = found
        stops = np.cumsum([len(w.encode()) for w in part])
        a_cut, b_cut = np.searchsorted(a_ends, stops) + 1, np.searchsorted(b_ends, stops) + 1
        if (a_ends[a_cut - 1] != stops).any() or (b_ends[b_cut - 1] != stops).any():
            raise ValueError(f"a token crosses the end of a word in {part}")
        n_a, n_b = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
        starts = np.concatenate([[0], np.cumsum(2 + 2 * n_a + 2 * n_b)])
        begin, at, out = np.concatenate([[0], stops[:-1]]), starts[:-1], np.empty(starts[-1], np.int32)
        out[at], out[at + 1] = n_a, n_b
        out[_spread(at + 2, n_a)], out[_spread(at + 2 + n_a, n_a)] = a_id, a_ends - np.repeat(begin, n_a)
        out[_spread(at + 2 + 2 * n_a, n_b)], out[_spread(at + 2 + 2 * n_a + n_b, n_b)] = b_id, b_ends - np.repeat(begin, n_b)
        raw, cut = out.tobytes(), (4 * starts).tolist()
        yield from (raw[x:y] for x, y in zip(cut, cut[1:], strict=False))

    def of(self, distinct: list[str]) -> list[bytes | None]:
        """What encoded() gives for each word. Words are remembered in two generations: when the younger is full it becomes the older one,
        and words of the older one that come again move up."""
        out = [self.young.get(w, _NEW) for w in distinct]
        missed = [k for k, x in enumerate(out) if x is _NEW]
        for k in missed:
            out[k] = self.old.get(distinct[k], _NEW)
        new = [k for k in missed if out[k] is _NEW]
        for k, x in zip(new, self.encoded([distinct[k] for k in new]), strict=True):
            out[k] = x
        self.young.update((distinct[k], out[k]) for k in missed if len(distinct[k]) <= 64)
        if len(self.young) > KEPT_WORDS:
            self.young, self.old = {}, self.young
        return out


@lru_cache(maxsize=1)
def encoder(a_file: str = A_FILE, b_file: str = B_FILE) -> Encoder:
    return Encoder(a_file, b_file)


def _digit_table(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. most - 1, from the left, and how many they are."""
    width = len(str(most))
    text = np.char.ljust(np.arange(most).astype(f"S{width}"), width, b" ")
    table = np.frombuffer(text.tobytes(), np.uint8).reshape(most, width) if most else np.zeros((0, width), np.uint8)
    return table, (table != 0x20).sum(axis=1).astype(np.int32)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... (count[k] of them) for each k, in one array."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


class Chunk:
    """Aligned documents of a chunk: counts and group digests by document, and each document's distinct pairs with their counts."""

    def __init__(self, libraries: Encoder, block: int = BLOCK) -> None:
        self.block, self.libraries, self.digits = block, libraries, _digit_table(max(len(libraries.a_bytes), len(libraries.b_bytes)))
        self.clear()

    def clear(self) -> None:
        self.ids: list[int | None] = []
        self.hashers: list = []
        self.counts: list[np.ndarray] = []  # by block: document, n_a, n_b, n_groups, n_links
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # by block: document, pair, count
        self.links = 0
        self.held: list[tuple[int, list[str]]] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        self.ids.append(doc_id)
        self.hashers.append(None)
        if not text:
            return
        text = " " + text
        if len(text) > self.block and any(x is None for part in slices(text, self.block) for x in self.libraries.of(list(dict.fromkeys(words(part))))):
            return
        for part in slices(text, self.block):
            self.held.append((len(self.ids) - 1, words(part)))
            self.bytes += len(part)
            if self.bytes >= self.block or len(self.held) >= BLOCK_DOCS:
                self.align()

    def align(self) -> None:
        """Tokens of what is held, their links and groups."""
        if not self.held:
            return
        docs = np.repeat(np.array([d for d, _ in self.held]), [len(w) for _, w in self.held])
        every = [w for _, part in self.held for w in part]
        self.held, self.bytes = [], 0
        place = {w: k for k, w in enumerate(dict.fromkeys(every))}
        at = np.fromiter(map(place.__getitem__, every), np.int64, len(every))
        packed = self.libraries.of(list(place))
        wrong = np.array([x is None for x in packed])[at]
        if wrong.any():
            keep = ~np.isin(docs, docs[wrong])
            docs, at = docs[keep], at[keep]
        if not len(at):
            return
        data = np.frombuffer(b"".join(x or bytes(8) for x in packed), np.int32)
        starts = np.cumsum([0, *(len(x or bytes(8)) // 4 for x in packed)])[:-1][at]
        n_a, n_b = data[starts].astype(np.int64), data[starts + 1].astype(np.int64)
        sizes = data[starts + 1 + 2 * n_a].astype(np.int64)  # the last end of the A side
        begin = np.cumsum(sizes) - sizes
        a_at, b_at = _spread(starts + 2, n_a), _spread(starts + 2 + 2 * n_a, n_b)
        a_id, b_id = data[a_at].astype(np.int64), data[b_at].astype(np.int64)
        a_end, b_end = data[a_at + np.repeat(n_a, n_a)] + np.repeat(begin, n_a), data[b_at + np.repeat(n_b, n_b)] + np.repeat(begin, n_b)
        a_doc, b_doc = np.repeat(docs, n_a), np.repeat(docs, n_b)

        # two cuts of the same bytes: each stretch between neighbouring ends of either lies in one token of both, and is their link
        b_over, a_over = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)
        a_common, b_common = b_end[b_over] == a_end, a_end[a_over] == b_end
        inner = np.flatnonzero(~b_common)
        a_link, b_link = np.concatenate([np.arange(len(a_id)), a_over[inner]]), np.concatenate([b_over, inner])
        link_doc = a_doc[a_link]

        first, last = int(docs[0]), int(docs[-1]) + 1
        counts = [np.bincount(x - first, minlength=last - first) for x in (a_doc, b_doc, a_doc[a_common], link_doc)]
        self.counts.append(np.stack([np.arange(first, last), *counts]))
        pair = (((b_id * _STIR) & _LOW) << _BITS)[b_link] | a_id[a_link]
        order = np.lexsort((pair, link_doc)) if last - first > (1 << 15) else np.argsort(((link_doc - first) << 48) | pair)
        pair, link_doc = pair[order], link_doc[order]
        new = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (link_doc[1:] != link_doc[:-1])]))
        self.pairs.append((link_doc[new].astype(np.int32), pair[new], np.diff(np.append(new, len(pair))).astype(np.int32)))
        self.links += len(pair)
        self._digest(a_id, b_id, b_doc, a_common, b_common)

    def _digest(self, a_id: np.ndarray, b_id: np.ndarray, b_doc: np.ndarray, a_common: np.ndarray, b_common: np.ndarray) -> None:
        """Adds the groups' decimal ids to the documents' digests: A ids, |, B ids, ; a group."""
        a_group, b_group = np.cumsum(a_common, dtype=np.int32) - a_common, np.cumsum(b_common, dtype=np.int32) - b_common
        b_last = np.flatnonzero(b_common)  # the last B token of each group, and so the last of the group
        b_row = np.arange(len(b_id)) + (np.flatnonzero(a_common) + 1)[b_group]
        a_row = np.arange(len(a_id)) + np.concatenate([[0], b_last + 1])[a_group]
        table, sizes = self.digits
        n = len(a_id) + len(b_id)
        ids, ends = np.empty(n, np.int32), np.empty(n, np.uint8)
        ids[a_row], ids[b_row] = a_id, b_id
        ends[a_row], ends[b_row] = np.where(a_common, ord("|"), ord(",")), np.where(b_common, ord(";"), ord(","))
        size = sizes[ids]
        stops = np.cumsum(size + 1)
        out = np.empty(int(stops[-1]), np.uint8)
        begin = stops - size - 1
        for k in range(table.shape[1]):
            longer = np.flatnonzero(size > k) if k else slice(None)
            out[begin[longer] + k] = table[ids[longer], k]
        out[stops - 1] = ends
        out = out.tobytes()
        start = 0
        for k in np.flatnonzero(np.append(b_doc[1:] != b_doc[:-1], True)):
            d, stop = int(b_doc[k]), int(stops[b_row[k]])
            if self.hashers[d] is None:
                self.hashers[d] = hashlib.sha256()
            else:
                self.hashers[d].update(b";")
            self.hashers[d].update(out[start : stop - 1])
            start = stop

    def row(self) -> pa.RecordBatch:
        """The chunk as a row; afterwards the chunk is empty."""
        self.align()
        counts = np.zeros((4, len(self.ids)), np.int64)
        for block in self.counts:
            counts[:, block[0]] += block[1:]
        doc, pair, times = (np.concatenate(x) for x in zip(*self.pairs, strict=True)) if self.pairs else (np.zeros(0, np.int64),) * 3
        distinct, place = np.unique(pair, return_inverse=True)
        total = np.bincount(place, times, len(distinct)).astype(np.int64)
        digests = ["" if h is None else h.hexdigest() for h in self.hashers]
        entries = np.bincount(doc.astype(np.int64), minlength=len(self.ids))
        values = [len(distinct), self.ids, *counts.tolist(), digests, entries.tolist(), _small(np.diff(place, prepend=0)), _small(times), _small(np.diff(distinct, prepend=0)), _small(total)]
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _ROW.types, strict=True)], schema=_ROW)


_LONGS = pa.list_(pa.int64())
_ROW = pa.schema([("n_pairs", pa.int64()), ("doc_ids", _LONGS), ("n_a", _LONGS), ("n_b", _LONGS), ("n_groups", _LONGS), ("n_links", _LONGS), ("digests", pa.list_(pa.string())), ("entries", _LONGS), *((c, pa.binary()) for c in ("place", "times", "pairs", "counts"))])
_COUNTED = "bucket int, sender long, pairs binary, counts binary"
_ANSWER = "chunk long, bucket int, counts binary, best binary"


def _small(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<i8").tobytes())


def _large(x: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "<i8")


def chunks(docs: DataFrame, size: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text) aligned, a row a chunk: counts and digests by document, and which pairs each has how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(encoder(), block)
        for batch, texts in text_blocks(batches):
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                chunk.add(doc, text.decode() if text else None)
                if chunk.links >= size:
                    yield chunk.row()
        if chunk.ids:
            yield chunk.row()

    kinds = {pa.int64(): "long", _LONGS: "array<long>", pa.list_(pa.string()): "array<string>", pa.binary(): "binary"}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in _ROW))
    return stored(rows.withColumn("chunk", F.monotonically_increasing_id()), "aligned-chunks")


def _added(rows: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each message's pairs, all distinct pairs in order, and the sums of their counts."""
    pairs = [np.cumsum(_large(x)) for x in rows.pairs]
    distinct, place = np.unique(np.concatenate(pairs), return_inverse=True)
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, place, np.concatenate([_large(x) for x in rows.counts]))
    return pairs, distinct, sums


def pair_counts(parts: DataFrame, buckets: int, groups: int = 1) -> DataFrame:
    """(chunk, bucket, counts, best): for the chunk's pairs in order, how often they are linked in all documents, and whether that is the
    most of their B id."""
    edges = np.array([-(-(k << _BITS) // buckets) << _BITS for k in range(1, buckets)], np.int64)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                pairs, counts, out = np.cumsum(_large(row.pairs)), _large(row.counts), []
                cut = np.concatenate([[0], np.searchsorted(pairs, edges), [len(pairs)]]).astype(np.int64)
                for k in np.flatnonzero(np.diff(cut)):
                    s = slice(cut[k], cut[k + 1])
                    out.append((row.group, int(k), row.chunk, _small(np.diff(pairs[s], prepend=0)), _small(counts[s])))
                yield pd.DataFrame(out, columns=["group", "bucket", "sender", "pairs", "counts"])

    def up(rows: pd.DataFrame) -> pd.DataFrame:
        _, distinct, sums = _added(rows)
        return pd.DataFrame({"bucket": rows.bucket.iloc[:1], "sender": rows.group.iloc[:1].astype("int64"), "pairs": [_small(np.diff(distinct, prepend=0))], "counts": [_small(sums)]})

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        pairs, distinct, sums = _added(rows)
        start = np.flatnonzero(np.diff(distinct >> _BITS, prepend=-1))
        best = sums == np.repeat(np.maximum.reduceat(sums, start), np.diff(np.append(start, len(sums))))
        out = [(sender, bucket, _small(sums[at := np.searchsorted(distinct, own)]), _small(best[at])) for sender, bucket, own in zip(rows.sender, rows.bucket, pairs, strict=True)]
        return pd.DataFrame(out, columns=["chunk", "bucket", "counts", "best"])

    def down(asked: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"chunk": [], "bucket": [], "counts": [], "best": []})
        pairs, distinct, _ = _added(asked)
        counts, best = _large(found.counts.iloc[0]), _large(found.best.iloc[0])
        out = [(sender, bucket, _small(counts[at := np.searchsorted(distinct, own)]), _small(best[at])) for sender, bucket, own in zip(asked.sender, asked.bucket, pairs, strict=True)]
        return pd.DataFrame(out, columns=["chunk", "bucket", "counts", "best"])

    asked = parts.where("n_pairs > 0").select("chunk", "pairs", "counts", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int").alias("group")).mapInPandas(ask, f"group int, {_COUNTED}")
    if groups == 1:
        return stored(asked.groupBy("bucket").applyInPandas(answer, _ANSWER), "pair-counts")
    asked = stored(asked, "pairs-asked")
    sums = stored(asked.groupBy("group", "bucket").applyInPandas(up, _COUNTED), "pair-sums")
    found = sums.groupBy("bucket").applyInPandas(answer, _ANSWER).withColumnRenamed("chunk", "group").withColumn("group", F.col("group").cast("int"))
    out = stored(asked.groupBy("group", "bucket").cogroup(found.groupBy("group", "bucket")).applyInPandas(down, _ANSWER), "pair-counts")
    dropped(asked)
    dropped(sums)
    return out


_RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(docs: DataFrame, chunk: int = CHUNK, fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """Of each row of docs (doc_id, text): tokens of both sides, groups, links, and how frequent the linked pairs are in all of docs.

    Null and empty texts, and texts whose tokens' bytes are not the text's, have no tokens: zeros and an empty digest. Rows that repeat a
    doc_id are aligned and counted each; doc_id is cast to long; other columns are not looked at. Ties for a B id's most frequent
    pair all count as best.
    """
    parts = chunks(docs, chunk, block)
    n, pairs = parts.agg(F.count("*"), F.sum("n_pairs")).first()
    groups = max(1, -(-n // fan))
    buckets = min(1 << _BITS, max(-(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // groups), (pairs or 0) // groups // BUCKET + 1))
    answers = pair_counts(parts, buckets, groups)

    def result(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("bucket")
        counts, best = (np.concatenate([_large(x) for x in found[c]]) if len(found) else np.zeros(0, np.int64) for c in ("counts", "best"))
        out = []
        for r in rows.itertuples():
            if len(counts) != r.n_pairs:
                raise ValueError(f"chunk {r.chunk}: {len(counts)} answers for {r.n_pairs} pairs")
            place, times, doc = np.cumsum(_large(r.place)), _large(r.times), np.repeat(np.arange(len(r.entries)), r.entries)
            sums = np.zeros((2, len(r.entries)), np.int64)
            np.add.at(sums[0], doc, times * best[place])
            np.add.at(sums[1], doc, times * counts[place])
            out.append(pd.DataFrame({"doc_id": pd.array(r.doc_ids, "Int64"), "n_a": r.n_a, "n_b": r.n_b, "n_groups": r.n_groups, "n_links": r.n_links, "n_best": sums[0], "count_sum": sums[1], "groups_sha256": r.digests}))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in _RESULT.split(", ")})

    asking = parts.drop("pairs", "counts").groupBy("chunk")
    return asking.cogroup(answers.groupBy("chunk")).applyInPandas(result, _RESULT)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
