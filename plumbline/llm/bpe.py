"""BPE encoding and decoding: speculate by greedy longest match, verify adjacent pairs, merge only what fails (operator 6).

A word's tokens are what byte-pair merging gives exactly when each adjacent pair of them is: merging the two tokens' text
alone gives these two tokens again. So greedy longest-match proposals for a whole batch of words are made and checked as
arrays, and only words with an incompatible pair are merged step by step. Decoding gathers the tokens' texts from one byte array.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm.common import text_blocks
from plumbline.llm.hashing import _BASE, _INV, _INVERSE, _POW, _powers, mix

_U = np.uint64
_BYTE = mix(np.arange(1, 257, dtype=_U))
#: The end of a word, as a byte that UTF-8 never has.
_STOP = b"\xff"
#: Entries that a task keeps of words and of pairs; a full table is begun anew.
KEPT_WORDS, KEPT_PAIRS = 400_000, 2_000_000
#: Characters below are Latin letters, signs and ASCII, whose case and classes are settled and which do not compose with each other.
_LATIN_END = "\u0250"
_BREAK = re.compile(r"[ \t\n\r\x0b\x0c]+")


def _byte_of() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordBpe:
    """Encodes and decodes as the tokenizers library does with a file of lower-casing BPE with word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte_of = spec["model"], _byte_of()
        self.byte_of, self.library = byte_of, Tokenizer.from_file(path)
        end = model["end_of_word_suffix"]
        raw = lambda s: bytes(byte_of[c] for c in s.removesuffix(end)) + _STOP * s.endswith(end)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        text = {i: s.encode() + b" " for s, i in [*model["vocab"].items(), *self.special.items()]}
        each = [text.get(i, b"") for i in range(max(text) + 1)]
        self.text_at = np.concatenate([[0], np.cumsum([len(t) for t in each])])
        self.text = np.frombuffer(b"".join(each), np.uint8)
        self.id_of = {raw(s): i for s, i in model["vocab"].items() if s not in self.special}
        self.raw_of = {i: b for b, i in self.id_of.items()}
        self.rank = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[raw(a), raw(b)] = k
        keys = np.array([(self.id_of[a] << 20) | self.id_of[b] for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_key, self.never = keys[order], np.int64(1 << 40)
        self.pair_rank = np.array(list(self.rank.values()), np.int64)[order]
        self.pair_id = np.array([self.id_of[a + b] for a, b in self.rank], np.int64)[order]
        self.symbol = np.array([self.id_of.get(bytes([b]) + stop, -1) for stop in (b"", _STOP) for b in range(256)], np.int64)
        by_size: dict[int, list[bytes]] = {}
        for b in self.id_of:
            by_size.setdefault(len(b), []).append(b)
        self.sized = {}
        for size, tokens in sorted(by_size.items()):
            h = self._hash(np.frombuffer(b"".join(tokens), np.uint8).reshape(-1, size))
            order = np.argsort(h)
            self.sized[size] = (h[order], np.array([self.id_of[b] for b in tokens], np.int32)[order])
        self.word_pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.known = np.zeros(0, np.int64)
        self.fits = np.zeros(0, bool)
        self.clear()

    def clear(self) -> None:
        """Begins the tables of ids anew: of words (and special ids) and of stretches without white space."""
        self.word_ids: dict[str | int, bytes] = {i: np.array([i], "<u4").tobytes() for i in self.special.values()}
        self.part_ids: dict[str, bytes] = {}

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_BYTE[rows] * _POW[: rows.shape[1]]).sum(axis=1, dtype=_U)

    def merged(self, word: bytes) -> tuple[int, ...]:
        """Exact merging of one word's (or part's) bytes; a trailing _STOP belongs to the byte before it."""
        stop = word.endswith(_STOP)
        body = word[:-1] if stop else word
        parts = [body[i : i + 1] for i in range(len(body))]
        if stop and parts:
            parts[-1] += _STOP
        rank = self.rank
        while len(parts) > 1:
            ranks = [rank.get(p, 1 << 40) for p in zip(parts, parts[1:], strict=False)]
            low = min(ranks)
            if low == 1 << 40:
                break
            a, b = parts[(k := ranks.index(low))], parts[k + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return tuple(self.id_of[p] for p in parts)

    def merged_many(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """merged() of many: all short words as rows of a matrix, one merge (the lowest rank, leftmost) in each row at a time."""
        out: list = [None] * len(words)
        sizes = np.fromiter((len(w) - w.endswith(_STOP) for w in words), np.int64, len(words))
        for low, high in ((0, 8), (8, 16), (16, 48)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            for part in np.split(rows, range(20_000, len(rows), 20_000)):
                for r, ids in zip(part.tolist(), self._merged_rows([words[r] for r in part], high), strict=True):
                    out[r] = ids
        return [self.merged(w) if o is None else o for w, o in zip(words, out, strict=True)]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.where((a < 0) | (b < 0), np.int64(-1), (a << 20) | b)
        spot = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = self.pair_key[spot] == key
        return np.where(hit, self.pair_rank[spot], self.never), np.where(hit, self.pair_id[spot], -1)

    def _merged_rows(self, words: list[bytes], width: int) -> list[tuple[int, ...]]:
        symbols = np.full((len(words), width + 1), -1, np.int64)
        for r, w in enumerate(words):
            own = self.symbol[np.frombuffer(w.removesuffix(_STOP), np.uint8)]
            symbols[r, : len(own)] = own
            if w.endswith(_STOP):
                symbols[r, len(own) - 1] = self.symbol[256 + w[-2]]
        rank, into = self._ranks(symbols[:, :-1], symbols[:, 1:])
        rank, into = (np.concatenate([x, np.full((len(words), 1), fill)], axis=1) for x, fill in ((rank, self.never), (into, -1)))
        live, cols = np.arange(len(words)), np.arange(width + 1)
        while len(live):
            at = rank[live].argmin(axis=1)
            more = rank[live, at] < self.never
            live, at = live[more], at[more]
            if not len(live):
                break
            symbols[live, at] = into[live, at]
            move = np.minimum(cols + (cols > at[:, None]), width)  # what is right of the merged pair moves up by one
            for x, fill in ((symbols, -1), (rank, self.never), (into, -1)):
                y = np.take_along_axis(x[live], move, axis=1)
                y[:, -1] = fill
                x[live] = y
            for k in (at - 1, at):
                ok = (k >= 0) & (k < width)
                r, c = live[ok], k[ok]
                rank[r, c], into[r, c] = self._ranks(symbols[r, c], symbols[r, c + 1])
        count = (symbols >= 0).sum(axis=1).tolist()
        return [tuple(row[:n]) for row, n in zip(symbols.tolist(), count, strict=True)]

    def _compatible(self, pairs: np.ndarray) -> np.ndarray:
        """Per pair key (left << 32 | right) whether the two tokens stay apart; what is new is merged once and kept."""
        each, at = np.unique(pairs, return_inverse=True)
        spot = np.minimum(np.searchsorted(self.known, each), max(0, len(self.known) - 1))
        new = each[self.known[spot] != each] if len(self.known) else each
        if len(new):
            if len(self.known) > KEPT_PAIRS:
                self.known, self.fits, new = self.known[:0], self.fits[:0], each
            two = [(p >> 32, p & 0xFFFFFFFF) for p in new.tolist()]
            fits = [m == p for m, p in zip(self.merged_many([self.raw_of[a] + self.raw_of[b] for a, b in two]), two, strict=True)]
            known = np.concatenate([self.known, new])
            order = np.argsort(known)
            self.known, self.fits = known[order], np.concatenate([self.fits, np.array(fits, bool)])[order]
        return self.fits[np.searchsorted(self.known, each)][at]

    def proposed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest-match tokens of all words, flat; the word that each is of; the words that no token fits somewhere."""
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        end = np.repeat(ends, np.diff(ends, prepend=0))
        place = np.arange(len(data))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, _U)
            np.cumsum(_BYTE[data] * _powers(place, _POW, _BASE), dtype=_U, out=sums[1:])
        back = _powers(place, _INV, _INVERSE)
        size, token = np.zeros(len(data), np.int64), np.full(len(data), -1, np.int64)
        for n, (table, ids) in self.sized.items():  # from short to long: the longest that fits stays
            at = place[(place + n == end) | (place + n < end - 1)]  # never leaves a word's end alone
            with np.errstate(over="ignore"):
                h = (sums[at + n] - sums[at]) * back[at]
            spot = np.minimum(np.searchsorted(table, h), len(table) - 1)
            hit = table[spot] == h
            size[at[hit]], token[at[hit]] = n, ids[spot[hit]]
        now, word = ends - np.diff(ends, prepend=0), np.arange(len(words))
        tokens, of, stuck = [], [], []
        while len(word):
            none = size[now] == 0
            stuck.append(word[none])
            now, word = now[~none], word[~none]
            tokens.append(token[now])
            of.append(word)
            now = now + size[now]
            more = now < ends[word]
            now, word = now[more], word[more]
        tokens, of = np.concatenate(tokens), np.concatenate(of)
        order = np.argsort(of, kind="stable")
        return tokens[order], of[order], np.unique(np.concatenate(stuck)) if stuck else np.zeros(0, np.int64)

    def words(self, words: list[str]) -> None:
        """Encodes new words into the table."""
        raw = [w.encode() + _STOP for w in words]
        tokens, of, stuck = self.proposed(raw)
        bad = np.zeros(len(words), bool)
        bad[stuck] = True
        inside = np.flatnonzero(of[1:] == of[:-1])
        if len(inside):
            apart = self._compatible((tokens[inside] << 32) | tokens[inside + 1])
            bad[of[inside[~apart]]] = True
        cut = np.searchsorted(of, np.arange(len(words) + 1)).tolist()
        flat = tokens.astype("<u4").tobytes()
        for k in np.flatnonzero(~bad).tolist():
            self.word_ids[words[k]] = flat[4 * cut[k] : 4 * cut[k + 1]]
        failed = np.flatnonzero(bad).tolist()
        for k, ids in zip(failed, self.merged_many([raw[k] for k in failed]), strict=True):
            self.word_ids[words[k]] = array("I", ids).tobytes()

    def _split(self, part: str) -> list[str | int]:
        """Words and special ids of a stretch without ASCII white space."""
        out: list[str | int] = []
        for seg in self.special_pattern.split(part) if "<|" in part else [part]:
            if seg in self.special:
                out.append(self.special[seg])
            elif seg and max(seg) < _LATIN_END:
                out += self.word_pattern.findall(seg.lower())
            elif seg:  # normal forms, cases and classes of other characters depend on a version of Unicode: the library's decides
                plain = self.library.normalizer.normalize_str(seg)
                out += [bytes(self.byte_of[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        return out

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids (unsigned 32-bit, little-endian)."""
        parts = [_BREAK.split(t) for t in texts]
        if len(self.part_ids) > KEPT_WORDS or len(self.word_ids) > KEPT_WORDS:
            self.clear()
        new = set().union(*parts).difference(self.part_ids)
        split = {p: self._split(p) for p in new}
        if fresh := list({w for own in split.values() for w in own}.difference(self.word_ids)):
            self.words(fresh)
        word_ids, part_ids = self.word_ids, self.part_ids
        for p, own in split.items():
            part_ids[p] = word_ids[own[0]] if len(own) == 1 else b"".join([word_ids[w] for w in own])
        return [np.frombuffer(b"".join(map(part_ids.__getitem__, own)), "<u4") for own in parts]

    def decoded(self, ids: list[np.ndarray]) -> list[bytes]:
        """The texts of lists of ids, in UTF-8: the tokens with spaces between. Ids that are no token are left out."""
        flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
        flat = np.where((flat < 0) | (flat >= len(self.text_at) - 1), -1, flat)
        size = np.where(flat < 0, 0, self.text_at[flat + 1] - self.text_at[flat])
        ends = np.cumsum(size)
        out, at, cut = [], 0, np.cumsum([len(x) for x in ids])
        for stop in cut:
            # some MB of text at a time: an id's bytes are where its token's are
            for s in range(at, stop, 1 << 18):
                e = min(stop, s + (1 << 18))
                n = size[s:e]
                place = np.arange(n.sum()) + np.repeat(self.text_at[flat[s:e]] - (ends[s:e] - n - (ends[s - 1] if s else 0)), n)
                out.append(self.text[place].tobytes())
            at = stop
        # pieces of one text belong together; the last space is none
        pieces = iter(out)
        many = [-(-len(x) // (1 << 18)) for x in ids]
        return [b"".join([next(pieces) for _ in range(k)])[:-1] for k in many]


@lru_cache(maxsize=1)
def _coder(path: str) -> WordBpe:
    return WordBpe(path)


def encoded(docs: DataFrame, name: str = "word_bpe_49k.json", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """doc_id, n_tokens and the chosen outputs of each row: ids (array), decoded (text), ids_sha256, decoded_sha256.

    A null text is taken as empty: no ids, an empty decoded text. Rows that repeat a doc_id are each encoded. doc_id is cast to
    long (an id that is no number is an error).
    """
    kinds = {"ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    make = {"ids": lambda i, d: i.astype(np.int32), "decoded": lambda i, d: d.decode(), "ids_sha256": lambda i, d: hashlib.sha256(i.tobytes()).hexdigest(), "decoded_sha256": lambda i, d: hashlib.sha256(d).hexdigest()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(public_tokenizers.path(name))
        for batch, texts in text_blocks(batches):
            ids = coder.encoded([(t or b"").decode() for t in texts])
            back = coder.decoded(ids) if any(o.startswith("decoded") for o in outputs) else [b""] * len(ids)
            n, out = list(map(len, ids)), [[make[o](i, d) for i, d in zip(ids, back, strict=True)] for o in outputs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, kinds[o][1]) for x, o in zip(out, outputs, strict=True))], ["doc_id", "n_tokens", *outputs])

    schema = ", ".join(["doc_id long", "n_tokens long", *(f"{o} {kinds[o][0]}" for o in outputs)])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def decoded(rows: DataFrame, name: str = "word_bpe_49k.json", ids: str = "ids") -> DataFrame:
    """rows (doc_id, ids array<int>) with ``decoded``, the text of the ids, instead of them. Nulls and empty lists give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(public_tokenizers.path(name))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = coder.decoded([np.array([-1 if i is None else i for i in x or []], np.int64) for x in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "decoded"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), ids).mapInArrow(run, "doc_id long, decoded string")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), outputs=("ids_sha256", "decoded_sha256"))
