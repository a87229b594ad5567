"""Vectorised 64-bit hashes of words and word n-grams over whole Arrow or pandas batches.

The words of a text are its runs of bytes other than space and 0x09-0x0D; upper-case A-Z are folded to lower case first.
A batch is hashed as one byte array, so there is no Python loop over words: each byte gets a 64-bit value, values are
weighted by powers of an odd base, and a word's hash is the difference of two prefix sums, brought back to position 0
by the inverse power and mixed with its length. Sets are compared by these hashes; within one pair of texts two different
shingles meet with probability below n*n / 2**64.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 16

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift, multiply), so that all bits of the result depend on all bits of x."""
    x = x.astype(_U, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0x632BE59BD9B4E019 & 0xFFFFFFFF))
with np.errstate(over="ignore"):
    _POW = np.concatenate([[_U(1)], np.cumprod(np.full(_BLOCK - 1, _BASE, dtype=_U))])
    _INV = np.concatenate([[_U(1)], np.cumprod(np.full(_BLOCK - 1, _INVERSE, dtype=_U))])


def _powers(at: np.ndarray, table: np.ndarray, base: int) -> np.ndarray:
    """base ** at modulo 2**64, from a table of the low part and a short one of the high part."""
    high = (at >> 16).astype(np.int64)
    top = int(high.max(initial=0)) + 1
    step = pow(base, _BLOCK, 1 << 64)
    with np.errstate(over="ignore"):
        steps = np.concatenate([[_U(1)], np.cumprod(np.full(top - 1, step, dtype=_U))]) if top > 1 else np.ones(1, _U)
        return table[at & (_BLOCK - 1)] * steps[high]


_SEGMENT = 1 << 21


def _segment_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of one byte array."""
    edge = np.diff(np.concatenate([[1], _SPACE[data].view(np.int8), [1]]))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_BYTE[data] * _powers(np.arange(len(data)), _POW, _BASE), dtype=_U, out=sums[1:])
        return mix((sums[last] - sums[first]) * _powers(first, _INV, _INVERSE) + (last - first).astype(_U)), first, last


def word_hashes(texts: list[bytes | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a batch, in order, and the offsets (len(texts) + 1) of each text's words. Nulls have no words.

    The joined bytes are taken in segments of some MB, cut at spaces, so one very long text costs no more memory than many
    short ones (a hash does not depend on a word's place).
    """
    joined = b" ".join(t or b"" for t in texts)
    if lower:
        joined = joined.translate(_LOWER)
    ends = np.cumsum(np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts)))
    words, starts, at = [], [], 0
    while at < len(joined):
        stop = len(joined)
        if stop - at > _SEGMENT:
            cut = [x for x in (joined.find(b" ", at + _SEGMENT), joined.find(b"\n", at + _SEGMENT)) if x >= 0]
            stop = min(cut, default=stop)
        w, first, _ = _segment_words(np.frombuffer(joined, np.uint8, stop - at, at))
        words.append(w)
        starts.append(first + at)
        at = stop
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return np.concatenate(words) if words else np.zeros(0, _U), np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words of one array (positions 0 .. len - width)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    with np.errstate(over="ignore"):
        out = np.zeros(n, _U)
        for k in range(width):
            out = out * _U(_BASE) + words[k : k + n]
    return mix(out)


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text with 1 .. width-1 words has its whole sequence as its one shingle."""
    words, at = word_hashes(texts)
    every = shingle_hashes(words, width)
    out = []
    for s, e in zip(at[:-1], at[1:], strict=True):
        if e - s >= width:
            x = np.sort(every[s : e - width + 1])
            keep = np.ones(len(x), bool)
            keep[1:] = x[1:] != x[:-1]
            out.append(x[keep])
        elif e > s:
            out.append(shingle_hashes(words[s:e], int(e - s)) ^ _U(int(e - s)))
        else:
            out.append(np.zeros(0, _U))
    return out
