"""Cross-tokenizer alignment against plain Python on whole texts, and on odd rows."""

import collections
import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import alignment as A

PARTS = ["a", "b", "the", "x'", "'s", "'S", " ", "  ", "\n", "\t", "\r\n", " ", "　", "é", "ß", "×", "你", "好", "😀", "‍", "́", "<s>", "<|endoftext|>", "<0x41>", "▁", "12", "3", "...", "!!", "\x00", "\x85", "﻿", "ａ", "ﬁ", "İ", " ", "_", "-", "Straße", "naïve"]


@pytest.fixture(scope="module")
def libraries():
    return A.encoder()


def texts(n, most, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, most))) for _ in range(n)]


def whole(e, text):
    """Ids and byte ends of both libraries over the whole text; None if a side's bytes are not the text's."""
    out = []
    for ids, table in ((e.a.encode(" " + text, add_special_tokens=False).ids, e.a_bytes), (e.b.encode(text), e.b_bytes)):
        if b"".join(table[i] for i in ids) != (" " + text).encode():
            return None
        out.append((ids, np.cumsum([len(table[i]) for i in ids]).tolist()))
    return out


def plain(e, rows):
    """What aligned() gives, by walking both sides' ends."""
    links, found = collections.Counter(), []
    for doc, text in rows:
        both = whole(e, text) if text else None
        if both is None:
            found.append((doc, None))
            continue
        (a, a_end), (b, b_end) = both
        i = j = 0
        own, groups, ga, gb = [], [], [], []
        while i < len(a):
            own.append((a[i], b[j]))
            x, y = a_end[i], b_end[j]
            if x <= y:
                ga.append(a[i])
                i += 1
            if y <= x:
                gb.append(b[j])
                j += 1
            if x == y:
                groups.append(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)))
                ga, gb = [], []
        links.update(own)
        found.append((doc, (len(a), len(b), groups, own)))
    best = collections.Counter()
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    out = []
    for doc, x in found:
        if x is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((doc, x[0], x[1], len(x[2]), len(x[3]), sum(links[p] == best[p[1]] for p in x[3]), sum(links[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()))
    return out


def test_words_are_cut_where_no_token_crosses(libraries):
    """Words encoded apart, and joined with others, give the ids and ends of whole texts."""
    n = 0
    for text in texts(4000, 14):
        parts = A.words(" " + text)
        assert "".join(parts) == " " + text
        packed, want = libraries.of(parts), whole(libraries, text)
        assert (None in packed) == (want is None), text
        if want is None:
            continue
        ids, ends, at = ([], []), ([], []), 0
        for word, x in zip(parts, packed, strict=True):
            y = np.frombuffer(x, np.int32).tolist()
            na, nb, y = y[0], y[1], y[2:]
            ids[0].extend(y[:na])
            ends[0].extend(at + k for k in y[na : 2 * na])
            ids[1].extend(y[2 * na : 2 * na + nb])
            ends[1].extend(at + k for k in y[2 * na + nb :])
            at += len(word.encode())
        assert list(zip(ids, ends, strict=True)) == [(list(i), list(e)) for i, e in want], text
        n += 1
    assert n > 3000


def test_spans_inside_characters(libraries):
    """Coarse spans end inside no character; decoded bytes do, on both sides."""
    (x,) = libraries.of([" 😀ａ"])
    y = np.frombuffer(x, np.int32).tolist()
    a, b = y[2 + y[0] : 2 + 2 * y[0]], y[2 + 2 * y[0] + y[1] :]
    assert a[-1] == b[-1] == 8 and set(a) - {1, 5, 8} and set(b) - {1, 5, 8}


@pytest.mark.parametrize("sizes", [{}, {"fan": 2, "chunk": 500, "block": 300}])
def test_against_plain_python(spark, libraries, sizes):
    """Also with chunks of some texts in groups of two, where counts go through both levels, and with texts of several blocks."""
    rows = list(enumerate(texts(120, 60, 7))) + [(0, "again the same id"), (None, "no id"), (900, None), (901, ""), (902, "word " * 900), (903, "▁"), (904, "x" * 3000), (905, " \n\t ")]
    df = spark.createDataFrame([(d, t, "n", 1) for d, t in rows], "doc_id long, text string, pairs string, chunk int").repartition(3)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted((tuple(r) for r in A.aligned(df, **sizes).collect()), key=key)
    assert got == sorted(plain(libraries, rows), key=key)


def test_slices(libraries):
    text = " " + "Über weite words\n and more. " * 60
    parts = list(A.slices(text, 100))
    assert "".join(parts) == text and len(parts) > 10 and [w for p in parts for w in A.words(p)] == A.words(text)


def test_empty(spark, none):
    out = A.aligned(none)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"] and out.count() == 0
