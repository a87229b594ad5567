"""Spelling variants against plain Python, with all pairs compared."""

import collections
import random
import re
import zlib

import pytest

from plumbline.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    """Whether b is a with exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else len(b) - len(a) == 1 and a[k:] == b[k + 1 :])


def plain(rows, every=31, factor=10):
    n = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    words = sorted(w for w, k in n.items() if len(w) >= 7 and k >= 2)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in words}


def spelled(seed, n=40):
    """Texts of words that differ by an edit or two, by the order of their letters, and by case; frequencies over four orders."""
    rng = random.Random(seed)
    letters = "abcdeöüßÉñ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 11))) for _ in range(8)] + ["aaaaaaa", "aaaaaaaa", "abababab", "babababa", "ÉÉÉÉÉÉÉ", "ééééééé"]
    every = []
    for w in base:
        for _ in range(9):
            x = list(w)
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                k = rng.randrange(len(x))
                kind = rng.randrange(4)
                if kind == 0:
                    x[k] = rng.choice(letters)
                elif kind == 1:
                    x.insert(k, rng.choice(letters))
                elif kind == 2 and len(x) > 7:
                    del x[k]
                else:
                    x[0], x[k] = x[k], x[0]
            every += ["".join(x)] * rng.choice([1, 2, 3, 25, 300])
    rng.shuffle(every)
    cut = -(-len(every) // n)
    return [(k, " ".join(w.upper() if rng.random() < 0.05 else w for w in every[k * cut : (k + 1) * cut])) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_plain_python(spark, seed):
    rows = spelled(seed)
    rows += [rows[0], (None, rows[1][1]), (900, None), (901, ""), (902, "short, UPPERCASE×sign÷more 1234567 _______ under_scored"), (903, "longword" * 4000), (904, "longword" * 4000)]
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in S.variants(df).collect()}
    want = plain(rows)
    assert got == want
    assert sum(f is not None for f, *_ in want.values()) > 5


def test_roots_follow_forms_to_the_last(spark):
    """A chain of seven forms, each ten times as frequent as the one before, and a branch."""
    chain = ["abcdefg", "abcdefx", "abcdeyx", "abcdzyx", "abcwzyx", "abvwzyx", "auvwzyx"]
    words = spark.createDataFrame([(w, 10**k) for k, w in enumerate(chain)] + [("abcdefgh", 1), ("nothing", 5)], "word string, n long")
    got = {r.word: (r.form, r.root) for r in S.grouped(words).collect()}
    assert all(got[a] == (b, chain[-1]) for a, b in zip(chain, chain[1:], strict=False))
    assert got[chain[-1]] == (None, chain[-1]) and got["nothing"] == (None, "nothing") and got["abcdefgh"] == (None, "abcdefgh")


def test_every_pair_shares_a_signature(spark):
    """Words one edit apart have an equal signature, wherever the edit is, from the least length on."""
    rng, pairs = random.Random(5), []
    for k in range(3000):
        w = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzÀÿ") for _ in range(7 + k % 6))
        at, c = rng.randrange(len(w) + 1), rng.choice("abcxyzß")
        pairs.append((k, w, w[:at] + c + w[at + (k % 2 and at < len(w)) :]))
    df = spark.createDataFrame(pairs, "k int, a string, b string")
    signed = lambda c: S.signed(df.selectExpr(f"concat({c}, '') as word", "cast(k as long) as n"))
    both = signed("a").select("n", "signature").distinct().join(signed("b").select("n", "signature"), ["n", "signature"]).select("n").distinct()
    assert both.count() == sum(len(a) >= 7 and len(b) >= 7 for _, a, b in pairs)


def test_odd_and_empty(spark, odd, none):
    assert S.variants(none).count() == 0
    out = S.variants(odd)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r.word: r.n for r in out.collect()} == {w: x[2] for w, x in plain([(r.doc_id, r.text) for r in odd.collect()]).items()}
