SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, host string, key string, score double, `at` long, token long"
_SENTENCE = "The quick brown fox jumps over the lazy dog while seven wizards boil tea near the old stone bridge and talk of rivers"
_LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
_TEXTS = [
    (1, _SENTENCE), (2, _SENTENCE), (3, _SENTENCE.upper()), (4, _SENTENCE + " today"), (5, ""), (6, None), (7, " \n\t "), (8, "one"), (9, "one two three"),
    (10, "one two three"), (11, _LONG), (12, _LONG + " end"), (13, "<|endoftext|> ünï çödé 日本語 </s>[INST] x"), (14, "x" * 5000), (15, "a b " * 200),
    (1, _SENTENCE), (None, _SENTENCE), (None, None), (16, "line one is here\nline one is here\n\nother"), (17, "\0 null byte \x1c sep"),
]
ODD = [(i, t, None if k % 5 == 0 else "en", None if k % 3 == 0 else f"src{k % 2}", None if t is None else len(t), 7, "h", "k", 0.5, 3, 4) for k, (i, t) in enumerate(_TEXTS)]
