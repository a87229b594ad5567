"""Spelling variant grouping: words one edit apart by PartEnum signatures of their letters (operator 12).

A word's letters are a multiset, that is a binary vector with a dimension for each (letter, how many-th). One inserted, deleted or
replaced code point changes at most two of its dimensions. The dimensions are cut into PARTS parts by their letters; two vectors at
distance at most two agree in at least PARTS - 2 parts, so one of the enumerated sets of PARTS - 2 parts is equal in both. A
signature is such a set of parts with their letters and an anchor: one edit leaves the first or the last few letters of a word
alone, so each set is taken once with the beginning and once with the end. Signatures are exact: equal ones are joined, and
what the join brings together is verified by edit distance. No pair is missed, whatever the words are.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import dropped, stored

#: Runs of letters in a text; only A-Z are lower-cased.
ALPHABET = "A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters are dealt to parts in this order, by how common they are in English, so that parts hold about as much; others by code point.
_COMMON = "etaoinshrdlcumwfgypbvkjxqz"
MIN_LENGTH, MIN_COUNT, DELETE_EVERY, FORM_FACTOR = 7, 2, 31, 10
PARTS = 5


def _part(letter: str) -> int:
    return (_COMMON.index(letter) if letter in _COMMON else ord(letter)) % PARTS


def runs(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, run): every maximal run of at least min_length letters of every text, lower-cased in A-Z. Null texts have none."""
    found = F.regexp_extract_all("text", F.lit(f"([{ALPHABET}]{{{min_length},}})"), 1)
    return docs.select("doc_id", F.explode(found).alias("run")).select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))


def noised(found: DataFrame, every: int = DELETE_EVERY) -> DataFrame:
    """(word): each run; where the crc32 h of ``doc_id:run`` is divisible by ``every``, without its code point h % length. A null id is
    the empty text."""
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "run").cast("binary"))
    cut = found.select("run", h.alias("h"))
    return cut.select(F.when(F.col("h") % every == 0, F.overlay("run", F.lit(""), (F.col("h") % F.length("run")).cast("int") + 1, F.lit(1))).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): the words that are long and frequent enough. Counts are partial before the shuffle."""
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def signed(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n, signature): the signatures of each word. Words have letters of ALPHABET only, in at least min_length code points.

    An edit at place p leaves the first p code points alone: the first a of them if p >= a, else at least the last
    min_length - a.
    """
    letters = [*_UPPER, *_LOWER, *(chr(c) for c in range(0xC0, 0x100))]
    a = (min_length - 1) // 2
    ordered = words.select("word", "n", F.array_join(F.array_sort(F.split("word", "")), "").alias("letters"))
    parts = ordered.select("word", "n", *(F.translate("letters", "".join(x for x in letters if _part(x) != k), "").alias(f"p{k}") for k in range(PARTS)))
    sets = [F.xxhash64(F.lit(i), *(f"p{k}" for k in kept)) for i, kept in enumerate(combinations(range(PARTS), PARTS - 2))]
    hashed = parts.select("word", "n", F.xxhash64(F.lit(0), F.substring("word", 1, a)).alias("first"), F.xxhash64(F.lit(1), F.substring("word", a - min_length, min_length - a)).alias("last"), F.explode(F.array(*sets)).alias("own"))
    return hashed.select("word", "n", F.explode(F.array(F.xxhash64("own", "first"), F.xxhash64("own", "last"))).alias("signature"))


def near_pairs(words: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n, other, other_n), both ways round: words that differ by exactly one inserted, deleted or replaced code point.

    Rows that meet in a signature are verified at once. A signature that many words share is a skewed key of an equi-join, which can
    be split; what is kept of it are verified pairs only.
    """
    rows = stored(signed(words, min_length), "word-signatures")
    a, b = (rows.select("signature", F.col("word").alias(f"{k}_word"), F.col("n").alias(f"{k}_n")) for k in "ab")
    close = (F.col("a_word") < F.col("b_word")) & (F.levenshtein("a_word", "b_word", 1) == 1)
    pairs = stored(a.join(b, "signature").where(close).select("a_word", "a_n", "b_word", "b_n").distinct(), "near-words")
    dropped(rows)
    names = ["word", "n", "other", "other_n"]
    return pairs.toDF(*names).union(pairs.select("b_word", "b_n", "a_word", "a_n").toDF(*names))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): from each word of (word, form), forms followed to the last. A form is much more frequent than its word, so there are
    no rings; each round doubles how far a word has been followed."""
    now = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "word-roots")
    while now.where("moved").limit(1).count():
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        step = now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        old, now = now, stored(step, "word-roots")
        dropped(old)
    return now.select("word", "root")


def grouped(words: DataFrame, factor: int = FORM_FACTOR, min_length: int = MIN_LENGTH) -> DataFrame:
    """word, form, root, n, n_near and form_n of each row of words (word, n).

    The form of a word is its near word of largest n, the first in code-point order among equals, if its n is at least
    ``factor`` times the word's; else null. The root is the last form, or the word itself.
    """
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best")
    near = near_pairs(words, min_length).groupBy("word", "n").agg(F.count("*").alias("n_near"), best)
    formed = -F.col("best.less") >= factor * F.col("n")
    near = stored(near.select("word", "n_near", F.when(formed, F.col("best.other")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")), "word-forms")
    out = words.join(near, "word", "left").join(roots(near.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("form_n").cast("long").alias("form_n"))


def variants(docs: DataFrame, every: int = DELETE_EVERY, factor: int = FORM_FACTOR, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """The words of all texts of docs (doc_id, text), grouped with their spelling variants; see noised, counted and grouped.

    Nulls and empty texts have no words; rows that repeat a doc_id are each counted; other columns are not looked at; an empty table, or
    one without words, gives no rows.
    """
    return grouped(counted(noised(runs(docs, min_length), every), min_length, min_count), factor, min_length)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The same in DuckDB's SQL: crc32 by its definition, near words by what is left of a word without or with a wildcard for one code point.
OP12_SQL = rf"""
with t as (select coalesce(doc_id::varchar, '') as doc, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as r from documents),
r as (select doc, translate(r, '{_UPPER}', '{_LOWER}') as r from t where length(r) >= {MIN_LENGTH}),
x as (select doc, r, count(*) as times, hex(encode(doc || ':' || r)) as x from r group by all),
b as (select *, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::int, 2))::bigint) as b from x),
h as (select r, times, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, y:
  list_reduce(list_prepend(xor(c, y), range(8)), lambda z, _: case when z & 1 = 1 then xor(z >> 1, 3988292384) else z >> 1 end))) as h from b),
w as (select case when h % {DELETE_EVERY} = 0 then left(r, (h % length(r))::int) || substr(r, (h % length(r))::int + 2) else r end as word, times from h),
n as (select word, sum(times)::bigint as n from w where length(word) >= {MIN_LENGTH} group by 1 having sum(times) >= {MIN_COUNT}),
c as (select word, n, unnest(range(1, length(word) + 1))::int as i from n),
d as (select word, n, i, left(word, i - 1) || substr(word, i + 1) as cut from c),
near as (select a.word, a.n, b.word as other, b.n as other_n from d a join d b on a.cut = b.cut and a.i = b.i and a.word <> b.word
  union select a.word, a.n, b.word, b.n from d a join n b on a.cut = b.word
  union select b.word, b.n, a.word, a.n from d a join n b on a.cut = b.word),
f0 as (select word, n, other, other_n, row_number() over (partition by word order by other_n desc, other) as k, count(*) over (partition by word) as n_near from near),
f as (select n.word, n.n, coalesce(n_near, 0) as n_near, case when other_n >= {FORM_FACTOR} * n.n then other end as form, case when other_n >= {FORM_FACTOR} * n.n then other_n end as form_n
  from n left join f0 on n.word = f0.word and k = 1),
roots as (select f1.word, coalesce(f5.form, f4.form, f3.form, f2.form, f1.form, f1.word) as root from f f1 left join f f2 on f1.form = f2.word left join f f3 on f2.form = f3.word
  left join f f4 on f3.form = f4.word left join f f5 on f4.form = f5.word)
select word, form, root, n, n_near, form_n from f join roots using (word)
"""
