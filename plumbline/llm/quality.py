"""Quality rules: counts within a text, and lines that too many documents of one host share (operator 7).

Lines are hashed in a normal form and counted by host. A candidate is a line of more than MIN_DOCS distinct documents of a host (exact
copies are one document). Copies with changes share most of their lines too, and these are no boilerplate; so a document that has
candidates votes only if it has a text of its own. Words are a document's own if their line is neither a candidate nor a variant of one:
a line is a variant if at least MATCHES of its four anchors (its first, its last and the words around its smallest and its largest
word) are anchors of candidates. A document votes with at least OWN_WORDS such words, when they are at least half of what is no candidate.
How large a share of it is candidates does not matter. A line is common if more than MIN_DOCS documents vote for it, whatever the
size of the host. Common lines are removed, and a document of which too little is left is depleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import fresh, stored, text_blocks
from plumbline.llm.hashing import mix, shingle_hashes, word_hashes

_BLANK = b" \t\n\r\x0b\x0c"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_WORD_START = np.array([(c & 0xC0) != 0x80 and c not in _BLANK for c in range(256)])

#: A line is common on a host if more than this many documents vote for it.
MIN_DOCS = 10
#: A document votes with at least so many words of its own; a line is a variant if at least so many of its anchors are those of candidates.
OWN_WORDS, MATCHES = 20, 2
#: A document is depleted when less than this share of its words is outside common lines.
MIN_LEFT = 0.3

_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content binary, lines array<long>, line_words array<int>, anchors array<int>"


def _key(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def line_key(line: bytes) -> int:
    """Signed 64-bit hash of a line with A-Z folded and each run of white space made one space."""
    return _key(line.translate(_LOWER).split())


def line_anchors(words: list[bytes]) -> list[int]:
    """Signed 32-bit hashes of three words each: the first, the last, and those around the smallest and around the largest word."""
    low, high = words.index(min(words)), words.index(max(words))
    parts = words[:3], words[-3:], words[max(0, low - 1) : low + 2], words[max(0, high - 1) : high + 2]
    return [xxhash.xxh32_intdigest(b" ".join(p)) - (1 << 31) for p in parts]


def _repeated(words: np.ndarray, at: np.ndarray, width: int = 3) -> np.ndarray:
    """Per text, the words inside a window of ``width`` words that occurs at least twice in this text."""
    windows = shingle_hashes(words, width)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    own = text[: len(windows)] == text[width - 1 :]
    place = np.flatnonzero(own)
    key = windows[place] ^ mix(text[place].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(place), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(words) + 1, bool)
    for k in range(width):
        hit[place[twice] + k] = True
    sums = np.concatenate([[0], np.cumsum(hit[:-1])])
    return sums[at[1:]] - sums[at[:-1]]


def _stats(texts: list[bytes | None]) -> list[pa.Array]:
    words, at = word_hashes(texts, lower=False)
    repeat = _repeated(words, at)
    chars, symbols, dup, content, lines, counts, anchors = [], [], [], [], [], [], []
    for t in (t or b"" for t in texts):
        data = np.frombuffer(t, np.uint8)
        chars.append(int(np.count_nonzero(_WORD_START[data])))
        symbols.append(int(np.count_nonzero(_SYMBOL[data])))
        content.append(xxhash.xxh3_128_digest(t))
        seen, found, marks, again = set(), {}, [], 0
        for line in t.split(b"\n"):
            if own := line.translate(_LOWER).split():
                again += line in seen
                seen.add(line)
                key = _key(own)
                if key not in found:
                    marks += line_anchors(own)
                found[key] = found.get(key, 0) + len(own)
        anchors.append(marks)
        dup.append(again)
        lines.append(list(found))
        counts.append(list(found.values()))
    long = pa.int64()
    return [pa.array(np.diff(at), long), pa.array(chars, long), pa.array(symbols, long), pa.array(dup, long), pa.array(repeat, long), pa.array(content, pa.binary()), pa.array(lines, pa.list_(long)), pa.array(counts, pa.list_(pa.int32())), pa.array(anchors, pa.list_(pa.int32()))]


def text_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of docs beside counts, a content hash, and the distinct normalised lines (with their words) of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keep, *(x.split()[0] for x in _STATS.split(", "))]
        for batch, texts in text_blocks(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *_stats(texts)], names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*keep, "text").mapInArrow(run, f"{kept}, {_STATS}")


def common_lines(each: DataFrame, min_docs: int = MIN_DOCS, own_words: int = OWN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(host, content, n_words, line, words) of the candidates' occurrences, and (host, line) of the common lines among them.

    each: (host, content, n_words, line, words, anchors), a row a distinct line of a distinct text of a host.
    """
    candidates = stored(each.groupBy("host", "line").agg(F.count("*").alias("n"), F.first("anchors").alias("anchors")).where(F.col("n") > min_docs).select("host", "line", "anchors"), "candidates")
    held = stored(each.drop("anchors").join(candidates.drop("anchors"), ["host", "line"]), "candidate-lines")
    # the planner broadcasts the marks of candidates while their table is small, and shuffles the other lines beyond that
    marks = stored(candidates.select("host", F.posexplode("anchors").alias("kind", "mark")).distinct(), "candidate-marks")
    holders = held.select("host", "content").distinct()
    others = each.join(candidates, ["host", "line"], "left_anti").join(holders, ["host", "content"], "left_semi").select("host", "content", "line", "words", F.posexplode("anchors").alias("kind", "mark"))
    variants = others.join(marks, ["host", "kind", "mark"]).groupBy("host", "content", "line").agg(F.count("*").alias("n"), F.first("words").alias("words")).where(F.col("n") >= MATCHES)
    alike = variants.groupBy("host", "content").agg(F.sum("words").alias("alike"))
    rest = F.col("n_words") - F.col("words")
    own = rest - F.coalesce("alike", F.lit(0))
    voters = held.groupBy("host", "content").agg(F.sum("words").alias("words"), F.first("n_words").alias("n_words")).join(alike, ["host", "content"], "left").where((own >= own_words) & (2 * own >= rest)).select("host", "content")
    return held, held.join(voters, ["host", "content"]).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs).select("host", "line")


def verdicts(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, own_words: int = OWN_WORDS, min_left: float = MIN_LEFT) -> DataFrame:
    """Per row of docs: doc_id, the counts, removed_lines (hashes), removed_words, base_failed, depleted and kept.

    Counts are partial before each shuffle, and a line of very many documents meets one row, so AQE can split it. Nulls and empty
    texts have no words and fail the base rule; a null host is a host of its own; rows that repeat a doc_id are each judged and all returned.
    """
    stats = stored(text_stats(docs.select(F.col("doc_id"), F.coalesce(F.col(host).cast("string"), F.lit("\0")).alias("host"), "text"), ["doc_id", "host"]), "line-stats")
    texts = stats.where("size(lines) > 0").groupBy("host", "content").agg(F.first("n_words").alias("n_words"), F.first(F.struct("lines", "line_words", "anchors")).alias("x"))  # equal within a group
    lines = texts.select("host", "content", "n_words", "x.line_words", "x.anchors", F.posexplode("x.lines").alias("k", "line"))
    each = stored(lines.select("host", "content", "n_words", "line", F.get("line_words", "k").alias("words"), F.slice("anchors", 4 * F.col("k") + 1, F.lit(4)).alias("anchors")), "text-lines")
    held, common = common_lines(each, min_docs, own_words)
    lost = held.join(common, ["host", "line"]).groupBy("host", "content").agg(F.collect_list("line").alias("removed_lines"), F.sum("words").cast("long").alias("removed_words"))
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    return (
        stats.drop("lines", "line_words", "anchors")
        .join(lost, ["host", "content"], "left")
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            F.coalesce("removed_lines", F.array().cast("array<bigint>")).alias("removed_lines"),
            F.coalesce("removed_words", F.lit(0)).cast("long").alias("removed_words"),
            ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
            (left < min_left * F.col("n_words")).alias("depleted"),
        )
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    )


def without_lines(docs: DataFrame, removed: str = "removed_lines") -> DataFrame:
    """docs with the lines whose key is in the array column ``removed`` taken out of ``text``; that column is dropped."""
    names = [c for c in docs.columns if c != removed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_blocks(batches):
            gone = map(set, batch.column(removed).to_pylist())
            out = [t if not g or t is None else b"\n".join(x for x in t.split(b"\n") if not x.split() or line_key(x) not in g) for t, g in zip(texts, gone, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string()) if c == "text" else batch.column(c) for c in names], names)

    return docs.mapInArrow(run, docs.select(*names).schema)


def filtered(docs: DataFrame, **limits: float) -> DataFrame:
    """The rows of docs that pass, with the common lines removed from their texts; n_chars, where it exists, follows.

    Rows that repeat a doc_id pass together if one of them does; null ids count as one id.
    """
    key, gone = fresh(docs, "id"), fresh(docs, "removed")
    verdict = verdicts(docs, **limits).where("kept").groupBy(F.col("doc_id").alias(key)).agg(F.array_distinct(F.flatten(F.collect_list("removed_lines"))).alias(gone))
    out = without_lines(docs.join(verdict, docs["doc_id"].eqNullSafe(F.col(key))).select(*docs.columns, gone), gone)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")


#: The same in DuckDB's SQL, with the limits above.
OP7_SQL = rf"""
with d as (select row_number() over () as row, doc_id, coalesce(source, chr(0)) as host, coalesce(text, '') as t from documents),
w as (select row, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from d),
n as (select row, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars from w),
x as (select row, unnest(range(1, len(w) - 1)) as i, w from w where len(w) > 2),
y as (select row, i, count(*) over (partition by row, w[i], w[i + 1], w[i + 2]) as c from x),
r as (select row, count(distinct p) as n_repeat_words from (select row, unnest([i, i + 1, i + 2]) as p from y where c > 1) group by 1),
l0 as (select row, host, t, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as o from d),
l as (select *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as lw from l0),
dup as (select row, count(*) as n_dup_lines from (select row, row_number() over (partition by row, line order by o) as k from l where len(lw) > 0) where k > 1 group by 1),
k as (select row, host, t, array_to_string(lw, ' ') as line, any_value(lw) as lw, sum(len(lw)) as words from l where len(lw) > 0 group by row, host, t, array_to_string(lw, ' ')),
each as (select t, host, line, any_value(lw) as lw, any_value(words) as words from k group by t, host, line),
mark as (select t, host, line, words, unnest([0, 1, 2, 3]) as kind, unnest([lw[1:3], lw[greatest(1, len(lw) - 2):],
  lw[greatest(1, list_position(lw, list_min(lw)) - 1):list_position(lw, list_min(lw)) + 1],
  lw[greatest(1, list_position(lw, list_max(lw)) - 1):list_position(lw, list_max(lw)) + 1]]) as mark from each),
candidate as (select host, line from each group by all having count(*) > {MIN_DOCS}),
held as (select t, host, line, words from each join candidate using (host, line)),
holder as (select t, host, sum(words) as words from held group by all),
known as (select distinct host, kind, mark from mark join candidate using (host, line)),
variant as (select t, host, line, any_value(mark.words) as words from mark join holder using (t, host) join known using (host, kind, mark)
  where not exists (from candidate c where c.host = mark.host and c.line = mark.line) group by all having count(*) >= {MATCHES}),
alike as (select t, host, sum(words) as alike from variant group by all),
size as (select t, host, sum(words) as n from each group by all),
voters as (select t, host from holder join size using (t, host) left join alike using (t, host)
  where n - words - coalesce(alike, 0) >= {OWN_WORDS} and 2 * (n - words - coalesce(alike, 0)) >= n - words),
common as (select host, line from held join voters using (t, host) group by all having count(*) > {MIN_DOCS}),
lost as (select row, sum(words)::bigint as removed_words from k join common using (host, line) group by 1),
a as (select doc_id, n_words, word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
  coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(removed_words, 0) as removed_words
  from d join n using (row) left join r using (row) left join dup using (row) left join lost using (row))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not (n_words - removed_words < {MIN_LEFT}::double * n_words) as kept from a
"""
