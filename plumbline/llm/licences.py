"""License scans: a trained paragraph classifier with a calibrated unknown class and template comparison (operator 9).

DataFrame and SQL functions only; the fit is pyspark.ml's multinomial logistic regression over sparse word n-grams.

* Units. A paragraph is a run of lines with something in them; its lines are joined. A paragraph of several lines is scored as
  a whole and line by line, so both a notice wrapped over lines and one among other lines is found.
* Features are words and pairs of neighbours that have at least one licence word: a word of the notices, no English stop word,
  that is rare in the corpus' sampled lines which resemble no notice. A unit without any licence word has no feature, and the
  fit makes sure that this means the class ``none``: leaving such units out loses nothing.
* Training rows are whole notices, their sentences, and names of licences in sentences that all families (and names of no
  family, the class ``unknown``) share, so that only what names a family tells it from others. Sampled lines of the corpus, and
  licence words out of their order, stand for ``none``.
* Calibration rows are notices, sentences and other families' names that the fit did not see: they choose the temperature,
  and the least probability below which a family is ``unknown``.
* A family is confirmed if the unit has CONFIRMED of the words of one of its notices or names, each word weighing by how few
  families have it: boilerplate confirms nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import notices
from plumbline.llm.common import sampled, stored

NONE, UNKNOWN = "none", "unknown"
#: Documents and lines of the corpus that are sampled, lines of them that stand for ``none``, and the longest of these, at most.
SAMPLED_DOCS, SAMPLED_LINES, NONE_LINES, LINE_CHARS = 4_000, 8_000, 2_000, 2_000
#: A notice's word is a licence word if less than this share of the sampled lines that resemble no notice have it.
RARE = 0.002
CONFIRMED, RESEMBLES = 0.6, 0.6
#: Features at most; the grids that calibration chooses from.
VOCABULARY = 1 << 14
TEMPERATURES, THRESHOLDS = [0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0], [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def words(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits; a number keeps its decimals."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:\.\p{N}+)*"), F.lit(0))


def grams(w: Column) -> Column:
    """Distinct words and pairs of neighbours."""
    return F.array_distinct(F.concat(w, F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(F.get(w, i), F.lit(" "), x))))


def licence_grams(w: Column, licence_words: Column) -> Column:
    """The grams that have a licence word."""
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda i: (i <= F.size(w)) & F.array_contains(licence_words, F.get(w, i - 1)))
    one = F.transform(at, lambda i: F.get(w, i - 1))
    left = F.transform(F.filter(at, lambda i: i > 1), lambda i: F.concat(F.get(w, i - 2), F.lit(" "), F.get(w, i - 1)))
    right = F.transform(F.filter(at, lambda i: i < F.size(w)), lambda i: F.concat(F.get(w, i - 1), F.lit(" "), F.get(w, i)))
    return F.array_distinct(F.concat(one, left, right))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _array(xs: list[str]) -> Column:
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


@dataclass
class Classifier:
    """Weights by n-gram and class (a DataFrame: gram, weights), intercepts, temperature, the least probability of a family, the
    licence words, and the templates (a DataFrame: family, templates of words with their weights)."""

    weights: DataFrame
    classes: list[str]
    intercepts: list[float]
    temperature: float
    threshold: float
    licence_words: list[str]
    templates: DataFrame


def _given(frames: list[str], names: dict[str, list[str]], others: list[str], whole: dict[str, list[str]], other_notices: list[str]) -> list[tuple[str, str]]:
    """(label, text): names in sentences (those of one word not alone), notices and their sentences."""
    rows = [(label, f.format(n)) for label, own in [*names.items(), (UNKNOWN, others)] for n in own for f in frames if f != "{}" or not n.isalpha()]
    for label, own in [*whole.items(), (UNKNOWN, other_notices)]:
        for t in own:
            rows.append((label, t))
            parts = [p.strip() for p in t.replace(";", ".").split(". ") if len(p.split()) >= 8]
            rows += [(label, p) for p in parts if len(parts) > 1]
    return rows


def _texts(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "label string, t string").select("label", words("t").alias("w"))


def families() -> list[str]:
    return sorted(notices.NOTICES)


def templates(spark: SparkSession) -> DataFrame:
    """(family, templates): each of a family's names, notices and their sentences as its distinct words with their weights, which fall with the
    number of families that have the word; a word of all families weighs nothing."""
    named = [(f, n) for f, own in notices.NAMES.items() for n in own] + [("", n) for n in notices.OTHER_NAMES]
    given = named + [("" if f == UNKNOWN else f, t) for f, t in _given([], {}, [], notices.NOTICES, notices.OTHER_NOTICES)]
    each = _texts(spark, given).withColumn("i", F.monotonically_increasing_id()).select("label", "i", F.explode(F.array_distinct("w")).alias("word"))
    weight = each.groupBy("word").agg(F.countDistinct("label").alias("n")).withColumn("idf", F.log((1.0 + len(notices.NOTICES)) / F.col("n")))
    own = each.where("label <> ''").join(weight, "word").groupBy("label", "i").agg(F.array_sort(F.collect_list(F.struct("word", "idf"))).alias("t"))
    return own.groupBy(F.col("label").alias("family")).agg(F.collect_list("t").alias("templates"))


def likeness(texts: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """(key, family, likeness): for each row of texts (key, w) and each family that it shares a word with, the largest share, over
    the family's templates, of a template's weight whose words are in w. table: templates()."""
    each = table.select("family", F.posexplode("templates").alias("i", "t")).select("family", "i", F.explode("t").alias("x")).select("family", "i", "x.word", "x.idf").where("idf > 0")
    part = each.join(each.groupBy("family", "i").agg(F.sum("idf").alias("whole")), ["family", "i"]).select("family", "i", "word", (F.col("idf") / F.col("whole")).alias("part"))
    held = texts.select(*key, F.explode(F.array_distinct("w")).alias("word")).join(F.broadcast(part), "word")  # fixed notices' words
    return held.groupBy(*key, "family", "i").agg(F.sum("part").alias("part")).groupBy(*key, "family").agg(F.max("part").alias("likeness"))


def _background(docs: DataFrame) -> DataFrame:
    """(w) of sampled lines: those of SAMPLED_DOCS documents (ids first, so no text is sorted), the SAMPLED_LINES with the smallest
    hashes; lines longer than LINE_CHARS don't stand for lines."""
    ids = F.broadcast(sampled(docs.select("doc_id").where("doc_id is not null").distinct(), SAMPLED_DOCS, "doc_id"))  # at most SAMPLED_DOCS ids
    lines = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line").between(1, LINE_CHARS))
    return stored(sampled(lines.distinct(), SAMPLED_LINES, "line").select(words("line").alias("w")).where(F.size("w") > 0).distinct(), "licence-lines")


def fit(docs: DataFrame) -> Classifier:
    """Learns from the notices and a bounded sample of the corpus' lines (see the module's text)."""
    spark = docs.sparkSession
    train = _texts(spark, _given(notices.FRAMES, notices.NAMES, notices.OTHER_NAMES, notices.NOTICES, notices.OTHER_NOTICES))
    held = _texts(spark, _given(notices.HELD_FRAMES, notices.NAMES, notices.HELD_OTHER_NAMES, notices.HELD_NOTICES, notices.HELD_OTHER_NOTICES))
    table = stored(templates(spark), "licence-templates")
    background = _background(docs)
    # lines that resemble a notice are notices: they neither make its words common nor stand for ``none``
    background = background.withColumn("key", F.xxhash64("w"))
    notice = likeness(background, table, ["key"]).where(F.col("likeness") >= RESEMBLES).select("key").distinct()
    plain = stored(background.join(notice, "key", "left_anti").select("w"), "licence-plain-lines")
    n = max(1, plain.count())
    own = sorted({r.x for r in train.select(F.explode("w").alias("x")).distinct().collect()})
    common = {r.x for r in plain.select(F.explode(F.array_distinct("w")).alias("x")).where(F.col("x").isin(own)).groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") > RARE * n + 1).collect()}
    stop = set(StopWordsRemover.loadDefaultStopWords("english"))
    licence_words = [w for w in own if w not in common and w not in stop and len(w) > 1 and not w.replace(".", "").isdigit()]
    gate = _array(licence_words)
    # ``none``: sampled lines, those with licence words first; each licence word alone; licence words far apart in the alphabet
    lines = plain.select(F.lit(NONE).alias("label"), "w").orderBy(F.when(F.arrays_overlap("w", gate), 0).otherwise(1), F.xxhash64("w"), "w").limit(NONE_LINES)
    k = len(licence_words)
    loose = spark.createDataFrame([(NONE, [licence_words[i], *(["x", licence_words[(i * 7 + 3) % k]] if both else [])]) for i in range(k) for both in (False, True)], "label string, w array<string>")
    rows = train.union(lines).union(loose).select("label", licence_grams(F.col("w"), gate).alias("g")).where(F.size("g") > 0)
    rows = stored(rows.repartition(1), "licence-training")  # some thousand short rows, whatever the input
    counted = CountVectorizer(inputCol="g", outputCol="x", binary=True, vocabSize=VOCABULARY, minDF=2.0).fit(rows)
    classes = [NONE, UNKNOWN, *families()]
    index = F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate(classes) for x in (c, float(i)))), F.col("label"))
    share = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # a row a class
    even = F.element_at(F.create_map(*(F.lit(x) for c, m in share.items() for x in (c, ({NONE: 2.0, UNKNOWN: 4.0}.get(c, 1.0)) / m))), F.col("label"))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="even", family="multinomial", standardization=False, regParam=1e-5, maxIter=120).fit(counted.transform(rows).withColumn("y", index).withColumn("even", even))
    intercepts = [float(x) for x in model.interceptVector]
    matrix = model.coefficientMatrix.toArray()  # VOCABULARY n-grams by the classes: a table of bounded size
    weights = spark.createDataFrame([(g, [float(x) for x in matrix[:, i]]) for i, g in enumerate(counted.vocabulary)], "gram string, weights array<double>")
    raw = vector_to_array("rawPrediction")
    judged = stored(model.transform(counted.transform(held.select("label", licence_grams(F.col("w"), gate).alias("g"))).withColumn("y", index)).select(raw.alias("r"), F.col("y").cast("int").alias("y")).repartition(1), "licence-held")
    spread = lambda t: _total(F.transform("r", lambda x: F.exp((x - F.array_max("r")) / t)))
    loss = lambda t: F.avg(F.log(spread(t)) - (F.element_at("r", F.col("y") + 1) - F.array_max("r")) / t)
    losses = judged.agg(*(loss(t).alias(f"t{i}") for i, t in enumerate(TEMPERATURES))).first()
    heat = min(zip(losses, TEMPERATURES, strict=True))[1]
    if 2 * math.exp(intercepts[0] / heat) < sum(math.exp(x / heat) for x in intercepts):
        raise ValueError("a unit without licence words would not be of the class none")
    best = F.array_max(F.slice("r", 3, len(classes)))
    top = F.array_position("r", best) - 1

    def right(least: float) -> Column:
        """The mean of two shares: families found, and other families' notices not taken for one of them."""
        sure = F.exp((best - F.array_max("r")) / heat) / spread(heat) >= least
        return (F.avg(F.when(F.col("y") > 1, (sure & (top == F.col("y"))).cast("double"))) + F.avg(F.when(F.col("y") == 1, (~sure).cast("double")))) / 2

    found = judged.agg(*(right(x).alias(f"p{i}") for i, x in enumerate(THRESHOLDS))).first()
    return Classifier(weights, classes, intercepts, heat, max(zip(found, [-x for x in THRESHOLDS], strict=True))[1] * -1, licence_words, table)


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, row, paragraph, line, w): the words of all paragraphs (line -1) and of the lines of those with several lines."""
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    blocks = texts.select("doc_id", "row", F.posexplode(F.split("text", r"\n[ \t\r\f]*(?:\n[ \t\r\f]*)+")).alias("paragraph", "block"))
    both = F.array_union(F.array(F.struct(F.lit(-1).alias("line"), F.col("block").alias("t"))), F.when(F.contains("block", F.lit("\n")), F.transform(F.split("block", "\n"), lambda t, i: F.struct(i.alias("line"), t.alias("t")))).otherwise(F.array()))
    return blocks.select("doc_id", "row", "paragraph", F.explode(both).alias("u")).select("doc_id", "row", "paragraph", "u.line", words("u.t").alias("w"))


def probabilities(found: DataFrame, model: Classifier) -> DataFrame:
    """(row, paragraph, line, p) of the units that have a feature: the classes' probabilities."""
    hits = found.select("row", "paragraph", "line", F.explode(grams(F.col("w"))).alias("gram")).join(F.broadcast(model.weights), "gram")  # at most VOCABULARY rows
    sums = hits.groupBy("row", "paragraph", "line").agg(*(F.sum(F.element_at("weights", i + 1)).alias(f"s{i}") for i in range(len(model.classes))))
    z = sums.select("row", "paragraph", "line", F.array(*((F.col(f"s{i}") + b) / model.temperature for i, b in enumerate(model.intercepts))).alias("z"))
    e = z.withColumn("e", F.transform("z", lambda x: F.exp(x - F.array_max("z")))).withColumn("all", _total(F.col("e")))
    return e.select("row", "paragraph", "line", F.transform("e", lambda x: x / F.col("all")).alias("p"))


def scanned(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """(doc_id, paragraph, line, family, probability, likeness, confirmed): what the units of docs say that are not of the class none.

    A unit is of the class none if that has a probability of one half or more; else of the likeliest family, or ``unknown`` if that
    is less likely than the model's threshold (probability is the family's). A confirmed line is reported; its paragraph as a
    whole (line null) is if it is confirmed for another family than such lines, or if none of its lines is confirmed; lines that
    are not confirmed only if their paragraph as a whole says nothing. Ties go to none, and to the first family by name. Nulls and empty texts have no
    units; rows that repeat a doc_id are each scanned; paragraphs and lines count from 0, blank lines included.
    """
    model = model or fit(docs)
    gate = _array(model.licence_words)
    # quick tests of texts and units: without a licence word there is no feature, which is the class none
    some = docs.where(F.arrays_overlap(words("text"), gate))
    found = stored(units(some).where(F.arrays_overlap("w", gate)), "licence-units")
    key = ["row", "paragraph", "line"]
    best = probabilities(found, model).where(F.get("p", F.lit(0)) < 0.5).withColumn("probability", F.array_max(F.slice("p", 3, len(model.classes))))
    family = F.element_at(_array(model.classes), F.array_position("p", F.col("probability")).cast("int"))
    best = stored(found.join(best.withColumn("family", family), key), "licence-findings")
    best = best.join(likeness(best, model.templates, key), [*key, "family"], "left").withColumn("likeness", F.coalesce("likeness", F.lit(0.0)))
    sure = F.col("probability") >= model.threshold
    best = best.withColumn("confirmed", sure & (F.col("likeness") >= CONFIRMED)).withColumn("family", F.when(sure, F.col("family")).otherwise(UNKNOWN))
    lines = F.col("line") >= 0
    of = best.groupBy("row", "paragraph").agg(F.collect_set(F.when(lines & F.col("confirmed"), F.col("family"))).alias("sure_lines"), F.count_if(~lines).alias("wholes"))
    whole = F.when(F.col("confirmed"), ~F.array_contains("sure_lines", F.col("family"))).otherwise(F.size("sure_lines") == 0)
    out = best.join(of, ["row", "paragraph"]).where(F.when(~lines, whole).otherwise(F.col("confirmed") | (F.col("wholes") == 0)))
    return out.select("doc_id", "paragraph", F.when(lines, F.col("line")).alias("line"), "family", "probability", "likeness", "confirmed")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its number of licence findings, how many are confirmed and unknown, and the families found."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scanned(docs).groupBy("doc_id").agg(
        F.count("*").alias("n_paragraphs"),
        F.count_if("confirmed").alias("n_confirmed"),
        F.count_if(F.col("family") == UNKNOWN).alias("n_unknown"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", *map(zero, ("n_paragraphs", "n_confirmed", "n_unknown")), F.coalesce("families", F.lit("")).alias("families"))
