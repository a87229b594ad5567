"""Class taxonomies and label spaces: categories, hosts by name, matched names, mapped labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.scalars import normal_name
from plumbline.operators.lineage import dimension


def assign_category(names: DataFrame, rules: DataFrame, default: str = "pest") -> DataFrame:
    """names (name) with the category of the reviewed rule that lists it, else the default. rules: (name, category)."""
    return names.join(rules, "name", "left").withColumn("category", F.coalesce("category", F.lit(default)))


def resolve_host(names: DataFrame, aliases: DataFrame, overrides: DataFrame) -> DataFrame:
    """(name, host, tier, status) of each name.

    Tiers: 0 an override; 1 "(alias)" or "(alias " inside the name; 2 the name is the alias or begins with it and a space or a
    bracket; 3 the alias is one of the name's words, where brackets are spaces too. The first tier with a host decides: one host
    is ok, several are ambiguous; no tier at all is unresolved. Full-width brackets count as plain ones.

    What of a name could be an alias is listed (beginnings up to a space or bracket, words), so aliases are found by equality.
    """
    plain = F.translate(F.lower("name"), "（）", "()")
    n = names.select("name").distinct().withColumn("plain", plain)
    a = aliases.select(F.lower("alias").alias("alias"), "host").distinct()
    # beginnings of t that end before one of ``stops`` or, if ``whole``, at its end
    at = lambda t: F.filter(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: i <= F.length(t))
    heads = lambda t, stops: F.transform(F.filter(at(t), lambda i: F.substr(t, i, F.lit(1)).isin(*stops)), lambda i: F.substr(t, F.lit(1), i - 1))
    opened = F.slice(F.split("plain", r"\("), 2, 1_000)
    in_brackets = F.flatten(F.transform(opened, lambda t: heads(t, [" ", ")"])))
    begins = F.concat(heads(F.col("plain"), [" ", "("]), F.array("plain"))
    tokens = F.split(F.trim(F.translate("plain", "()", "  ")), r"\s+")
    tier = lambda k, c: F.transform(F.array_distinct(c), lambda x: F.struct(F.lit(k).alias("tier"), x.alias("alias")))
    found = n.select("name", F.inline(F.concat(tier(1, in_brackets), tier(2, begins), tier(3, tokens)))).join(a, "alias").select("name", "host", "tier")
    found = found.union(overrides.join(n.select("name"), "name", "left_semi").select("name", "host", F.lit(0).alias("tier")))
    best = found.groupBy("name").agg(F.min("tier").alias("tier"))
    hosts = found.join(best, ["name", "tier"]).groupBy("name", "tier").agg(F.countDistinct("host").alias("k"), F.min("host").alias("host"))
    out = n.select("name").join(hosts, "name", "left")
    status = F.when(F.col("k").isNull(), "unresolved").when(F.col("k") > 1, "ambiguous").otherwise("ok")
    return out.select("name", F.when(F.col("k") == 1, F.col("host")).alias("host"), "tier", status.alias("status"))


def match_names(source: DataFrame, target: DataFrame, overrides: DataFrame) -> DataFrame:
    """(source, target, method): reviewed pairs first, else equal normal forms, else method "unmatched". Inputs: (name)."""
    s = source.select(F.col("name").alias("source")).withColumn("form", normal_name("source"))
    t = target.select(F.col("name").alias("target")).withColumn("form", normal_name("target"))
    given = overrides.select("source", F.col("target").alias("reviewed"))
    out = s.join(given, "source", "left").join(t, "form", "left")
    method = F.when(F.col("reviewed").isNotNull(), "reviewed_alias").when(F.col("target").isNotNull(), "normalized_name").otherwise("unmatched")
    return out.select("source", F.coalesce("reviewed", "target").alias("target"), method.alias("method"))


def assign_detector_labels(labels: DataFrame) -> DataFrame:
    """(source_label, public_id) with detector_label: 1..K in the order of the public ids, one for each. A dimension table."""
    ids = labels.select("public_id").distinct().withColumn("detector_label", F.row_number().over(W.orderBy("public_id")))
    return labels.join(ids, "public_id")


def map_labels(objects: DataFrame, label_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects with the columns of their source_label's entry, and the objects that have none."""
    m = dimension(label_map)
    return objects.join(m, "source_label"), objects.join(m, "source_label", "left_anti")


def map_predictions(detections: DataFrame, label_map: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Detections with public_id (-1 if unmapped), name ("class_<label>") and host ("")."""
    public = dimension(label_map.select(F.col("detector_label").alias("label"), "public_id").distinct())
    names = dimension(taxonomy.select(F.col("class_id").alias("public_id"), "name", "host"))
    out = detections.join(public, "label", "left").join(names, "public_id", "left")
    return out.withColumn("public_id", F.coalesce("public_id", F.lit(-1))).withColumn("name", F.coalesce("name", F.concat(F.lit("class_"), F.col("label")))).withColumn("host", F.coalesce("host", F.lit("")))
