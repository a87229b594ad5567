"""Manifests of labelled files: audit, duplicate groups, leakage-free splits, summaries and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.scalars import error_text, stable_tie_break
from plumbline.operators.lineage import checkpointed, dimension
from plumbline.operators.prefix import running_total

SPLITS = ("train", "val", "test")


def audit_content(files: DataFrame, content: str = "content", bad: str = "false", error: str = "'unreadable'") -> DataFrame:
    """(path, class_id, ...) with sha256, size_bytes, decode_status and decode_error instead of the content. Bad rows stay."""
    raw = F.col(content).cast("binary")
    is_bad = F.expr(bad)
    return files.select(
        *[c for c in files.columns if c != content],
        F.sha2(raw, 256).alias("sha256"),
        F.octet_length(raw).cast("long").alias("size_bytes"),
        F.when(is_bad, "bad").otherwise("ok").alias("decode_status"),
        F.when(is_bad, error_text(F.lit("DecodeError"), F.expr(error))).otherwise("").alias("decode_error"),
    )


def excluded(manifest: DataFrame) -> DataFrame:
    return manifest.where("decode_status <> 'ok'")


def duplicate_groups(manifest: DataFrame, seed: int = 0) -> DataFrame:
    """(group_id, class_id, n, size, n_classes, tie_break): usable rows grouped by content, one row per group and class."""
    each = manifest.where("decode_status = 'ok'").groupBy(F.col("sha256").alias("group_id"), "class_id").agg(F.count("*").alias("n"))
    total = each.groupBy("group_id").agg(F.sum("n").alias("size"), F.count("*").alias("n_classes"))
    return each.join(total, "group_id").withColumn("tie_break", stable_tie_break(seed, "group_id"))


def required_splits(groups: DataFrame) -> DataFrame:
    """Images and groups of each class, and the splits that it must be in: train, test from two groups on, val from three."""
    out = groups.groupBy("class_id").agg(F.sum("n").alias("n_images"), F.count("*").alias("n_groups"))
    return out.withColumn("required", F.when(F.col("n_groups") >= 3, "train,val,test").when(F.col("n_groups") == 2, "train,test").when(F.col("n_groups") == 1, "train").otherwise(""))


def group_split(groups: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), rounds: int = 0) -> DataFrame:
    """(group_id, home, size, split): no group is in two splits, every class is in its required ones, each class and all near the ratios.

    A group's home is its class with the fewest groups. Within a home the smallest groups are reserved for the required splits;
    the others follow in random order, each going where the middle of its rows falls in the remaining quotas. Then, while a class
    lacks one of its splits, groups move there that leave all their classes covered; what ten rounds can't mend is an error. With
    ``rounds``, balanced() then auctions groups between splits, as far as a class or all of them are off by more than their largest group.
    """
    counts = groups.groupBy("class_id").agg(F.count("*").alias("k"))
    home = groups.join(counts, "class_id").groupBy("group_id").agg(F.min(F.struct("k", "class_id")).alias("h"), F.first("size").alias("size"), F.first("tie_break").alias("tie_break"))
    home = checkpointed(home.select("group_id", F.col("h.class_id").alias("home"), "size", "tie_break"))
    first = home.withColumn("rank", F.row_number().over(W.partitionBy("home").orderBy("size", "tie_break"))).where("rank <= 3").select("group_id", "rank")
    total = home.groupBy("home").agg(F.count("*").alias("k"), F.sum("size").alias("total"))
    all_ = home.join(total, "home").join(first, "group_id", "left")
    reserved = F.when(F.col("rank") == 1, "train").when((F.col("rank") == 2) & (F.col("k") >= 3), "val").when((F.col("rank") == 3) & (F.col("k") >= 3), "test").when((F.col("rank") == 2) & (F.col("k") == 2), "test")
    all_ = all_.withColumn("reserved", reserved)
    held = all_.groupBy("home").agg(*(F.coalesce(F.sum(F.when(F.col("reserved") == s, F.col("size"))), F.lit(0)).alias(f"r_{s}") for s in SPLITS))
    rest = running_total(all_.where("reserved is null").select("group_id", "home", "size", "tie_break", "total"), ["home"], ["tie_break", "group_id"], "size", "upto").join(held, "home")
    middle = F.col("upto") - F.col("size") / 2
    quota = [F.greatest(F.lit(0.0), F.lit(ratios[i]) * F.col("total") - F.col(f"r_{s}")) for i, s in enumerate(SPLITS)]
    placed = rest.withColumn("split", F.when(middle <= quota[0], "train").when(middle <= quota[0] + quota[1], "val").otherwise("test"))
    out = checkpointed(placed.select("group_id", "home", "size", "split").union(all_.where("reserved is not null").select("group_id", "home", "size", F.col("reserved").alias("split"))))
    for _ in range(10):
        gaps = checkpointed(missing_coverage(groups, out))
        if gaps.isEmpty():
            return balanced(groups, out, ratios, rounds)
        out = checkpointed(_covered(groups, out, gaps))
    left = missing_coverage(groups, out).take(3)
    if left:
        raise ValueError("no group can be moved to " + ", ".join(f"{r.split} of class {r.class_id}" for r in left))
    return balanced(groups, out, ratios, rounds)


def split_quotas(groups: DataFrame, split: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """(class_id, split, n, groups, target, largest, needed) of each class and split; class_id is null for all classes together.

    n: rows there; groups: groups that have the class there; target: the ratio's share of the class; largest: its largest group;
    needed: whether the class has to be in that split. A row that is |n - target| <= largest is within one group of its quota.
    """
    where = F.create_map(*(x for s, r in zip(SPLITS, ratios, strict=True) for x in (F.lit(s), F.lit(float(r)))))
    member = groups.select("group_id", "class_id", "n").join(split.select("group_id", "split"), "group_id")
    parts = lambda df: df.groupBy("class_id").agg(F.sum("n").alias("total"), F.max("n").alias("largest"), *(f(F.when(F.col("split") == s, F.col("n"))).alias(f"{f.__name__}_{s}") for s in SPLITS for f in (F.sum, F.count)))
    every = split.select(F.lit(None).cast(groups.schema["class_id"].dataType).alias("class_id"), F.col("size").alias("n"), "split")
    rows = F.inline(F.array(*(F.struct(F.lit(s).alias("split"), F.coalesce(f"sum_{s}", F.lit(0)).alias("n"), F.col(f"count_{s}").alias("groups")) for s in SPLITS)))
    out = parts(member).unionByName(parts(every)).select("class_id", "total", "largest", rows)
    required = required_splits(groups).select("class_id", F.split("required", ",").alias("required"))
    out = out.join(required, "class_id", "left")
    return out.select("class_id", "split", "n", "groups", (F.col("total") * where[F.col("split")]).alias("target"), "largest", F.coalesce(F.array_contains("required", F.col("split")), F.lit(False)).alias("needed"))


def balanced(groups: DataFrame, split: DataFrame, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), rounds: int = 12) -> DataFrame:
    """split after an auction: groups move from a split that has too much to one that has too little, first where a class is off by more
    than its largest group, then where all together are off by more than the largest group of all.

    In a round every class that is off names the split it has most too much of and the one it lacks most. Groups that have it there bid to
    move, one of several such classes for the one that is furthest off; if no class is off, all groups of the fullest split bid for
    the emptiest. Only groups bid whose move alone leaves each of their classes covered and within one group of its quota, or nearer to it.
    Bids are taken in an order that each round shuffles anew, as long as the class has something to move; one wins if its move does that
    still when all bids before it have moved as well. What loses may bid in the next round. Rounds end when nothing is off, or
    nothing moves, or after ``rounds``. Running totals are two-level, so neither a class nor a lane is one task's.
    """
    kind = groups.schema["class_id"].dataType
    member = checkpointed(groups.select("group_id", "class_id", "n", "tie_break"))
    member = member.unionByName(member.groupBy("group_id").agg(F.first("tie_break").alias("tie_break"), F.sum("n").alias("n")).withColumn("class_id", F.lit(None).cast(kind)))
    member = checkpointed(member.withColumn("key", F.coalesce(F.col("class_id").cast("string"), F.lit(""))).drop("class_id"))
    for k in range(rounds):
        quotas = split_quotas(groups, split, ratios).withColumn("key", F.coalesce(F.col("class_id").cast("string"), F.lit("")))
        quotas = checkpointed(quotas.select("key", "split", "groups", "largest", "needed", (F.col("n") - F.col("target")).alias("over")))
        off = quotas.where("abs(over) > largest").agg(F.max("key")).first()[0]  # the empty key is that of all classes
        if off is None:
            break
        lanes = quotas.groupBy("key").agg(F.max_by("split", "over").alias("source"), F.min_by("split", "over").alias("to"), F.least(F.max("over"), -F.min("over")).alias("room"), F.max(F.abs("over") - F.col("largest")).alias("worst"))
        lanes = lanes.where("worst > 0").where(F.lit(off == "") | (F.col("key") != ""))
        here = member.join(split.select("group_id", "split"), "group_id").withColumn("tie", stable_tie_break(k, "tie_break"))
        asked = here.join(lanes, "key").where("split = source").groupBy("group_id", "tie").agg(F.max_by(F.struct("key", "n", "source", "to", "room"), F.struct("worst", "key")).alias("x"))
        asked = asked.select("group_id", "tie", F.col("x.key").alias("bidder"), F.col("x.n").alias("part"), "x.source", "x.to", "x.room")
        alone = member.join(asked, "group_id").withColumn("moved", F.col("n")).withColumn("turn", F.lit(1))
        bids = checkpointed(asked.join(_allowed(alone, quotas).select("group_id"), "group_id", "left_semi"))
        bids = running_total(bids, ["bidder"], ["tie", "group_id"], "part", "upto").where("upto - part / 2 <= room")
        rows = checkpointed(member.join(bids.select("group_id", "source", "to", "tie"), "group_id").withColumn("one", F.lit(1)))
        rows = running_total(rows, ["key", "source", "to"], ["tie", "group_id"], "n", "moved")
        rows = running_total(rows, ["key", "source", "to"], ["tie", "group_id"], "one", "turn")
        won = checkpointed(_allowed(rows, quotas))
        if won.isEmpty():
            break
        split = checkpointed(split.join(won, "group_id", "left").withColumn("split", F.coalesce("to", "split")).drop("to"))
    return split


def _allowed(moves: DataFrame, quotas: DataFrame) -> DataFrame:
    """(group_id, to) of the groups all of whose rows (key, source, to, moved, turn) leave the key in the splits it needs, and within one
    group of its quota or nearer to it."""
    at = lambda name, side: quotas.select("key", F.col("split").alias(name), *(F.col(c).alias(f"{side}_{c}") for c in ("over", "groups", "largest", "needed")))
    known = moves.join(at("source", "from"), ["key", "source"]).join(at("to", "into"), ["key", "to"])
    left, got = F.col("from_over") - F.col("moved"), F.col("into_over") + F.col("moved")
    near = (F.abs(left) <= F.greatest("from_largest", F.abs("from_over"))) & (F.abs(got) <= F.greatest("into_largest", F.abs("into_over")))
    covered = ~F.col("from_needed") | (F.col("turn") < F.col("from_groups"))
    return known.groupBy("group_id").agg(F.bool_and(near & covered).alias("fine"), F.first("to").alias("to")).where("fine").select("group_id", "to")


def _covered(groups: DataFrame, split: DataFrame, gaps: DataFrame) -> DataFrame:
    """split after one round of moves: for each missing (class, split) its smallest group that leaves no class without a split it needs.
    Of the groups that would leave the same split of a class, one moves."""
    member = groups.select("group_id", "class_id", "tie_break").join(split, "group_id")
    needed = required_splits(groups).select("class_id", F.explode(F.split("required", ",")).alias("split"), F.lit(True).alias("needed"))
    held = member.groupBy("class_id", "split").agg(F.count("*").alias("k")).join(needed, ["class_id", "split"], "left")
    member = member.join(held, ["class_id", "split"])
    free = member.groupBy("group_id").agg(F.bool_and(F.col("needed").isNull() | (F.col("k") > 1)).alias("free")).where("free").select("group_id")
    wanted = member.join(free, "group_id").join(gaps.withColumnRenamed("split", "to"), "class_id").where("split <> to")
    best = wanted.groupBy("class_id", "to").agg(F.min(F.struct("size", "tie_break", "group_id")).alias("b"))
    moves = best.groupBy(F.col("b.group_id").alias("group_id")).agg(F.min("to").alias("to"), F.min("b.tie_break").alias("tie"))
    first = W.partitionBy("class_id", "split").orderBy("tie", "group_id")
    sole = member.join(moves, "group_id").withColumn("turn", F.row_number().over(first)).groupBy("group_id").agg(F.max("turn").alias("turn")).where("turn = 1")  # at most a move a missing pair
    moves = moves.join(sole, "group_id").select("group_id", "to")
    return split.join(moves, "group_id", "left").withColumn("split", F.coalesce("to", "split")).drop("to")


def missing_coverage(groups: DataFrame, split: DataFrame) -> DataFrame:
    """(class_id, split) pairs that a class requires and does not have."""
    want = required_splits(groups).select("class_id", F.explode(F.split("required", ",")).alias("split")).where("split <> ''")
    have = groups.select("group_id", "class_id").join(split.select("group_id", "split"), "group_id").select("class_id", "split").distinct()
    return want.join(have, ["class_id", "split"], "left_anti")


def split_summary(manifest: DataFrame, split: DataFrame, classes: DataFrame) -> DataFrame:
    """Images of each class in all and per split, zero-filled for every class of the dimension."""
    rows = manifest.where("decode_status = 'ok'").join(split.select(F.col("group_id").alias("sha256"), "split"), "sha256")
    wide = rows.groupBy("class_id").pivot("split", list(SPLITS)).count()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = classes.join(wide, "class_id", "left").select("class_id", *map(zero, SPLITS))
    return out.withColumn("total_images", F.col("train") + F.col("val") + F.col("test"))


def audit_summary(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count("*").alias("total"), F.count_if(F.col("decode_status") == "ok").alias("usable"), F.count_if(F.col("decode_status") != "ok").alias("bad"),
        F.sum("size_bytes").alias("bytes"), F.countDistinct("sha256").alias("distinct_contents"),
    )


def histogram(df: DataFrame, value, name: str) -> DataFrame:
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def class_set_audit(directories: DataFrame, classes: DataFrame, aliases: DataFrame) -> DataFrame:
    """Per official class: n_forms (directories under its name or alias), n_files, status missing / duplicate / empty / ok; other
    directories are "extra". directories: (directory, n_files); classes: (official_name); aliases: (official_name, local_directory)."""
    names = classes.select("official_name", F.col("official_name").alias("directory")).union(aliases.select("official_name", F.col("local_directory").alias("directory"))).distinct()
    shown = directories.where(~F.startswith("directory", F.lit(".")))
    both = names.join(shown, "directory", "full_outer")
    known = both.where("official_name is not null").groupBy(F.col("official_name").alias("name")).agg(F.count("n_files").alias("n_forms"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"))
    status = F.when(F.col("n_forms") == 0, "missing").when(F.col("n_forms") > 1, "duplicate").when(F.col("n_files") == 0, "empty").otherwise("ok")
    extra = both.where("official_name is null").select(F.col("directory").alias("name"), F.lit(1).cast("long").alias("n_forms"), "n_files", F.lit("extra").alias("status"))
    return known.withColumn("status", status).unionByName(extra)


def pair_audit(formal: DataFrame, images: DataFrame, annotations: DataFrame) -> DataFrame:
    """(violation, id): formal ids without an image or an annotation, and images that no formal id names. Inputs: (id)."""
    named = lambda df, kind: df.select(F.lit(kind).alias("violation"), F.col("id").cast("string").alias("id"))
    return (
        named(formal.join(images, "id", "left_anti"), "missing_image")
        .union(named(formal.join(annotations, "id", "left_anti"), "missing_annotation"))
        .union(named(images.join(formal, "id", "left_anti"), "extra_image"))
    )


def mismatches(recorded: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of recorded whose columns differ from found's, or that found lacks: key, recorded_*, found_*, status."""
    f = found.select(F.col(key).alias("__key"), *(F.col(c).alias(f"found_{c}") for c in columns), F.lit(True).alias("__there"))
    out = recorded.select(F.col(key), *(F.col(c).alias(f"recorded_{c}") for c in columns)).join(f, F.col(key) == F.col("__key"), "left")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"recorded_{c}").eqNullSafe(F.col(f"found_{c}"))
    status = F.when(F.col("__there").isNull(), "missing").otherwise("mismatch")
    return out.where(F.col("__there").isNull() | differs).withColumn("status", status).drop("__key", "__there")


def changed_ranges(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(path, start, length, status) of the ranges (path, start, length, sha256) that are not the same in both: changed, missing or extra,
    with recorded's length where it has one. A changed byte names its range; a file that grew or shrank its last ones."""
    f = found.select("path", "start", F.col("length").alias("__length"), F.col("sha256").alias("__sha256"))
    both = recorded.join(f, ["path", "start"], "full_outer").where(~F.col("sha256").eqNullSafe(F.col("__sha256")) | ~F.col("length").eqNullSafe(F.col("__length")))
    status = F.when(F.col("__sha256").isNull(), "missing").when(F.col("sha256").isNull(), "extra").otherwise("changed")
    return both.select("path", "start", F.coalesce("length", "__length").alias("length"), status.alias("status"))


def enrich_samples(manifest: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """manifest with the host and category ordinals of its class; the taxonomy is a dimension, a row a class."""
    return manifest.join(dimension(taxonomy), "class_id")


def taxonomy_rollup(taxonomy: DataFrame, declared: DataFrame) -> DataFrame:
    """(dimension, ordinal, value, class_count, image_count) of every declared host, category and host group, 0 where no class has it.

    declared: (dimension, ordinal, value), the values in the order in which they are declared. Each class is three rows of one
    aggregation, its host's, its category's and its host group's.
    """
    t = taxonomy.select(F.expr("stack(3, 'host', cast(host_id as string), 'category', cast(category as string), 'host_group', cast(host_group as string)) as (dimension, value)"), "image_count")
    sums = t.groupBy("dimension", "value").agg(F.count("*").alias("class_count"), F.sum("image_count").alias("image_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return declared.join(sums, ["dimension", "value"], "left").select("dimension", "ordinal", "value", zero("class_count"), zero("image_count"))


def class_weights(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """n ** -0.5 of each class of the dimension (1 where it is absent), scaled to a mean of 1."""
    raw = classes.join(counts, "class_id", "left").withColumn("w", F.when(F.coalesce("n", F.lit(0)) > 0, 1 / F.sqrt("n")).otherwise(F.lit(1.0)))
    mean = raw.agg(F.avg("w").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("class_id", (F.col("w") / F.col("mean")).alias("weight"))  # one row


def sample_weights(samples: DataFrame, mode: str = "sqrt") -> DataFrame:
    """Each sample's weight by its class's count n: 1 / sqrt(n) ("sqrt") or 1 / n ("inverse")."""
    counts = samples.groupBy("class_id").agg(F.count("*").alias("n"))
    w = 1 / F.sqrt("n") if mode == "sqrt" else 1 / F.col("n")
    return samples.join(dimension(counts), "class_id").withColumn("weight", w).drop("n")


def weighted_resample(df: DataFrame, weight: str, n: int, seed: int, key: str) -> DataFrame:
    """df's rows with ``copies``: n draws in proportion to ``weight`` by systematic sampling along a seeded order.

    Weights are taken in whole millionths, so running totals are exact in any order of summation. Row r covers the stretch
    (upto - w, upto]; the draws stand at (k + 0.5) * total / n.
    """
    d = df.withColumn("__w", F.round(F.col(weight) * 1_000_000).cast("long")).withColumn("__tie", stable_tie_break(seed, key))
    total = d.agg(F.sum("__w").alias("__total"))
    d = running_total(d, [], ["__tie", key], "__w", "__upto").crossJoin(F.broadcast(total))  # one row
    upto = lambda c: F.floor(c * F.lit(n) / F.col("__total") + 0.5)
    d = d.withColumn("copies", (upto(F.col("__upto")) - upto(F.col("__upto") - F.col("__w"))).cast("long"))
    return d.where("copies > 0").drop("__w", "__tie", "__upto", "__total")


def seeded_order(df: DataFrame, seed: int, key: str, n: int | None = None) -> DataFrame:
    """Rows in the order of their tie break; the first n of them if n is given."""
    d = df.withColumn("tie_break", stable_tie_break(seed, key)).orderBy("tie_break")
    return d if n is None else d.limit(n)


def split_invariants(a: DataFrame, b: DataFrame, official: DataFrame, lists: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(invariant, violations) of two id sets that should be disjoint, not empty, and make up the official set; with ``lists``, two
    DataFrames (formal_index, image_id), also how many places of the two lists differ (order)."""
    side = lambda df, a, b, o: df.select(F.col(df.columns[0]).alias("id"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(o).alias("o"))
    each = side(a, 1, 0, 0).union(side(b, 0, 1, 0)).union(side(official, 0, 0, 1)).groupBy("id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("o").alias("o"))
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    row = each.agg(
        n(((F.col("a") > 0) & (F.col("b") > 0)).cast("int")).alias("disjoint"),
        n(F.greatest(F.col("o") - F.col("a") - F.col("b"), F.lit(0))).alias("missing"), n(F.greatest(F.col("a") + F.col("b") - F.col("o"), F.lit(0))).alias("unexpected"),
        ((n("a") == 0).cast("long") + (n("b") == 0).cast("long")).alias("empty"),
    )
    out = row.select(F.expr("stack(4, 'disjoint', disjoint, 'missing', missing, 'unexpected', unexpected, 'empty', empty) as (invariant, violations)"))
    if lists:
        one, other = (x.select("formal_index", F.col("image_id").alias(c)) for x, c in zip(lists, ("one", "other"), strict=True))
        places = one.join(other, "formal_index", "full_outer").agg(F.lit("order").alias("invariant"), F.count_if(~F.col("one").eqNullSafe(F.col("other"))).alias("violations"))
        out = out.union(places)
    return out


def violations(checks: list[tuple[str, DataFrame]]) -> DataFrame:
    """(check, key, detail) of all checks, each a DataFrame (key, detail) of what breaks it."""
    out = None
    for name, df in checks:
        rows = df.select(F.lit(name).alias("check"), F.col("key").cast("string").alias("key"), F.col("detail").cast("string").alias("detail"))
        out = rows if out is None else out.union(rows)
    return out


def require(found: DataFrame, shown: int = 5) -> None:
    """Raises if there is any violation, naming the first few."""
    rows = found.take(shown)
    if rows:
        raise ValueError("; ".join(f"{r['check']}: {r['key']} ({r['detail']})" for r in rows))
