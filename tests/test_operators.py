"""Edge cases, invariants and golden values."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import boxes as X
from plumbline.operators import classification as C
from plumbline.operators import coco, multilabel, predict, runs
from plumbline.operators import manifest as M
from plumbline.operators import taxonomy as T
from plumbline.plans import bindings as B


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_extensions(spark):
    rows = spark.createDataFrame([("a/b.JPG",), ("a.b/c",), (".hidden",), ("x.tar.gz",), ("",)], ["n"]).select(S.file_extension("n")).collect()
    assert [r[0] for r in rows] == [".jpg", "<none>", "<none>", ".gz", "<none>"]


def test_paths(spark):
    assert one(spark, S.relative_path("p", "/data/root"), p="/data/root/a\\b.jpg") == "a/b.jpg"
    assert one(spark, S.relative_path("p", "/data/root"), p="/data/rooted/a") == "/data/rooted/a"
    rows = spark.createDataFrame([("a/b",), ("/a",), ("a/../b",), ("a..b",)], ["p"]).select(S.is_safe_path("p")).collect()
    assert [r[0] for r in rows] == [True, False, False, True]


def test_box_reasons(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0.0, 0.0, 5.0, 5.0), (0.0, 0.0, 10.0, 10.0), (0.0, 0.0, 10.1, 5.0), (5.0, 5.0, 5.0, 4.0), (nan, 5.0, 4.0, 4.0), (0.0, 0.0, inf, 1.0), (-1.0, 0.0, -2.0, 3.0)]
    df = spark.createDataFrame(rows, ["a", "b", "c", "d"]).select(S.box_filter_reasons("a", "b", "c", "d", F.lit(10), F.lit(10)))
    assert [r[0] for r in df.collect()] == [[], [], ["out_of_bounds"], ["non_positive_width", "non_positive_height"], ["non_finite"], ["non_finite"], ["non_positive_width", "out_of_bounds"]]


def test_top_k_ties(spark):
    assert one(spark, S.top_k("s", 3), s=[1.0, 3.0, 3.0, 0.0]) == [1, 2, 0]
    assert one(spark, S.argmax("s"), s=[1.0, 3.0, 3.0, 0.0]) == 1
    assert sum(one(spark, S.softmax("s"), s=[1000.0, 1000.0])) == pytest.approx(1)


def test_clock_and_progress(spark):
    assert one(spark, S.clock("s"), s=3725.9) == "01:02:05"
    assert one(spark, S.clock("s"), s=360000.0) == "100:00:00"
    assert one(spark, S.progress("a", "b"), a=7, b=3) == 100.0
    assert one(spark, S.progress("a", "b"), a=7, b=0) == 0.0


def test_resolve_host_tiers(spark):
    aliases = spark.createDataFrame([("rice", "R"), ("corn", "C"), ("big corn", "K")], ["alias", "host"])
    names = spark.createDataFrame([("blast（rice）",), ("rice leaf",), ("old corn pest",), ("rice (corn)",), ("big corn",), ("none",), ("given",)], ["name"])
    given = spark.createDataFrame([("given", "Z")], ["name", "host"])
    got = {r.name: (r.host, r.tier, r.status) for r in T.resolve_host(names, aliases, given).collect()}
    assert got["blast（rice）"] == ("R", 1, "ok")
    assert got["rice leaf"] == ("R", 2, "ok")
    assert got["old corn pest"] == ("C", 3, "ok")
    assert got["rice (corn)"] == ("C", 1, "ok")
    assert got["big corn"] == ("K", 2, "ok")
    assert got["none"] == (None, None, "unresolved")
    assert got["given"] == ("Z", 0, "ok")


def test_group_split_invariants(spark, sf):
    for seed in (0, 1, 2):
        g = M.duplicate_groups(B.manifest(spark, sf), seed)
        s = M.group_split(g)
        assert s.count() == s.select("group_id").distinct().count() == g.select("group_id").distinct().count()
        assert M.missing_coverage(g, s).count() == 0


def test_group_split_auction(spark):
    """Groups of two and three classes, most of them in the first split: the auction brings classes and all of them to their quotas."""
    import hashlib
    import random

    rng, rows = random.Random(5), []
    for i in range(600):
        own = {c: rng.choice([1, 1, 2, 5]) for c in rng.sample(range(12), rng.choice([1, 2, 2, 3]))}
        rows += [(f"g{i}", c, n, sum(own.values()), len(own), hashlib.sha256(f"0:g{i}".encode()).hexdigest()) for c, n in own.items()]
    g = spark.createDataFrame(rows, "group_id string, class_id int, n long, size long, n_classes long, tie_break string")
    off = lambda s: M.split_quotas(g, s).where("abs(n - target) > largest").count()
    start = M.group_split(g)
    skewed = start.withColumn("split", F.when(F.col("split") == "test", F.when(F.substring("group_id", -1, 1) < "7", "train").otherwise("test")).otherwise(F.col("split")))
    skewed = skewed.join(start.select("group_id", F.col("split").alias("was")), "group_id")
    out = M.balanced(g, skewed.drop("was"))
    assert off(skewed.drop("was")) > 3 >= off(out)
    assert out.count() == out.select("group_id").distinct().count() == 600
    assert M.missing_coverage(g, out).count() <= M.missing_coverage(g, skewed.drop("was")).count()
    assert M.split_quotas(g, out).where("class_id is null and abs(n - target) > largest").count() == 0
    same = M.balanced(g, out)
    assert off(same) <= off(out)


def test_order_statistics(spark):
    import random
    import statistics

    from plumbline.operators.selection import median, nth_smallest, smallest

    rng = random.Random(2)
    rows = [(i, rng.choice([1.0, 2.0, 2.0, 3.0, 5e300, -5e300, 1e-9]), rng.random()) for i in range(999)]
    df = spark.createDataFrame([*rows, (999, None, float("nan"))], "id int, a double, b double").repartition(5)
    for c, k in (("a", 1), ("b", 2)):
        values = sorted(r[k] for r in rows)
        assert median(df, c) == statistics.median(values)
        for rank in (1, 400, 999):
            value, below, equal = nth_smallest(df, c, rank, levels=7)
            assert value == values[rank - 1] and below == sum(x < value for x in values) and equal == values.count(value)
    assert nth_smallest(df, "a", 1000) is None and median(df.limit(0), "a") is None
    assert median(df.where("id in (0, 1)"), "b") == pytest.approx((rows[0][2] + rows[1][2]) / 2, rel=1e-15)
    best = sorted((r[1], r[2]) for r in rows)
    for k in (0, 1, 250, 998, 5000):
        assert sorted((r.a, r.b) for r in smallest(df.where("a is not null"), k, ["a", "b"]).collect()) == best[:k]


def test_multilabel_split_of_many_rare_labels(spark):
    import random

    rng = random.Random(4)
    rows = [(i, rng.randrange(120) if rng.random() < 0.5 else 0) for i in range(900) for _ in range(rng.randint(1, 5))]
    labels = spark.createDataFrame([*rows, (None, 1), (5, None)], "image_id int, label int")
    out = multilabel.multilabel_split(labels, 0.3, seed=2)
    n = len({i for i, _ in rows})
    assert out.count() == n and out.where("side = 'val'").count() == round(n * 0.3)
    each = labels.distinct().join(out, "image_id").groupBy("label").agg(F.count_if(F.col("side") == "val").alias("v"), F.count("*").alias("n")).collect()
    assert all(r.v < r.n for r in each if r.n > 1)
    assert sum(r.v == 0 for r in each if r.n > 1) <= 1


def test_multilabel_split(spark, sf):
    labels = B.boxes(spark, sf).select("image_id", F.col("source_label").alias("label")).distinct()
    out = multilabel.multilabel_split(labels, 0.2, seed=3)
    n = labels.select("image_id").distinct().count()
    assert out.where("side = 'val'").count() == round(n * 0.2)
    both = labels.join(out, "image_id").groupBy("label").agg(F.count_if(F.col("side") == "val").alias("v"), F.count("*").alias("n")).collect()
    assert all(0 < r.v < r.n for r in both)
    assert max(abs(r.v / r.n - 0.2) for r in both) < 0.1


def test_best_so_far_golden(spark):
    # what a run that begins with the sentinel and one that ties give
    rows = [(1, i + 1, m) for i, m in enumerate([-100.0, 2.0, 2.0, 5.0, 4.0])] + [(2, 1, None), (2, 2, -100.0)]
    got = [(r.run, r.epoch, r.best_metric, r.best_epoch) for r in runs.best_so_far(spark.createDataFrame(rows, ["run", "epoch", "metric"])).orderBy("run", "epoch").collect()]
    assert got == [(1, 1, -1.0, 0), (1, 2, 2.0, 2), (1, 3, 2.0, 2), (1, 4, 5.0, 4), (1, 5, 5.0, 4), (2, 1, -1.0, 0), (2, 2, -1.0, 0)]


def test_early_stop(spark):
    rows = [(1, i + 1, m) for i, m in enumerate([1.0, 3.0, 2.0, 2.0, 2.0, 9.0])]
    got = [(r.epoch, r.stop) for r in runs.early_stop(spark.createDataFrame(rows, ["run", "epoch", "metric"]), 3).orderBy("epoch").collect()]
    assert got == [(1, False), (2, False), (3, False), (4, False), (5, True)]


BOX = "image_id string, {} long, label int{}, xmin double, ymin double, xmax double, ymax double"


def boxes(spark, rows, kind="obj_id"):
    return spark.createDataFrame(rows, BOX.format(kind, ", score double" if kind == "det_id" else ""))


def test_greedy_match_first_truth_wins_ties(spark):
    g = boxes(spark, [("a", 0, 1, 0.0, 0.0, 10.0, 10.0), ("a", 1, 1, 0.0, 0.0, 10.0, 10.0), ("b", 0, 1, 0.0, 0.0, 4.0, 4.0)])
    d = boxes(spark, [("a", 0, 1, 0.9, 0.0, 0.0, 10.0, 10.0), ("a", 1, 2, 0.9, 0.0, 0.0, 10.0, 10.0), ("a", 2, 1, 0.8, 0.0, 0.0, 10.0, 10.0), ("a", 3, 1, 0.7, 0.0, 0.0, 10.0, 10.0)], "det_id")
    r = X.precision_recall(X.matched(g, d)).first()
    assert (r.tp, r.fp, r.fn) == (2, 1, 1)  # the detection of a label without truth in its image does not count


def test_empty_scores(spark):
    empty = spark.createDataFrame([], "sample_id int, target int, logits array<double>")
    assert C.topk_accuracy(empty).first().asDict() == {"top1": 0.0, "top5": 0.0}
    c = C.confusion_matrix(C.with_prediction(empty))
    assert C.macro_f1(c).first()[0] == 0.0 and C.balanced_accuracy(c).first()[0] == 0.0
    none = X.precision_recall(X.matched(boxes(spark, []), boxes(spark, [], "det_id"))).first()
    assert (none.tp, none.precision) == (0, 0.0)


def test_coco_golden(spark, sf):
    b = B.boxes(spark, sf)
    got = {r.metric: r.value for r in coco.coco_map(B.truth(b), B.detections(b)).collect()}
    assert got == {"map": 29.8505, "ap50": 53.4138, "ap75": 30.1457, "small": 11.8838, "medium": 33.304, "large": 43.9486, "ar100": 41.2147}


def test_coco_empty(spark):
    g, none = boxes(spark, [("a", 0, 1, 0.0, 0.0, 10.0, 10.0)]), boxes(spark, [], "det_id")
    got = {r.metric: r.value for r in coco.coco_map(g, none).collect()}
    assert got["map"] == 0.0 and got["large"] == -100.0
    labels = spark.createDataFrame([(1,), (2,)], "label int")
    assert {r.label: r.ap for r in coco.per_class_ap(g, none, labels).collect()} == {1: 0.0, 2: -100.0}


def test_resample_draws(spark):
    rows = spark.createDataFrame([(str(i), float(i % 5)) for i in range(100)], ["id", "w"])
    out = M.weighted_resample(rows, "w", 500, 1, "id")
    assert out.agg(F.sum("copies")).first()[0] == 500
    got = {r.id: r.copies for r in out.collect()}
    assert "0" not in got and all(abs(got[str(i)] - 500 * (i % 5) / 200) < 1 for i in range(100) if i % 5)


def test_require(spark):
    with pytest.raises(ValueError, match="empty: a"):
        M.require(M.violations([("empty", spark.createDataFrame([("a", "b")], ["key", "detail"]))]))


def test_batch_predict_order(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], ["id", "x"])
    got = {r.id: [t.class_id for t in r.top] for r in predict.batch_predict(rows, "id", "x", lambda: lambda x: x @ [[0.0, 2.0, 1.0], [0.0, 0.0, 0.0]], k=2).collect()}
    assert got == {1: [1, 2], 2: [0, 1]}


def test_saved_heads(spark, tmp_path):
    """Saved and loaded heads give the logits of plain products with the fitted weights, and of the fit itself; rows without vectors have none."""
    import numpy as np
    from pyspark.ml.classification import LogisticRegressionModel

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    y = (x[:, :3] + rng.normal(size=(300, 3)) * 0.2).argmax(axis=1)
    rows = [(i, [float(v) for v in x[i]], int(y[i]), int(y[i] % 2)) for i in range(300)] + [(300, None, 1, 1), (301, [0.0] * 6, None, None)]
    df = spark.createDataFrame(rows, "id int, v array<double>, a int, b int").repartition(3)
    predict.fit_heads(df, "v", {"one": "a", "two": "b"}, str(tmp_path))
    predict.fit_heads(df, "v", {"two": "b"}, str(tmp_path))
    got = {r.id: r for r in predict.score_heads(df, "v", ["one", "two"], str(tmp_path), 6, batch=7).collect()}
    assert len(got) == 302 and got[300].one_logits is None and got[300].two_logits is None
    for name, k in (("one", 3), ("two", 2)):
        m = LogisticRegressionModel.load(f"{tmp_path}/{name}")
        want = x @ m.coefficientMatrix.toArray().T + m.interceptVector.toArray()
        assert want.shape == (300, k) and all(np.allclose(got[i][f"{name}_logits"], want[i]) for i in range(300))
    fitted = {r.id: r.logits for r in predict.linear_probe(df.where("a is not null and v is not null"), "v", "a").collect()}
    assert all(np.allclose(got[i].one_logits, z, atol=1e-6) for i, z in fitted.items())
    assert np.mean([np.argmax(got[i].one_logits) == y[i] for i in range(300)]) > 0.9


def test_linear_heads_query(spark, sf):
    """The query's metrics are those of the plain fits of the same heads."""
    from plumbline.operators import classification as C
    from plumbline.plans import scoring

    e = spark.read.parquet(f"{sf}/embeddings.parquet").withColumnRenamed("label", "target")
    got = {r["head"]: r for r in scoring.linear_heads(spark, sf).collect()}
    assert got.keys() == {"class", "host", "category"} and all(0 <= r.top1 <= r.top5 <= 100 for r in got.values())
    plain = predict.linear_probe(e, "embedding", "target").select("target", "logits", "pred")
    assert abs(C.topk_accuracy(plain).first().top1 - got["class"].top1) < 0.5 and abs(C.macro_f1(C.confusion_matrix(plain)).first().macro_f1 - got["class"].macro_f1) < 0.5


def test_linear_probe_learns(spark, sf):
    from plumbline.plans.scoring import linear_probe_fit

    rows = linear_probe_fit(spark, sf).where("head = 'category_target'")
    total, right = rows.agg(F.sum("n"), F.sum(F.when(F.col("target") == F.col("pred"), F.col("n")))).first()
    assert right > 0.55 * total


def test_resolve_host_words_in_brackets(spark):
    aliases = spark.createDataFrame([("rice", "R"), ("sweet corn", "S"), ("corn", "C")], ["alias", "host"])
    names = spark.createDataFrame([("pest rice(china)",), ("old sweet corn",), ("sweet corn (old)",), ("x (sweet corn leaf)",), ("ricefield",), ("rice corn",), ("a rice and corn",), ("",), (None,)], ["name"])
    got = {r.name: (r.host, r.tier, r.status) for r in T.resolve_host(names, aliases, spark.createDataFrame([], "name string, host string")).collect()}
    assert got["pest rice(china)"] == ("R", 3, "ok")
    assert got["old sweet corn"] == ("C", 3, "ok")  # an alias of two words is no word
    assert got["sweet corn (old)"] == ("S", 2, "ok") and got["x (sweet corn leaf)"] == ("S", 1, "ok")
    assert got["ricefield"] == (None, None, "unresolved") and got["rice corn"] == ("R", 2, "ok")
    assert got["a rice and corn"] == (None, 3, "ambiguous")


def test_group_split_covers_classes_without_a_home(spark):
    """Class 9 shares each of its groups with a smaller class, whose own groups take the reserved places."""
    rows = []
    for c in range(5):
        rows += [(f"g{c}", c, 5, 10, 2, f"{c}a"), (f"g{c}", 9, 5, 10, 2, f"{c}a")] + [(f"s{c}{k}", c, 1, 1, 1, f"{c}{k}") for k in range(3)]
    g = spark.createDataFrame(rows, "group_id string, class_id int, n long, size long, n_classes long, tie_break string")
    s = M.group_split(g)
    assert M.missing_coverage(g, s).count() == 0 and s.count() == s.select("group_id").distinct().count() == 20
    alone = g.where("group_id like 'g%'")  # nothing can move: each smaller class has this one group
    with pytest.raises(ValueError, match="class 9"):
        M.group_split(alone)


def test_multilabel_split_of_a_dominant_label(spark):
    rows = [(i, 0) for i in range(3000)] + [(i, 1 + i % 7) for i in range(0, 3000, 5)] + [(1, 50), (2, 51), (3, 51)]
    labels = spark.createDataFrame(rows, "image_id long, label int")
    out = multilabel.multilabel_split(labels, 0.25, seed=1)
    assert out.where("side = 'val'").count() == 750 and out.count() == 3000
    both = {r.label: (r.v, r.n) for r in labels.join(out, "image_id").groupBy("label").agg(F.count_if(F.col("side") == "val").alias("v"), F.count("*").alias("n")).collect()}
    assert all(0 < v < n for k, (v, n) in both.items() if n > 1)


def test_multilabel_split_moves_few_images_of_frequent_labels(spark):
    """The rest keep the side of their seeded number, so that what is exchanged grows as the square root of the images; labels are within half a percent of their images of their share."""
    import random

    rng = random.Random(7)
    rows = sorted({(i, rng.randrange(6)) for i in range(20000) for _ in range(rng.randint(1, 4))})
    labels = spark.createDataFrame(rows, "image_id long, label int")
    out = multilabel.multilabel_split(labels, 0.2, seed=5).localCheckpoint()
    assert out.count() == 20000 and out.where("side = 'val'").count() == 4000
    drawn = out.selectExpr("side = 'val' as val", "shiftrightunsigned(xxhash64('5:0', image_id), 11) / double(9007199254740992) < 0.2 as drawn")
    assert drawn.where("val <> drawn").count() < 1000
    each = labels.join(out, "image_id").groupBy("label").agg(F.count_if(F.col("side") == "val").alias("v"), F.count("*").alias("n")).collect()
    assert all(abs(r.v - r.n * 0.2) <= r.n * 0.005 for r in each)


def test_multilabel_split_writes_only_images_near_the_ratio(spark, monkeypatch):
    """Neither all images nor all their labels are written again: what is, is by image, and few of them where labels are frequent."""
    import random

    rng, written = random.Random(9), []
    put = multilabel.stored
    monkeypatch.setattr(multilabel, "stored", lambda df: written.append(put(df)) or written[-1])
    images = spark.createDataFrame([(i, sorted(rng.sample(range(5), rng.randint(1, 3)))) for i in range(20000)], "image_id long, labels array<int>").localCheckpoint()
    out = multilabel.split_images(images, 0.2, seed=5, rounds=3)
    assert out.columns == ["image_id", "labels", "side"] and out.exceptAll(images.join(out.select("image_id", "side"), "image_id")).count() == 0
    assert out.count() == 20000 and out.where("side = 'val'").count() == 4000
    assert written and max(w.count() for w in written) < 5000


def test_multilabel_split_of_few_images(spark):
    schema = "image_id string, label string"
    assert multilabel.multilabel_split(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in multilabel.multilabel_split(spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], schema)).orderBy("image_id").collect()] == [("a", "train"), ("b", "train")]
    alone = spark.createDataFrame([(str(i), str(i)) for i in range(5)], schema)
    assert multilabel.multilabel_split(alone, 0.4).where("side = 'val'").count() == 2
    with pytest.raises(ValueError, match="last training image"):
        multilabel.multilabel_split(spark.createDataFrame([("a", "x"), ("b", "x")], schema), 0.9)


def test_ranks_in_stretches(spark):
    from plumbline.operators.prefix import ranked

    rows = spark.range(5000).selectExpr("id % 3 as k", "cast((id * 7919) % 101 as double) as v", "sha2(cast(id as string), 256) as tie")
    plain = rows.selectExpr("*", "row_number() over (partition by k order by v, tie) as at")
    assert ranked(rows, ["k"], "v", "tie", "at").exceptAll(plain.select("k", "v", "tie", "at")).count() == 0
    assert ranked(rows.limit(0), [], "v", "tie", "at").count() == 0


def test_annotation_errors(spark):
    schema = "image_id string, doc int, obj_id int, source_label int, width int, height int, xmin double, ymin double, xmax double, ymax double"
    ok = (5.0, 5.0, 9.0, 9.0)
    rows = [
        ("twice", 0, 0, 1, 10, 10, *ok), ("twice", 1, 0, 1, 10, 10, *ok), ("two", 0, 0, 1, 10, 10, *ok), ("two", 1, 0, 2, 10, 10, 5.0, 5.0, 5.0, 9.0), ("sizes", 0, 0, 1, 10, 10, *ok), ("sizes", 1, 0, 1, 20, 10, *ok),
        ("zero", 0, 0, 1, 0, 10, *ok), ("none", 0, 0, 1, None, 10, *ok), ("nobox", 0, 0, 1, 10, 10, None, None, None, None), ("nolabel", 0, 0, None, 10, 10, *ok), ("odd", 0, 0, 7, 10, 10, *ok), ("flat", 0, 0, 1, 10, 10, 5.0, 5.0, 5.0, 5.0),
    ]
    b = spark.createDataFrame(rows, schema)
    m = spark.createDataFrame([(1, 1, 30), (2, 2, 40)], "source_label int, detector_label int, public_id int")
    got = {r.image_id: r for r in X.annotation_clean(b, m).collect()}
    assert {k: r.error for k, r in got.items()} == {"twice": "", "two": "", "sizes": "inconsistent_size", "zero": "non_positive_size", "none": "no_size", "nobox": "incomplete_object", "nolabel": "incomplete_object", "odd": "unmapped_label", "flat": "no_valid_box"}
    assert (got["twice"].n_docs, got["twice"].n_duplicate_docs, len(got["twice"].raw_objects)) == (1, 1, 1)
    assert [(o.obj_id, o.public_id, o.valid) for o in got["two"].raw_objects] == [(0, 30, True), (1, 40, False)] and [o.detector_label for o in got["two"].objects] == [1]
    report = {(r.kind, r.key) for r in X.exceptions_report(b, spark.createDataFrame([("two",)], ["image_id"]), spark.createDataFrame([("two",), ("extra",)], ["image_id"])).collect()}
    assert {("duplicated_document", "twice"), ("extra_file", "extra"), ("label_missing_in_test", "7")} <= report and ("extra_file", "two") not in report


def test_joint_predict(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], ["id", "x"])
    names = spark.createDataFrame([(0, "a", "h0", "c0"), (1, "b", "h1", "c1")], "class_id int, name string, host string, category string")
    det = spark.createDataFrame([(1, 0, 5, 1, "b", "h1", 0.5, 1.0, 2.0, 3.0, 4.0), (1, 1, 6, 0, "a", "h0", 0.9, 1.0, 2.0, 3.0, 4.0)], "id long, det_id int, label int, class_id int, name string, host string, score double, xmin double, ymin double, xmax double, ymax double")
    model = lambda: lambda x: (x, x * 0, x * 2)
    got = {r.id: r for r in predict.joint_predict(rows, "id", "x", model, names, k=2, detections=det).collect()}
    assert [t.name for t in got[1].top] == ["a", "b"] and got[1].host.host == "h0" and got[1].host.probability == 0.5 and got[2].category.category == "c1"
    assert [d.score for d in got[1].detections] == [0.9, 0.5] and got[2].detections == []
    assert {len(r.detections) for r in predict.joint_predict(rows, "id", "x", model, names).collect()} == {0}


def _runs(spark, at, out, **how):
    """Runs the files of ``at`` to the end, one a micro-batch, from where the checkpoint beside ``out`` has got to."""
    from plumbline.streaming.runs import durable_state, run_outcomes

    stream = spark.readStream.schema("run long, epoch int, metric double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(at)
    with durable_state(spark):
        q = run_outcomes(stream, **how).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r.run, r.epoch, r.best_metric, r.best_epoch, r.outcome) for r in spark.read.parquet(out).collect())


def test_epochs_in_any_order_and_a_restart(spark, tmp_path):
    """Shuffled over micro-batches, and stopped and started between them, alerts are those of the batch operator."""
    import random

    from plumbline.operators.runs import early_stop

    rng, at, out = random.Random(5), str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(run, e, rng.choice([None, float("nan"), rng.random(), rng.random()]), None) for run in range(12) for e in range(1, rng.randint(2, 16))]
    rows += rng.sample(rows, 20)  # the same record again
    rng.shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[k::4], "run long, epoch int, metric double, ts timestamp").coalesce(1).write.mode("append").parquet(at)
        if k in (1, 3):  # a new query goes on from the checkpoint
            got = _runs(spark, at, out, patience=4)
    once = list({(r[0], r[1]): r for r in rows}.values())
    whole = early_stop(spark.createDataFrame(once, "run long, epoch int, metric double, ts timestamp"), 4)
    assert got and got == sorted((r.run, r.epoch, r.best_metric, r.best_epoch, "stopped") for r in whole.where("stop").collect())


def test_silent_runs(spark, tmp_path):
    """A run ends by its timer when the others' time has passed it; what it held is taken then, and what comes after is no new run."""
    from datetime import datetime, timedelta

    t = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    batches = [
        [(1, 1, 5.0, t(0)), (1, 4, 7.0, t(1)), (2, 1, 1.0, t(0)), (3, 1, 2.0, t(0))],  # run 1 lacks epochs 2 and 3
        [(2, 2, 3.0, t(9)), (3, 2, 1.0, t(6)), (2, 3, None, t(12))],  # run 2 pauses for nine hours
        [(3, 3, 1.0, t(13)), (3, 4, 0.5, t(14)), (3, 5, 0.5, t(15))],
        [(1, 2, 9.0, t(16)), (4, 1, 1.0, t(30))],  # run 1 has ended
    ]
    at, out = str(tmp_path / "in"), str(tmp_path / "out")
    for b in batches:
        spark.createDataFrame(b, "run long, epoch int, metric double, ts timestamp").coalesce(1).write.mode("append").parquet(at)
    got = _runs(spark, at, out, patience=4, silence=8 * 3600.0, late="1 hour")
    assert got == [(1, 4, 7.0, 4, "silent"), (2, 1, 1.0, 1, "silent"), (3, 5, 2.0, 1, "stopped")]


def test_detection_contract_counts_and_odd_rows(spark):
    """Counts come from the job of the violations; nulls fail their checks instead of passing them."""
    from plumbline.operators import contract

    lists = [("train", "a", 0), ("official_trainval", "a", 0), ("test", "b", 4), ("official_test", "b", 4), ("train", None, 1)]
    box = lambda *c: (list(c), 1, 1, 0)
    records = [("a", "i/a.jpg", "x/a.xml", 10, 10, "1", "2", 3, [box(0.0, 0.0, 10.0, 10.0)]), ("b", None, "x/b.xml", 10, None, "1", None, 2, [box(0.0, 0.0, float("nan"), 3.0), (None, None, None, None)]), ("c", "i/c.jpg", "x/c..d.xml", 1, 1, None, None, 0, [])]
    kind = "image_id string, image_path string, annotation_path string, width int, height int, image_sha256 string, annotation_sha256 string, n_raw int, objects array<struct<bbox array<double>, source_label int, detector_label int, public_id int>>"
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    images = df([("a", "1", 10, 10), ("b", "1", 10, 10), ("z", "0", 1, 1)], "image_id string, sha256 string, width int, height int")
    found, counts = contract.detection_contract(df(lists, "list string, image_id string, ord int"), df(records, kind), images, df([("a", "2")], "image_id string, sha256 string"), (1, 9), (0, 9))
    got = {(r.check, r.image_id) for r in found.collect()}
    assert got == {("unsafe_path", "b"), ("dimensions", "b"), ("invalid_box", "b"), ("label_space", "b"), ("missing_annotation", "b"), ("unlisted_record", "c"), ("missing_image", "c"), ("missing_annotation", "c"), ("official", None)}
    assert contract.unexpected(counts, {"train": 2, "test": 1, "records": 3, "images": 3, "raw_boxes": 5, "valid_boxes": 3, "failed_images": 3}) == {}
    assert contract.unexpected(counts, {"val": 1}) == {"val": (1, 0)}
    empty = contract.detection_contract(df([], "list string, image_id string, ord int"), df([], kind), images.limit(0), df([], "image_id string, sha256 string"), (1, 9), (0, 9))[0]
    assert empty.count() == 0


def test_joint_predict_keeps_rows_that_repeat_a_key(spark, monkeypatch):
    import numpy as np

    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [0.0, 2.0])], "k int, x array<double>")
    names = spark.createDataFrame([(0, "zero", "h0", "c0")], "class_id int, name string, host string, category string")
    factory = lambda: lambda x: (np.asarray(x), np.asarray(x), np.asarray(x))
    want = sorted([(1, [0, 1], ["zero", None]), (1, [1, 0], [None, "zero"]), (None, [1, 0], [None, "zero"])], key=str)
    shape = lambda out: sorted(((r.k, [t.class_id for t in r.top], [t.name for t in r.top]) for r in out.collect()), key=str)
    assert shape(predict.joint_predict(rows, "k", "x", factory, names, k=2)) == want
    monkeypatch.setattr(predict, "is_small", lambda df: False)
    assert shape(predict.joint_predict(rows, "k", "x", factory, names, k=2)) == want


def test_contract_sql_checks_the_labels_of_all_boxes_of_a_record(spark, tmp_path):
    """Order 13's only box of label 25 is empty, and its record keeps it; order 14's record leaves it out."""
    import datetime

    import duckdb

    from plumbline.plans import detection

    day = datetime.datetime(2024, 1, 1)
    tables = {
        "orders": spark.createDataFrame([(13, 1, "O", 1.0, day, "1"), (14, 1, "O", 1.0, day, "1"), (15, 1, "O", 1.0, day, "1")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": spark.createDataFrame([(k, p, 1, n, q, 1.0) for k, p, n, q in [(13, 1, 1, 1.0), (13, 2, 2, 9.0), (14, 1, 1, 1.0), (14, 2, 2, 9.0), (15, 1, 1, 9.0)]], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double"),
        "part": spark.createDataFrame([(1, "Brand#25"), (2, "Brand#11")], "p_partkey long, p_brand string"),
    }
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = {(r.check, r.image_id) for r in detection.detection_contract(spark, str(tmp_path)).collect()}
    assert got == set(con.execute(detection.SQL["detection_contract"]).fetchall())
    assert {i for c, i in got if c == "label_space"} == {"13", "15"} and ("invalid_box", "13") in got and ("invalid_box", "14") not in got


def test_linear_probe_after_an_observation(spark):
    """A session that has observed a query has a part that tasks can't be sent; a fitted model must not take it along."""
    from pyspark.sql import Observation

    seen = Observation()
    assert spark.range(3).observe(seen, F.count("*").alias("n")).count() == 3 and seen.get == {"n": 3}
    df = spark.createDataFrame([([float(i % 2), 1.0], i % 2) for i in range(20)], "v array<double>, y int")
    assert all(r.y == r.pred for r in predict.linear_probe(df, "v", "y").collect())


def test_held_epochs_take_a_few_calls_of_the_state_server():
    """However many epochs wait, a batch of a run reads and writes its states in a few calls."""
    from pyspark.sql import Row

    from plumbline.streaming.runs import _Stopping

    calls = []

    class State:
        value = None

        def __getattr__(self, name):
            def call(*given):
                calls.append(name)
                if name == "get":
                    return self.value if not isinstance(self.value, list) else iter(self.value)
                if name in ("update", "put"):
                    self.value = given[0]
                if name == "appendList":
                    self.value = (self.value or []) + given[0]
                return None

            return call

    class Handle:
        def getValueState(self, *_):  # noqa: N802
            return State()

        getListState = getMapState = getValueState  # noqa: N815

    one = _Stopping(3, None, 1.0)
    one.init(Handle())
    rows = lambda epochs: iter([Row(epoch=e, metric=1.0 / e, at=0.0) for e in epochs])
    assert list(one.handleInputRows((7,), rows(range(500, 1, -1)), None)) == [] and len(calls) <= 4
    assert list(one.handleInputRows((7,), rows([501]), None)) == [] and len(calls) <= 8
    assert [tuple(r) for r in one.handleInputRows((7,), rows([1]), None)] == [(7, 4, 1.0, 1, "stopped")] and len(calls) <= 12


def test_boxes_are_exchanged_by_image_once(spark, sf, capsys):
    """Documents, objects and counts of an image are found together: the plan has an exchange by image for each reading of the boxes, not for each grouping."""
    from plumbline.plans import detection

    detection.annotation_clean(spark, sf).explain()
    plan = capsys.readouterr().out
    assert 1 <= plan.count("Exchange hashpartitioning(image_id") <= 2 and "Union" not in plan


def test_matches_are_computed_once(spark):
    """Precision counts, samples, orders and totals the detections; what they are matched by is not worked out again for any of it."""
    seen = spark.sparkContext.accumulator(0)

    def tp(i):
        seen.add(1)
        return (1 << 40) - 1 if i % 2 == 0 else 0

    truth = spark.createDataFrame([(f"i{i}", i, 1, 0.0, 0.0, 10.0, 10.0) for i in range(10)], "image_id string, obj_id int, label int, xmin double, ymin double, xmax double, ymax double")
    found = spark.createDataFrame([(1, 1 - i / 100, f"i{i % 10}", i) for i in range(20)], "label int, score double, image_id string, det_id int")
    found = found.withColumn("tp", F.udf(tp, "long")("det_id")).withColumn("counted", F.lit((1 << 40) - 1).cast("long"))
    rows = coco.precision_table(truth, found).where("area = 'all' and t = 0").collect()
    assert seen.value == 20 and len(rows) == 1
    held = {k: k / (2 * k - 1) for k in range(1, 11)}  # the k-th true positive is at rank 2k - 1
    want = sum(max(v for k, v in held.items() if k >= max(1, -(-x * 10 // 100))) for x in range(101)) / 101
    assert abs(rows[0].ap - want) < 1e-9 and rows[0].recall == 1.0
