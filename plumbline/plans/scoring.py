"""Queries over classification scores and run histories."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import boxes as X
from plumbline.operators import classification as C
from plumbline.operators import manifest as M
from plumbline.operators import predict, runs
from plumbline.operators import taxonomy as T
from plumbline.operators.lineage import checkpointed, shared_folder
from plumbline.plans import bindings as B

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _confusion(spark, d):
    return C.confusion_matrix(C.with_prediction(B.scores(spark, d)))


def _dim(spark):
    return spark.range(12).select(F.col("id").cast("int").alias("class_id"), (F.col("id") % 3).cast("int").alias("host"))


@query(f"with {B.SCORES}, m as (select sample_id, max(z) as m from z group by 1), s as (select sample_id, sum(exp(z - m)) as s from z join m using (sample_id) group by 1) select sample_id, r as rank, cls, round(exp(z - m) / s, 6) as p from ranked join m using (sample_id) join s using (sample_id) where r <= 5")
def softmax_topk(spark, d):
    s = B.scores(spark, d).withColumn("p", S.softmax("logits")).withColumn("best", S.top_k("logits", 5))
    e = s.select("sample_id", "p", F.posexplode("best").alias("r", "cls"))
    return e.select("sample_id", (F.col("r") + 1).cast("long").alias("rank"), "cls", F.round(F.element_at("p", F.col("cls") + 1), 6).alias("p"))


@query(f"with {B.SCORES} select * from confusion")
def confusion_matrix(spark, d):
    return _confusion(spark, d)


@query(f"with {B.SCORES} select 100.0 * avg(case when r = 1 then 1.0 else 0.0 end)::double as top1, 100.0 * avg(case when r <= 5 then 1.0 else 0.0 end)::double as top5 from ranked where cls = target")
def topk_accuracy(spark, d):
    return C.topk_accuracy(B.scores(spark, d))


@query(f"with {B.COUNTS} select round(avg(2 * tp / (support + predicted)) * 100, 9) as macro_f1 from counts where support > 0")
def macro_f1(spark, d):
    return C.macro_f1(_confusion(spark, d)).select(F.round("macro_f1", 9).alias("macro_f1"))


@query(f"with {B.COUNTS} select round(avg(tp / support) * 100, 9) as balanced_accuracy from counts where support > 0")
def balanced_accuracy(spark, d):
    return C.balanced_accuracy(_confusion(spark, d)).select(F.round("balanced_accuracy", 9).alias("balanced_accuracy"))


_REPORT = B.COUNTS + """, report as (select i::int as class_id, coalesce(support, 0) as support, round(case when predicted > 0 then tp / predicted else 0.0 end, 6) as precision,
  round(case when support > 0 then tp / support else 0.0 end, 6) as recall, round(case when support + predicted > 0 then 2 * tp / (support + predicted) else 0.0 end, 6) as f1 from range(0, 12) r(i) left join counts on class_id = i)"""


@query(f"with {_REPORT} select * from report")
def per_class_report(spark, d):
    return C.per_class_report(_confusion(spark, d), _dim(spark).select("class_id"))


@query(f"""with {B.SCORES} select target % 3 as host, cast(sum(n) as bigint) as support, cast(sum(case when target % 3 = pred % 3 then n else 0 end) as bigint) as correct,
  round(sum(case when target % 3 = pred % 3 then n else 0 end) / sum(n), 6) as accuracy from confusion group by 1""")
def group_breakdown(spark, d):
    return C.group_breakdown(_confusion(spark, d), _dim(spark))


@query(f"with {B.SCORES} select * from confusion where target <> pred order by n desc, target, pred limit 10")
def confused_pairs(spark, d):
    return C.confused_pairs(_confusion(spark, d))


@query(f"with {_REPORT} (select 'worst' as side, class_id, f1 from report where support > 0 order by f1, class_id limit 5) union all (select 'best', class_id, f1 from report where support > 0 order by f1 desc, class_id limit 5)")
def worst_best_classes(spark, d):
    return C.worst_best(C.per_class_report(_confusion(spark, d), _dim(spark).select("class_id")), "f1")


_LOSS = B.SCORES + """, n as (select target, count(*) as n from preds group by 1), w0 as (select target, 1 / sqrt(n) as w from n), w as (select target, w / ((select avg(w) from w0)) as w from w0),
m as (select sample_id, max(z) as m from z group by 1), l as (select sample_id, target, cls, z - m - ln(sum(exp(z - m)) over (partition by sample_id)) as lp from z join m using (sample_id)),
t as (select sample_id, any_value(target) as target, sum(lp) as total, sum(case when cls = target then lp end) as own from l group by 1)"""


def _weights(scores):
    counts = scores.groupBy(F.col("target").alias("class_id")).agg(F.count("*").alias("n"))
    return M.class_weights(counts, counts.select("class_id"))


@query(f"with {_LOSS} select round(avg(w * power(1 - exp(own), 2) * -(own * 0.9::double + (total - own) * (0.1::double / 9))), 6) as loss from t join w using (target)")
def focal_loss(spark, d):
    s = B.scores(spark, d)
    return C.focal_loss(s, _weights(s), 10).select(F.round("loss", 6).alias("loss"))


@query(f"""with {_LOSS}, h as (select sample_id, cls % 5 as c, sum(z) as z, any_value(target) % 5 as target from z group by 1, 2), hl as (select sample_id, target, c, z - max(z) over (partition by sample_id) as z from h),
hp as (select sample_id, target, c, z - ln(sum(exp(z)) over (partition by sample_id)) as lp from hl), hc as (select sample_id, -(sum(case when c = target then lp end) * 0.95::double + sum(lp) * (0.05::double / 5)) as ce from hp group by 1),
k as (select sample_id, cls % 2 as c, sum(z) as z, any_value(target) % 2 as target from z group by 1, 2), kl as (select sample_id, target, c, z - max(z) over (partition by sample_id) as z from k),
kp as (select sample_id, target, c, z - ln(sum(exp(z)) over (partition by sample_id)) as lp from kl), kc as (select sample_id, -(sum(case when c = target then lp end) * 0.95::double + sum(lp) * (0.05::double / 2)) as ce from kp group by 1)
select round(avg(w * power(1 - exp(own), 2) * -(own * 0.9::double + (total - own) * (0.1::double / 9)) + 0.2 * hc.ce + 0.05 * kc.ce), 6) as loss from t join w using (target) join hc using (sample_id) join kc using (sample_id)""")
def multitask_loss(spark, d):
    s = B.scores(spark, d)
    folded = lambda k: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda h: F.aggregate(F.filter("logits", lambda x, i: i % k == h), F.lit(0.0), lambda a, x: a + x))
    s2 = s.withColumn("host_logits", folded(5)).withColumn("category_logits", folded(2)).withColumn("host_target", F.col("target") % 5).withColumn("category_target", F.col("target") % 2)
    return C.multitask_loss(s2, _weights(s), 10, 5, 2).select(F.round("loss", 6).alias("loss"))


def _centres(e) -> np.ndarray:
    """The labels' mean vectors, a row a class."""
    each = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    rows = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c")).orderBy("label").collect()
    return np.array([r.c for r in rows])


@query(f"with {B.SCORES} select sample_id as vec_id, cls as class_id, z as score, cast(r as int) as rank from ranked where r <= 5")
def batch_predict(spark, d):
    e = B.table(spark, d, "embeddings")
    centre = _centres(e)
    out = predict.batch_predict(e, "vec_id", "embedding", lambda: lambda x: np.round(x @ centre.T, 6))
    return out.select("vec_id", F.posexplode("top").alias("r", "t")).select("vec_id", "t.class_id", "t.score", (F.col("r") + 1).alias("rank"))


_JOINT = f"""with {B.DETECTIONS}, {B.SCORES.replace("ranked as", "zr as").replace("from ranked", "from zr").replace("mean as", "mean_ as").replace("join mean using", "join mean_ using")},
zz as (select sample_id, cls, z as x, 'class' as head from z union all select sample_id, cls % 5, sum(z), 'host' from z group by 1, 2 union all select sample_id, cls % 2, sum(z), 'category' from z group by 1, 2),
sm as (select sample_id, head, cls, exp(x - mx) / sum(exp(x - mx)) over w as p from (select *, max(x) over (partition by sample_id, head) as mx from zz) window w as (partition by sample_id, head)),
top as (select sample_id, head, max(p) as p from sm group by all), best as (select sample_id, cls from zr where r = 1),
pd as (select image_id, det_id, round(score, 6) as score, row_number() over (partition by image_id order by round(score, 6) desc, det_id) as r from dets where score >= 0.3),
nd as (select image_id, count(*) as n, max(score) as s from pd where r <= 30 group by 1)
select b.sample_id as vec_id, cls as class_id, 'class ' || cls as name, 'host' || cls % 5 as host, round(h.p, 6) as host_p, 'category' || cls % 2 as category, round(c.p, 6) as category_p, round(t.p, 6) as probability, 5 as n_top, cast(coalesce(n, 0) as int) as n_detections, s as best_score
from best b join top t on t.sample_id = b.sample_id and t.head = 'class' join top h on h.sample_id = b.sample_id and h.head = 'host' join top c on c.sample_id = b.sample_id and c.head = 'category' left join nd on image_id = cast(b.sample_id as varchar)"""


@query(_JOINT)
def joint_predict(spark, d):
    """Class, host and category heads by centroids, and the detections of the image with the vector's number."""
    e = B.table(spark, d, "embeddings")
    centre = _centres(e)
    fold = lambda z, k: np.stack([z[:, i::k].sum(axis=1) for i in range(k)], axis=1)

    def model(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.round(x @ centre.T, 6)
        return z, fold(z, 5), fold(z, 2)

    names = spark.range(len(centre)).select(F.col("id").cast("int").alias("class_id"), F.concat(F.lit("class "), "id").alias("name"), F.concat(F.lit("host"), F.col("id") % 5).alias("host"), F.concat(F.lit("category"), F.col("id") % 2).alias("category"))
    found = X.postprocess(B.detections(B.boxes(spark, d)))
    label_map = found.select(F.col("label").alias("detector_label"), (F.col("label") % 10).alias("public_id")).distinct()
    found = T.map_predictions(found, label_map, names).withColumnRenamed("public_id", "class_id").withColumn("vec_id", F.col("image_id").cast(e.schema["vec_id"].dataType))
    out = predict.joint_predict(e, "vec_id", "embedding", lambda: model, names, detections=found)
    first = F.get("top", F.lit(0))
    return out.select(
        "vec_id", first["class_id"].alias("class_id"), first["name"].alias("name"), F.col("host.host").alias("host"), F.col("host.probability").alias("host_p"), F.col("category.category").alias("category"),
        F.col("category.probability").alias("category_p"), first["probability"].alias("probability"), F.size("top").alias("n_top"), F.size("detections").alias("n_detections"), F.get("detections", F.lit(0))["score"].alias("best_score"),
    )


@query()
def linear_probe_fit(spark, d):
    e = B.table(spark, d, "embeddings").withColumnRenamed("label", "target").withColumn("host_target", F.col("target") % 5).withColumn("category_target", F.col("target") % 2)
    counts = e.groupBy(F.col("target").alias("class_id")).agg(F.count("*").alias("n"))
    weighted = e.join(M.class_weights(counts, counts.select("class_id")).withColumnRenamed("class_id", "target"), "target")
    out = None
    for head in ("target", "host_target", "category_target"):
        rows = C.confusion_matrix(predict.linear_probe(weighted, "embedding", head, "weight").select(F.col(head).alias("target"), "pred")).withColumn("head", F.lit(head))
        out = rows if out is None else out.union(rows)
    return out


@query()
def linear_heads(spark, d):
    """Class, host and category heads fitted, saved in the shared folder, loaded, and scored in one pass; how good each is on the rows it was fitted on, in percent."""
    e = B.table(spark, d, "embeddings").withColumnRenamed("label", "target").withColumn("host_target", F.col("target") % 5).withColumn("category_target", F.col("target") % 2)
    at = f"{shared_folder(spark)}/plumbline/heads-{uuid.uuid4().hex}"
    heads = {"class": "target", "host": "host_target", "category": "category_target"}
    predict.fit_heads(e, "embedding", heads, at)
    width = e.select(F.max(F.size("embedding"))).first()[0]
    scored = checkpointed(predict.score_heads(e, "embedding", list(heads), at, width).drop("embedding"))
    out = None
    for name, target in heads.items():
        s = C.with_prediction(scored.select(F.col(target).alias("target"), F.col(f"{name}_logits").alias("logits")))
        confusion = checkpointed(C.confusion_matrix(s))
        row = C.topk_accuracy(s).crossJoin(C.macro_f1(confusion)).crossJoin(C.balanced_accuracy(confusion)).withColumn("head", F.lit(name))  # one row each
        out = row if out is None else out.union(row)
    return out


_STATES = """states as (select event_id, user_id as run, ts as updated_at, event_id % 50 as step, 50 as steps_per_epoch, event_id % 9 + 1 as epoch, 10 as epochs, abs(value) as seconds_per_step from events)"""


def _states(spark, d):
    e = B.table(spark, d, "events")
    return e.select("event_id", F.col("user_id").alias("run"), F.col("ts").alias("updated_at"), (F.col("event_id") % 50).alias("step"), F.lit(50).alias("steps_per_epoch"), (F.col("event_id") % 9 + 1).alias("epoch"), F.lit(10).alias("epochs"), F.abs("value").alias("seconds_per_step"))


def _clock(x: str) -> str:
    return f"lpad(cast(floor(floor({x}) / 3600)::bigint as varchar), greatest(2, length(cast(floor(floor({x}) / 3600)::bigint as varchar)))::int, '0') || ':' || lpad(cast(floor(floor({x}) / 60)::bigint % 60 as varchar), 2, '0') || ':' || lpad(cast(floor({x})::bigint % 60 as varchar), 2, '0')"


@query(f"""with {_STATES} select event_id, round(100.0::double * step / 50, 2) as batch_percent, round(100.0::double * ((epoch - 1) * 50 + step) / 500, 2) as global_percent,
  {_clock('(50 - step) * seconds_per_step')} as eta_epoch, {_clock('(500 - (epoch - 1) * 50 - step) * seconds_per_step')} as eta_total from states""")
def progress_fields(spark, d):
    return runs.progress_fields(_states(spark, d)).select("event_id", "batch_percent", "global_percent", "eta_epoch", "eta_total")


@query("""select user_id as run, cast(k as int) as epoch, round(sum(value * (k + 1)) / sum(k + 1), 6) as mean_loss, cast(sum(k + 1) as bigint) as samples from (select *, event_id % 7 as k from events) group by 1, 2""")
def epoch_running_means(spark, d):
    k = F.col("event_id") % 7
    e = B.table(spark, d, "events").select(F.col("user_id").alias("run"), k.cast("int").alias("epoch"), F.col("value").alias("loss"), (k + 1).alias("size"))
    return runs.epoch_running_means(e).withColumn("mean_loss", F.round("mean_loss", 6))


@query(f"with {B.HISTORY} select * from bests")
def best_so_far(spark, d):
    return runs.best_so_far(B.history(spark, d)).select("run", "epoch", "metric", "best_metric", "best_epoch")


_STOP = B.HISTORY + """, s as (select *, epoch - best_epoch as since, sum((epoch - best_epoch >= 5)::int) over (partition by run order by epoch rows unbounded preceding) as o from bests)"""


@query(f"with {_STOP} select run, epoch, best_metric, best_epoch, since as epochs_since_best, since >= 5 as stop from s where o = 0 or (o = 1 and since >= 5)")
def early_stop(spark, d):
    return runs.early_stop(B.history(spark, d), 5).select("run", "epoch", "best_metric", "best_epoch", "epochs_since_best", "stop")


@query(f"with {_STATES} select run, updated_at, event_id, (select count(distinct run) from states) as runs from states order by updated_at desc, run desc, event_id desc limit 1")
def latest_run(spark, d):
    return runs.latest_run(_states(spark, d).select("run", "updated_at", "event_id")).select("run", "updated_at", "event_id", "runs")
