"""Queries over boxes and detections derived from lineitem and part."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import boxes as X
from plumbline.operators import coco, contract, multilabel
from plumbline.operators import manifest as M
from plumbline.operators import taxonomy as T
from plumbline.operators.lineage import checkpointed, stored
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


@query(f"with {B.REASONS} select image_id, obj_id, array_to_string(filter_reasons, ',') as reasons, len(filter_reasons) = 0 as valid from reasons")
def box_filter_reasons(spark, d):
    return X.with_reasons(B.boxes(spark, d)).select("image_id", "obj_id", F.array_join("filter_reasons", ",").alias("reasons"), "valid")


@query(f"with {B.BOXES} select image_id, obj_id, greatest(0.0, xmax - xmin) as w, greatest(0.0, ymax - ymin) as h, greatest(0.0, xmax - xmin) * greatest(0.0, ymax - ymin) as area from boxes")
def box_geometry(spark, d):
    return B.boxes(spark, d).select("image_id", "obj_id", S.box_width("xmin", "xmax").alias("w"), S.box_width("ymin", "ymax").alias("h"), S.box_area("xmin", "ymin", "xmax", "ymax").alias("area"))


@query(f"""with {B.DETECTIONS}, p as (select a.image_id, obj_id, det_id, greatest(0.0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0.0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin)) as i,
  greatest(0.0, a.xmax - a.xmin) * greatest(0.0, a.ymax - a.ymin) + greatest(0.0, b.xmax - b.xmin) * greatest(0.0, b.ymax - b.ymin) as s
  from truth a join dets b on a.image_id = b.image_id and a.label = b.label)
select image_id, obj_id, det_id, round(case when s - i > 0 then i / (s - i) else 0.0 end, 9) as iou from p""")
def box_iou(spark, d):
    b = B.boxes(spark, d)
    g, e = B.truth(b).select("image_id", "obj_id", "label", *(F.col(c).alias(f"g_{c}") for c in X.CORNERS)), B.detections(b)
    iou = S.box_iou(tuple(f"g_{c}" for c in X.CORNERS), X.CORNERS)
    return g.join(e, ["image_id", "label"]).select("image_id", "obj_id", "det_id", F.round(iou, 9).alias("iou"))


@query(f"""with {B.BOXES} select image_id, obj_id, width - xmax as flip_xmin, width - xmin as flip_xmax, least(greatest(xmin, 0.0), width) as clip_xmin, least(greatest(ymin, 0.0), height) as clip_ymin,
  least(greatest(xmax, 0.0), width) as clip_xmax, least(greatest(ymax, 0.0), height) as clip_ymax from boxes""")
def box_flip_clip(spark, d):
    b = B.boxes(spark, d).withColumn("f", S.box_hflip(*X.CORNERS, "width")).withColumn("c", S.box_clip(*X.CORNERS, "width", "height"))
    return b.select("image_id", "obj_id", F.col("f.xmin").alias("flip_xmin"), F.col("f.xmax").alias("flip_xmax"), *(F.col(f"c.{c}").alias(f"clip_{c}") for c in X.CORNERS))


@query(f"""with {B.BOXES}, m as (select distinct cast(replace(p_brand, 'Brand#', '') as int) as source_label, (cast(replace(p_brand, 'Brand#', '') as int) * 7) % 23 as public_id from part where cast(replace(p_brand, 'Brand#', '') as int) % 10 <> 4)
select image_id, obj_id, source_label, public_id, (select count(distinct public_id) from m x where x.public_id <= m.public_id) as detector_label from boxes join m using (source_label)""")
def map_labels(spark, d):
    brand = F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int")
    m = T.assign_detector_labels(B.table(spark, d, "part").select(brand.alias("source_label"), (brand * 7 % 23).alias("public_id")).distinct().where("source_label % 10 <> 4"))
    return T.map_labels(B.boxes(spark, d), m)[0].select("image_id", "obj_id", "source_label", "public_id", F.col("detector_label").cast("long").alias("detector_label"))


@query(f"""with {B.BOXES} select source_label, count(*) as n from boxes where source_label % 10 = 4 group by 1""")
def unmapped_labels(spark, d):
    brand = F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int")
    m = B.table(spark, d, "part").select(brand.alias("source_label")).distinct().where("source_label % 10 <> 4")
    return T.map_labels(B.boxes(spark, d), m)[1].groupBy("source_label").agg(F.count("*").alias("n"))


@query(f"""with {B.DETECTIONS}, m as (select label, label * 3 % 26 as public_id from (select distinct label from dets) where label % 8 <> 0), t as (select i as class_id, 'class ' || i as name, 'host' || (i % 5) as host from range(0, 20) r(i))
select image_id, det_id, label, coalesce(public_id, -1) as public_id, coalesce(name, 'class_' || label) as name, coalesce(host, '') as host from dets left join m using (label) left join t on class_id = public_id""")
def map_predictions(spark, d):
    e = B.detections(B.boxes(spark, d))
    m = e.select(F.col("label").alias("detector_label")).distinct().where("detector_label % 8 <> 0").withColumn("public_id", F.col("detector_label") * 3 % 26)
    t = spark.range(20).select(F.col("id").cast("int").alias("class_id"), F.concat(F.lit("class "), F.col("id")).alias("name"), F.concat(F.lit("host"), F.col("id") % 5).alias("host"))
    return T.map_predictions(e, m, t).select("image_id", "det_id", "label", "public_id", "name", "host")


@query(f"with {B.BOXES} select source_label, count(distinct image_id) as images, count(*) as boxes from boxes group by 1")
def per_label_stats(spark, d):
    return X.per_label_stats(B.boxes(spark, d))


@query(f"""with {B.REASONS}, m as (select distinct cast(replace(p_brand, 'Brand#', '') as int) as source_label, (cast(replace(p_brand, 'Brand#', '') as int) * 7) % 23 as public_id from part),
l as (select source_label, public_id, dense_rank() over (order by public_id) as detector_label from m), v as (select r.*, len(filter_reasons) = 0 as valid, public_id, detector_label from reasons r left join l using (source_label))
select 'labels' as subject, 'source' as value, count(distinct source_label) as n, min(source_label)::bigint as low, max(source_label)::bigint as high from v where valid
union all select 'labels', 'detector', count(distinct detector_label), min(detector_label), max(detector_label) from v where valid
union all select 'labels', 'public', count(distinct public_id), min(public_id), max(public_id) from v where valid
union all select 'boxes', 'raw', count(*), null, null from v union all select 'boxes', 'valid', count(*), null, null from v where valid union all select 'boxes', 'filtered', count(*), null, null from v where not valid
union all select 'images', 'annotated', count(distinct image_id), null, null from v
union all select 'image_format', case when o_orderstatus = 'P' then 'PNG' else 'JPEG' end, count(*), null, null from orders group by 2
union all select 'image_mode', case when o_orderpriority = '5-LOW' then 'L' else 'RGB' end, count(*), null, null from orders group by 2""")
def label_space_audit(spark, d):
    brand = F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int")
    m = T.assign_detector_labels(B.table(spark, d, "part").select(brand.alias("source_label"), (brand * 7 % 23).alias("public_id")).distinct())
    images = B.table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "PNG").otherwise("JPEG").alias("image_format"), F.when(F.col("o_orderpriority") == "5-LOW", "L").otherwise("RGB").alias("image_mode"))
    return X.label_space_audit(B.boxes(spark, d), m, images)


def _documents(b):
    """Boxes with the annotation document that they are of: images with a box whose pk is a multiple of nine have theirs twice."""
    twice = F.max(F.col("pk") % 9 == 0).over(W.partitionBy("image_id"))
    return b.withColumn("twice", twice).withColumn("doc", F.explode(F.when(F.col("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("twice")


@query(f"""with {B.REASONS} select image_id, count(*) as raw, count(*) filter (where len(filter_reasons) = 0) as valid, coalesce(string_agg(cast(obj_id as varchar), ',' order by obj_id) filter (where len(filter_reasons) = 0), '') as kept,
  1 as n_docs, cast(max((pk % 9 = 0)::int) as bigint) as n_duplicate_docs, sum(case when len(filter_reasons) = 0 then source_label * 7 % 23 else 0 end)::bigint as public_sum,
  case when bool_or(source_label % 10 = 4) then 'unmapped_label' when count(*) filter (where len(filter_reasons) = 0) = 0 then 'no_valid_box' else '' end as error from reasons group by 1""")
def annotation_clean(spark, d):
    brand = F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int")
    m = T.assign_detector_labels(B.table(spark, d, "part").select(brand.alias("source_label"), (brand * 7 % 23).alias("public_id")).distinct().where("source_label % 10 <> 4"))
    c = X.annotation_clean(_documents(B.boxes(spark, d)), m)
    ids = F.array_join(F.transform("objects", lambda o: o["obj_id"].cast("string")), ",").alias("kept")
    public = F.aggregate("objects", F.lit(0).cast("long"), lambda a, o: a + F.coalesce(o["public_id"], o["source_label"] * 7 % 23))
    return c.select("image_id", F.size("raw_objects").cast("long").alias("raw"), F.size("objects").cast("long").alias("valid"), ids, "n_docs", "n_duplicate_docs", public.alias("public_sum"), "error")


#: Test images: the first of a seeded order, as a smoke run takes them.
_TEST_IMAGES = 8
_TEST_SQL = f"tests as (select image_id from (select distinct image_id from boxes) order by sha256('7:' || image_id) limit {_TEST_IMAGES})"


def _test_images(b):
    return M.seeded_order(b.select("image_id").distinct(), 7, "image_id", _TEST_IMAGES).select("image_id")


@query(f"""with {B.REASONS}, {_TEST_SQL} select 'filtered_box' as kind, image_id || '/' || obj_id as key, array_to_string(filter_reasons, ',') as detail from reasons where len(filter_reasons) > 0
union all select 'duplicated_document', image_id, '1' from boxes group by image_id having bool_or(pk % 9 = 0)
union all select 'extra_file', cast(o_orderkey as varchar), '' from orders where o_orderkey not in (select l_orderkey from lineitem)
union all select 'label_missing_in_test', cast(source_label as varchar), '' from (select distinct source_label from boxes) where source_label not in (select source_label from boxes where image_id in (select image_id from tests))""")
def exceptions_report(spark, d):
    b = B.boxes(spark, d)
    return X.exceptions_report(_documents(b), _test_images(b), B.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("image_id")))


@query(f"with {B.BOXES}, {_TEST_SQL} select distinct source_label from boxes where source_label not in (select source_label from boxes where image_id in (select image_id from tests))")
def label_gap(spark, d):
    b = B.boxes(spark, d)
    return X.label_gap(b, _test_images(b))


@query(f"""with {B.BOXES}, i as (select image_id, count(*) as k from boxes group by 1)
select (select count(*) from i) as images, (select avg(k) from i) as objects_per_image, (select avg((k = 1)::int) from i) as single_object_share,
  (select quantile_cont(greatest(0.0, xmax - xmin) * greatest(0.0, ymax - ymin) / (width * height), 0.5) from boxes) as median_relative_area""")
def dataset_geometry(spark, d):
    return X.dataset_geometry(B.boxes(spark, d))


@query("select l_orderkey as image_id, l_partkey, l_suppkey, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) - 1 as obj_id from lineitem")
def object_index(spark, d):
    line = B.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "image_id")
    out = X.object_index(line, ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice"])
    return out.select("image_id", "l_partkey", "l_suppkey", F.col("obj_id").cast("long").alias("obj_id"))


@query(f"""with {B.BOXES}, c as (select source_label, count(*) as n from boxes group by 1), f as (select source_label, least(8.0, sqrt((select max(n) from c)::double / n)) as f from c),
w as (select image_id, max(f) as f from boxes join f using (source_label) group by 1)
select cast(o_orderkey as varchar) as image_id, round(coalesce(f, 1.0), 9) as factor from orders left join w on w.image_id = cast(o_orderkey as varchar)""")
def repeat_factors(spark, d):
    images = B.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("image_id"))
    return X.repeat_factors(B.boxes(spark, d), images).select("image_id", F.round("factor", 9).alias("factor"))


@query(f"""with recursive {B.DETECTIONS}, gd as (select image_id, label, count(*) as n_truth from truth group by all),
nd as (select image_id, label, det_id, row_number() over (partition by image_id, label order by score desc, det_id) as r, xmin, ymin, xmax, ymax from dets where score >= 0.5),
p as (select t.image_id, t.label, obj_id, r, greatest(0.0, least(t.xmax, n.xmax) - greatest(t.xmin, n.xmin)) * greatest(0.0, least(t.ymax, n.ymax) - greatest(t.ymin, n.ymin)) as i,
  (t.xmax - t.xmin) * (t.ymax - t.ymin) + greatest(0.0, n.xmax - n.xmin) * greatest(0.0, n.ymax - n.ymin) as s from truth t join nd n using (image_id, label)),
c as (select image_id, label, r, obj_id, i / (s - i) as iou from p where s - i > 0 and i / (s - i) >= 0.5),
cand as (select image_id, label, r, list({{'m': -iou, 'o': obj_id}} order by iou desc, obj_id) as l from c group by all),
seq as (select *, row_number() over (partition by image_id, label order by r) as q from cand),
walk as (select image_id, label, q, [x.o for x in l][1:1] as used from seq where q = 1
  union all select s.image_id, s.label, s.q, list_concat(w.used, ([x.o for x in s.l if not list_contains(w.used, x.o)])[1:1]) from walk w join seq s on s.image_id = w.image_id and s.label = w.label and s.q = w.q + 1),
tp as (select image_id, label, max(len(used)) as tp from walk group by all), n as (select image_id, label, count(*) as n from nd group by all)
select image_id, label, cast(n_truth as int) as n_truth, cast(coalesce(n, 0) as int) as n_detections, cast(coalesce(tp, 0) as int) as tp from gd left join tp using (image_id, label) left join n using (image_id, label)""")
def box_match(spark, d):
    b = B.boxes(spark, d)
    return X.matched(B.truth(b), B.detections(b))


@query()
def precision_recall_at_iou(spark, d):
    b = B.boxes(spark, d)
    return X.precision_recall(X.matched(B.truth(b), B.detections(b)))


SQL["precision_recall_at_iou"] = f"with m as ({SQL['box_match']}) select sum(tp)::bigint as tp, sum(n_detections - tp)::bigint as fp, sum(n_truth - tp)::bigint as fn, sum(tp) / sum(n_detections) as precision, sum(tp) / sum(n_truth) as recall from m"


@query(f"""with {B.DETECTIONS} select image_id, det_id, label, round(score, 6) as score, round(xmin, 2) as xmin, round(ymin, 2) as ymin, round(xmax, 2) as xmax, round(ymax, 2) as ymax, cast(r as int) as rank
from (select *, row_number() over (partition by image_id order by score desc, det_id) as r from dets where score >= 0.3) where r <= 30""")
def detection_postprocess(spark, d):
    return X.postprocess(B.detections(B.boxes(spark, d)))


@query(f"""with recursive {B.DETECTIONS}, n as (select *, row_number() over (partition by image_id, label order by score desc, det_id) as r from dets),
ov as (select a.image_id, a.label, b.r, list(a.r) as over from n a join n b on a.image_id = b.image_id and a.label = b.label and a.r < b.r where
  greatest(0.0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0.0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))
  > 0.5 * (greatest(0.0, a.xmax - a.xmin) * greatest(0.0, a.ymax - a.ymin) + greatest(0.0, b.xmax - b.xmin) * greatest(0.0, b.ymax - b.ymin) - greatest(0.0, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * greatest(0.0, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))) group by all),
s as (select n.image_id, n.label, n.r, coalesce(over, []) as over from n left join ov using (image_id, label, r)),
w as (select image_id, label, r, [r] as kept from s where r = 1
  union all select s.image_id, s.label, s.r, case when list_has_any(w.kept, s.over) then w.kept else list_append(w.kept, s.r) end from w join s on s.image_id = w.image_id and s.label = w.label and s.r = w.r + 1),
k as (select image_id, label, unnest(arg_max(kept, r)) as r from w group by image_id, label)
select image_id, label, det_id, score from (select n.*, row_number() over (partition by image_id order by score desc, det_id) as q from n join k using (image_id, label, r)) where q <= 100""")
def class_nms(spark, d):
    return X.class_nms(B.detections(B.boxes(spark, d)))


# What a detection takes, setting by setting: walks over an image's and label's detections in order of score; ``l`` lists what each could take, best first.
_AP = f"""with recursive {B.DETECTIONS},
setting as (select a, lo, hi, t, 0.5::double + 0.05::double * t as least from (values ('all', 0.0::double, 1e10::double), ('small', 0, 1024), ('medium', 1024, 9216), ('large', 9216, 1e10)) v(a, lo, hi), range(0, 10) r(t)),
gt as (select *, (xmax - xmin) * (ymax - ymin) as area from truth),
nd as (select * from (select *, row_number() over (partition by image_id, label order by score desc, det_id) as r, greatest(0.0, xmax - xmin) * greatest(0.0, ymax - ymin) as area
  from dets where score >= 0.05 and image_id in (select image_id from truth) and label in (select label from truth)) where r <= 100),
p as (select gt.image_id, gt.label, obj_id, r, gt.area as g_area, gt.area + nd.area as s, greatest(0.0, least(gt.xmax, nd.xmax) - greatest(gt.xmin, nd.xmin)) * greatest(0.0, least(gt.ymax, nd.ymax) - greatest(gt.ymin, nd.ymin)) as i from gt join nd using (image_id, label)),
c as (select image_id, label, obj_id, r, g_area, i / (s - i) as iou from p where s - i > 0 and i / (s - i) >= 0.5),
cand as (select image_id, label, a, t, r, list({{'o': obj_id, 'inside': g_area between lo and hi}} order by (g_area between lo and hi) desc, iou desc, obj_id desc) as l from c join setting on iou >= least group by all),
seq as (select *, row_number() over (partition by image_id, label, a, t order by r) as q from cand),
walk as (select image_id, label, a, t, r, q, l[1:1] as pick, [l[1].o] as used from seq where q = 1
  union all select s.image_id, s.label, s.a, s.t, s.r, s.q, ([x for x in s.l if not list_contains(w.used, x.o)])[1:1], list_concat(w.used, ([x.o for x in s.l if not list_contains(w.used, x.o)])[1:1])
  from walk w join seq s on s.image_id = w.image_id and s.label = w.label and s.a = w.a and s.t = w.t and s.q = w.q + 1),
judged as (select nd.image_id, nd.label, s.a, s.t, nd.score, nd.det_id, coalesce(len(pick), 0) > 0 as taken, coalesce(pick[1].inside, false) as tp, nd.area between lo and hi as inside
  from nd cross join setting s left join walk w on w.image_id = nd.image_id and w.label = nd.label and w.a = s.a and w.t = s.t and w.r = nd.r),
ranked as (select *, row_number() over w as n, sum(tp::int) over w as k from judged where tp or (not taken and inside) window w as (partition by label, a, t order by score desc, image_id, det_id rows unbounded preceding)),
hits as (select label, a, t, k, max(k / n) over (partition by label, a, t order by k desc rows unbounded preceding) as envelope from ranked where tp),
npig as (select label, a, t, count(*) as npig from gt join setting on area between lo and hi group by all),
ap as (select label, a, t, sum(coalesce(envelope, 0.0)) / 101 as ap from (select label, a, t, greatest(1, (x * npig + 99) // 100) as k from npig, range(0, 101) r(x)) left join hits using (label, a, t, k) group by all),
rec as (select label, a, t, max(k) / any_value(npig) as recall from hits join npig using (label, a, t) group by all),
v as (select label, a, t, ap, coalesce(recall, 0.0) as recall from ap left join rec using (label, a, t))"""


def _metric(name: str, cond: str, column: str = "ap") -> str:
    return f"select '{name}' as metric, coalesce(round(avg({column}) filter (where {cond}) * 100, 4), -100.0) as value from v"


@query(_AP + " union all ".join([" " + _metric("map", "a = 'all'"), _metric("ap50", "a = 'all' and t = 0"), _metric("ap75", "a = 'all' and t = 5"), *(_metric(a, f"a = '{a}'") for a in ("small", "medium", "large")), _metric("ar100", "a = 'all'", "recall")]))
def coco_map(spark, d):
    b = stored(B.boxes(spark, d))
    return coco.coco_map(B.truth(b), B.detections(b))


@query(_AP + """ select l.label, coalesce(round(avg(ap) * 100, 4), -100.0) as ap, coalesce(round(avg(ap) filter (where t = 0) * 100, 4), -100.0) as ap50, coalesce(round(avg(ap) filter (where t = 5) * 100, 4), -100.0) as ap75
from (select distinct source_label as label from boxes) l left join v on v.label = l.label and a = 'all' group by l.label""")
def per_class_ap(spark, d):
    b = stored(B.boxes(spark, d))
    labels = b.select(F.col("source_label").alias("label")).distinct()
    return coco.per_class_ap(B.truth(b), B.detections(b), labels)


@query()
def multilabel_stratified_split(spark, d):
    return multilabel.multilabel_split(B.boxes(spark, d).select("image_id", F.col("source_label").alias("label")))


@query(f"""with {B.BOXES}, p as (select distinct image_id, source_label as label from boxes)
select label, count(*) as images, true as covered, true as near from p group by 1
union all select -1, round_even(count(distinct image_id) * 0.2::double, 0)::bigint, true, true from p""")
def multilabel_split_invariants(spark, d):
    """Of each label its images, whether it is on both sides and within 3 % of its images of its share; as label -1 the size of val, and whether it is exact."""
    images = multilabel.image_labels(B.boxes(spark, d).select("image_id", F.col("source_label").alias("label")))
    split = multilabel.split_images(images)
    val = F.count_if(F.col("side") == "val")
    each = split.select(F.explode("labels").alias("label"), "side").groupBy("label").agg(F.count("*").alias("images"), ((F.count("*") < 2) | (val > 0) & (val < F.count("*"))).alias("covered"), (F.abs(val - F.count("*") * 0.2) <= F.greatest(F.lit(1.0), F.count("*") * 0.03)).alias("near"))
    exact = val == F.bround(F.count("*") * 0.2).cast("long")
    return each.union(split.agg(F.lit(-1), val, exact, F.lit(True)))


_CONTRACT = f"""{B.REASONS}, od as (select o_orderkey as k, o_orderkey::varchar as image_id, o_orderkey % 10 as part from orders), i as (select distinct image_id from boxes),
ok as (select * from od where image_id in (select image_id from i)), m as (select distinct image_id from reasons where source_label = 25 and (len(filter_reasons) = 0 or image_id::bigint % 13 = 0)), bad as (select distinct image_id from reasons where image_id::bigint % 13 = 0 and len(filter_reasons) > 0)"""


@query(f"""with {_CONTRACT}
select 'split' as "check", image_id from od where (part < 8 and k % 97 = 0) or (part = 8 and k % 83 = 0) union all select 'official', image_id from od where part = 8 and k % 83 = 0
union all select 'test_order', image_id from od where part = 9 and k % 89 = 0
union all select 'missing_record', image_id from od where image_id not in (select image_id from i) union all select 'repeated_record', image_id from ok where k % 79 = 0
union all select 'unsafe_path', image_id from ok where k % 101 = 0 union all select 'missing_image', image_id from ok where k % 107 = 0 union all select 'missing_annotation', image_id from ok where k % 73 = 0
union all select 'image_hash', image_id from ok where k % 103 = 0 and k % 107 <> 0 union all select 'annotation_hash', image_id from ok where k % 71 = 0 and k % 73 <> 0
union all select 'dimensions', image_id from ok where k % 109 = 0 and k % 107 <> 0 union all select 'invalid_box', image_id from bad union all select 'label_space', image_id from m""")
def detection_contract(spark, d):
    """All orders as images with lists, records and files, each of which breaks the contract here and there.

    Records have their image's valid boxes, those of every thirteenth order the others too; labels are checked of all boxes of a record."""
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("image_id"), (F.col("o_orderkey") % 10).alias("part"))
    k = F.col("k")
    named = lambda name, where, ord_=k: o.where(where).select(F.lit(name).alias("list"), "image_id", ord_.alias("ord"))
    lists = named("train", "part < 8").union(named("val", "part = 8 and k % 83 <> 0 or part < 8 and k % 97 = 0")).union(named("test", "part = 9", k + (k % 89 == 0).cast("int")))
    lists = lists.union(named("official_trainval", "part < 9")).union(named("official_test", "part = 9"))
    b = X.with_reasons(B.boxes(spark, d)).where((F.col("image_id").cast("long") % 13 == 0) | F.col("valid"))
    label = F.col("source_label")
    obj = F.struct(F.array(*X.CORNERS).alias("bbox"), "source_label", label.alias("detector_label"), (label * 7 % 23).alias("public_id"))
    own = B.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("image_id")).groupBy("image_id").agg(F.count("*").alias("n_raw"))
    records = own.join(b.groupBy("image_id").agg(F.collect_list(obj).alias("objects")), "image_id", "left").withColumn("k", F.col("image_id").cast("long"))
    path = lambda folder, suffix: F.concat(F.when(k % 101 == 0, "../").otherwise(""), F.lit(folder), "image_id", F.lit(suffix))
    sha = lambda salt, id_="image_id": F.sha2(F.concat(F.lit(salt), id_), 256)
    records = records.select("k", "image_id", path("images/", ".jpg").alias("image_path"), path("xml/", ".xml").alias("annotation_path"), F.lit(640).alias("width"), F.lit(480).alias("height"), sha("i").alias("image_sha256"), sha("a").alias("annotation_sha256"), "n_raw", F.coalesce("objects", F.array()).alias("objects"))
    records = records.union(records.where(k % 79 == 0))
    images = o.where("k % 107 <> 0").select("image_id", F.when(k % 103 == 0, "0").otherwise(sha("i")).alias("sha256"), F.when(k % 109 == 0, 1).otherwise(640).alias("width"), F.lit(480).alias("height"))
    annotations = o.where("k % 73 <> 0").select("image_id", F.when(k % 71 == 0, "0").otherwise(sha("a")).alias("sha256"))
    return contract.detection_contract(lists, records, images, annotations, (1, 24), (0, 22))[0].select("check", "image_id")


@query("""with l as (select o_orderkey::varchar as image_id, o_orderkey as ord, case when o_orderkey % 5 = 4 then 1 else 0 end as list from orders),
p as (select *, row_number() over (order by list, ord) - 1 as formal_index, lag(image_id) over (partition by list order by ord) as last from l)
select image_id, formal_index, case when list = 1 then 'test' else 'trainval' end as official_partition, coalesce(last < image_id, true) as ordered from p""")
def official_partition(spark, d):
    """Order keys as two id lists in numeric order, which is not that of text."""
    o = B.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("image_id"), F.col("o_orderkey").alias("ord"))
    test = F.col("ord") % 5 == 4
    return contract.official_partition(o.where(~test), o.where(test))
