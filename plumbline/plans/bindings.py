"""The driver's tables as manifests, boxes, detections, class scores and run histories, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.operators import manifest as M
from plumbline.operators.lineage import dimension


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(class_id, name, host_id, category, host_group): the sources in order, with host = id mod 5 and category = id mod 4."""
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()
    d = names.withColumn("class_id", F.row_number().over(W.orderBy("name")) - 1)  # a row a class
    return d.select("class_id", "name", (F.col("class_id") % 5).alias("host_id"), (F.col("class_id") % 4).alias("category"), (F.col("class_id") % 2).alias("host_group"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests first, so texts are read in the scan and go through no join."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("relative_path"), "source", "text", "n_chars")
    audited = M.audit_content(files, "text", bad="n_chars < 40", error="concat('only ', n_chars, ' characters')").drop("n_chars")
    return audited.join(dimension(classes(spark, sf_dir).select("class_id", F.col("name").alias("source"))), "source").select("relative_path", "class_id", "sha256", "size_bytes", "decode_status", "decode_error")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    order = ["l_linenumber", "l_quantity", "l_extendedprice"]
    o = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("image_id"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), *order,
        F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int").alias("source_label"),
    )
    o = o.withColumn("obj_id", F.row_number().over(W.partitionBy("image_id").orderBy("pk", "sk", *order)) - 1)  # by image, as what follows groups them
    o = o.select("image_id", "obj_id", "pk", "sk", F.col("l_quantity").alias("q"), "source_label")
    g = o.selectExpr("*", "cast((pk*31+sk*17)%440 as double) as x1", "cast((pk*13+sk*29)%300 as double) as y1", "cast(12+(pk*3)%188 as double) as w", "cast(12+(sk*7)%168 as double) as h")
    return g.selectExpr("image_id", "obj_id", "source_label", "640 as width", "480 as height", "x1 as xmin", "y1 as ymin", "case when q=1 then x1 when q=2 then 700.0D else x1+w end as xmax", "y1+h as ymax", "pk", "sk")


def detections(boxes_: DataFrame) -> DataFrame:
    return boxes_.where("(sk+obj_id)%5 <> 0").selectExpr(
        "image_id", "obj_id as det_id", "case when pk%9=0 then source_label%25+1 else source_label end as label",
        "cast((pk*7919+sk*104729+obj_id*31)%1000 as double)/1000.0D as score",
        "xmin+(sk%13)-6 as xmin", "ymin+(pk%11)-5 as ymin", "xmax+(sk%13)-6+(pk%7) as xmax", "ymax+(pk%11)-5+(sk%5) as ymax",
    )


def truth(boxes_: DataFrame) -> DataFrame:
    """Valid boxes with their label."""
    from plumbline.operators.boxes import with_reasons

    return with_reasons(boxes_).where("valid").drop("valid", "filter_reasons").withColumnRenamed("source_label", "label")


def scores(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """(sample_id, target, logits): inner products with the labels' mean vectors, rounded to 6 decimals."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("target"), F.posexplode("embedding").alias("i", "v"))
    mean = e.groupBy(F.col("target").alias("cls"), "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    each = e.join(mean, "i").groupBy("vec_id", "target", "cls").agg(F.round(F.sum(F.col("v").cast("double") * F.col("m")), 6).alias("z"))  # k rows of a vector's length
    return each.groupBy(F.col("vec_id").alias("sample_id"), "target").agg(F.transform(F.array_sort(F.collect_list(F.struct("cls", "z"))), lambda s: s["z"]).alias("logits"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, epoch, metric, ts, event_id): the events of a user in order."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("epoch"), F.col("value").alias("metric"), "ts", "event_id")


# The same in DuckDB's SQL, as common table expressions.
CLASSES = """classes as (select cast(row_number() over (order by source) as int) - 1 as class_id, source as name from (select distinct source from documents)),
dims as (select class_id, name, class_id % 5 as host_id, class_id % 4 as category, class_id % 2 as host_group from classes)"""
MANIFEST = CLASSES + """,
manifest as (select cast(doc_id as varchar) as relative_path, class_id, sha256(text) as sha256, cast(strlen(text) as bigint) as size_bytes,
  case when n_chars < 40 then 'bad' else 'ok' end as decode_status,
  case when n_chars < 40 then 'DecodeError: only ' || n_chars || ' characters' else '' end as decode_error
  from documents join classes on source = name)"""
GROUPS = MANIFEST + """,
each as (select sha256 as group_id, class_id, count(*) as n from manifest where decode_status = 'ok' group by all),
groups as (select e.*, size, n_classes, sha256('0:' || e.group_id) as tie_break
  from each e join (select group_id, cast(sum(n) as bigint) as size, count(*) as n_classes from each group by 1) using (group_id))"""
SPLIT = GROUPS + """,
home as (select group_id, arg_min(class_id, k * 1000000 + class_id) as home, any_value(size) as size, any_value(tie_break) as tie_break
  from groups join (select class_id, count(*) as k from groups group by 1) using (class_id) group by 1),
ranked as (select *, row_number() over (partition by home order by size, tie_break) as rank, count(*) over (partition by home) as k,
  sum(size) over (partition by home) as total from home),
marked as (select *, case when rank = 1 then 'train' when rank = 2 and k >= 3 then 'val' when rank = 3 and k >= 3 then 'test' when rank = 2 and k = 2 then 'test' end as reserved from ranked),
held as (select home, coalesce(sum(size) filter (where reserved = 'train'), 0) as r1, coalesce(sum(size) filter (where reserved = 'val'), 0) as r2,
  coalesce(sum(size) filter (where reserved = 'test'), 0) as r3 from marked group by 1),
rest as (select group_id, home, size, total, sum(size) over (partition by home order by tie_break, group_id rows unbounded preceding) - size / 2 as middle from marked where reserved is null),
split as (select group_id, home, size, case when middle <= greatest(0.0, 0.8::double * total - r1) then 'train'
  when middle <= greatest(0.0, 0.8::double * total - r1) + greatest(0.0, 0.1::double * total - r2) then 'val' else 'test' end as split from rest join held using (home)
  union all select group_id, home, size, reserved from marked where reserved is not null)"""
BOXES = """o as (select cast(l_orderkey as varchar) as image_id, cast(row_number() over (partition by l_orderkey
    order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) as int) - 1 as obj_id,
  l_partkey as pk, l_suppkey as sk, l_quantity as q, cast(replace(p_brand, 'Brand#', '') as int) as source_label
  from lineitem join part on l_partkey = p_partkey),
g as (select image_id, obj_id, source_label, cast((pk*31+sk*17)%440 as double) as x1, cast((pk*13+sk*29)%300 as double) as y1,
  cast(12+(pk*3)%188 as double) as w, cast(12+(sk*7)%168 as double) as h, q, pk, sk from o),
boxes as (select image_id, obj_id, source_label, 640 as width, 480 as height, x1 as xmin, y1 as ymin,
  case when q=1 then x1 when q=2 then 700.0 else x1+w end as xmax, y1+h as ymax, pk, sk from g)"""
REASONS = BOXES + """,
reasons as (select *, case when not (isfinite(xmin) and isfinite(ymin) and isfinite(xmax) and isfinite(ymax)) then ['non_finite']
  else list_filter([case when xmax <= xmin then 'non_positive_width' end, case when ymax <= ymin then 'non_positive_height' end,
    case when xmin < 0 or ymin < 0 or xmax > width or ymax > height then 'out_of_bounds' end], lambda r: r is not null) end as filter_reasons from boxes),
truth as (select image_id, obj_id, source_label as label, xmin, ymin, xmax, ymax from reasons where len(filter_reasons) = 0)"""
DETECTIONS = REASONS + """,
dets as (select image_id, obj_id as det_id, case when pk%9=0 then source_label%25+1 else source_label end as label,
  cast((pk*7919+sk*104729+obj_id*31)%1000 as double)/1000.0 as score,
  xmin+(sk%13)-6 as xmin, ymin+(pk%11)-5 as ymin, xmax+(sk%13)-6+(pk%7) as xmax, ymax+(pk%11)-5+(sk%5) as ymax from boxes where (sk+obj_id)%5 <> 0)"""
SCORES = """e as (select vec_id, label as target, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as i from embeddings),
mean as (select target as cls, i, avg(v) as m from e group by all),
z as (select vec_id as sample_id, target, cls, round(sum(v * m), 6) as z from e join mean using (i) group by all),
ranked as (select *, row_number() over (partition by sample_id order by z desc, cls) as r from z),
preds as (select sample_id, target, cls as pred from ranked where r = 1),
confusion as (select target, pred, count(*) as n from preds group by all)"""
COUNTS = SCORES + """,
counts as (select class_id, cast(sum(tp) as bigint) as tp, cast(sum(s) as bigint) as support, cast(sum(p) as bigint) as predicted from (
  select target as class_id, case when target = pred then n else 0 end as tp, n as s, 0 as p from confusion union all
  select pred, 0, 0, n from confusion) group by 1)"""
HISTORY = """history as (select user_id as run, cast(row_number() over (partition by user_id order by ts, event_id) as int) as epoch, value as metric, ts, event_id from events),
best as (select *, greatest(-1.0, coalesce(max(metric) over (partition by run order by epoch rows unbounded preceding), -1.0)) as best_metric,
  greatest(-1.0, coalesce(max(metric) over (partition by run order by epoch rows between unbounded preceding and 1 preceding), -1.0)) as before from history),
bests as (select run, epoch, metric, best_metric, cast(coalesce(max(case when metric > before then epoch end) over (partition by run order by epoch rows unbounded preceding), 0) as int) as best_epoch from best)"""
