"""Queries over documents as a manifest of labelled files."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scalars as S
from plumbline.operators import manifest as M
from plumbline.operators import taxonomy as T
from plumbline.operators.lineage import checkpointed
from plumbline.operators.prefix import ranked
from plumbline.plans import bindings as B
from plumbline.sources.writers import canonical_json

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"with {B.MANIFEST} select * from manifest")
def audit_content(spark, d):
    return B.manifest(spark, d)


@query(f"with {B.MANIFEST} select relative_path, class_id, decode_error from manifest where decode_status <> 'ok'")
def write_manifest_excluded(spark, d):
    return M.excluded(B.manifest(spark, d)).select("relative_path", "class_id", "decode_error")


@query("""select doc_id, '{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}' as json from documents""")
def canonical_json_rows(spark, d):
    return B.table(spark, d, "documents").select("doc_id", canonical_json("doc_id", "lang", "n_chars", "source").alias("json"))


@query(r"""select page_id, coalesce(nullif(lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '[^.](\.[^.]+)$', 1)), ''), '<none>') as extension from pages""")
def file_extension(spark, d):
    return B.table(spark, d, "pages").select("page_id", S.file_extension("url").alias("extension"))


@query("select doc_id, sha256('17:' || doc_id) as tie_break from documents")
def stable_tie_break(spark, d):
    return B.table(spark, d, "documents").select("doc_id", S.stable_tie_break(17, "doc_id").alias("tie_break"))


@query("""select page_id, case when starts_with(url, 'https:/') then substr(url, 8) else url end as path,
  not starts_with(url, '/') and not list_contains(string_split(url, '/'), '..') as safe from pages""")
def relative_path(spark, d):
    return B.table(spark, d, "pages").select("page_id", S.relative_path("url", "https:/").alias("path"), S.is_safe_path("url").alias("safe"))


@query("select doc_id, left('ValueError: ' || text, 400) as error from documents")
def error_text(spark, d):
    return B.table(spark, d, "documents").select("doc_id", S.error_text(F.lit("ValueError"), F.col("text")).alias("error"))


_RULES = {"src1": "disease", "src4": "disease", "src7": "healthy", "src12": "healthy", "src9": "disorder"}


@query("""select doc_id, case when source in ('src1', 'src4') then 'disease' when source in ('src7', 'src12') then 'healthy' when source = 'src9' then 'disorder' else 'pest' end as category from documents""")
def assign_category(spark, d):
    rules = spark.createDataFrame(list(_RULES.items()), "name string, category string")
    names = B.table(spark, d, "documents").select("doc_id", F.col("source").alias("name"))
    return T.assign_category(names, rules).select("doc_id", "category")


_ALIASES = [("green", "verde"), ("dark", "umbra"), ("light", "umbra"), ("blue", "mare"), ("steel", "metal"), ("copper", "metal"), ("brass", "metal"), ("red", "rubra"), ("red widget", "special"), ("gear", "metal"), ("ring", "orbis")]
_ALIAS_SQL = ", ".join(f"('{a}', '{h}')" for a, h in _ALIASES)


@query(rf"""with a(alias, host) as (values {_ALIAS_SQL}), n as (select p_name as name from part union select split_part(p_name, ' ', 2) || ' of the（' || split_part(p_name, ' ', 1) || ' kind)' from part
  union select 'some ' || replace(p_name, ' ', '(') || ')' from part), m as (select name, translate(lower(name), '（）', '()') as plain from n),
f as (select name, host, case when contains(plain, '(' || alias || ')') or contains(plain, '(' || alias || ' ') then 1
   when plain = alias or starts_with(plain, alias || ' ') or starts_with(plain, alias || '(') then 2
   when list_contains(regexp_split_to_array(trim(replace(replace(plain, '(', ' '), ')', ' ')), '\s+'), alias) then 3 end as tier from m, a),
g as (select name, tier, count(distinct host) as k, min(host) as host from f where tier is not null group by all),
b as (select name, min(tier) as tier from g group by 1)
select n.name, case when k = 1 then host end as host, b.tier, case when k is null then 'unresolved' when k > 1 then 'ambiguous' else 'ok' end as status
from n left join b using (name) left join g on g.name = n.name and g.tier = b.tier""")
def resolve_host(spark, d):
    """Part names, plain and with one of their words in brackets."""
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    part = B.table(spark, d, "part")
    forms = [F.col("p_name"), F.concat(word(2), F.lit(" of the（"), word(1), F.lit(" kind)")), F.concat(F.lit("some "), F.replace("p_name", F.lit(" "), F.lit("(")), F.lit(")"))]
    names = part.select(F.explode(F.array(*forms)).alias("name"))
    return T.resolve_host(names, spark.createDataFrame(_ALIASES, "alias string, host string"), spark.createDataFrame([], "name string, host string"))


@query("""with s as (select n_name as source, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') as form from nation),
t as (select r_name as target, regexp_replace(lower(r_name), '[^a-z0-9]', '', 'g') as form from region union select n_name || ' (Land)', regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') from nation where n_nationkey % 3 = 0)
select source, case when source = (select min(n_name) from nation) then 'reviewed' else target end as target,
  case when source = (select min(n_name) from nation) then 'reviewed_alias' when target is not null then 'normalized_name' else 'unmatched' end as method from s left join t using (form)""")
def match_names(spark, d):
    nation, region = B.table(spark, d, "nation"), B.table(spark, d, "region")
    target = region.select(F.col("r_name").alias("name")).union(nation.where("n_nationkey % 3 = 0").select(F.concat("n_name", F.lit(" (Land)"))))
    reviewed = nation.agg(F.min("n_name").alias("source")).withColumn("target", F.lit("reviewed"))
    return T.match_names(nation.select(F.col("n_name").alias("name")), target, reviewed)


@query("""select b as source_label, p as public_id, dense_rank() over (order by p) as detector_label from (select distinct cast(replace(p_brand, 'Brand#', '') as int) as b, (cast(replace(p_brand, 'Brand#', '') as int) * 7) % 23 as p from part)""")
def assign_detector_labels(spark, d):
    return T.assign_detector_labels(_label_map(spark, d))


def _label_map(spark, d):
    brand = F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int")
    return B.table(spark, d, "part").select(brand.alias("source_label"), (brand * 7 % 23).alias("public_id")).distinct()


@query("""with ref(official_name) as (select 'src' || i from range(0, 23) r(i)), al as (select 'src' || i as official_name, case when i = 3 then 'lang_en' when i = 21 then 'lang_de' else 'src' || i end as local_directory from range(0, 23) r(i)),
dirs as (select source as directory, count(*) as n_files from documents group by 1 union all select 'lang_' || lang, count(*) from documents group by 1 union all select '.hidden', 1),
names as (select official_name, official_name as directory from ref union select official_name, local_directory from al),
b as (select * from names full outer join (select * from dirs where not starts_with(directory, '.')) using (directory)),
k as (select official_name as name, count(n_files) as n_forms, cast(coalesce(sum(n_files), 0) as bigint) as n_files from b where official_name is not null group by 1)
select *, case when n_forms = 0 then 'missing' when n_forms > 1 then 'duplicate' when n_files = 0 then 'empty' else 'ok' end as status from k
union all select directory, 1, n_files, 'extra' from b where official_name is null""")
def class_set_audit(spark, d):
    docs = B.table(spark, d, "documents")
    dirs = docs.groupBy(F.col("source").alias("directory")).agg(F.count("*").alias("n_files"))
    dirs = dirs.union(docs.groupBy(F.concat(F.lit("lang_"), F.col("lang"))).agg(F.count("*"))).union(spark.sql("select '.hidden', 1L"))
    ref = spark.range(23).select(F.concat(F.lit("src"), F.col("id")).alias("official_name"))
    local = F.when(F.col("official_name") == "src3", "lang_en").when(F.col("official_name") == "src21", "lang_de").otherwise(F.col("official_name"))
    return M.class_set_audit(dirs, ref, ref.select("official_name", local.alias("local_directory")))


@query(f"with {B.MANIFEST} select relative_path, class_id, host_id, category from manifest join dims using (class_id)")
def enrich_samples(spark, d):
    dims = B.classes(spark, d).select("class_id", "host_id", "category")
    return M.enrich_samples(B.manifest(spark, d), dims).select("relative_path", "class_id", "host_id", "category")


@query("""with f as (select doc_id from documents where n_chars >= 40) select 'missing_image' as violation, cast(doc_id as varchar) as id from f where doc_id not in (select doc_id from labels)
union all select 'missing_annotation', cast(doc_id as varchar) from f where doc_id not in (select doc_id from labels where quality = 1)
union all select 'extra_image', cast(doc_id as varchar) from labels where doc_id not in (select doc_id from f)""")
def pair_audit(spark, d):
    docs, labels = B.table(spark, d, "documents"), B.table(spark, d, "labels")
    ids = lambda df: df.select(F.col("doc_id").alias("id"))
    return M.pair_audit(ids(docs.where("n_chars >= 40")), ids(labels), ids(labels.where("quality = 1")))


@query("""with r as (select o_orderkey, o_custkey % 640 as w, o_custkey % 480 as h from orders), f as (select l_orderkey, max(l_quantity) as q, o_custkey % 640 as w, case when max(l_quantity) = 50 then 1 else o_custkey % 480 end as h from lineitem join orders on l_orderkey = o_orderkey group by l_orderkey, o_custkey)
select o_orderkey, r.w as recorded_w, r.h as recorded_h, f.w as found_w, f.h as found_h, case when f.l_orderkey is null then 'missing' else 'mismatch' end as status
from r left join f on l_orderkey = o_orderkey where l_orderkey is null or r.w <> f.w or r.h <> f.h""")
def dimension_check(spark, d):
    """Recorded sizes of all orders against those found by their lines: none for orders without lines, another height where a line has the largest quantity."""
    o = B.table(spark, d, "orders")
    w, h = F.col("o_custkey") % 640, F.col("o_custkey") % 480
    recorded = o.select("o_orderkey", w.alias("w"), h.alias("h"))
    lines = B.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("q"))
    found = o.join(lines, "o_orderkey").select("o_orderkey", w.alias("w"), F.when(F.col("q") == 50, F.lit(1).cast("long")).otherwise(h).alias("h"))
    return M.mismatches(recorded, found, "o_orderkey", ["w", "h"])


@query(f"""with {B.MANIFEST}, r as (select relative_path, case when class_id = 3 then repeat('0', 64) else sha256 end as sha256 from manifest), f as (select * from manifest where decode_status = 'ok')
select relative_path, r.sha256 as recorded_sha256, f.sha256 as found_sha256, case when f.relative_path is null then 'missing' else 'mismatch' end as status
from r left join f using (relative_path) where f.relative_path is null or r.sha256 <> f.sha256""")
def checksum_verify(spark, d):
    m = B.manifest(spark, d)
    recorded = m.select("relative_path", F.when(F.col("class_id") == 3, F.repeat(F.lit("0"), 64)).otherwise(F.col("sha256")).alias("sha256"))
    return M.mismatches(recorded, m.where("decode_status = 'ok'").select("relative_path", "sha256"), "relative_path", ["sha256"])


@query(f"with {B.GROUPS} select * from groups")
def duplicate_groups(spark, d):
    return M.duplicate_groups(B.manifest(spark, d))


@query(f"""with {B.GROUPS} select class_id, cast(sum(n) as bigint) as n_images, count(*) as n_groups,
  case when count(*) >= 3 then 'train,val,test' when count(*) = 2 then 'train,test' else 'train' end as required from groups group by 1""")
def required_splits(spark, d):
    return M.required_splits(M.duplicate_groups(B.manifest(spark, d)))


@query(f"with {B.SPLIT} select * from split")
def group_stratified_split(spark, d):
    return M.group_split(checkpointed(M.duplicate_groups(B.manifest(spark, d))))


@query(f"""with {B.SPLIT}, m as (select class_id, n, split from groups join split using (group_id) union all select null, size, split from split),
t as (select class_id, sum(n) as total, max(n) as largest from m group by 1), s(split, r) as (values ('train', 0.8::double), ('val', 0.1::double), ('test', 0.1::double)),
q as (select class_id, case when count(*) >= 3 then ['train', 'val', 'test'] when count(*) = 2 then ['train', 'test'] else ['train'] end as required from groups group by 1)
select t.class_id, s.split, round(total * r, 6) as target, largest, coalesce(list_contains(required, s.split), false) as needed, true as covered, true as within
from t cross join s left join q on q.class_id = t.class_id""")
def group_split_balanced(spark, d):
    """After the auction each class, and all of them, are in every split they need and within one group of their quotas there."""
    g = checkpointed(M.duplicate_groups(B.manifest(spark, d)))
    q = M.split_quotas(g, M.group_split(g, rounds=12))
    return q.select("class_id", "split", F.round("target", 6).alias("target"), "largest", "needed", (~F.col("needed") | (F.col("groups") > 0)).alias("covered"), (F.abs(F.col("n") - F.col("target")) <= F.col("largest")).alias("within"))


@query(f"""with {B.SPLIT}, c as (select class_id, count(*) filter (where split = 'train') as train, count(*) filter (where split = 'val') as val, count(*) filter (where split = 'test') as test
  from manifest join split on sha256 = group_id where decode_status = 'ok' group by 1)
select class_id, coalesce(train, 0) as train, coalesce(val, 0) as val, coalesce(test, 0) as test, coalesce(train + val + test, 0) as total_images from classes left join c using (class_id)""")
def split_summary(spark, d):
    m = checkpointed(B.manifest(spark, d))  # digests, not texts
    return M.split_summary(m, M.group_split(M.duplicate_groups(m)), B.classes(spark, d))


@query(f"""with {B.SPLIT}, want as (select class_id, unnest(case when k >= 3 then ['train', 'val', 'test'] when k = 2 then ['train', 'test'] else ['train'] end) as split from (select class_id, count(*) as k from groups group by 1)),
have as (select distinct class_id, split from groups join split using (group_id)) select class_id, split, count(*) as n from want anti join have using (class_id, split) group by all""")
def split_coverage_gaps(spark, d):
    g = checkpointed(M.duplicate_groups(B.manifest(spark, d)))
    return M.missing_coverage(g, M.group_split(g)).groupBy("class_id", "split").agg(F.count("*").alias("n"))


@query(f"""with {B.MANIFEST} select count(*) as total, count(*) filter (where decode_status = 'ok') as usable, count(*) filter (where decode_status <> 'ok') as bad,
  cast(sum(size_bytes) as bigint) as bytes, count(distinct sha256) as distinct_contents from manifest""")
def audit_summary(spark, d):
    return M.audit_summary(B.manifest(spark, d))


@query(r"""select coalesce(nullif(lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '[^.](\.[^.]+)$', 1)), ''), '<none>') as extension, count(*) as n from pages group by 1""")
def extension_histogram(spark, d):
    return M.histogram(B.table(spark, d, "pages"), S.file_extension("url"), "extension")


@query(f"""with {B.MANIFEST}, t as (select d.*, n from dims d join (select class_id, count(*) as n from manifest group by 1) using (class_id)),
s as (select 'host' as dimension, cast(host_id as varchar) as value, count(*) as c, sum(n) as n from t group by host_id
union all select 'category', cast(category as varchar), count(*), sum(n) from t group by category
union all select 'host_group', cast(host_group as varchar), count(*), sum(n) from t group by host_group),
w as (select unnest(['host', 'category', 'host_group']) as dimension, unnest([7, 5, 2]) as k), e as (select dimension, unnest(range(0, k)) as o from w)
select dimension, cast(o as bigint) as ordinal, cast(o as varchar) as value, coalesce(c, 0) as class_count, cast(coalesce(n, 0) as bigint) as image_count from e left join s using (dimension) where s.value = cast(o as varchar)
union all select dimension, cast(o as bigint), cast(o as varchar), 0, 0 from e where not exists (select 1 from s where s.dimension = e.dimension and s.value = cast(o as varchar))""")
def taxonomy_rollup(spark, d):
    """Seven hosts, five categories and two host groups are declared; the classes have five, four and two of them."""
    counts = B.manifest(spark, d).groupBy("class_id").agg(F.count("*").alias("image_count"))
    declared = spark.range(7).select(F.explode(F.array(*(F.struct(F.lit(k).alias("dimension"), F.lit(n).alias("n")) for k, n in (("host", 7), ("category", 5), ("host_group", 2))))).alias("x"), "id").where("id < x.n")
    declared = declared.select("x.dimension", F.col("id").alias("ordinal"), F.col("id").cast("string").alias("value"))
    return M.taxonomy_rollup(B.classes(spark, d).join(counts, "class_id"), declared)


@query(f"""with {B.MANIFEST}, p as (select sha256 from manifest where decode_status = 'ok' group by 1 having count(distinct class_id) > 1)
select 'bad_file' as "check", relative_path as key, decode_error as detail from manifest where decode_status <> 'ok'
union all select 'content_in_several_classes', sha256, '' from p
union all select 'unlabelled', cast(doc_id as varchar), '' from documents anti join labels using (doc_id)""")
def contract_check(spark, d):
    m = B.manifest(spark, d)
    bad = m.where("decode_status <> 'ok'").select(F.col("relative_path").alias("key"), F.col("decode_error").alias("detail"))
    several = M.duplicate_groups(m).where("n_classes > 1").select(F.col("group_id").alias("key"), F.lit("").alias("detail")).distinct()
    free = B.table(spark, d, "documents").join(B.table(spark, d, "labels"), "doc_id", "left_anti").select(F.col("doc_id").alias("key"), F.lit("").alias("detail"))
    return M.violations([("bad_file", bad), ("content_in_several_classes", several), ("unlabelled", free)])


@query(f"""with {B.MANIFEST}, w as (select i as class_id, case when coalesce(n, 0) > 0 then 1 / sqrt(n) else 1.0 end as w from range(0, 23) r(i) left join (select class_id, count(*) as n from manifest where decode_status = 'ok' group by 1) on class_id = i)
select cast(class_id as int) as class_id, round(w / (select avg(w) from w), 9) as weight from w""")
def class_weights(spark, d):
    """Over a dimension of 23 classes, three of which no document has."""
    counts = B.manifest(spark, d).where("decode_status = 'ok'").groupBy("class_id").agg(F.count("*").alias("n"))
    return M.class_weights(counts, spark.range(23).select(F.col("id").cast("int").alias("class_id"))).select("class_id", F.round("weight", 9).alias("weight"))


@query(f"""with {B.MANIFEST} select relative_path, class_id, round(1 / sqrt(count(*) over (partition by class_id)), 9) as weight from manifest""")
def sample_weights(spark, d):
    return M.sample_weights(B.manifest(spark, d).select("relative_path", "class_id")).withColumn("weight", F.round("weight", 9))


@query(f"""with {B.MANIFEST}, w as (select relative_path, cast(round(round(1 / sqrt(count(*) over (partition by class_id)), 9) * 1000000) as bigint) as w from manifest),
u as (select *, sum(w) over (order by sha256('5:' || relative_path), relative_path rows unbounded preceding) as u, sum(w) over () as t, count(*) over () as k from w)
select relative_path, cast(floor(u * k::double / t + 0.5) - floor((u - w) * k::double / t + 0.5) as bigint) as copies from u
where floor(u * k::double / t + 0.5) - floor((u - w) * k::double / t + 0.5) > 0""")
def weighted_resample(spark, d):
    rows = M.sample_weights(B.manifest(spark, d).select("relative_path", "class_id")).withColumn("weight", F.round("weight", 9))
    return M.weighted_resample(rows, "weight", B.table(spark, d, "documents").count(), 5, "relative_path").select("relative_path", "copies")


@query("select doc_id, sha256('3:' || doc_id) as tie_break from documents order by tie_break limit 100")
def seeded_order_head(spark, d):
    return M.seeded_order(B.table(spark, d, "documents").select("doc_id"), 3, "doc_id", 100)


@query(f"""with {B.SPLIT}, tr as (select group_id from split where split = 'train'), te as (select group_id from split where split <> 'train'), al as (select distinct group_id from groups),
li as (select row_number() over (order by group_id) as k, group_id from te), ot as (select row_number() over (order by sha256('1:' || group_id)) as k, group_id from te)
select 'disjoint' as invariant, count(*) as violations from (select * from tr intersect select * from te)
union all select 'missing', count(*) from (select * from al except all (select * from tr union all select * from te))
union all select 'unexpected', count(*) from ((select * from tr union all select * from te) except all select * from al)
union all select 'empty', ((select count(*) from tr) = 0)::int + ((select count(*) from te) = 0)::int
union all select 'order', count(*) from li join ot using (k) where li.group_id <> ot.group_id""")
def split_invariants(spark, d):
    """The two lists compared for order are the test groups by id and by another tie break."""
    g = checkpointed(M.duplicate_groups(B.manifest(spark, d)))
    s = checkpointed(M.group_split(g))
    test = s.where("split <> 'train'").select("group_id", S.stable_tie_break(1, "group_id").alias("tie"))
    place = lambda tie: ranked(test, [], None, tie, "formal_index").select("formal_index", F.col("group_id").alias("image_id"))
    return M.split_invariants(s.where("split = 'train'").select("group_id"), test.select("group_id"), g.select("group_id").distinct(), (place("group_id"), place("tie")))
