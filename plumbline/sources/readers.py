"""Readers of class lists, alias maps, files, annotations, manifests and run records. All return DataFrames."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from plumbline.functions.images import image_header
from plumbline.functions.scalars import file_extension

MANIFEST = "relative_path string, class_id int, sha256 string, size_bytes long, width int, height int, decode_status string, decode_error string, duplicate_group_id string, split string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line) of one small text file, trimmed, without blank lines."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("ord", "line")).withColumn("line", F.trim("line")).where("line <> ''")


def _unique(df: DataFrame, column: str, what: str) -> DataFrame:
    twice = [r[0] for r in df.groupBy(column).count().where("count > 1").limit(5).collect()]
    if twice:
        raise ValueError(f"{what} has duplicates: {', '.join(map(str, twice))}")
    return df


def read_class_list(spark: SparkSession, path: str, skip_comments: bool = True) -> DataFrame:
    """(class_id, name): the order in the file is the id. Comment lines begin with "#"; duplicates fail."""
    lines = _lines(spark, path)
    lines = lines.where("line not like '#%'") if skip_comments else lines
    return _unique(lines, "line", path).select((F.row_number().over(W.orderBy("ord")) - 1).alias("class_id"), F.col("line").alias("name"))


def read_alias_map(spark: SparkSession, path: str, classes: DataFrame | None = None) -> DataFrame:
    """(official_name, local_directory) of a JSON object. Values that repeat, or keys other than the class list, fail."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    if raw.where("m is null").take(1):
        raise ValueError(f"{path} is not an object of strings")
    out = raw.select(F.explode("m").alias("official_name", "local_directory"))
    if out.where("local_directory is null").take(1):
        raise ValueError(f"{path} has a value that is not a string")
    _unique(out, "local_directory", path)
    if classes is not None:
        names = classes.select(F.col("name").alias("official_name"))
        odd = out.join(names, "official_name", "left_anti").select("official_name").union(names.join(out, "official_name", "left_anti")).take(3)
        if odd:
            raise ValueError(f"{path} and the class list differ: {', '.join(r[0] for r in odd)}")
    return out


def scan_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """(path, dir, name, size_bytes) of the files below root; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true" if recursive else "false")
    path = root if recursive else f"{root.rstrip('/')}/*"
    parts = F.split("path", "/")
    return reader.load(path).select("path", F.element_at(parts, -2).alias("dir"), F.element_at(parts, -1).alias("name"), F.col("length").alias("size_bytes"))


def audit_images(spark: SparkSession, root: str) -> DataFrame:
    """audited_images() of the files in the folders below root, each read once. Spark's reader leaves out files without any byte."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*").select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
    return audited_images(files)


#: Suffixes of each format, and so which names tell the truth.
SUFFIXES = {"PNG": (".png",), "JPEG": (".jpg", ".jpeg"), "GIF": (".gif",), "WEBP": (".webp",)}


def audited_images(files: DataFrame) -> DataFrame:
    """path, sha256, size_bytes, image_format, image_mode, width, height, renamed, decode_status and decode_error of files (path, content).

    Headers are parsed by column functions, so a file is one row of one scan and no pixel is decoded. Files that are no image, and images
    without their end, stay as bad. renamed: the format is known, and the path's suffix is that of none or of another.
    """
    known = files.select("path", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"), image_header("content").alias("h"))
    suffix = F.create_map(*(x for k, own in SUFFIXES.items() for s in own for x in (F.lit(s), F.lit(k))))[file_extension("path")]
    renamed = F.coalesce(F.col("h.image_format") != F.coalesce(suffix, F.lit("")), F.lit(False))
    status = F.when(F.col("h.decode_error") == "", "ok").otherwise("bad")
    return known.select("path", "sha256", "size_bytes", "h.image_format", "h.image_mode", "h.width", "h.height", renamed.alias("renamed"), status.alias("decode_status"), "h.decode_error")


def read_voc_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, n_docs, n_dup, width, height, objects, status) of annotation XML files.

    A file may hold several annotation roots; identical ones count once. objects is an array of (name, xmin, ymin, xmax, ymax) in
    order; a coordinate that is not a number is null there. status: ok, no_annotation, no_size or no_object.
    """
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.xml$", 1).alias("image_id"), "value")
    return parsed_annotations(whole)


def read_annotation_lines(spark: SparkSession, path: str) -> DataFrame:
    """read_voc_annotations for files of many images, an annotation root a line, whose <filename> names the image."""
    lines = spark.read.text(path).select(F.regexp_extract("value", r"<filename>([^<]*?)(?:\.[A-Za-z]+)?</filename>", 1).alias("image_id"), "value")
    return parsed_annotations(lines)


def parsed_annotations(whole: DataFrame) -> DataFrame:
    """read_voc_annotations for texts that are read already: (image_id, value); an image may have several rows."""
    whole = whole.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list("value")), "\n").alias("value"))
    text = "size struct<width string, height string>, object array<struct<name string, bndbox struct<xmin string, ymin string, xmax string, ymax string>>>"
    docs = whole.withColumn("all", F.regexp_extract_all("value", F.lit(r"(?s)<annotation\b.*?</annotation>"), F.lit(0))).withColumn("docs", F.array_distinct("all"))
    each = docs.select("image_id", F.size("docs").alias("n_docs"), (F.size("all") - F.size("docs")).alias("n_dup"), F.posexplode_outer("docs").alias("d", "doc"))
    each = each.withColumn("x", F.from_xml("doc", text, {"rowTag": "annotation"}))
    objects = F.transform("x.object", lambda o: F.struct(o["name"].alias("name"), *(o["bndbox"][k].try_cast("double").alias(k) for k in ("xmin", "ymin", "xmax", "ymax"))))
    rows = each.select("image_id", "n_docs", "n_dup", "d", F.col("x.size.width").try_cast("int").alias("w"), F.col("x.size.height").try_cast("int").alias("h"), objects.alias("o"))
    out = rows.groupBy("image_id").agg(F.max("n_docs").alias("n_docs"), F.max("n_dup").alias("n_dup"), F.min("w").alias("width"), F.min("h").alias("height"), F.array_sort(F.collect_list(F.struct("d", "o"))).alias("l"))
    out = out.withColumn("objects", F.flatten(F.transform("l", lambda r: F.coalesce(r["o"], F.array())))).drop("l")
    status = F.when(F.col("n_docs") == 0, "no_annotation").when(F.col("width").isNull() | F.col("height").isNull(), "no_size").when(F.size("objects") == 0, "no_object").otherwise("ok")
    return out.withColumn("status", status)


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """(formal_index, image_id) of text files with one id a line, in the order of the files' names and their lines; duplicates fail.

    Lines are read split by split; an index is the number of ids in the splits before (a row a split is totalled for this) and the
    place within the split, so no task holds the list.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.trim(F.regexp_replace("value", "\r$", "")).alias("image_id")).where("image_id <> ''")
    _unique(lines, "image_id", path)
    lines = lines.withColumn("at", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row a split
    return lines.join(splits, ["file", "start"]).select((F.col("before") + F.col("at") - F.col("first")).alias("formal_index"), "image_id")


def read_manifest(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Usable rows of a manifest, of one split if given: Parquet (partitioned by split, so that other splits are not read) or CSV."""
    df = spark.read.schema(MANIFEST).csv(path, header=True) if path.rstrip("/").endswith((".csv", ".csv.gz")) else spark.read.parquet(path)
    df = df.where("decode_status = 'ok'")
    return df if split is None else df.where(F.col("split") == split)


def read_annotation_index(spark: SparkSession, path: str, ids: DataFrame, schema: str) -> DataFrame:
    """JSON-lines records of the ids (image_id); an id that is missing or repeats fails."""
    rows = spark.read.schema(schema).json(path).join(ids.select("image_id"), "image_id", "left_semi")
    _unique(rows, "image_id", path)
    lost = ids.join(rows, "image_id", "left_anti").take(3)
    if lost:
        raise ValueError(f"{path} lacks {', '.join(str(r.image_id) for r in lost)}")
    return rows


def read_json_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The rows of an array of objects inside one JSON document, such as a taxonomy's or label map's "classes"."""
    return spark.read.option("multiLine", True).json(path).select(F.inline(table))


HISTORY = "epoch int, train_loss double, best_metric double, best_epoch int, timestamp double"
RUN_STATE = "task string, run_id string, status string, epoch int, global_step long, steps_per_epoch int, updated_at double"


def _run_states(reader: DataFrameReader | DataStreamReader, glob: str, schema: str, lines: bool) -> DataFrame:
    """(run, task, ..., malformed, path, modified): a row a state, with its text in ``malformed`` and nulls where it is no JSON object of the schema."""
    rows = reader.schema(f"{schema}, malformed string").option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "malformed").json(glob)
    rows = rows.withColumn("path", F.col("_metadata.file_path")).withColumn("modified", F.col("_metadata.file_modification_time"))
    parts = F.split("path", "/")
    rows = rows.withColumn("run", F.element_at(parts, -2))
    return rows.withColumn("task", F.coalesce(F.nullif("task", F.lit("")), F.element_at(parts, -3))) if "task" in rows.columns else rows


def read_run_state(spark: SparkSession, glob: str, schema: str = RUN_STATE, lines: bool = False) -> DataFrame:
    """(run, task, ..., malformed, path, modified) of state files, one JSON object each (with ``lines``, one a line), named by their run's
    folder; ``task`` is the folder above the run's where the file has none. A malformed file gives a row with nulls and its text in
    ``malformed``; ``modified`` is the file's time, and a filter on it keeps other files from being read."""
    return _run_states(spark.read, glob, schema, lines)


def stream_run_state(spark: SparkSession, glob: str, schema: str = RUN_STATE, lines: bool = False, files: int = 1000) -> DataFrame:
    """read_run_state as a stream of files as they appear, at most ``files`` a micro-batch. A file that is replaced under its name is not read
    again by a file stream; streaming.runs.poll_states does that."""
    return _run_states(spark.readStream.option("maxFilesPerTrigger", files), glob, schema, lines)


JOURNAL = "run string, text string"


def _journal(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    rows = reader.schema(JOURNAL).json(path)
    return rows.withColumn("path", F.col("_metadata.file_path")).withColumn("modified", F.col("_metadata.file_modification_time"))


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """(run, text, path, modified) of files that hold the records of many runs, {"run": ..., "text": ...} a line: what a run wrote is the text, as it
    was written. With a folder and file for each run, listing and opening them is what a job over very many runs does; a journal's files are as many as their bytes ask for."""
    return _journal(spark.read, path)


def stream_journal(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """read_journal as a stream of files as they appear, at most ``files`` a micro-batch."""
    return _journal(spark.readStream.option("maxFilesPerTrigger", files), path)


def journal_states(journal: DataFrame, schema: str = RUN_STATE) -> DataFrame:
    """read_run_state for the rows of a journal: (run, task, ..., malformed, path, modified), ``task`` being the folder of the journal where a state has none."""
    rows = journal.withColumn("s", F.from_json("text", f"{schema}, malformed string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "malformed"}))
    rows = rows.select("run", "s.*", "path", "modified")
    return rows.withColumn("task", F.coalesce(F.nullif("task", F.lit("")), F.element_at(F.split("path", "/"), -2))) if "task" in rows.columns else rows


def journal_histories(journal: DataFrame, schema: str = HISTORY) -> DataFrame:
    """read_run_history for the rows of a journal, whose texts are JSON arrays; a malformed one gives no rows."""
    rows = journal.select("run", F.explode(F.from_json("text", f"array<struct<{schema}>>")).alias("e"))
    return rows.select("e.*", "run").where("epoch is not null").withColumn("ts", F.timestamp_seconds("timestamp"))


def read_run_history(spark: SparkSession, glob: str, schema: str = HISTORY) -> DataFrame:
    """(run, epoch, ...) of history files, JSON arrays named by their run's folder; a malformed file gives no rows."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(glob)
    return rows.withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2)).where("epoch is not null").withColumn("ts", F.timestamp_seconds("timestamp"))


def range_digests(spark: SparkSession, path: str, piece: int = 64 << 20, glob: str = "*") -> DataFrame:
    """(path, start, length, sha256) of the files below a folder, by ranges of ``piece`` bytes, so that the tasks which read a large file are
    many and files may be larger than a row can be. Only names and sizes are listed; a task reads its ranges a block at a time, through
    pyarrow's file systems. Empty files are not listed by Spark's reader. A file that ends before its listed size is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")
    ranges = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(piece).cast("long"))).alias("start"), F.col("length").alias("size"))
    ranges = ranges.select("path", "start", F.least(F.lit(piece), F.col("size") - F.col("start")).cast("long").alias("length")).repartition("path", "start")

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for file, start, length in zip(frame.path, frame.start, frame.length, strict=True):
                system, at = pyarrow.fs.FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", file), safe="/:@"))
                h, left = hashlib.sha256(), int(length)
                with system.open_input_file(at) as f:
                    f.seek(int(start))
                    while left:
                        block = f.read(min(left, 1 << 20))
                        if not block:
                            raise OSError(f"{file} ends {left} bytes before its listed size")
                        h.update(block)
                        left -= len(block)
                out.append(h.hexdigest())
            yield frame.assign(sha256=out)

    return ranges.mapInPandas(digest, "path string, start long, length long, sha256 string")


def tree_digests(ranges: DataFrame) -> DataFrame:
    """(path, size, ranges, sha256) a file: the digest of its ranges' digests, as lowercase hex in order. A row a range goes into it, no bytes."""
    order = F.array_sort(F.collect_list(F.struct("start", "sha256")))
    out = ranges.groupBy("path").agg(F.sum("length").alias("size"), F.count("*").alias("ranges"), order.alias("d"))
    return out.select("path", "size", "ranges", F.sha2(F.array_join(F.transform("d", lambda x: x["sha256"]), ""), 256).alias("sha256"))
