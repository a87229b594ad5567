"""Commits of written tables: rows go to a folder of their own first, and a marker that only one writer can create makes them the table."""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MARKER = "_committed.json"
#: Stores without links and renames that fail if the name is taken; a create that doesn't overwrite is exclusive there.
_OBJECTS = ("s3a", "gs", "abfs", "abfss", "wasb", "wasbs", "oss", "cosn")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> str | None:
    at, fs = _file_system(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file with the whole text; False, and nothing changed, if there is one of that name, whoever else tries at the time."""
    at, fs = _file_system(spark, path)

    def write(p) -> None:
        out = fs.create(p, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    scheme = fs.getUri().getScheme()
    if scheme in _OBJECTS:
        try:
            write(at)
        except Py4JJavaError:
            if fs.exists(at):
                return False
            raise
        return True
    draft = spark._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".draft-{uuid.uuid4().hex}")
    write(draft)
    try:
        if scheme != "file":
            return bool(fs.rename(draft, at))
        os.link(draft.toUri().getPath(), at.toUri().getPath())
        return True
    except FileExistsError:
        return False
    finally:
        fs.delete(draft, False)


def _measures(df: DataFrame) -> list:
    """Row count and a hash of all rows that does not depend on their order."""
    row = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    return [F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("hash")]


def _mark(df: DataFrame, found: dict) -> dict:
    return {"rows": int(found["rows"]), "hash": str(found["hash"]), "columns": {f.name: f.dataType.simpleString() for f in sorted(df.schema, key=lambda f: f.name)}}


def fingerprint(df: DataFrame) -> dict:
    """Row count, hash and columns of df, the same for the same rows in any order and column order."""
    return _mark(df, df.agg(*_measures(df)).first().asDict())


def committed(spark: SparkSession, out: str) -> dict | None:
    """The marker of the table at ``out``: the fingerprint of its rows and their folder; None if none is committed."""
    text = _read(spark, f"{out.rstrip('/')}/{MARKER}")
    return None if text is None else json.loads(text)


def write_once(df: DataFrame, out: str) -> bool:
    """Writes df as the Parquet table ``out`` (True) unless it has the same rows already (False); other rows there are a ValueError.

    Rows go to a new folder below ``out`` and are counted and hashed on the way; then the marker is created if absent. Of writers that race
    one wins, and the others compare their rows with its marker and delete their folders. What a lost writer left is named by no marker and
    never read. Where there is a marker, df is hashed and compared with it; the table's data are not read. Files without a marker are another's, and an error.
    """
    spark, out = df.sparkSession, out.rstrip("/")
    there = committed(spark, out)
    if there is None:
        at, fs = _file_system(spark, out)
        if fs.exists(at) and any(not s.getPath().getName().startswith(("rows-", ".draft-", "_")) for s in fs.listStatus(at)):
            raise ValueError(f"{out} has files that were not written by write_once")
        folder, seen = f"rows-{uuid.uuid4().hex}", Observation()
        df.observe(seen, *_measures(df)).write.parquet(f"{out}/{folder}")
        own = _mark(df, seen.get)
        if put_if_absent(spark, f"{out}/{MARKER}", json.dumps({**own, "folder": folder})):
            return True
        fs.delete(_file_system(spark, f"{out}/{folder}")[0], True)
        there = committed(spark, out)
    else:
        own = fingerprint(df)
    if {k: there[k] for k in own} != own:
        raise ValueError(f"{out} exists with other rows")
    return False


def read_once(spark: SparkSession, out: str) -> DataFrame:
    """The rows committed at ``out``."""
    there = committed(spark, out)
    if there is None:
        raise FileNotFoundError(f"no table is committed at {out}")
    return spark.read.parquet(f"{out.rstrip('/')}/{there['folder']}")
