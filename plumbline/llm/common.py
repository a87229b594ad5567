"""What the operators of this subpackage share: the shared working folder, text batches, the training split and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into arrays at once.
TEXT_BLOCK = 1 << 21


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only in local mode, where it may be unset, one is made and set."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-plumbline-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class _Stored:
    """A table in the shared folder, as a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def delete(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


_written: list[_Stored] = []


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df, written as Parquet to a new table in the shared folder and read again: its lineage ends there and survives lost executors.

    The table stays until dropped() or clean() deletes it: results of the operators read such tables when they are used.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plumbline/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written.append(_Stored(spark, path))
    out._plumbline_table = _written[-1]
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the table of a DataFrame that stored() gave, once nothing reads it any more."""
    df._plumbline_table.delete()
    _written.remove(df._plumbline_table)


def clean() -> int:
    """Deletes all tables that stored() has written in this process; call it when the results of the operators are written. How many."""
    n = len(_written)
    while _written:
        _written.pop().delete()
    return n


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (f"{name}_{k}" for k in range(len(taken) + 1)) if x not in taken)


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids count as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def sampled(df: DataFrame, most: int, key: str) -> DataFrame:
    """The rows of df whose hashed key is smallest, at most ``most``. Where there are many more, a bound on the hash (set for twice as
    many) leaves tasks little to sort and to send."""
    n, whole = df.count(), 1 << 30
    at = F.pmod(F.xxhash64(key), F.lit(whole))
    if n > 4 * most:
        df = df.where(at < F.lit(int(whole * 2 * most / n)))
    return df.orderBy(at, key).limit(most)


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text", block: int = TEXT_BLOCK) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches with about ``block`` bytes of text each, and their texts as UTF-8 bytes. Only a slice's texts are made
    Python objects at a time, however long the texts of a batch are."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        start = 0
        while start < len(texts):
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + block)) + 1
            stop = min(stop, len(texts))
            yield batch.slice(start, stop - start), texts.slice(start, stop - start).to_pylist()
            start = stop


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components: (id, component), component = the smallest id reachable; ids without an edge are not listed.

    edges has two long columns src and dst. Alternates large-star and small-star steps: each node hands its larger (then its
    smaller) neighbours over to its smallest neighbour, so chains shorten by halves and the result is a star per component.
    A step is one aggregation and one join; a node with very many neighbours is pre-aggregated on the map side, and its join
    side can be split as a skewed key. Each round is written to the shared folder, which cuts the lineage.
    """
    now = stored(edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # small star: every node links its smaller neighbours and itself to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select("m", "u", "v")
        old, now = now, stored(small.select(F.col("m").alias("u"), F.col("u").alias("v")).where("u <> v").union(small.select(F.col("m").alias("u"), "v")).distinct(), "edges")
        dropped(old)
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("component")).union(now.select("u").distinct().select(F.col("u").alias("id"), F.col("u").alias("component")))
