"""Sharding: size-tiered compaction of small immutable shards, with a versioned manifest (operator 8).

A table is a folder of runs, folders of Parquet shards that are never changed once written, and manifests v<N>.json that list
the live runs. An arrival is written as one run of small shards; compaction merges the runs of one size tier (by the mean size
of their shards), when enough shards are there, into a run of files of about the target size. A version is committed by
creating its manifest, whole, under its name only if that name is free; a writer that was slower puts its change on top of the
faster one's version and tries again. Files that no manifest lists are never read, and vacuum() removes them.

Merging needs no shuffle: the scan packs small files into splits of the target size, and each split is written as one shard.
The driver holds a row a run, not a row a shard: each merge makes one run of all runs of a tier.

Rows are kept as they come: nulls, empty and very long texts, repeated rows and further columns. All arrivals of a table have the
same columns (others are refused); an arrival without rows is a run without shards.
"""

from __future__ import annotations

import json
import os
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.common import fresh, shared_folder

#: Size of a merged shard, and of the smallest tier; each tier is FACTOR times the one below; shards of a tier that make it merge.
TARGET, SMALLEST, FACTOR, RUNS = 128 << 20, 1 << 20, 4, 4
#: Rows of a shard that an append writes at most; hours after which an unlisted folder is no writer's work in progress.
ROWS, GRACE = 20_000, 24.0
#: Attempts of a commit, and seconds of the first pause between them at most.
TRIES, PAUSE = 20, 0.05


@dataclass(frozen=True)
class Run:
    """A folder of shards below the table's root, with their number, rows and bytes."""

    path: str
    shards: int
    rows: int
    size: int


def tier(size: int, smallest: int = SMALLEST, factor: int = FACTOR) -> int:
    """0 up to the smallest size, then one more for each factor."""
    k = 0
    while size > smallest:
        size, k = -(-size // factor), k + 1
    return k


def _as_stored(schema: StructType) -> StructType:
    """The schema as Parquet gives it back: all columns may be null."""
    return StructType.fromJson(json.loads(schema.json().replace('"nullable":false', '"nullable":true')))


class ShardedTable:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, runs: int = RUNS, smallest: int = SMALLEST) -> None:
        self.spark, self.root, self.target, self.runs, self.smallest = spark, root.rstrip("/"), target, runs, smallest
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest_path(self, version: int):
        return self._path(f"{self.root}/manifests/v{version:08d}.json")

    def version(self) -> int:
        """The latest version, 0 for a table without any."""
        found = self._fs.globStatus(self._path(f"{self.root}/manifests/v*.json")) or []
        return max((int(s.getPath().getName()[1:-5]) for s in found), default=0)

    def _document(self, version: int) -> dict:
        if not version:
            return {"schema": None, "runs": []}
        stream = self._fs.open(self._manifest_path(version))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> list[Run]:
        return [Run(**x) for x in self._document(self.version() if version is None else version)["runs"]]

    def _published(self, version: int, text: str) -> bool:
        """Creates a version's manifest; False if there is one. On local disks by a hard link to a finished draft and on HDFS by renaming
        one, both of which fail if the name is taken; on object stores by a create that doesn't overwrite, which shows the object when
        it is whole (exclusive where the store has conditional writes)."""
        final, scheme = self._manifest_path(version), self._fs.getUri().getScheme()
        if scheme in ("s3a", "gs", "abfs", "abfss", "wasb", "wasbs", "oss", "cosn"):
            try:
                out = self._fs.create(final, False)
                out.write(bytearray(text.encode()))
                out.close()
            except Py4JJavaError as e:
                if self._fs.exists(final):
                    return False
                raise e
            return True
        draft = self._path(f"{self.root}/manifests/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if scheme != "file":
                return bool(self._fs.rename(draft, final))
            os.link(draft.toUri().getPath(), final.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            self._fs.delete(draft, False)

    def commit(self, runs: list[Run], base: int, schema: str | None = None) -> int:
        """Creates version base + 1; fails if another writer already has."""
        schema = schema or self._document(base)["schema"]
        text = json.dumps({"version": base + 1, "parent": base, "schema": schema, "runs": [asdict(r) for r in sorted(runs, key=lambda r: r.path)]})
        if not self._published(base + 1, text):
            raise RuntimeError(f"version {base + 1} was committed by another writer")
        return base + 1

    def _changed(self, change: Callable[[list[Run]], list[Run] | None], schema: str | None = None) -> int:
        """Commits change(live runs) on top of the latest version; 0 if it gives None. If another writer was faster it tries again after a
        pause that grows, TRIES times in all."""
        for k in range(TRIES):
            if k:
                time.sleep(random.uniform(0, min(PAUSE * 2**k, 10.0)))
            base = self.version()
            document = self._document(base)
            if schema and document["schema"] and json.loads(schema) != json.loads(document["schema"]):
                raise ValueError("the rows' columns are not the table's")
            runs = change([Run(**x) for x in document["runs"]])
            if runs is None:
                return 0
            try:
                return self.commit(runs, base, schema or document["schema"])
            except RuntimeError:
                continue
        raise RuntimeError(f"other writers were faster {TRIES} times")

    def _measured(self, path: str, schema: StructType) -> Run:
        files = self.spark.read.schema(schema).parquet(f"{self.root}/{path}").groupBy("_metadata.file_path").agg(F.count("*").alias("n"), F.max("_metadata.file_size").alias("size"))
        r = files.agg(F.count("*").alias("shards"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
        return Run(path, r["shards"], r["n"], r["size"])

    def append(self, df: DataFrame, rows: int = ROWS, arrival: Column | None = None) -> int:
        """Adds df's rows as one run of small shards of at most ``rows`` rows, and commits. With ``arrival`` (a column of few values)
        the rows of each value are a run of their own, written in the same job and committed in the same version."""
        at = f"shards/{uuid.uuid4().hex}"
        schema = _as_stored(df.schema)
        writer = lambda d: d.write.option("compression", "zstd").option("maxRecordsPerFile", rows)
        if arrival is None:
            writer(df).parquet(f"{self.root}/{at}")
            paths = [at]
        else:
            # the folders' column is a name that neither df nor the files have
            name = fresh(df, "arrival")
            writer(df.withColumn(name, arrival.cast("string"))).partitionBy(name).parquet(f"{self.root}/{at}")
            found = self._fs.globStatus(self._path(f"{self.root}/{at}/{name}=*")) or []
            paths = [f"{at}/{s.getPath().getName()}" for s in found] or [at]
        new = [self._measured(p, schema) for p in paths]
        return self._changed(lambda live: live + new, schema.json())

    def _due(self, live: list[Run]) -> list[list[Run]]:
        """The runs of each tier below half the target size that has at least ``runs`` shards."""
        tiers: dict[int, list[Run]] = {}
        for r in live:
            if r.shards and r.size // r.shards < self.target // 2:
                tiers.setdefault(tier(r.size // r.shards, self.smallest), []).append(r)
        return [own for _, own in sorted(tiers.items()) if sum(r.shards for r in own) >= self.runs]

    def compact(self) -> int:
        """Merges until no tier is due; each merge is one job and one commit. Runs that another compaction has merged meanwhile are left to it."""
        settled: set[Run] = set()
        while True:
            due = [own for own in self._due(self.manifest()) if not settled.issuperset(own)]
            if not due:
                return self.version()
            merged = self._merge(due[0])
            old = set(due[0])
            fewer = merged.shards < sum(r.shards for r in old)
            if not fewer or not self._changed(lambda live: [r for r in live if r not in old] + [merged] if old.issubset(live) else None):
                self._fs.delete(self._path(f"{self.root}/{merged.path}"), True)
                settled |= old if not fewer else set()

    def _merge(self, runs: list[Run]) -> Run:
        session = self.spark.newSession()  # its own settings of how scans pack files
        session.conf.set("spark.sql.files.maxPartitionBytes", str(self.target))
        session.conf.set("spark.sql.files.openCostInBytes", "0")
        session.conf.set("spark.sql.files.minPartitionNum", "1")
        at, schema = f"shards/{uuid.uuid4().hex}", self._schema()
        rows = session.read.schema(schema).parquet(*(f"{self.root}/{r.path}" for r in runs))
        rows.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(f"{self.root}/{at}")
        return self._measured(at, schema)

    def _schema(self, version: int | None = None) -> StructType:
        return StructType.fromJson(json.loads(self._document(self.version() if version is None else version)["schema"]))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest by default."""
        version = self.version() if version is None else version
        return self.spark.read.schema(self._schema(version)).parquet(*(f"{self.root}/{r.path}" for r in self.manifest(version)))

    def vacuum(self, keep: int = 2, grace: float = GRACE) -> None:
        """Deletes all versions but the last ``keep``, the runs that only they list, and folders that no version lists and that
        are older than ``grace`` hours (what lost commits and failed writers left)."""
        last = self.version()
        versions = [s.getPath() for s in self._fs.globStatus(self._path(f"{self.root}/manifests/v*.json")) or []]
        old = [p for p in versions if int(p.getName()[1:-5]) <= last - keep]
        live = {r.path for v in range(max(1, last - keep + 1), last + 1) for r in self.manifest(v)}
        gone = {r.path for p in old for r in self.manifest(int(p.getName()[1:-5]))} - live
        for path in [*(self._path(f"{self.root}/{r}") for r in gone), *old]:
            self._fs.delete(path, True)
        before = (time.time() - 3600 * grace) * 1000
        for s in self._fs.globStatus(self._path(f"{self.root}/shards/*")) or []:
            name = f"shards/{s.getPath().getName()}"
            if s.getModificationTime() < before and not any(r == name or r.startswith(f"{name}/") for r in live):
                self._fs.delete(s.getPath(), True)


#: Arrivals that op8 splits the table into, and in how many appends they come.
ARRIVALS, APPENDS = 4, 2


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, arriving in APPENDS commits of several runs each, with a compaction after each: for each row, read from the last version's shards, its shard and how large that is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    table = ShardedTable(spark, f"{shared_folder(spark)}/plumbline/shards-{uuid.uuid4().hex}")
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS))
    for k in range(APPENDS):
        table.append(docs.where(arrival % APPENDS == k), rows=2_000, arrival=arrival)
        table.compact()
    table.vacuum(keep=1)
    size = F.col("_metadata.file_size")
    tiers = F.when(size <= SMALLEST, 0).otherwise(F.ceil(F.log(float(FACTOR), size / SMALLEST) - 1e-12)).cast("int")
    return table.read().select("doc_id", F.col("_metadata.file_name").alias("shard"), size.alias("shard_bytes"), tiers.alias("tier"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
