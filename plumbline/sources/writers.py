"""Writers of manifests, reports and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_manifest(manifest: DataFrame, out: str) -> None:
    """Usable rows as Parquet partitioned by split, ranges of class and path in order in each file; bad rows as gzip CSV beside them."""
    order = ["split", "class_id", "relative_path"]
    ok = manifest.where("decode_status = 'ok'")
    ok.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("split").parquet(f"{out}/manifest")
    manifest.where("decode_status <> 'ok'").orderBy("class_id", "relative_path").write.option("compression", "gzip").csv(f"{out}/excluded", header=True)


def write_report(report: DataFrame, out: str) -> None:
    report.write.mode("overwrite").json(out)


def canonical_json(*columns: str) -> Column:
    """A compact JSON object with its keys in alphabetical order and nulls kept."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"})


def write_hierarchy_view(df: DataFrame, out: str) -> None:
    """Rows to browse as host / category folders."""
    df.write.mode("overwrite").partitionBy("host_id", "category").parquet(out)


def write_journal(records: DataFrame, out: str) -> None:
    """Records (run, text) of many runs as JSON lines, for readers.read_journal."""
    records.select(F.col("run").cast("string").alias("run"), "text").write.json(out)
