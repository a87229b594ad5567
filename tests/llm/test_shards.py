"""Sharded tables: round trips, versions, racing writers, odd rows."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from plumbline.llm import shards


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_round_trip(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    table = shards.ShardedTable(spark, str(tmp_path / "t"), target=1 << 20, smallest=1 << 12, runs=3)
    for k in range(5):
        table.append(df.where(F.col("doc_id") % 5 == k), rows=20)
    before, first = sum(r.shards for r in table.manifest()), table.version()
    table.compact()
    assert sum(r.shards for r in table.manifest()) < before and table.version() > first == 5
    assert same(table.read(), df)
    assert table.read(first).count() == df.count()  # versions before are still there
    assert sum(r.rows for r in table.manifest()) == df.count()
    with pytest.raises(RuntimeError):
        table.commit([], table.version() - 1)
    table.vacuum(keep=1)
    assert same(table.read(), df) and len(list((tmp_path / "t" / "manifests").glob("v*.json"))) == 1
    again = table.version()
    assert table.compact() == again
    with pytest.raises(ValueError, match="columns"):
        table.append(df.select("doc_id"))


def test_tiers(spark, tmp_path):
    """Large runs stay as they are while small ones of a tier are merged."""
    table = shards.ShardedTable(spark, str(tmp_path / "t"), target=1 << 16, smallest=1 << 11, runs=4)
    table.append(spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1), rows=100_000)
    large = table.manifest()[0]
    for k in range(4):
        table.append(spark.range(20).select(F.lit(f"small {k}").alias("x")).coalesce(1))
    table.compact()
    assert large in table.manifest() and len(table.manifest()) == 2 and table.read().count() == 60_080
    assert [shards.tier(s, 100, 4) for s in (1, 100, 101, 400, 401, 1601)] == [0, 0, 1, 1, 2, 3]


def test_two_writers(spark, tmp_path):
    tables = [shards.ShardedTable(spark, str(tmp_path / "t"), target=1 << 20, smallest=1 << 12, runs=4) for _ in range(2)]
    failed = []

    def work(k):
        try:
            for i in range(4):
                tables[k].append(spark.range(10).select((F.col("id") + 100 * k + 10 * i).alias("id")).coalesce(1))
                if i % 2:
                    tables[k].compact()
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    ids = sorted(r.id for r in tables[0].read().collect())
    assert ids == [*range(40), *range(100, 140)]
    names = sorted(int(p.name[1:-5]) for p in (tmp_path / "t" / "manifests").glob("v*.json"))
    assert names == list(range(1, len(names) + 1))


def test_lost_merge_leaves_nothing(spark, tmp_path, monkeypatch):
    table = shards.ShardedTable(spark, str(tmp_path / "t"), target=1 << 20, smallest=1 << 12, runs=2)
    other = shards.ShardedTable(spark, str(tmp_path / "t"), target=1 << 20, smallest=1 << 12, runs=2)
    for _ in range(2):
        table.append(spark.range(10).coalesce(1))
    merge = table._merge

    def slow(runs):
        out = merge(runs)
        other.compact()  # another writer merges the same runs first
        return out

    monkeypatch.setattr(table, "_merge", slow)
    table.compact()
    assert table.read().count() == 20 and len(table.manifest()) == 1
    assert len(list((tmp_path / "t" / "shards").iterdir())) == 3  # two arrivals and the other writer's run
    (tmp_path / "t" / "shards" / "left").mkdir()
    table.vacuum(keep=1, grace=0.0)
    assert len(list((tmp_path / "t" / "shards").iterdir())) == 1 and table.read().count() == 20


def test_odd_and_empty(spark, odd, none, tmp_path):
    table = shards.ShardedTable(spark, str(tmp_path / "t"), runs=2)
    table.append(none)
    assert table.read().count() == 0 and sum(r.shards for r in table.manifest()) == 0
    table.append(odd.union(odd), rows=3, arrival=F.coalesce(F.col("source"), F.lit("none")))
    table.compact()
    assert same(table.read(), odd.union(odd)) and table.read().columns == odd.columns
    empty = shards.ShardedTable(spark, str(tmp_path / "e"))
    empty.append(none, arrival=F.col("source"))
    assert empty.compact() == 1 and empty.read().count() == 0


def test_arrivals_beside_columns_of_their_name(spark, tmp_path):
    """The folders' column takes a name that the table does not have, whatever that is called."""
    df = spark.range(40).selectExpr("id", "id * 2 as arrival_0", "cast(id as string) as __arrival", "id % 3 as arrival")
    t = shards.ShardedTable(spark, str(tmp_path / "t"))
    t.append(df, arrival=F.col("id") % 4)
    assert len(t.manifest()) == 4
    t.compact()
    assert t.read().columns == df.columns and t.read().exceptAll(df).count() == 0 == df.exceptAll(t.read()).count()


def test_choice_of_runs_in_plain_python(spark, tmp_path):
    """The runs that compact() would merge first, against sizes put into tiers by hand, over versions with several commits."""
    t = shards.ShardedTable(spark, str(tmp_path / "t"), target=1 << 20, runs=3, smallest=1000)
    rng = random.Random(3)
    for k in range(60):
        live = [shards.Run(f"shards/{k}-{j}", rng.randint(0, 3), 10, rng.randint(0, 3_000_000)) for j in range(rng.randint(0, 9))]
        want = {}
        for r in live:
            if r.shards and r.size // r.shards < 1 << 19:
                mean, level = r.size // r.shards, 0
                while mean > 1000 * 4**level:
                    level += 1
                want.setdefault(level, []).append(r)
        assert t._due(live) == [own for _, own in sorted(want.items()) if sum(r.shards for r in own) >= 3]


def test_commits_give_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "TRIES", 3)
    monkeypatch.setattr(shards.ShardedTable, "_published", lambda self, version, text: False)
    with pytest.raises(RuntimeError, match="3 times"):
        shards.ShardedTable(spark, str(tmp_path / "t")).append(spark.range(3))
