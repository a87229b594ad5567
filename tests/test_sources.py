"""Readers and writers on small hand-made files."""

import base64
import json

import pytest

from plumbline.sources import commits as Cm
from plumbline.sources import readers as R
from plumbline.sources import writers as Wr

PNG = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mNk+M9QDwADhgGAWjR9awAAAABJRU5ErkJggg==")


def test_class_list(spark, tmp_path):
    f = tmp_path / "c.txt"
    f.write_text("# names\nb\n\n  a \nc\n")
    assert [(r.class_id, r.name) for r in R.read_class_list(spark, str(f)).orderBy("class_id").collect()] == [(0, "b"), (1, "a"), (2, "c")]
    f.write_text("a\na\n")
    with pytest.raises(ValueError, match="duplicates"):
        R.read_class_list(spark, str(f))


def test_alias_map(spark, tmp_path):
    f, c = tmp_path / "m.json", tmp_path / "c.txt"
    c.write_text("a\nb\n")
    classes = R.read_class_list(spark, str(c))
    f.write_text('{"a": "x",\n "b": "y"}')
    assert {tuple(r) for r in R.read_alias_map(spark, str(f), classes).collect()} == {("a", "x"), ("b", "y")}
    for bad in ('{"a": "x", "b": "x"}', '{"a": "x"}', '{"a": null, "b": "y"}'):
        f.write_text(bad)
        with pytest.raises(ValueError):
            R.read_alias_map(spark, str(f), classes)


def test_files_and_images(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.png").write_bytes(PNG)
    (tmp_path / "d" / "b.jpg").write_bytes(b"junk")
    assert {(r.dir, r["name"], r.size_bytes) for r in R.scan_files(spark, str(tmp_path)).collect()} == {("d", "a.png", len(PNG)), ("d", "b.jpg", 4)}
    assert R.scan_files(spark, str(tmp_path), recursive=False).count() == 2
    got = {r.path.rsplit("/", 1)[1]: (r.decode_status, r.width, r.height) for r in R.audit_images(spark, str(tmp_path)).collect()}
    assert got == {"a.png": ("ok", 1, 1), "b.jpg": ("bad", None, None)}


def xml(*objects, size="<size><width>640</width><height>480</height></size>"):
    return "<annotation>" + size + "".join(f"<object><name>{n}</name>" + (f"<bndbox><xmin>{b[0]}</xmin><ymin>{b[1]}</ymin><xmax>{b[2]}</xmax><ymax>{b[3]}</ymax></bndbox>" if b else "") + "</object>" for n, b in objects) + "</annotation>"


def test_voc(spark, tmp_path):
    a = xml((1, (1, 2, 3, 4)))
    (tmp_path / "twice.xml").write_text(a + "\n" + a)
    (tmp_path / "two.xml").write_text(a + xml((2, ("nan", 2, 3, 4)), (3, None)))
    (tmp_path / "junk.xml").write_text("nothing here")
    (tmp_path / "nosize.xml").write_text(xml((1, (1, 2, 3, 4)), size=""))
    got = {r.image_id: r for r in R.read_voc_annotations(spark, str(tmp_path / "*.xml")).collect()}
    assert (got["twice"].n_docs, got["twice"].n_dup, len(got["twice"].objects), got["twice"].width) == (1, 1, 1, 640)
    assert [o.name for o in got["two"].objects] == ["1", "2", "3"] and got["two"].objects[0].xmin == 1.0
    assert got["two"].objects[2].xmin is None
    assert got["junk"].status == "no_annotation" and got["nosize"].status == "no_size"


def test_ids_manifest_index(spark, tmp_path):
    ids = tmp_path / "ids.txt"
    ids.write_text("b\na\n")
    index = R.read_id_list(spark, str(ids))
    assert [(r.formal_index, r.image_id) for r in index.orderBy("formal_index").collect()] == [(0, "b"), (1, "a")]
    (tmp_path / "i.jsonl").write_text('{"image_id": "a", "k": 1}\n{"image_id": "b", "k": 2}\n{"image_id": "z", "k": 3}\n')
    assert R.read_annotation_index(spark, str(tmp_path / "i.jsonl"), index, "image_id string, k int").count() == 2
    (tmp_path / "i.jsonl").write_text('{"image_id": "a", "k": 1}\n')
    with pytest.raises(ValueError, match="lacks b"):
        R.read_annotation_index(spark, str(tmp_path / "i.jsonl"), index, "image_id string, k int")
    m = spark.createDataFrame([("p1", 0, "h", 1, None, None, "ok", "", "h", "train"), ("p2", 0, "g", 1, None, None, "ok", "", "g", "val"), ("p3", 1, "f", 1, None, None, "bad", "x", "f", "")], R.MANIFEST)
    Wr.write_manifest(m, str(tmp_path / "out"))
    assert [r.relative_path for r in R.read_manifest(spark, str(tmp_path / "out/manifest"), "train").collect()] == ["p1"]
    assert spark.read.csv(str(tmp_path / "out/excluded"), header=True).count() == 1
    m.coalesce(1).write.option("compression", "gzip").csv(str(tmp_path / "m.csv"), header=True)
    assert R.read_manifest(spark, str(tmp_path / "m.csv"), "val").count() == 1


def test_json_and_history(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"classes": [{"id": 1, "n": "a"}, {"id": 2, "n": "b"}], "version": 1}, indent=1))
    assert R.read_json_table(spark, str(tmp_path / "t.json"), "classes").count() == 2
    for run, text in (("r1", '[{"epoch": 1, "train_loss": 0.5, "timestamp": 10.0}]'), ("r2", "{broken")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "history.json").write_text(text)
    rows = R.read_run_history(spark, str(tmp_path / "*/history.json")).collect()
    assert [(r.run, r.epoch) for r in rows] == [("r1", 1)]


def test_canonical_json(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    assert sorted(r.j for r in df.select(Wr.canonical_json("s", "i").alias("j")).collect()) == ['{"i":1,"s":"a"}', '{"i":2,"s":null}']


def test_write_once(spark, tmp_path):
    """Same rows in any order are a no-op that reads no data; other rows, types or files of others are errors; empty tables count too."""
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "i int, s string")
    out = str(tmp_path / "o")
    assert Cm.write_once(df, out)
    for f in tmp_path.glob("o/rows-*/*.parquet"):
        f.rename(f.with_suffix(".away"))
    assert not Cm.write_once(df.orderBy("s").select("s", "i"), out)
    for f in tmp_path.glob("o/rows-*/*.away"):
        f.rename(f.with_suffix(".parquet"))
    assert sorted(map(str, Cm.read_once(spark, out).collect())) == sorted(map(str, df.collect()))
    for other in (df.limit(1), df.distinct(), df.selectExpr("cast(i as bigint) as i", "s"), df.withColumnRenamed("s", "t")):
        with pytest.raises(ValueError, match="other rows"):
            Cm.write_once(other, out)
    assert Cm.write_once(df.limit(0), str(tmp_path / "e")) and not Cm.write_once(df.limit(0), str(tmp_path / "e")) and Cm.read_once(spark, str(tmp_path / "e")).count() == 0
    df.write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError, match="not written by write_once"):
        Cm.write_once(df, str(tmp_path / "p"))
    with pytest.raises(FileNotFoundError):
        Cm.read_once(spark, str(tmp_path / "p"))


def test_racing_writers(spark, tmp_path):
    """Of eight writers with four different tables one wins; the one with its rows learns that they are there, the others fail, and no folder but the winner's is left."""
    from concurrent.futures import ThreadPoolExecutor

    out = str(tmp_path / "r")

    def attempt(k):
        try:
            return Cm.write_once(spark.range(100).selectExpr(f"id + {k % 4} as x"), out)
        except ValueError:
            return None

    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(attempt, range(8)))
    (winner,) = [k for k in range(8) if got[k] is True]
    assert [k for k in range(8) if got[k] is False] == [(winner + 4) % 8] and got.count(None) == 6
    assert Cm.read_once(spark, out).agg({"x": "min"}).first()[0] == winner % 4
    assert len(list(tmp_path.glob("r/rows-*"))) == 1 and not list(tmp_path.glob("r/.draft-*"))


def test_hierarchy(spark, tmp_path):
    Wr.write_hierarchy_view(spark.createDataFrame([("h", "c", 1)], "host_id string, category string, class_id int"), str(tmp_path / "v"))
    assert (tmp_path / "v/host_id=h/category=c").is_dir()
    Wr.write_report(spark.createDataFrame([(1,)], "total int"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().total == 1


def test_id_list_of_many_splits(spark, tmp_path):
    (tmp_path / "l").mkdir()
    ids = [f"id{(k * 7919) % 5000:05d}" for k in range(5000)]
    (tmp_path / "l" / "part-0").write_text("\n".join(ids[:3000]) + "\n\n")
    (tmp_path / "l" / "part-1").write_text("\r\n".join(f" {i} " for i in ids[3000:]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = R.read_id_list(spark, str(tmp_path / "l")).orderBy("formal_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.formal_index for r in rows] == list(range(5000)) and [r.image_id for r in rows] == ids


def test_run_state(spark, tmp_path):
    for run, text in (("r1", '{"task": "t", "status": "running", "epoch": 3}'), ("r2", "{broken"), ("r3", '{"epoch": 1}')):
        (tmp_path / "tasks" / run).mkdir(parents=True)
        (tmp_path / "tasks" / run / "state.json").write_text(text)
    got = {r.run: (r.task, r.status, r.epoch) for r in R.read_run_state(spark, str(tmp_path / "tasks/*/state.json")).collect()}
    assert got == {"r1": ("t", "running", 3), "r2": ("tasks", None, None), "r3": ("tasks", None, 1)}


def test_annotation_lines(spark, tmp_path):
    a = xml((1, (1, 2, 3, 4))).replace("<annotation>", "<annotation><filename>a.b.jpg</filename>")
    (tmp_path / "x.txt").write_text(a + "\n" + a + "\n" + xml((2, (1, 2, 3, 4)), (3, (1, 2, 3, 4))).replace("<annotation>", "<annotation><filename>c.png</filename>") + "\n")
    got = {r.image_id: (r.n_docs, r.n_dup, len(r.objects)) for r in R.read_annotation_lines(spark, str(tmp_path / "x.txt")).collect()}
    assert got == {"a.b": (1, 1, 1), "c": (1, 0, 2)}


def test_image_headers(spark, tmp_path):
    """Files as their formats define them: every kind of WebP, JPEG segments before the frame, ends missing, and bytes of no image."""
    big, little = (lambda n, k: n.to_bytes(k, "big")), (lambda n, k: n.to_bytes(k, "little"))
    png = bytes.fromhex("89504E470D0A1A0A0000000D49484452") + big(70000, 4) + big(3, 4) + b"\x08\x06\0\0\0" + bytes(4) + bytes.fromhex("0000000049454E44AE426082")
    frame = b"\xff\xc2" + big(17, 2) + b"\x08" + big(33, 2) + big(44, 2) + b"\x01" + bytes(9)
    jpeg = b"\xff\xd8" + b"\xff\xe1" + big(20, 2) + b"\xff\xc0" + bytes(16) + b"\xff\xc4" + big(4, 2) + bytes(2) + frame + bytes(50) + b"\xff\xd9"
    gif = b"GIF87a" + little(300, 2) + little(2, 2) + bytes(3) + b"\x3b"
    riff = lambda kind, body: b"RIFF" + little(4 + 8 + len(body), 4) + b"WEBP" + kind + little(len(body), 4) + body
    lossless = riff(b"VP8L", b"\x2f" + little((640 - 1) | (480 - 1) << 14 | 1 << 28, 4))
    lossy = riff(b"VP8 ", bytes(3) + b"\x9d\x01\x2a" + little(176 | 1 << 14, 2) + little(144, 2) + bytes(4))
    more = riff(b"VP8X", bytes(4) + little(99999, 3) + little(4, 3))
    want = {
        "a.png": (png, "PNG", "RGBA", 70000, 3, False, ""), "b.jpeg": (jpeg, "JPEG", "L", 44, 33, False, ""), "c.gif": (gif, "GIF", "P", 300, 2, False, ""), "d.webp": (lossless, "WEBP", "RGBA", 640, 480, False, ""),
        "e.webp": (lossy, "WEBP", "RGB", 176, 144, False, ""), "f.webp": (more, "WEBP", "RGB", 100000, 5, False, ""), "g.jpg": (png, "PNG", "RGBA", 70000, 3, True, ""),
        "h.png": (png[:-4], "PNG", "RGBA", 70000, 3, False, "Truncated: PNG without its end"), "i.png": (png[:20], "PNG", None, 70000, None, False, "BadHeader: PNG without a size"), "j.jpg": (jpeg[:30], "JPEG", None, None, None, False, "BadHeader: JPEG without a size"),
        "k.webp": (lossy[:-2], "WEBP", "RGB", 176, 144, False, "Truncated: WEBP without its end"), "l.jpg": (b"", None, None, None, None, False, "Empty: no bytes"), "m.jpg": (b"text", None, None, None, None, False, "UnknownFormat: begins with 74657874"),
        "n.jpg": (b"\xff\xd8\xff\xe0\0\x01", "JPEG", None, None, None, False, "BadHeader: JPEG without a size"),
    }
    (tmp_path / "kind").mkdir()
    for name, row in want.items():
        (tmp_path / "kind" / name).write_bytes(row[0])
    got = {r.path.rsplit("/", 1)[1]: r for r in R.audit_images(spark, str(tmp_path)).collect()}
    want.pop("l.jpg")  # Spark's reader lists no empty file
    assert got.keys() == want.keys()
    for name, (raw, *row) in want.items():
        r = got[name]
        assert [r.image_format, r.image_mode, r.width, r.height, r.renamed, r.decode_error] == row and r.size_bytes == len(raw), name
        assert r.decode_status == ("ok" if row[-1] == "" else "bad")


def test_ranges_of_files(spark, tmp_path):
    """Digests by range against hashlib, last ranges and whole multiples included; a changed byte names its range, other sizes their last ones."""
    import hashlib
    import random

    from plumbline.operators.manifest import changed_ranges

    rng = random.Random(1)
    blobs = {"a.bin": rng.randbytes(2_500_000), "b.bin": rng.randbytes(3 * 4096), "c.bin": b"x", "sub/a b.bin": rng.randbytes(5000)}
    for name, blob in blobs.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(blob)
    (tmp_path / "none.bin").write_bytes(b"")
    for piece in (4096, 1_200_000):
        found = R.range_digests(spark, str(tmp_path), piece)
        got = {(r.path.split(str(tmp_path) + "/")[1].replace("%20", " "), r.start): (r.length, r.sha256) for r in found.collect()}
        want = {(n, k): (len(b[k : k + piece]), hashlib.sha256(b[k : k + piece]).hexdigest()) for n, b in blobs.items() for k in range(0, len(b), piece)}
        assert got == want
        trees = {r.path.rsplit("/", 1)[1]: (r.size, r.ranges, r.sha256) for r in R.tree_digests(found).collect() if "/sub/" not in r.path}
        for n in ("a.bin", "b.bin", "c.bin"):
            own = [want[n, k][1] for k in range(0, len(blobs[n]), piece)]
            assert trees[n] == (len(blobs[n]), len(own), hashlib.sha256("".join(own).encode()).hexdigest())
    before = spark.createDataFrame(R.range_digests(spark, str(tmp_path), 4096).toPandas())
    (tmp_path / "a.bin").write_bytes(blobs["a.bin"][:1_000_000] + bytes([blobs["a.bin"][1_000_000] ^ 1]) + blobs["a.bin"][1_000_001:])
    (tmp_path / "b.bin").write_bytes(blobs["b.bin"] + b"more")
    (tmp_path / "c.bin").unlink()
    out = changed_ranges(before, R.range_digests(spark, str(tmp_path), 4096)).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.start, r.length, r.status) for r in out) == [("a.bin", 1_000_000 // 4096 * 4096, 4096, "changed"), ("b.bin", 12288, 4, "extra"), ("c.bin", 0, 1, "missing")]


def test_polled_states(spark, tmp_path):
    """Files that appear, are replaced under their names, share a time or are malformed, over several polls; what the last poll gives is what the batch reader gives."""
    import os

    from plumbline.streaming import runs

    def put(run, text, at):
        (tmp_path / "tasks" / run).mkdir(parents=True, exist_ok=True)
        (tmp_path / "tasks" / run / "state.json").write_text(text)
        os.utime(tmp_path / "tasks" / run / "state.json", (at, at))

    glob, out = str(tmp_path / "tasks/*/state.json"), str(tmp_path / "out")
    polls = [
        [("r1", '{"status": "running", "epoch": 1}', 1000), ("r2", '{"epoch": 5}', 1000), ("r3", "{broken", 900)],
        [("r4", '{"epoch": 7}', 1000), ("r1", '{"status": "running", "epoch": 2}', 1010)],  # r4 has the last poll's time
        [],
        [("r1", '{"status": "done",', 1020), ("r3", '{"epoch": 1}', 1020)],  # r1's file is being written
        [("r1", '{"status": "done", "epoch": 3}', 1021)],
    ]
    for n, changes in enumerate(polls):
        for c in changes:
            put(*c)
        for _ in range(2 if n == 3 else 1):  # a poll that runs again replaces itself
            runs.poll_states(spark, glob, out, n)
        assert {r.path.rsplit("/", 2)[1] for b in ("states", "malformed") for r in spark.read.parquet(f"{out}/{b}").where(f"batch = {n}").collect()} == {c[0] for c in changes}
    got = {r.run: (r.task, r.status, r.epoch) for r in runs.current_states(spark, out).collect()}
    assert got == {"r1": ("tasks", "done", 3), "r2": ("tasks", None, 5), "r3": ("tasks", None, 1), "r4": ("tasks", None, 7)}
    assert got == {r.run: (r.task, r.status, r.epoch) for r in R.read_run_state(spark, glob).collect()}
    assert sorted((r.run, r.malformed) for r in spark.read.parquet(f"{out}/malformed").collect()) == [("r1", '{"status": "done",'), ("r3", "{broken")]


def test_state_files_as_a_stream(spark, tmp_path):
    from plumbline.streaming import runs

    out = str(tmp_path / "out")
    for part in (range(5), range(5, 8)):
        for k in part:
            (tmp_path / "t" / f"r{k}").mkdir(parents=True)
            (tmp_path / "t" / f"r{k}" / "state.json").write_text("{" if k == 6 else json.dumps({"epoch": k}))
        stream = R.stream_run_state(spark, str(tmp_path / "t/*/state.json"), files=2)
        stream.writeStream.foreachBatch(lambda df, n: runs.keep_states(df, out, n)).option("checkpointLocation", f"{out}/c").trigger(availableNow=True).start().awaitTermination()
    assert {r.run: r.epoch for r in runs.current_states(spark, out).collect()} == {f"r{k}": k for k in range(8) if k != 6}
    assert [r.run for r in spark.read.parquet(f"{out}/malformed").collect()] == ["r6"] and spark.read.parquet(f"{out}/states").select("batch").distinct().count() >= 4


def test_journals_say_what_the_files_of_runs_say(spark, tmp_path):
    """The same texts as a file a run and as lines of a journal, malformed, empty and odd ones among them; the journal's files don't grow with the runs."""
    from plumbline.sources import writers as Wr

    texts = {"a": '{"task": "t", "status": "running", "epoch": 3}', "b": '{"status": "run', "c": '{"task": "", "epoch": 1}', "d": '{"epoch": "x"}', "e": "[1, 2", "f\u00e4 \"1": '{"status": "a\\nb", "epoch": 9}'}
    for name, text in texts.items():
        at = tmp_path / "tasks" / name
        at.mkdir(parents=True)
        (at / "state.json").write_text(text)
    fields = lambda df: {r.run: (r.task, r.status, r.epoch, r.malformed) for r in df.collect()}
    Wr.write_journal(spark.createDataFrame(list(texts.items()), "run string, text string").coalesce(1), str(tmp_path / "j/tasks"))
    files = fields(R.read_run_state(spark, str(tmp_path / "tasks/[a-e]/state.json")))
    got = fields(R.journal_states(R.read_journal(spark, str(tmp_path / "j/tasks"))))
    assert {k: v for k, v in got.items() if k in files} == files and got.keys() == texts.keys()
    assert got["f\u00e4 \"1"] == ("tasks", "a\nb", 9, None)
    assert len(list((tmp_path / "j/tasks").glob("part-*"))) == 1
    past = {"a": '[{"epoch": 1, "best_metric": 0.5, "best_epoch": 1, "timestamp": 3.5}, {"epoch": 2}]', "b": '[{"epoch": 1', "c": "[]", "d": '[{"best_epoch": 2}]'}
    for name, text in past.items():
        (tmp_path / "tasks" / name / "history.json").write_text(text)
    Wr.write_journal(spark.createDataFrame(list(past.items()), "run string, text string"), str(tmp_path / "h"))
    key = lambda df: sorted(((r.run, r.epoch, r.best_metric, r.best_epoch, r.ts) for r in df.collect()), key=str)
    found = key(R.journal_histories(R.read_journal(spark, str(tmp_path / "h"))))
    assert found == key(R.read_run_history(spark, str(tmp_path / "tasks/*/history.json"))) and len(found) == 2


def test_queries_over_runs_write_few_files(spark, sf, monkeypatch):
    """Folders and files of the queries over all runs don't grow with the number of runs."""
    import os

    from plumbline.plans import files as P
    from plumbline.plans import streams as St

    made = []

    def folder(spark, name):
        made.append(St.shared_folder(spark) + f"/few/{name}-{len(made)}")
        return made[-1]

    monkeypatch.setattr(P, "_folder", folder)
    monkeypatch.setattr(St, "_folder", folder)
    for q in (P.read_run_history, P.read_run_state, St.stream_run_states):
        assert q(spark, sf).count() > 10
    assert len(made) == 4 and not [d for at in made for _, ds, _ in os.walk(at.removeprefix("file:")) for d in ds if d.startswith("run=")]
