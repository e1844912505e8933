import hashlib
import json
import math
import os
import random

import numpy as np
import pytest

from orvane.sources import files
from orvane.sources.collection import Collection, CommittedError, Maintenance
from orvane.streaming.ingest import ingest

SCHEMA = "id string, vector array<double>, side string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v], s, n) for i, v, s, n in rows], SCHEMA)


def made(spark, path, **more):
    return Collection.create(spark, str(path), 2, schema="side string, n int", **more)


def test_mutations_search_and_recovery(spark, tmp_path):
    c = made(spark, tmp_path / "c")
    c.insert(frame(spark, [("a", (1, 0), "x", 1), ("b", (0, 1), "y", 2), ("c", (-1, 0), "x", 3)]))
    with pytest.raises(ValueError):
        c.insert(frame(spark, [("d", (1, 1), "x", 1), ("a", (1, 1), "x", 1)]))
    with pytest.raises(ValueError):
        c.upsert(frame(spark, [("d", (0, 0), "x", 1)]))
    with pytest.raises(ValueError):
        c.upsert(frame(spark, [("d", (1, 0), "x", 1), ("d", (1, 0), "x", 1)]))
    with pytest.raises(KeyError):
        c.delete(["a", "zz"])
    assert (len(c), c.manifest.revision) == (3, 1)
    c.build(2, iterations=3)
    assert c.is_built and not c.is_dirty
    c.upsert(frame(spark, [("d", (1, 0.1), "y", 4)]))
    c.update("a", metadata={"side": "z", "n": 9})
    c.delete(["b"])
    assert c.is_dirty and len(c) == 3
    assert c.get("a")["side"] == "z" and c.get("a")["vector"] == [1.0, 0.0]
    found = [(r["rank"], r["id"]) for r in c.search([[1, 0]], k=3, nprobe=2).orderBy("rank").collect()]
    assert found == [(1, "a"), (2, "d"), (3, "c")]
    assert [r["id"] for r in c.search([[1, 0]], where={"side": "y"}, k=3).collect()] == ["d"]
    assert c.counts()["tombstones"] == 2 and c.counts()["delta"] == 2
    c.check()
    with pytest.raises(RuntimeError):
        Collection.load(spark, str(tmp_path / "c"))
    assert len(Collection.load(spark, str(tmp_path / "c"), read_only=True)) == 3
    with pytest.raises(FileExistsError):
        made(spark, tmp_path / "c")
    c.compact()
    assert len(c) == 3 and not c.is_dirty
    assert c.info().first()["live"] == 3
    c.save()
    c.close()
    # a torn draft is dropped and a damaged manifest passed over
    os.makedirs(tmp_path / "c/revisions/draft-x")
    newest = open(tmp_path / "c/CURRENT").read()
    held = json.load(open(tmp_path / "c" / newest))
    held["sha256"] = "0"
    json.dump(held, open(tmp_path / "c" / newest, "w"))
    with pytest.raises(ValueError):
        Collection.load(spark, str(tmp_path / "c"))
    r = Collection.recover(spark, str(tmp_path / "c"))
    assert len(r) == 3 and not os.path.exists(tmp_path / "c/revisions/draft-x")
    r.close()


def test_faults_and_segments(spark, tmp_path):
    c = made(spark, tmp_path / "c", maintenance=Maintenance(max_active=3, max_segments=2))

    def fail():
        raise OSError("no space")

    c.hooks["before_rename"] = fail
    with pytest.raises(OSError):
        c.upsert(frame(spark, [("a", (1, 0), "x", 1)]))
    assert len(c) == 0
    c.hooks = {"after_rename": fail}
    with pytest.raises(CommittedError):
        c.upsert(frame(spark, [("a", (1, 0), "x", 1)]))
    c.hooks = {}
    assert len(c) == 1
    with pytest.raises(ValueError):
        c.upsert(frame(spark, [(str(i), (1, i), "x", 1) for i in range(4)]))
    c.upsert(frame(spark, [(str(i), (1, i), "x", 1) for i in range(2)]))
    assert c.manifest.segments == [[1, 2]]
    c.upsert(frame(spark, [(str(i), (1, i), "x", 1) for i in range(2, 5)]))
    assert len(c.manifest.segments) == 2 and c.maintenance_due() and c.maintain() and len(c) == 6
    c.close()


def test_state_machine(spark, tmp_path):
    r, c, want = random.Random(5), made(spark, tmp_path / "c"), {}
    for step in range(10):
        kind = r.choice(["upsert", "upsert", "delete"])
        if kind == "upsert" or not want:
            rows = {str(r.randrange(12)): (r.uniform(0.1, 1), r.uniform(-1, 1)) for _ in range(3)}
            c.upsert(frame(spark, [(i, v, "s", step) for i, v in rows.items()]))
            want |= {i: step for i in rows}
        else:
            gone = r.sample(sorted(want), min(2, len(want)))
            c.delete(gone)
            want = {k: v for k, v in want.items() if k not in gone}
        if step == 5 and len(want) > 2:
            c.build(2, iterations=2)
    assert {x["id"]: x["n"] for x in c.rows().collect()} == want
    found = c.search([[1, 0]], k=20, strategy="exact")
    assert {x["id"] for x in found.collect()} == set(want)
    c.close()


def test_stream(spark, tmp_path):
    c = made(spark, tmp_path / "c")
    frame(spark, [("a", (1, 0), "x", 1), ("b", (0, 1), "y", 2), ("b", (0, 1), "y", 2)]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    ingest(stream, c, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert sorted(x["id"] for x in c.ids().collect()) == ["a", "b"]
    c.close()


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0, -2.0]) for i in range(10)], "position long, vector array<float>")
    files.write_vecs(df, str(tmp_path / "v.fvecs"))
    assert files.vector_file_header(str(tmp_path / "v.fvecs")) == (3, 10)
    back = files.read_fvecs(spark, str(tmp_path / "v.fvecs"), limit=7)
    assert [r["vector"][0] for r in back.orderBy("position").collect()] == [float(i) for i in range(7)]
    assert files.read_fvecs(spark, str(tmp_path / "v.fvecs"), normalize=True, positions=[3]).count() == 1
    files.write_vecs(df.selectExpr("position", "array(cast(position as int), 5) as vector"), str(tmp_path / "t.ivecs"), kind="int")
    assert files.read_ivecs(spark, str(tmp_path / "t.ivecs")).orderBy("position").collect()[4]["vector"] == [4, 5]
    (tmp_path / "bad.fvecs").write_bytes(b"\x03\x00\x00\x00abc")
    with pytest.raises(ValueError):
        files.read_fvecs(spark, str(tmp_path / "bad.fvecs"))
    (tmp_path / "a.jsonl").write_text('{"main_categories": ["cs", "x"], "number_of_versions": 2, "license": null}\n')
    assert files.read_attributes(spark, str(tmp_path / "a.jsonl")).first()["license"] == "unspecified"
    files.write_tsv(spark.createDataFrame([("a\tb", 1)], ["s", "n"]), str(tmp_path / "tsv"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv")).first()["s"] == "a b"


HOOKS = ["before_rename", "after_rename", "compact_written", "index_written", "before_manifest", "before_current", "before_remove"]


@pytest.mark.parametrize("hook", HOOKS)
def test_a_crash_in_compaction_loses_nothing(spark, tmp_path, hook):
    path = str(tmp_path / "c")
    c = made(spark, path)
    c.insert(frame(spark, [(f"r{i}", (1, i), "x", i) for i in range(6)]))
    c.build(2, iterations=2)
    c.delete(["r0"])
    c.upsert(frame(spark, [("r1", (2, 2), "y", 100)]))
    c.save(retain=0)
    want = {x["id"]: x["n"] for x in c.rows().collect()}

    def crash():
        raise OSError("crash")

    c.hooks[hook] = crash
    with pytest.raises((OSError, RuntimeError)):
        c.compact()
        c.save(retain=0)  # before_remove: only what no manifest needs goes
    c.close()
    again = Collection.load(spark, path)
    assert {x["id"]: x["n"] for x in again.rows().collect()} == want
    again.close()
    again = Collection.recover(spark, path)
    assert {x["id"]: x["n"] for x in again.rows().collect()} == want
    again.check()
    again.insert(frame(spark, [("later", (1, 1), "z", 7)]))
    again.compact()
    assert len(again) == len(want) + 1
    again.close()


def test_retained_manifests_open_after_compaction(spark, tmp_path):
    path = str(tmp_path / "c")
    c = made(spark, path)
    for k in range(3):
        c.insert(frame(spark, [(f"r{k}", (1, k), "x", k)]))
        c.save(retain=2)
    c.compact()
    want = {x["id"]: x["n"] for x in c.rows().collect()}
    names = c._manifests()
    assert len(names) == 3
    for name in names:
        old = Collection(spark, path, Collection._read(path, name), False)._recovered()
        assert {x["id"]: x["n"] for x in old.rows().collect()} == want
    c.save(retain=0)
    import os

    assert [x for x in os.listdir(f"{path}/revisions") if x.isdigit()] == ["4"]
    c.verify()
    file = next(os.path.join(top, x) for top, _, found in os.walk(f"{path}/revisions/4") for x in found if x.endswith(".parquet"))
    size = os.path.getsize(file)
    os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
    with open(file, "r+b") as f:
        f.seek(size // 2)
        f.write(bytes([f.read(1)[0] ^ 255]))
    with pytest.raises(ValueError):
        c.verify()
    c.close()


def test_made_ids_checkpoints_and_forced_strategies(spark, tmp_path):
    c = made(spark, tmp_path / "c")
    c.configure_maintenance(checkpoint_operations=3)
    c.insert(frame(spark, [("2", (1, 0), "x", 1), ("4", (0, 1), "y", 2)]))
    assert c.manifest.generation == 1
    c.insert(frame(spark, [("-", (1, 1), "x", 3), ("-", (1, 2), "x", 4)]).drop("id"))
    assert sorted(x["id"] for x in c.ids().collect()) == ["2", "3", "4", "5"]  # from three on; four is in use
    assert c.manifest.generation == 2, "four operations publish a manifest"
    for name in ("ivf", "ivf_prefilter", "filter_aware", "filter_aware_bound"):
        with pytest.raises(ValueError, match="index"):
            c.search([[1, 0]], strategy=name)
    c.build(2, iterations=2)
    with pytest.raises(ValueError, match="filter"):
        c.search([[1, 0]], strategy="filter_aware")
    c.close()


def test_background_maintenance_tries_again(spark, tmp_path):
    c = made(spark, tmp_path / "c")
    c.configure_maintenance(min_changes=1, max_delta=1)
    c.insert(frame(spark, [("a", (1, 0), "x", 1)]))
    left = [OSError("once")]

    def once():
        if left:
            raise left.pop()

    c.hooks["compact_written"] = once
    c.maintain_in_background(retries=2, save=True)
    assert c.wait_for_maintenance(120) == 1
    assert c.manifest.base > 1 and len(c) == 1
    c.hooks["compact_written"] = lambda: (_ for _ in ()).throw(OSError("always"))
    c.maintain_in_background(retries=1)
    with pytest.raises(OSError, match="always"):
        c.wait_for_maintenance(120)
    c.close()


def test_varying_ivecs_raw_matrices_and_bundles(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PART", 40)
    lists = [[1, 2, 3], [], [9], list(range(30)), [4, 4]]
    (tmp_path / "data").mkdir()
    (tmp_path / "data/t.ivecs").write_bytes(b"".join(np.array([len(x), *x], "<i4").tobytes() for x in lists))
    read = files.read_ivecs(spark, str(tmp_path / "data/t.ivecs"))
    assert [r["vector"] for r in read.orderBy("position").collect()] == lists
    (tmp_path / "torn.ivecs").write_bytes(np.array([3, 1], "<i4").tobytes())
    with pytest.raises(ValueError):
        files.read_ivecs(spark, str(tmp_path / "torn.ivecs"))
    df = spark.createDataFrame([(i, [3.0 * (i + 1), 4.0 * (i + 1)]) for i in range(9)], "position long, vector array<float>")
    raw = str(tmp_path / "m.f32")
    assert files.append_raw(df, raw) == 72 and files.append_raw(df, raw, normalize=False) == 144
    back = [r["vector"] for r in files.read_raw(spark, raw, 2).orderBy("position").collect()]
    assert np.allclose(back[:9], [[0.6, 0.8]] * 9) and back[10] == [6.0, 8.0]
    files.write_vecs(df, str(tmp_path / "data/v.fvecs"))
    manifest = files.dataset_manifest(spark, str(tmp_path / "data"))
    held = {r["file"]: (r["bytes"], r["sha256"]) for r in manifest.collect()}
    assert held["v.fvecs"] == (108, hashlib.sha256((tmp_path / "data/v.fvecs").read_bytes()).hexdigest())
    manifest = spark.createDataFrame([(k, *v) for k, v in held.items()], "file string, bytes long, sha256 string")
    found = files.load_bundle(spark, str(tmp_path / "data"), manifest, {"base": "v.fvecs", "truth": "t.ivecs"}, limit=4)
    assert found["base"].count() == 4 and found["truth"].count() == 5
    (tmp_path / "data/v.fvecs").write_bytes(b"\0" * 108)
    with pytest.raises(ValueError, match="v.fvecs"):
        files.load_bundle(spark, str(tmp_path / "data"), manifest, {"base": "v.fvecs"})


def test_search_reads_probed_lists_and_later_revisions_only(spark, tmp_path):
    c = made(spark, tmp_path / "c")
    rows = [(f"r{i}", (math.cos(i), math.sin(i)), "xy"[i % 2], i % 7) for i in range(300)]
    c.insert(frame(spark, rows))
    c.build(6, iterations=3)
    clean = c.search([[1, 0]], k=3, strategy="ivf", nprobe=6)
    want = [(r["id"], r["n"]) for r in c.search([[1, 0]], k=3, strategy="exact").orderBy("rank").collect()]
    assert [(r["id"], r["n"]) for r in clean.orderBy("rank").collect()] == want
    c.update("r0", metadata={"side": "z", "n": 3})
    c.delete([want[1][0]])
    found = c.search([[1, 0]], where={"n": 3}, k=3, strategy="ivf_prefilter", nprobe=6)
    assert found.columns == clean.columns == ["query_id", "rank", "position", "score", "id", "revision", "indexed", "side", "n"]
    scans = [x for x in found._jdf.queryExecution().toString().split("\n") if "FileScan parquet" in x]
    lists = next(x for x in scans if "vector" in x and "list_id" in x)
    assert "dynamicpruning" in lists.split("PartitionFilters")[1] and "EqualTo(n,3)" in lists
    assert not any("revisions/1]" in x or "revisions/1," in x for x in scans)
    assert {r["id"]: r["indexed"] for r in found.collect()}["r0"] is False
    live = {r["id"]: r["n"] for r in c.rows().collect()}
    assert live == {i: (3 if i == "r0" else n) for i, _, _, n in rows if i != want[1][0]}
    assert {r["id"]: r["n"] for r in c._live().collect()} == live
    c.check()
    c.close()


def test_metadata_may_not_have_the_collection_s_own_names(spark, tmp_path):
    with pytest.raises(ValueError, match="list_id"):
        Collection.create(spark, str(tmp_path / "c"), 2, schema="side string, list_id int")
