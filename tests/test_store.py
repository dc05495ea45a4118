import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from molframe.operators import lock as locks
from molframe.operators import model, read
from molframe.sources.ingest import arrays_batch
from molframe.sources.shard_set import ShardReader, relative_path, rewrite
from molframe.sources.store import Store, commits
from molframe.streaming.appends import append_stream


def batch(spark, energies, dtype=np.float32, **more):
    n = len(energies)
    p = np.zeros((n, 2, 3), dtype)
    p[:, 1, 0] = 1
    return arrays_batch(spark, p, np.tile(np.array([6, 8], np.uint8), (n, 1)), energy=np.array(energies, float), **more)


def energies(store):
    return [r.energy for r in store.molecules().orderBy("mol_id").collect()]


def test_round_trip_and_visibility(spark, tmp_path):
    path = str(tmp_path / "s")
    store = Store.create(spark, path, "ZSTD", level=5)
    assert len(store) == 0 and store.molecules().count() == 0
    store.append(batch(spark, [-1.0, -2.0, -3.0]))
    assert len(Store.open(spark, path)) == 0
    store.flush()
    store.append(batch(spark, [-4.0]))
    assert energies(Store.open(spark, path)) == [-1, -2, -3]
    store.flush()
    again = Store.open(spark, path)
    assert energies(again) == [-1, -2, -3, -4] and len(again) == 4
    assert [r.mol_id for r in again.molecules().orderBy("mol_id").collect()] == [0, 1, 2, 3]
    assert again.compression == ("zstd", 5) and again.record_format == 2 and again.size_bytes() > 0


@pytest.mark.parametrize("codec", ["none", "lz4", "zstd"])
def test_codecs(spark, tmp_path, codec):
    store = Store.create(spark, str(tmp_path / codec), codec)
    store.append(batch(spark, [1.0, 2.0]))
    store.flush()
    assert energies(Store.open(spark, store.path, persist=True)) == [1, 2]


def test_layouts_give_the_same(spark, tmp_path):
    rows = batch(spark, [1.0, 2.0, 3.0], forces=np.arange(18, dtype=np.float32).reshape(3, 2, 3), charges=np.ones((3, 2)), atom_properties={"dir": np.ones((3, 2, 3))})
    none = arrays_batch(spark, np.zeros((1, 0, 3), np.float32), np.zeros((1, 0), np.uint8), energy=np.zeros(1))
    stores = {}
    for layout in ("vectors", "flat"):
        store = stores[layout] = Store.create(spark, str(tmp_path / "set" / layout), layout=layout)
        store.append(rows)
        store.append(none)
        store.flush()
    one, other = (Store.open(spark, s.path) for s in stores.values())
    assert one.molecules().schema == other.molecules().schema and one.lock == other.lock
    assert one.molecules().orderBy("mol_id").collect() == other.molecules().orderBy("mol_id").collect()
    flat = other.plain().orderBy("mol_id").collect()
    assert one.plain().orderBy("mol_id").collect() == flat and flat[1].forces == [6, 7, 8, 9, 10, 11] and flat[3].positions == []
    columns = ("mol_id", "atom_idx", "z_num", "x", "y", "z", "fx", "fy", "fz", "charge")
    wide = model.wide_atoms(model.to_atoms(one.molecules())).select(*columns)
    assert sorted(model.plain_atoms(other.plain()).select(*columns).collect()) == sorted(wide.collect())
    both = ShardReader.open_path(spark, str(tmp_path / "set"))
    assert len(both) == 8 and [r.forces[0].x for r in both.get_many([1, 5]).orderBy("pos").collect()] == [6, 6]
    with pytest.raises(ValueError):
        Store.create(spark, str(tmp_path / "x"), layout="columns")


def test_guards(spark, tmp_path):
    path = str(tmp_path / "s")
    store = Store.create(spark, path)
    store.append(batch(spark, [1.0]))
    store.flush()
    with pytest.raises(FileExistsError):
        Store.create(spark, path)
    with pytest.raises(ValueError):
        Store.open(spark, path).append(batch(spark, [1.0]))
    with pytest.raises(ValueError):
        Store.create(spark, str(tmp_path / "x"), "gzip")
    with pytest.raises(FileNotFoundError):
        Store.open(spark, str(tmp_path / "none"))
    fresh = Store.create(spark, path, overwrite=True)
    assert len(Store.open(spark, path)) == 1  # replaced by the commit, not before
    fresh.flush()
    assert len(Store.open(spark, path)) == 0


def test_damaged_commit_falls_back_and_vacuum(spark, tmp_path):
    path = tmp_path / "s"
    store = Store.create(spark, str(path))
    for e in (1.0, 2.0):
        store.append(batch(spark, [e]))
        store.flush()
    newest = sorted((path / "_commits").glob("*.json"))[-1]
    newest.write_text(newest.read_text().replace("crc", "crx"))
    for crc in path.rglob("*.crc"):
        crc.unlink()
    assert energies(Store.open(spark, str(path))) == [1]
    (path / "data" / "junk").mkdir()
    writer = Store.open(spark, str(path), writable=True)
    assert "data/junk" in writer.vacuum()
    assert energies(Store.open(spark, str(path))) == [1] and len(commits(spark, str(path))) == 2


def test_lock_is_strict_and_additive(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"))
    store.append(batch(spark, [1.0]))
    store.append(batch(spark, [2.0], forces=np.ones((1, 2, 3), np.float32)))
    store.flush()
    rows = store.molecules()
    flat = read.flat_batch(rows, [0, 1]).orderBy("row").collect()
    assert [r.fx for r in flat] == [0, 0, 1, 1]
    with pytest.raises(locks.LockError):
        store.append(batch(spark, [3.0], dtype=np.float64))
    store.append(batch(spark, [3.0], properties={"spectrum": np.ones((1, 2))}))
    with pytest.raises(locks.LockError, match="spectrum"):
        store.append(batch(spark, [3.0], properties={"spectrum": np.ones((1, 3))}))
    with pytest.raises(locks.LockError):
        store.append(batch(spark, [3.0], atom_properties={"spectrum": np.ones((1, 2))}))


def test_format_promotion(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"))
    store.append(batch(spark, [1.0], dtype=np.float64))
    assert store.record_format == 3
    plain = Store.create(spark, str(tmp_path / "t"))
    plain.append(batch(spark, [1.0]))
    plain.flush()
    with pytest.raises(locks.LockError):
        plain.append(batch(spark, [1.0], cell=np.zeros((1, 3, 3), np.float32)))


def test_shards(spark, tmp_path):
    for name, e in (("b", [-3.0]), ("a", [-1.0, -2.0])):
        s = Store.create(spark, str(tmp_path / "set" / name))
        s.append(batch(spark, e))
        s.flush()
    reader = ShardReader.open_path(spark, str(tmp_path / "set"))
    assert len(reader) == 3
    assert [r.energy for r in reader.get_many([2, 0, -1]).orderBy("pos").collect()] == [-3, -1, -3]
    assert reader.get(-2).first().energy == -2
    with pytest.raises(IndexError):
        reader.get_many([3])
    with reader:
        pass
    with pytest.raises(ValueError):
        len(reader)
    manifest = rewrite(spark, str(tmp_path / "set"), str(tmp_path / "new"))
    assert [p.rsplit("/", 1)[1] for p in json.load(open(manifest))["output_files"]] == ["a", "b"]
    assert len(ShardReader.open_path(spark, str(tmp_path / "new"))) == 3
    with pytest.raises(FileNotFoundError):
        ShardReader.open_path(spark, str(tmp_path / "nothing"))


def test_shard_reader_reads_what_it_needs(spark, tmp_path):
    for name, e in (("a", [-1.0, -2.0]), ("b", [-3.0]), ("c", [-4.0, -5.0, -6.0])):
        s = Store.create(spark, str(tmp_path / "set" / name))
        s.append(batch(spark, e, **({"properties": {"extra": np.array(e)}} if name == "b" else {})))
        s.flush()
    reader = ShardReader.open_path(spark, str(tmp_path / "set"))
    rows = reader.molecules().orderBy("mol_id").collect()
    assert [(r.shard, r.local_idx, r.mol_id, r.energy, r.mp_extra) for r in rows][1:4] == [(0, 1, 1, -2, None), (1, 0, 2, -3, -3), (2, 0, 3, -4, None)]
    plan = reader.get(4)._jdf.queryExecution().toString()
    assert "EqualTo(mol_id,1)" in plan and reader.get(4).first().energy == -5
    some = reader.get_many([5, 0, 5, -1])
    assert "In(mol_id, [0,2])" in some._jdf.queryExecution().toString() and [r.energy for r in some.orderBy("pos").collect()] == [-6, -1, -6, -6]
    assert reader.get_many([]).count() == 0
    with pytest.raises(IndexError):
        reader.get(6)


def test_transfer(spark, tmp_path):
    from molframe.sources.shard_set import download, open_repository, transfer, upload

    for name, e in (("a", [-1.0, -2.0]), ("b", [-3.0])):
        s = Store.create(spark, str(tmp_path / "set" / name))
        s.append(batch(spark, e))
        s.flush()
    hub = str(tmp_path / "hub")
    assert upload(spark, str(tmp_path / "set"), hub) == [f"{hub}/set/a", f"{hub}/set/b"]
    upload(spark, str(tmp_path / "set" / "a"), hub, "one/")
    assert len(open_repository(spark, hub, "set")) == 3 and len(open_repository(spark, hub, "one")) == 2
    with pytest.raises(ValueError):
        open_repository(spark, hub)
    there = download(spark, hub, str(tmp_path / "local"), "set")
    assert there == str(tmp_path / "local" / "set") and len(ShardReader.open_path(spark, there)) == 3
    assert len(transfer(spark, hub, str(tmp_path / "again"))) == 3


def test_newest_commit_is_read_first(spark, tmp_path, monkeypatch):
    from molframe.sources import store as stores

    path = str(tmp_path / "s")
    store = Store.create(spark, path)
    for e in (1.0, 2.0, 3.0):
        store.append(batch(spark, [e]))
        store.flush()
    read, seen = stores._Files.read, []
    monkeypatch.setattr(stores._Files, "read", lambda self, name: seen.append(name) or read(self, name))
    assert len(Store.open(spark, path)) == 3 and seen == ["_commits/000000000003.json"]


def test_many_files_go_to_a_manifest(spark, tmp_path, monkeypatch):
    from molframe.sources import store as stores
    from molframe.sources.shard_set import transfer

    monkeypatch.setattr(stores, "LISTED", 2)
    path = tmp_path / "s"
    store, sizes = Store.create(spark, str(path)), []
    for k in range(7):
        store.append(batch(spark, [float(k)]))
        store.flush()
        sizes.append(len(stores.json.loads(stores.json.loads((path / "_commits" / f"{k + 1:012d}.json").read_text())["body"])["files"]))
        assert energies(Store.open(spark, str(path))) == [float(i) for i in range(k + 1)]
    assert max(sizes) == 2 and sizes.count(0) == 2
    (copy,) = transfer(spark, str(path), str(tmp_path / "copy"))
    assert energies(Store.open(spark, copy)) == [float(i) for i in range(7)]
    assert Store.open(spark, str(path), writable=True).vacuum() == []
    newest = sorted((path / "_commits").glob("manifest-*.json"))[-1]
    newest.write_text("[]")
    for crc in path.rglob("*.crc"):
        crc.unlink()
    assert energies(Store.open(spark, str(path))) == [0.0, 1.0, 2.0, 3.0, 4.0]  # the last commit before that manifest


def test_store_gives_payloads(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"))
    store.append(batch(spark, [1.0, 2.0]))
    store.flush()
    assert [p["results"]["energy"] for p in store.payloads([1, 0])] == [2, 1] and len(list(store.payloads())) == 2


def test_relative_path():
    assert relative_path(" /a/./b/ ") == "a/b"
    for bad in ("", ".", "a/../b", " / "):
        with pytest.raises(ValueError):
            relative_path(bad)


def test_stream_commits_each_batch_once(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "s")
    rows = batch(spark, [1.0, 2.0])
    Store.create(spark, path)
    rows.write.parquet(str(source / "one"))
    for _ in range(2):
        query = append_stream(spark, str(source / "*"), rows.schema, path, str(tmp_path / "cp"))
        query.awaitTermination(120)
        assert query.exception() is None
    store = Store.open(spark, path)
    assert len(store) == 2 and store.streamed("default") == 0


def test_append_in_order_of_a_column(spark, tmp_path):
    store = Store.create(spark, str(tmp_path / "s"))
    store.append(batch(spark, [3.0, 1.0, 2.0]).withColumn("k", F.col("energy").cast("long")).repartition(3), order="k")
    store.flush()
    assert energies(store) == [1, 2, 3]


def test_unequal_arrays_stop_the_job(spark):
    df = batch(spark, [1.0]).withColumn("mol_id", F.lit(0)).withColumn("charges", F.array(F.lit(1.0)))
    with pytest.raises(Exception, match="unequal length"):
        model.checked(df).select("mol_id").collect()


def test_repository_names(spark, tmp_path):
    from molframe.operators import stats
    from molframe.sources.shard_set import dataset_root, snapshot_patterns, upload_name

    for name in ("one/a", "two/b"):
        Store.create(spark, str(tmp_path / name))
    with pytest.raises(ValueError):
        dataset_root(spark, str(tmp_path))
    assert dataset_root(spark, str(tmp_path), "one") == str(tmp_path / "one")
    assert dataset_root(spark, str(tmp_path / "two")) == str(tmp_path / "two" / "b")
    with pytest.raises(FileNotFoundError):
        dataset_root(spark, str(tmp_path), "three")
    assert upload_name("/x/a.store") == "a.store" and upload_name("/x/a", "sets/") == "sets/a" and upload_name("/x/a", "b.store") == "b.store"
    assert snapshot_patterns("set")[0].startswith("set/")
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "plain"))
    size = stats.total_size(spark, str(tmp_path / "plain")).first()
    assert size.files == 1 and size.bytes > 0
    with pytest.raises(ValueError):
        stats.normalised_rows(spark.range(1), ["backend"], {})
