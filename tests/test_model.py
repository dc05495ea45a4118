import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molframe.functions import geometry as geo
from molframe.functions.values import Tag, classify
from molframe.operators import bridge, lock, model, read, shards, stats
from molframe.operators.model import RecordError
from molframe.sources.ingest import arrays_batch


def stacked(spark, **more):
    p = np.array([[[0, 2, 0], [0, 3.25, 0]], [[4, 0, 1], [4, 0, -1]]], np.float32)
    z = np.array([[14, 8], [7, 26]], np.uint8)
    return arrays_batch(spark, p, z, energy=np.array([-1.5, -2.5]), **more).withColumn("mol_id", F.monotonically_increasing_id()).coalesce(1)


def one(spark, **more):
    df = stacked(spark, **more)
    return df.withColumn("mol_id", F.when(F.col("energy") == -1.5, 0).otherwise(1).cast("long"))


def test_batch_types(spark):
    df = stacked(
        spark, cell=np.arange(18.0).reshape(2, 3, 3), pbc=np.array([[True, False, True], [False, False, True]]),
        name=["first", "second"], charges=np.zeros((2, 2), np.float32),
        properties={"gap": np.array([0.75, 4.0], np.float32), "n": np.array([9, 4], np.int32), "phase": ["solid", "gas"],
                    "eig": np.array([[3, 1], [2, 5]], np.float32), "density": np.arange(16, dtype=np.float32).reshape(2, 2, 4)},
        atom_properties={"mull": np.array([[0.5, -0.25], [1.5, -2.0]]), "desc": np.arange(16).reshape(2, 2, 2, 2)},
    )
    kinds = dict(df.dtypes)
    assert kinds["mp_gap"] == "double" and kinds["mp_n"] == "bigint" and kinds["mp_eig"] == "array<float>"
    assert kinds["mp_density"] == "struct<shape:array<int>,data:array<float>>" and kinds["charges"] == "array<float>"
    rows = df.orderBy("name").collect()
    assert [r.mp_phase for r in rows] == ["solid", "gas"] and rows[1].ap_mull == [1.5, -2.0]
    assert rows[0].mp_density.shape == [2, 4] and rows[1].mp_density.data[0] == 8.0
    assert rows[0].pbc.asDict() == {"a": True, "b": False, "c": True}
    assert lock.violations(df.withColumn("mol_id", F.lit(0))).count() == 0


@pytest.mark.parametrize(
    "bad",
    [
        {"properties": {"x": [np.zeros((2, 4)), np.zeros((3, 4))]}},
        {"properties": {"stress": np.zeros(2)}},
        {"properties": {"a": np.zeros(2)}, "atom_properties": {"a": np.zeros((2, 2))}},
        {"properties": {"a": np.zeros(3)}},
        {"atom_properties": {"a": np.zeros((2, 3))}},
        {"forces": np.zeros((2, 3, 3))},
        {"name": ["a"]},
    ],
)
def test_bad_batches(spark, bad):
    with pytest.raises(RecordError):
        stacked(spark, **bad)


def test_classify():
    cases = [
        (None, Tag.NULL), (True, Tag.I64), (3, Tag.I64), (1.5, Tag.F64), ("x", Tag.STRING), (np.zeros(2), Tag.F64_ARRAY),
        (np.zeros((2, 3), np.float32), Tag.VEC3_F32), (np.zeros((2, 3), np.int64), Tag.TENSOR_I64), (np.zeros((2, 2)), Tag.TENSOR_F64),
    ]
    for value, tag in cases:
        assert classify(value) == tag
    with pytest.raises(TypeError):
        classify(object())


def test_properties(spark):
    df = one(spark)
    df = model.set_property(df, "tag", F.lit("train"))
    df = model.set_property(df, "q", F.array(F.lit(0.1), F.lit(0.2)), scope="atom")
    with pytest.raises(RecordError):
        model.set_property(df, "tag", F.array(F.lit(1.0), F.lit(2.0)), scope="atom")
    with pytest.raises(RecordError):
        model.set_property(df, "stress", F.lit(1.0))
    with pytest.raises(KeyError):
        model.get_property(df, "none")
    row = df.select(model.property_keys().alias("k"), model.has_property("q", "molecule").alias("h"), model.get_property(df, "tag").alias("t")).first()
    assert row.k == ["q", "tag"] and row.h is False and row.t == "train"
    assert model.delete_property(df, "q").select(model.property_keys("atom").alias("k")).first().k == []
    with pytest.raises(Exception, match="wrong length"):
        model.set_property(df, "w", F.array(F.lit(1.0)), scope="atom").collect()


def test_lock_as_text_and_equal_layouts(spark):
    a, b = one(spark, charges=np.ones((2, 2))), one(spark, charges=np.zeros((2, 2)))
    found = lock.derive(a.schema)
    assert lock.from_json(lock.to_json(found)) == found == lock.derive(b.schema) and a.schema == b.schema
    other = one(spark, charges=np.ones((2, 2), np.float32))
    assert lock.derive(other.schema) != found and other.schema != a.schema


def test_lookup_errors_and_order(spark):
    df = one(spark)
    assert [r.energy for r in read.multi_get(df, [1, 0, 1]).orderBy("pos").collect()] == [-2.5, -1.5, -2.5]
    assert read.multi_get(df, []).count() == 0 and read.flat_batch(df, []).count() == 0
    assert read.multi_get(df, [9], strict=False).first().energy is None
    with pytest.raises(Exception, match="no molecule"):
        read.multi_get(df, [9]).collect()
    with pytest.raises(OverflowError):
        read.multi_get(df, [-1])
    assert read.point_get(df, 1).first().energy == -2.5
    assert [r.mol_id for r in read.iterate(df)] == [0, 1]


def test_empty_molecule_and_defaults(spark):
    df = arrays_batch(spark, np.zeros((1, 0, 3), np.float32), np.zeros((1, 0), np.uint8), energy=np.zeros(1)).withColumn("mol_id", F.lit(0))
    assert model.to_atoms(df).count() == 0
    full = one(spark).withColumn("forces", F.lit(None).cast("array<struct<x:float,y:float,z:float>>"))
    assert model.with_default(full, "forces").first().forces[1].asDict() == {"x": 0, "y": 0, "z": 0}
    assert model.to_atoms(full).count() == 4


def test_tensors(spark):
    t = spark.createDataFrame([(0, ([2, 2], [1.0, 2.0, 3.0, 4.0])), (1, ([2, 2], [5.0, 6.0, 7.0, 8.0]))], "mol_id long, d struct<shape:array<int>,data:array<double>>")
    assert read.stack_tensors(t, "d").count() == 2
    mixed = t.unionByName(spark.createDataFrame([(2, ([4], [0.0] * 4))], t.schema))
    with pytest.raises(Exception, match="tensor shapes of d"):
        read.stack_tensors(mixed, "d").collect()
    absent = t.unionByName(spark.createDataFrame([(2, None)], t.schema))
    with pytest.raises(Exception, match="tensor shapes of d"):
        read.stack_tensors(absent, "d").collect()


def test_geometry(spark):
    df = spark.range(1).select(
        geo.distance(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")), F.struct(F.lit(3.0).alias("x"), F.lit(4.0).alias("y"), F.lit(0.0).alias("z"))).alias("d"),
        geo.voigt_to_matrix(F.array(*[F.lit(x) for x in (0.5, -1.25, 2.0, 0.75, -0.5, 1.5)])).alias("v"),
        geo.at(F.array(F.lit(1), F.lit(2)), F.lit(-1)).alias("last"), geo.at(F.array(F.lit(1)), F.lit(4)).alias("none"),
    )
    row = df.first()
    assert row.d == 5.0 and row.v == [0.5, 1.5, -0.5, 1.5, -1.25, 0.75, -0.5, 0.75, 2.0] and row.last == 2 and row.none is None


def test_offsets_two_levels(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n"))
    got = {r.k: r.o for r in read.exclusive_total(df, "k", "n", "o", width=64).collect()}
    total = 0
    for k in range(1000):
        assert got[k] == total
        total += k % 7


def test_locate(spark):
    rows = spark.createDataFrame([("b", 0), ("a", 0), ("a", 1)], "shard string, local_idx long")
    got = {r.wanted: (r.shard, r.local_idx) for r in shards.locate(shards.shard_offsets(rows), [0, 2, -1, 5]).collect()}
    assert got == {0: ("a", 0), 2: ("b", 0), -1: ("b", 0), 5: (None, None)}


def test_stats_edges(spark):
    one_row = spark.createDataFrame([("a", 1.0)], "k string, v double")
    r = stats.rate_summary(one_row, ["k"], "v").first()
    assert (r.sd, r.ci95, r["median"]) == (0, 0, 1)
    assert stats.speedup(spark.createDataFrame([("a", 2, 3.0)], "k string, w int, v double"), ["k"], "w", "v").first().speedup is None
    assert stats.draws(spark.range(5).withColumnRenamed("id", "m"), "m", 10).where("m between 0 and 4").count() == 10
    assert stats.permutation(spark.range(5), "id").count() == 5


class FakeAtoms:
    def __init__(self, n=2, info=None, arrays=None, results=None, pbc=(True, True, True)):
        self.info, self.arrays = info or {}, arrays or {}
        self._n, self._pbc = n, pbc
        self.calc = type("Calc", (), {"results": results or {}})()

    def get_positions(self):
        return np.arange(self._n * 3, dtype=float).reshape(-1, 3)

    def get_atomic_numbers(self):
        return np.array([6, 8, 1][: self._n])

    def get_cell(self):
        return np.diag([4.0, 5.0, 6.5])

    def get_pbc(self):
        return self._pbc


class Asked(FakeAtoms):
    """Gives its sections by getters."""

    pbc = np.array([False, True, False])

    def __init__(self, stress=None, only_sextet=False, **more):
        super().__init__(**more)
        self._stress, self._only_sextet = stress, only_sextet

    def get_potential_energy(self):
        return -7.5

    def get_forces(self):
        return np.full((self._n, 3), 0.25)

    def get_charges(self):
        return np.arange(self._n) / 4

    def get_velocities(self):
        return np.full((self._n, 3), -2.0)

    def get_stress(self, **how):
        if self._only_sextet and how:
            raise TypeError("voigt")
        if self._stress is None:
            raise RuntimeError("no stress")
        return self._stress


def test_import_asks_the_getters():
    full = np.arange(9.0).reshape(3, 3) - 4
    r = bridge.from_object(Asked(full, results={"energy": 1.0, "dipole": np.array([1.0, 2.0, 3.0])}))
    assert r.values["energy"] == -7.5 and r.values["mp_dipole"].tolist() == [1, 2, 3]
    assert r.values["forces"].tolist() == [[0.25] * 3] * 2 and r.tags["forces"] == Tag.VEC3_F32 == r.tags["positions"] == r.tags["velocities"]
    assert r.values["charges"].tolist() == [0, 0.25] and r.tags["charges"] == Tag.F64_ARRAY
    assert r.values["velocities"][0].tolist() == [-2, -2, -2] and r.values["stress"].tolist() == full.tolist()
    assert r.values["pbc"] == [False, True, False] and r.values["cell"].tolist() == np.diag([4, 5, 6.5]).tolist()
    sextet = np.array([1.0, 2.0, 3.0, 0.5, 0.25, -1.0])
    assert bridge.from_object(Asked(sextet, only_sextet=True)).values["stress"].tolist() == [[1, -1, 0.25], [-1, 2, 0.5], [0.25, 0.5, 3]]
    for absent in (None, np.arange(9).reshape(3, 3), np.zeros(5)):
        assert "stress" not in bridge.from_object(Asked(absent)).values
    assert bridge.from_object(Asked(full), energy=2, forces=np.ones((2, 3)), stress=2 * full).values["stress"].tolist() == (2 * full).tolist()
    with pytest.raises(bridge.ImportProblem):
        bridge.from_object(Asked(), forces=np.ones((3, 3)))


def test_stress_of_info_wins():
    own, given, asked = (np.full((3, 3), x) for x in (1.0, 2.0, 3.0))
    value = lambda **o: bridge.from_object(Asked(asked, info={"stress": own}), **o).values["stress"][0, 0]
    assert value() == 1 and value(stress=3 * asked) == 1 and value(info={"stress": given}) == 2 and value(copy_info=False) == 3
    assert value(info={"stress": np.zeros(6)}) == 1 and value(info={"stress": given.astype(int)}) == 1
    r = bridge.from_object(Asked(asked, info={"stress": own, "forces": 1, "charges": "x"}, arrays={"momenta": np.ones((2, 3)), "forces": np.ones((2, 3)), "numbers": np.ones(2)}))
    assert {k for k in r.values if k.startswith("mp_")} == {"mp_momenta"}


def test_import_rules():
    voigt = np.array([0.5, -1.25, 2.0, 0.75, -0.5, 1.5])
    r = bridge.from_object(FakeAtoms(info={"flag": True, "tag": "a", "energy": 5.0}, results={"energy": -1.0, "stress": voigt}), info={"tag": "b"})
    assert r.values["energy"] == -1.0 and r.values["mp_tag"] == "b" and r.values["mp_flag"] == 1 and "mp_energy" not in r.values
    assert r.values["stress"].tolist() == [[0.5, 1.5, -0.5], [1.5, -1.25, 0.75], [-0.5, 0.75, 2.0]]
    assert bridge.from_object(FakeAtoms(), energy=3.0).values["energy"] == 3.0
    assert "cell" not in bridge.from_object(FakeAtoms(pbc=(False,) * 3)).values
    inner = np.eye(3)
    assert bridge.from_object(FakeAtoms(info={"stress": inner}), stress=2 * inner).values["stress"].tolist() == inner.tolist()
    with pytest.raises(bridge.ImportProblem):
        bridge.from_object(FakeAtoms(info={"x": object()}))
    assert "mp_x" not in bridge.from_object(FakeAtoms(info={"x": object()}), copy_info=False).values
    runs = [len(b) for b in bridge.batches([bridge.from_object(FakeAtoms(n)) for n in (2, 2, 3, 2)])]
    assert runs == [2, 1, 1]


@pytest.fixture
def stub_package(monkeypatch):
    """Stands in for the package that export to objects needs."""
    import sys
    import types

    class Atoms:
        def __init__(self, **given):
            self.given, self.info, self.arrays, self.calc, self.velocities = given, {}, {}, None, None

        def set_velocities(self, v):
            self.velocities = v

        def set_array(self, key, value):
            self.arrays[key] = value

    class Calculator:
        def __init__(self):
            self.results = {}

    class Copying(Calculator):
        def __init__(self, atoms, **results):
            super().__init__()
            self.results = {k: np.array(v) for k, v in results.items()}

    names = {"ase": {"Atoms": Atoms}, "ase.calculators": {}, "ase.calculators.calculator": {"Calculator": Calculator}, "ase.calculators.singlepoint": {"SinglePointCalculator": Copying}}
    for name, content in names.items():
        module = types.ModuleType(name)
        module.__dict__.update(content)
        monkeypatch.setitem(sys.modules, name, module)
    return Copying


def test_objects(spark, stub_package):
    df = one(spark, forces=np.arange(12, dtype=np.float32).reshape(2, 2, 3), charges=np.ones((2, 2)), velocities=np.ones((2, 2, 3), np.float32),
             stress=np.arange(18.0).reshape(2, 3, 3), pbc=np.array([[True, False, False]] * 2), properties={"tag": ["p", "q"], "pair": np.ones((2, 2))})
    first, second = bridge.export_objects(df, calc_mode="singlepoint")
    assert type(second.calc) is stub_package and second.calc.results["energy"] == -2.5 and second.calc.results["forces"][0].tolist() == [6, 7, 8]
    assert first.info == {"tag": "p"} and first.arrays["pair"].tolist() == [1, 1] and first.given["pbc"] == (True, False, False) and "cell" not in first.given
    assert second.calc.results["stress"][0].tolist() == [9, 10, 11] and first.velocities.shape == (2, 3) and first.given["numbers"].tolist() == [14, 8]
    payload = next(bridge.export_batch(df))
    (shared,) = bridge.objects([payload], "nocopy")
    assert shared.calc.results["forces"] is payload["results"]["forces"] and shared.calc.atoms is shared
    (plain,) = bridge.export_objects(df, [1], attach_calc=False)
    assert plain.calc is None and plain.info["energy"] == -2.5 and plain.arrays["charges"].tolist() == [1, 1] and plain.info["stress"].shape == (3, 3)
    row = df.where("mol_id = 1").first()
    single = bridge.to_object(row)
    assert single.calc.results["forces"].tolist() == second.calc.results["forces"].tolist() and single.info == second.info
    assert bridge.to_object(row, attach_calc=False, copy_info=False).info.keys() == {"energy", "stress"}
    for call in (lambda: bridge.to_object(row, calc_mode="x"), lambda: list(bridge.export_batch(df, calc_mode="x")), lambda: list(bridge.objects([], "x"))):
        with pytest.raises(ValueError):
            call()


def test_batches_come_in_order(spark):
    df = one(spark)
    got = [p["results"]["energy"] for p in bridge.export_batch(df, [1, 0, 1, 1], at_once=3)]
    assert got == [-2.5, -1.5, -2.5, -2.5] and [p["results"]["energy"] for p in bridge.export_batch(df, at_once=1)] == [-1.5, -2.5]
    assert list(bridge.export_batch(df, [])) == [] and list(bridge.export_batch(df.where("false"))) == []


def test_typed_getters(spark):
    df = one(spark, properties={"gap": np.array([0.75, 4.0]), "n": np.array([9, 4]), "tag": ["a", "b"]}, atom_properties={"q": np.ones((2, 2)), "site": np.ones((2, 2), int), "dir": np.ones((2, 2, 3))})
    row = df.select(*[model.get_scalar(df, k).alias(k) for k in ("gap", "n", "tag", "none")], *[model.get_atom_property(df, k, t).alias(k + t) for k in ("q", "site", "dir") for t in ("float", "int", "vec3")]).first()
    assert (row.gap, row.n, row.tag, row.none) == (0.75, 9.0, None, None)
    assert row.qfloat == [1, 1] and row.siteint == [1, 1] and len(row.dirvec3) == 2 and all(row[k] is None for k in ("qint", "qvec3", "sitefloat", "sitevec3", "dirfloat", "dirint"))


def test_payloads_round_trip(spark):
    from molframe.functions import payload
    from molframe.functions.values import TYPES, to_cell

    r = np.random.default_rng(4)
    made = {
        Tag.F64: 2.5, Tag.I64: -7, Tag.F32: 0.25, Tag.STRING: "né漢", Tag.F64_ARRAY: r.random(4), Tag.F32_ARRAY: r.random(3).astype(np.float32),
        Tag.I64_ARRAY: np.array([1, -2]), Tag.I32_ARRAY: np.array([5], np.int32), Tag.VEC3_F32: r.random((2, 3)).astype(np.float32),
        Tag.VEC3_F64: r.random((3, 3)), Tag.MAT3_F64: r.random((3, 3)), Tag.MAT3_F32: r.random((3, 3)).astype(np.float32), Tag.BOOL3: [True, False, True],
        Tag.TENSOR_F64: r.random((2, 2, 3)), Tag.TENSOR_I32: np.arange(6, dtype=np.int32).reshape(1, 6), Tag.TENSOR_F32: np.zeros((0, 2), np.float32), Tag.TENSOR_I64: np.array(3),
    }
    for tag, value in made.items():
        back = payload.from_bytes(payload.to_bytes(value, tag), tag)
        assert np.array_equal(back, value) and np.shape(back) == np.shape(value), tag
        assert payload.from_bytes(payload.to_bytes(None, tag), tag) is None
        df = spark.createDataFrame([(to_cell(value, tag),), (None,)], T.StructType([T.StructField("v", TYPES[tag].spark)]))
        rows = df.select("v", payload.decoded(payload.encoded(F.col("v"), tag), tag).alias("w")).collect()
        assert rows[0].v == rows[0].w and rows[1].w is None, tag
    for data, tag in ((b"abc", Tag.F64), (b"abcd", Tag.VEC3_F32), (b"\1", Tag.BOOL3), (b"", Tag.TENSOR_F64), (b"\1\0\0\0\2\0\0\0", Tag.TENSOR_F64), (b"x" * 5, Tag.I32_ARRAY)):
        with pytest.raises(payload.PayloadError):
            payload.from_bytes(data, tag)


def test_values_too_large_are_refused(monkeypatch):
    from molframe.functions import payload

    monkeypatch.setattr(payload, "MOST_BYTES", 10)
    with pytest.raises(payload.PayloadError):
        payload.to_bytes("x" * 11, Tag.STRING)
    with pytest.raises(payload.PayloadError):
        payload.from_bytes(b"x" * 16, Tag.F64_ARRAY)


def test_raw_records(spark):
    from molframe.functions import payload

    row = payload.raw_records(one(spark)).where("mol_id = 1").first()
    places, numbers = payload.raw_atoms(bytes(row.raw))
    assert row.n_atoms == 2 and places.tolist() == [[4, 0, 1], [4, 0, -1]] and numbers.tolist() == [7, 26]
    with pytest.raises(payload.PayloadError):
        payload.raw_atoms(b"x" * 14)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_runs_over_ranges(spark):
    rows = [(k, "aab"[k // 7 % 3]) for k in range(0, 500, 3) if not 100 < k < 260]
    df = spark.createDataFrame([*rows, (900, None), (903, None)], "k long, s string")
    got = stats.runs(df, "k", F.col("s"), width=16)
    assert "SinglePartition" not in plan_of(got.select("k", "run")).split("Window")[-1]
    number, before, want = -1, object(), {}
    for k, s in [*rows, (900, None), (903, None)]:
        number += s != before
        before, want[k] = s, number
    assert {r.k: r.run for r in got.collect()} == want


def test_locate_by_halving(spark):
    lengths = [3, 1, 0, 5, 2, 7]
    rows = spark.createDataFrame([(f"s{k}", i) for k, n in enumerate(lengths) for i in range(n)], "shard string, local_idx long")
    found = shards.locate(shards.shard_offsets(rows), range(-19, 20))
    every = [(f"s{k}", i) for k, n in enumerate(lengths) for i in range(n)]
    want = {i: every[i] if -18 <= i < 18 else (None, None) for i in range(-19, 20)}
    assert {r.wanted: (r.shard, r.local_idx) for r in found.collect()} == want


def test_import_export(spark, tmp_path):
    from molframe.sources.store import Store

    store = Store.create(spark, str(tmp_path / "s"))
    items = [FakeAtoms(2, arrays={"site": np.array([1.0, 2.0])}, info={"tag": "a"}, results={"energy": -1.0, "forces": np.ones((2, 3))}), FakeAtoms(3, info={"tag": "b"})]
    assert bridge.import_objects(store, items) == 2
    store.flush()
    a, b = bridge.export_batch(store.molecules(), [0, 1])
    assert a["results"]["energy"] == -1.0 and a["results"]["forces"].shape == (2, 3) and a["arrays"]["site"].tolist() == [1.0, 2.0]
    assert a["info"] == {"tag": "a"} and b["info"] == {"tag": "b"} and b["results"] == {} and b["positions"].shape == (3, 3)
    (plain,) = bridge.export_batch(store.molecules(), [0], calc_mode="none")
    assert plain["info"]["energy"] == -1.0 and plain["arrays"]["forces"].shape == (2, 3)
    with pytest.raises(bridge.ImportProblem):
        bridge.import_objects(store, items, info=[{}])
