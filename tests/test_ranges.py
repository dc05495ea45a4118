"""Sorted appends deal rows to counted ranges; queries that store molecules make and move them once."""

import re
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from molframe.operators import model, ranges
from molframe.operators.ranges import Ranges
from molframe.plans import fixtures as fx
from molframe.sources.store import Store

SF = "/root/testdata/sf0.001"


def molecules(spark, keys, kind):
    """Molecules of two atoms with a key and their number in the order of the list."""
    rows = spark.createDataFrame(list(enumerate(keys)), f"n long, k {kind}")
    numbers, place = F.array(F.lit(6), F.lit(8)).cast("array<smallint>"), F.struct(*[F.lit(0.0).alias(c) for c in "xyz"])
    return rows.select("k", F.col("n").cast("double").alias("energy"), numbers.alias("atomic_numbers"), F.array(place, place).alias("positions"))


@pytest.fixture
def unstaged(monkeypatch):
    def staged(*_):
        raise AssertionError("rows were staged")

    monkeypatch.setattr(Store, "_write_staged", staged)


@pytest.mark.parametrize(
    "kind, keys",
    [
        ("long", [7, None, 3, 3, 3, -5, None, 900, 12, 3, 8, 1]),
        ("string", ["b", "a", "", None, "zz", "é", "b", "c", "d"]),
        ("double", [2.5, float("nan"), -0.0, 0.0, float("-inf"), None, 1e300, 3.0]),
        ("timestamp", [datetime(2020, 1, d) for d in (5, 2, 9, 2, 1, 7)]),
        ("long", []),
        ("long", [4]),
    ],
)
def test_sorted_append_by_ranges(spark, tmp_path, monkeypatch, unstaged, kind, keys):
    monkeypatch.setattr(ranges, "LEAST_ROWS", 1)
    rows = molecules(spark, keys, kind)
    store = Store.create(spark, str(tmp_path / "s"))
    for _ in range(2):  # the second time ids go on
        assert store.append(rows.repartition(3), order="k") == len(keys)
    store.flush()
    got = store.molecules().orderBy("mol_id").collect()
    assert [r.mol_id for r in got] == list(range(2 * len(keys)))
    plain = lambda x: repr(x + 0.0 if isinstance(x, float) else x)
    assert [plain(keys[int(r.energy)]) for r in got] == [plain(r.k) for r in rows.orderBy("k").collect()] * 2


def test_ranges_have_few_and_many_rows(spark, monkeypatch):
    rows = spark.range(5000).select((F.col("id") * 7 % 5000).alias("k"))
    assert Ranges.counted(rows, "k").counts == [5000]
    monkeypatch.setattr(ranges, "LEAST_ROWS", 10)
    monkeypatch.setattr(ranges, "MOST_ROWS", 100)
    found = Ranges.counted(rows, "k")
    assert sum(found.counts) == 5000 and len(found.counts) > 8 and max(found.counts) < 500
    dealt = found.deal(rows, "k").withColumn("p", F.spark_partition_id())
    dealt = dealt.groupBy(ranges.RANGE).agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("a"), F.countDistinct("p").alias("p"))
    got = sorted(dealt.collect(), key=lambda r: r[ranges.RANGE])
    assert [(r["n"], r["a"], r["p"]) for r in got] == [(n, a, 1) for n, a in zip(found.counts, found.starts)]


def test_counts_that_do_not_hold_lead_to_staging(spark, tmp_path):
    rows = molecules(spark, [3, 1, 2], "long")
    wrong = Ranges.counted(rows.where("k > 1"), "k")
    store = Store.create(spark, str(tmp_path / "s"))
    store.append(wrong.deal(rows, "k"), order="k", ranges=wrong)
    store.flush()
    assert [r.energy for r in store.molecules().orderBy("mol_id").collect()] == [1, 2, 0]


def test_a_table_is_appended_without_sort_or_staging(spark, tmp_path, unstaged):
    one, two = Store.create(spark, str(tmp_path / "a")), Store.create(spark, str(tmp_path / "b"), "zstd", layout="flat")
    one.append(molecules(spark, [2, 1, 3], "long"), order="k")
    one.flush()
    assert two.append_table(one) == 3 and two.append_table(one) == 3
    two.flush()
    assert [(r.mol_id, r.energy, r.n_atoms) for r in two.molecules().orderBy("mol_id").collect()] == list(zip(range(6), [1, 0, 2] * 2, [2] * 6))
    assert two.append_table(Store.create(spark, str(tmp_path / "c"))) == 0
    with pytest.raises(ValueError):
        Store.open(spark, two.path).append_table(one)


def test_fields_made_of_the_order_take_no_room(spark):
    """Only the columns of the order are gathered, and dealt tables are moved once each."""
    found = fx.id_ranges(spark, SF)
    plan = fx.molecules(spark, SF, found).sortWithinPartitions("mol_id")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?m)^.*- Exchange ", plan)) == 2
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 3, "c")], "k long, n int, t string")
    made = model.from_atoms(rows, "k", ["n"], {"double": lambda of: of("n") * 2, "t": F.col("t")})
    assert sorted((r.k, r.n_atoms, r.double, r.t) for r in made.collect()) == [(1, 2, [2, 4], ["a", "b"]), (2, 1, [6], ["c"])]
    gathered = fx.molecules(spark, SF).select("positions", "forces")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"_o\d+, l_\w+", gathered)) == len(fx.ORDER) and "positions, " not in gathered.split("collect_list")[1].split(", 0, 0)")[0]


@pytest.mark.parametrize("name", ["codec_roundtrip", "set_sections"])
def test_molecules_are_made_once_for_stores(spark, monkeypatch, unstaged, name):
    made, plain = [], fx.molecules
    monkeypatch.setattr(fx, "molecules", lambda *a: made.append(a) or plain(*a))
    monkeypatch.setattr(ranges, "LEAST_ROWS", 100)
    ours = entry.queries()[name](spark, SF)
    columns = sorted(ours.columns)
    db = duckdb.connect()
    for t in ("orders", "lineitem"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    theirs = db.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    plainly = lambda rows: sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert plainly(ours.select(*columns).collect()) == plainly(theirs)
    assert len(made) == 1 and len(made[0]) == 3 and len(made[0][2].counts) > 1
