"""Stand-ins for molecules made from the test tables: an order is a molecule, its line items are its atoms.

A test mapping, not chemistry. Line items repeat (order, line number), so the order of atoms is that of the whole row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.operators.model import from_atoms
from molframe.operators.ranges import RANGE, Ranges

SHARDS = 4
ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate",
    "l_returnflag", "l_linestatus",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_ranges(spark: SparkSession, sf_dir: str) -> Ranges:
    """Ranges of the molecules' ids."""
    return Ranges.counted(table(spark, sf_dir, "orders"), "o_orderkey")


def molecules(spark: SparkSession, sf_dir: str, ranges: Ranges | None = None) -> DataFrame:
    """mol_id, n_atoms, name, positions, atomic_numbers, energy, charges, forces, mp_status, mp_customer, present.

    Forces are absent where the order's status is P, the customer property is stored as null there. With ``ranges`` of the ids, orders and line
    items are dealt to these instead of by hash, and the molecules lie in them (column ``RANGE``).
    """
    lines, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    keys, same = ["l_orderkey"], F.col("o_orderkey") == F.col("l_orderkey")
    if ranges:
        o, lines = ranges.deal(o, "o_orderkey"), ranges.deal(lines, "l_orderkey").withColumnRenamed(RANGE, "_lines")
        keys, same = ["_lines", "l_orderkey"], (F.col(RANGE) == F.col("_lines")) & same
    vector = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    atoms = from_atoms(
        lines, keys, ORDER,
        {
            "positions": lambda of: vector(of("l_quantity"), of("l_extendedprice") / 1000, of("l_tax") * 100),
            "atomic_numbers": lambda of: (of("l_partkey") % 118 + 1).cast("smallint"),
            "charges": lambda of: of("l_discount"),
            "forces": lambda of: vector(of("l_quantity") * 2, of("l_quantity") * 0, of("l_quantity") * 0),
        },
    )
    o = o.join(atoms, same, "left")
    kinds = dict(atoms.dtypes)
    held = lambda c: F.coalesce(c, F.array().cast(kinds[c])).alias(c)
    stored = F.col("o_orderstatus") != "P"
    sections = F.array(*[F.lit(c) for c in ("charges", "energy", "mp_customer", "mp_status", "name")])
    return o.select(
        F.col("o_orderkey").alias("mol_id"), F.coalesce("n_atoms", F.lit(0)).alias("n_atoms"),
        F.col("o_orderpriority").alias("name"), held("positions"), held("atomic_numbers"),
        F.col("o_totalprice").alias("energy"), held("charges"),
        F.when(stored, F.coalesce("forces", F.array().cast(kinds["forces"]))).alias("forces"),
        F.col("o_orderstatus").alias("mp_status"), F.when(stored, F.col("o_custkey")).alias("mp_customer"),
        F.when(stored, F.array_sort(F.array_append(sections, "forces"))).otherwise(sections).alias("present"), *([RANGE] if ranges else []),
    )


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shard, local_idx, mol_id, energy): molecules dealt to shards by id."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        (F.col("o_orderkey") % SHARDS).cast("int").alias("shard"), F.floor(F.col("o_orderkey") / SHARDS).cast("long").alias("local_idx"),
        F.col("o_orderkey").alias("mol_id"), F.col("o_totalprice").alias("energy"),
    )


def tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mol_id, density, mp_array, cell, voigt): embeddings as 8 x 8 tensors, arrays of four, matrices and Voigt sextets."""
    e = table(spark, sf_dir, "embeddings")
    v = F.col("embedding")
    return e.select(
        F.col("vec_id").alias("mol_id"),
        F.struct(F.array(F.lit(8), F.lit(8)).alias("shape"), v.alias("data")).alias("density"),
        F.slice(v, 1, 4).alias("mp_array"), F.slice(v, 1, 9).alias("cell"), F.slice(v, 1, 6).alias("voigt"), F.col("label"),
    )


#: The same in SQL.
SQL_ATOMS = f"""
SELECT l_orderkey AS mol_id,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)}) - 1 AS INTEGER) AS atom_idx,
       CAST(l_partkey % 118 + 1 AS SMALLINT) AS z_num, l_quantity AS x, l_extendedprice / 1000 AS y, l_tax * 100 AS z,
       l_discount AS charge,
       CASE WHEN o_orderstatus <> 'P' THEN l_quantity * 2 END AS fx
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""
SQL_MOLECULES = """
SELECT o_orderkey AS mol_id, CAST(count(l_orderkey) AS INTEGER) AS n_atoms, any_value(o_orderpriority) AS name,
       any_value(o_totalprice) AS energy, any_value(o_orderstatus) AS status, any_value(o_custkey) AS custkey
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
"""
WITH = f"WITH a AS ({SQL_ATOMS}), m AS ({SQL_MOLECULES}) "
