"""Lookups that keep the caller's order, offsets without a global sort, and flat training batches."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .model import to_atoms, wide_atoms

#: Ids that one request may name as a list, and how many of them are broadcast, or pushed to the scan, at most.
MOST_IDS, BROADCAST_IDS, PUSHED_IDS = 1_000_000, 100_000, 10_000


class IndexOutOfRange(IndexError):
    """An id that no molecule has."""


def id_table(df: DataFrame, ids: Sequence[int]) -> DataFrame:
    """(pos, mol_id) of a request."""
    if len(ids) > MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} ids: join a DataFrame of ids instead")
    if any(i < 0 for i in ids):
        raise OverflowError("ids are not negative here")
    rows = pa.table({"pos": pa.array(range(len(ids)), pa.int32()), "mol_id": pa.array(ids, pa.int64())})
    return df.sparkSession.createDataFrame(rows)


def point_get(molecules: DataFrame, mol_id: int) -> DataFrame:
    """The row of one molecule; the id is pushed to the scan."""
    if mol_id < 0:
        raise OverflowError("ids are not negative here")
    return molecules.where(F.col("mol_id") == F.lit(mol_id).cast("long"))


def multi_get(molecules: DataFrame, ids: Sequence[int] | DataFrame, strict: bool = True) -> DataFrame:
    """Rows of the requested molecules with ``pos``, the place in the request; an id asked for twice comes twice.

    With ``strict`` an unknown id stops the job, else it gives a row of nulls. A list of ids is pushed to the scan.
    """
    if isinstance(ids, DataFrame):
        wanted, found = ids.select("pos", "mol_id"), molecules
    else:
        wanted = id_table(molecules, ids)
        wanted = F.broadcast(wanted) if len(ids) <= BROADCAST_IDS else wanted
        found = molecules.where(F.col("mol_id").isin([int(i) for i in set(ids)])) if len(ids) <= PUSHED_IDS else molecules
    there = found.withColumn("_there", F.lit(True))
    rows = wanted.join(there, "mol_id", "left")
    if strict:
        message = F.concat(F.lit("no molecule "), F.col("mol_id").cast("string"))
        rows = rows.withColumn("mol_id", F.when(F.col("_there"), F.col("mol_id")).otherwise(F.raise_error(message)))
    return rows.select("pos", "mol_id", *[c for c in molecules.columns if c != "mol_id"])


def missing_ids(molecules: DataFrame, ids: Sequence[int]) -> DataFrame:
    """(pos, mol_id) of the requested ids that no molecule has."""
    return id_table(molecules, ids).join(molecules.select("mol_id"), "mol_id", "left_anti").select("pos", "mol_id")


def exclusive_total(df: DataFrame, order: str, value: str, name: str, width: int = 1 << 16) -> DataFrame:
    """Adds the sum of ``value`` over all rows before, by the integer column ``order``.

    Two levels: totals per range of ``width`` orders, their running sum, and a window inside each range, so that no
    task sees more than a range and the table of ranges is a ``width``-th of the input.
    """
    cut = df.withColumn("_range", F.floor(F.col(order) / F.lit(width)).cast("long"))
    totals = cut.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return cut.join(starts, "_range").withColumn(name, total.cast("long")).drop("_range", "_start")


def batch_offsets(batch: DataFrame) -> DataFrame:
    """Adds ``atom_offset`` to the rows of a request: atoms of all rows before."""
    if "n_atoms" not in batch.columns:
        batch = batch.withColumn("n_atoms", F.size("atomic_numbers"))
    return exclusive_total(batch, "pos", "n_atoms", "atom_offset")


def flat_batch(molecules: DataFrame, ids: Sequence[int], fill: Sequence[str] = ("forces", "charges", "velocities")) -> DataFrame:
    """Concatenated atoms of the requested molecules: ``pos, mol_id, atom_idx, atom_offset, row`` and wide columns.

    ``row`` is the place in the concatenated arrays. Absent per-atom sections are zeros, also those that no requested
    molecule has but the table knows. An empty request gives no rows.
    """
    batch = batch_offsets(multi_get(molecules, ids))
    flat = wide_atoms(to_atoms(batch, ("pos", "mol_id", "atom_offset")))
    zeros = {"forces": ("fx", "fy", "fz"), "velocities": ("vx", "vy", "vz"), "charges": ("charge",)}
    filled = {c: F.coalesce(c, F.lit(0.0)) for s in fill for c in zeros[s] if c in flat.columns}
    return flat.withColumns({**filled, "row": (F.col("atom_offset") + F.col("atom_idx")).cast("long")})


def flat_scalars(molecules: DataFrame, ids: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """Per-molecule values of a request: numbers absent are zeros, strings stay null."""
    rows = multi_get(molecules, ids)
    kinds = dict(rows.dtypes)
    numbers = ("double", "float", "bigint", "int", "smallint")
    return rows.select("pos", "mol_id", *[F.coalesce(c, F.lit(0).cast(kinds[c])).alias(c) if kinds[c] in numbers else F.col(c) for c in columns])


def concat_arrays(molecules: DataFrame, column: str, ids: Sequence[int] | None = None) -> DataFrame:
    """Array values of a request one after the other: ``pos, mol_id, k, value``."""
    rows = multi_get(molecules, ids) if ids is not None else molecules.withColumn("pos", F.col("mol_id"))
    return rows.select("pos", "mol_id", F.posexplode(column).alias("k", "value"))


def stack_tensors(molecules: DataFrame, column: str, scope: str = "molecule") -> DataFrame:
    """Data of tensors that can be stacked: whole shapes agree, or, for atoms, all but their first length.

    A tensor that is absent, or whose shape differs from the others', stops the job: tensors are never filled.
    """
    shape = F.col(f"{column}.shape")
    part = shape if scope == "molecule" else F.slice(shape, 2, F.greatest(F.size(shape) - 1, F.lit(0)))
    rows = molecules.withColumn("_shape", F.to_json(part))
    one = rows.agg(F.min("_shape").alias("_least"), F.max("_shape").alias("_most"), F.count("_shape").alias("_n"), F.count(F.lit(1)).alias("_all"))
    ok = F.col("_least").isNull() & (F.col("_all") == 0) | (F.col("_least") == F.col("_most")) & (F.col("_n") == F.col("_all"))
    guard = F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit(f"tensor shapes of {column} differ or are absent")))
    return rows.crossJoin(F.broadcast(one.select(guard.alias("_ok")))).where("_ok").select("mol_id", shape.alias("shape"), F.col(f"{column}.data").alias("data"))


def iterate(molecules: DataFrame):
    """Rows in order of ``mol_id``, fetched partition by partition."""
    return molecules.orderBy("mol_id").toLocalIterator()

