"""Registered queries of the engine's own operators, each with its SQL equivalent where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from molframe.functions import geometry as geo
from molframe.functions import payload
from molframe.functions.values import Tag
from molframe.operators import bridge, lock, model, read, shards, stats
from molframe.sources.ingest import arrays_batch
from molframe.sources.shard_set import ShardReader, open_repository, rewrite, upload
from molframe.sources.store import Store

from . import fixtures as fx
from .scratch import scratch_dir
from .views import register

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

IDS = [5, 3, 5, 7, 1499]
SQL_IDS = "(VALUES (0, 5), (1, 3), (2, 5), (3, 7), (4, 1499)) AS ids(pos, mol_id)"


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(column: Column | str) -> Column:
    """Rounded as the SQL is."""
    return F.round(column, 6)


# -- scans and lookups ----------------------------------------------------------------------------------------------


@query(fx.WITH + "SELECT mol_id, n_atoms, name, energy FROM m")
def mol_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.molecules(spark, sf_dir).select("mol_id", "n_atoms", "name", "energy")


@query(fx.WITH + "SELECT mol_id, atom_idx, z_num, x, y, z, charge, fx FROM a")
def atom_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = model.wide_atoms(model.to_atoms(fx.molecules(spark, sf_dir)))
    return atoms.select("mol_id", "atom_idx", "z_num", "x", "y", "z", "charge", "fx")


@query("SELECT count(*) AS n FROM orders")
def mol_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"))


@query(fx.WITH + "SELECT mol_id, n_atoms FROM m")
def num_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.molecules(spark, sf_dir).select("mol_id", "n_atoms")


@query(fx.WITH + "SELECT mol_id, n_atoms, name, energy FROM m WHERE mol_id = 7")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.point_get(fx.molecules(spark, sf_dir), 7).select("mol_id", "n_atoms", "name", "energy")


@query(fx.WITH + f"SELECT CAST(pos AS INTEGER) AS pos, m.mol_id, n_atoms, energy FROM {SQL_IDS} JOIN m USING (mol_id)")
def multi_get_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.multi_get(fx.molecules(spark, sf_dir), IDS).select("pos", "mol_id", "n_atoms", "energy")


@query("SELECT CAST(pos AS INTEGER) AS pos, CAST(mol_id AS BIGINT) AS mol_id FROM (VALUES (0, 5), (1, 99999999), (2, 3), (3, 88888888)) AS t(pos, mol_id) WHERE mol_id NOT IN (SELECT o_orderkey FROM orders)")  # noqa: E501
def multi_get_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.missing_ids(fx.molecules(spark, sf_dir), [5, 99999999, 3, 88888888])


# -- flat batches ---------------------------------------------------------------------------------------------------

_BATCH = fx.WITH + f", b AS (SELECT CAST(pos AS INTEGER) AS pos, m.*, CAST(coalesce(sum(n_atoms) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS atom_offset FROM {SQL_IDS} JOIN m USING (mol_id)) "  # noqa: E501


@query(_BATCH + "SELECT pos, mol_id, atom_idx, atom_offset, atom_offset + atom_idx AS row, z_num, x, y, z, charge, coalesce(fx, 0) AS fx FROM b JOIN a USING (mol_id)")  # noqa: E501
def flat_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = read.flat_batch(fx.molecules(spark, sf_dir), IDS)
    return flat.select("pos", "mol_id", "atom_idx", "atom_offset", "row", "z_num", "x", "y", "z", "charge", "fx")


@query(_BATCH + "SELECT pos, mol_id, n_atoms, atom_offset FROM b")
def flat_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.batch_offsets(read.multi_get(fx.molecules(spark, sf_dir), IDS)).select("pos", "mol_id", "n_atoms", "atom_offset")


@query(fx.WITH + "SELECT mol_id, CAST(coalesce(sum(n_atoms) OVER (ORDER BY mol_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS atom_offset FROM m")  # noqa: E501
def table_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = fx.molecules(spark, sf_dir).select("mol_id", "n_atoms")
    return read.exclusive_total(counts, "mol_id", "n_atoms", "atom_offset", width=1024).select("mol_id", "atom_offset")


@query(fx.WITH + ", o AS (SELECT mol_id, coalesce(sum(n_atoms) OVER (ORDER BY mol_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS atom_offset FROM m) SELECT CAST(atom_offset + atom_idx AS BIGINT) AS row, mol_id, atom_idx, z_num, x, y, z FROM o JOIN a USING (mol_id)")  # noqa: E501
def flat_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table as one flat batch."""
    kept = fx.molecules(spark, sf_dir).select("mol_id", "n_atoms", "positions", "atomic_numbers")
    placed = read.exclusive_total(kept, "mol_id", "n_atoms", "atom_offset", width=1024)
    flat = model.wide_atoms(model.to_atoms(placed, ("mol_id", "atom_offset")))
    return flat.select((F.col("atom_offset") + F.col("atom_idx")).alias("row"), "mol_id", "atom_idx", "z_num", "x", "y", "z")


@query(fx.WITH + "SELECT mol_id, atom_idx, coalesce(fx, 0) AS fx FROM a")
def flat_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = model.with_default(fx.molecules(spark, sf_dir), "forces")
    return model.wide_atoms(model.to_atoms(filled, only=("forces",))).select("mol_id", "atom_idx", "fx")


@query(fx.WITH + f"SELECT CAST(pos AS INTEGER) AS pos, m.mol_id, energy, CASE WHEN status <> 'P' THEN custkey ELSE 0 END AS mp_customer FROM {SQL_IDS} JOIN m USING (mol_id)")  # noqa: E501
def flat_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.flat_scalars(fx.molecules(spark, sf_dir), IDS, ["energy", "mp_customer"])


@query(fx.WITH + f"SELECT CAST(pos AS INTEGER) AS pos, m.mol_id, name, status AS mp_status FROM {SQL_IDS} JOIN m USING (mol_id)")
def flat_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.flat_scalars(fx.molecules(spark, sf_dir), IDS, ["name", "mp_status"])


@query("SELECT vec_id AS mol_id, CAST(i AS INTEGER) AS r, round(CAST(embedding[i * 8 + 1] AS DOUBLE), 6) AS first FROM embeddings, range(8) t(i)")
def flat_tensor_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    stacked = read.stack_tensors(fx.tensors(spark, sf_dir), "density")
    rows = stacked.select("mol_id", F.posexplode(geo.rows_of(F.col("data"), 8)).alias("r", "v"))
    return rows.select("mol_id", "r", r6(F.get("v", F.lit(0)).cast("double")).alias("first"))


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN len(embedding) <> 64 THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM embeddings")
def tensor_shape_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.tensors(spark, sf_dir)
    return t.agg(F.count(F.lit(1)).alias("n"), F.sum((~geo.tensor_ok(F.col("density"))).cast("long")).alias("bad"))


@query(fx.WITH + "SELECT mol_id, atom_idx, charge AS value FROM a")
def atom_property_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = model.set_property(fx.molecules(spark, sf_dir), "partial", F.col("charges"), scope="atom")
    return model.to_atoms(made, only=("ap_partial",)).select("mol_id", "atom_idx", F.col("ap_partial").alias("value"))


@query("SELECT vec_id AS mol_id, CAST(i AS INTEGER) AS k, round(CAST(embedding[i + 1] AS DOUBLE), 6) AS value FROM embeddings, range(4) t(i)")
def molecule_array_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = read.concat_arrays(fx.tensors(spark, sf_dir), "mp_array")
    return flat.select("mol_id", "k", r6(F.col("value").cast("double")).alias("value"))


# -- shards ---------------------------------------------------------------------------------------------------------

_SHARDS = "WITH r AS (SELECT CAST(o_orderkey % 4 AS INTEGER) AS shard, o_orderkey // 4 AS local_idx, o_orderkey AS mol_id, o_totalprice AS energy FROM orders), o AS (SELECT shard, length, CAST(coalesce(sum(length) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM (SELECT shard, count(*) AS length FROM r GROUP BY shard)) "  # noqa: E501
SHARD_IDS = [1, 0, 1499, 700, 1]


@query(_SHARDS + "SELECT * FROM o")
def shard_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_offsets(fx.sharded(spark, sf_dir))


@query(_SHARDS + ", q AS (SELECT * FROM (VALUES (0, 1), (1, 0), (2, 1499), (3, 700), (4, 99999999)) AS t(pos, wanted)) SELECT CAST(pos AS INTEGER) AS pos, CAST(wanted AS BIGINT) AS wanted, shard, CAST(wanted - first AS BIGINT) AS local_idx FROM q LEFT JOIN o ON wanted >= first AND wanted < first + length")  # noqa: E501
def shard_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.locate(shards.shard_offsets(fx.sharded(spark, sf_dir)), [1, 0, 1499, 700, 99999999])


@query(_SHARDS + ", q AS (SELECT * FROM (VALUES (0, 1), (1, 0), (2, 1499), (3, 700), (4, 1)) AS t(pos, wanted)) SELECT CAST(pos AS INTEGER) AS pos, shard, mol_id, energy FROM q JOIN o ON wanted >= first AND wanted < first + length JOIN r USING (shard) WHERE local_idx = wanted - first")  # noqa: E501
def shard_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_get(fx.sharded(spark, sf_dir), SHARD_IDS).select("pos", "shard", "mol_id", "energy")


@query(_SHARDS + ", q AS (SELECT pos, wanted, CASE WHEN wanted < 0 THEN wanted + (SELECT sum(length) FROM o) ELSE wanted END AS spot FROM (VALUES (0, -1), (1, -1000), (2, 2)) AS t(pos, wanted)) SELECT CAST(pos AS INTEGER) AS pos, CAST(wanted AS BIGINT) AS wanted, shard, CAST(spot - first AS BIGINT) AS local_idx FROM q LEFT JOIN o ON spot >= first AND spot < first + length")  # noqa: E501
def shard_negative_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.locate(shards.shard_offsets(fx.sharded(spark, sf_dir)), [-1, -1000, 2])


# -- construction, getters, properties ------------------------------------------------------------------------------


@query(fx.WITH + "SELECT mol_id, CAST(count(*) AS INTEGER) AS n_atoms, max(CASE WHEN atom_idx = 0 THEN z_num END) AS first_z, arg_max(z_num, atom_idx) AS last_z, round(sum(x), 6) AS sum_x FROM a GROUP BY mol_id")  # noqa: E501
def rows_to_molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.molecules(spark, sf_dir).where("n_atoms > 0")
    total = F.aggregate(F.transform("positions", lambda p: p["x"]), F.lit(0.0), lambda a, x: a + x)
    return m.select("mol_id", "n_atoms", geo.at(F.col("atomic_numbers"), F.lit(0)).alias("first_z"), geo.at(F.col("atomic_numbers"), F.lit(-1)).alias("last_z"), r6(total).alias("sum_x"))  # noqa: E501


@query(fx.WITH + "SELECT mol_id, CAST(atom_idx * 3 + k AS INTEGER) AS at, round(CASE k WHEN 0 THEN x WHEN 1 THEN y ELSE z END, 6) AS value FROM a, range(3) t(k)")
def positions_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = fx.molecules(spark, sf_dir).select("mol_id", F.posexplode(geo.flat3(F.col("positions"))).alias("at", "value"))
    return flat.select("mol_id", "at", r6("value").alias("value"))


@query(fx.WITH + "SELECT m.mol_id, p.z_num AS second, l.z_num AS last FROM m LEFT JOIN a p ON p.mol_id = m.mol_id AND p.atom_idx = 1 LEFT JOIN a l ON l.mol_id = m.mol_id AND l.atom_idx = n_atoms - 1")  # noqa: E501
def atom_element_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("atomic_numbers")
    return fx.molecules(spark, sf_dir).select("mol_id", geo.at(z, F.lit(1)).alias("second"), geo.at(z, F.lit(-1)).alias("last"))


def _some_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules of which every third lacks the customer and every fourth the status."""
    m = fx.molecules(spark, sf_dir)
    kept = F.when(F.col("mol_id") % 3 == 0, F.array_remove("present", "mp_customer")).otherwise(F.col("present"))
    return m.withColumn("present", kept).withColumn("present", F.when(F.col("mol_id") % 4 == 0, F.array_remove("present", "mp_status")).otherwise(F.col("present")))


_KEYS = "concat_ws(',', CASE WHEN mol_id % 3 <> 0 THEN 'customer' END, CASE WHEN mol_id % 4 <> 0 THEN 'status' END)"


@query(fx.WITH + f"SELECT mol_id, {_KEYS} AS keys, mol_id % 3 <> 0 AS has_customer, false AS has_mass FROM m")
def property_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property stored as null is present."""
    m = _some_keys(spark, sf_dir)
    return m.select("mol_id", F.array_join(model.property_keys(), ",").alias("keys"), model.has_property("customer").alias("has_customer"), model.has_property("mass").alias("has_mass"))  # noqa: E501


@query(fx.WITH + "SELECT mol_id, status <> 'P' AS has_forces FROM m")
def has_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.molecules(spark, sf_dir).select("mol_id", F.array_contains("present", "forces").alias("has_forces"))


@query(fx.WITH + "SELECT mol_id, CASE WHEN mol_id % 4 <> 0 THEN 'status' ELSE '' END AS keys FROM m")
def delete_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model.delete_property(_some_keys(spark, sf_dir), "customer")
    return m.select("mol_id", F.array_join(model.property_keys("molecule"), ",").alias("keys"))


@query(fx.WITH + "SELECT mol_id, CAST(CASE WHEN status <> 'P' THEN custkey END AS DOUBLE) AS customer, CAST(NULL AS DOUBLE) AS status FROM m")
def get_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of either kind as doubles; a text is no number."""
    m = fx.molecules(spark, sf_dir)
    return m.select("mol_id", model.get_scalar(m, "customer").alias("customer"), model.get_scalar(m, "status").alias("status"))


@query(fx.WITH + "SELECT mol_id, atom_idx, charge AS as_float, CAST(NULL AS BIGINT) AS as_int FROM a")
def get_atom_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An atom property asked for by its kind, and by another one."""
    m = model.set_property(fx.molecules(spark, sf_dir), "partial", F.col("charges"), scope="atom")
    m = m.select("mol_id", "atomic_numbers", model.get_atom_property(m, "partial", "float").alias("f"), model.get_atom_property(m, "partial", "int").alias("i"))
    each = m.select("mol_id", "f", "i", F.posexplode("atomic_numbers").alias("atom_idx", "z"))
    return each.select("mol_id", "atom_idx", F.get("f", F.col("atom_idx")).alias("as_float"), F.get("i", F.col("atom_idx")).alias("as_int"))


@query(fx.WITH + "SELECT mol_id, energy / greatest(n_atoms, 1) AS per_atom, status AS got FROM m")
def set_get_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = model.set_property(fx.molecules(spark, sf_dir), "per_atom", F.col("energy") / F.greatest("n_atoms", F.lit(1)))
    return m.select("mol_id", model.get_property(m, "per_atom").alias("per_atom"), model.get_property(m, "status").alias("got"))


@query(fx.WITH + "SELECT mol_id, CAST(x * 2 AS DOUBLE) AS fx, atom_idx FROM a")
def set_forces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replaces a section of all molecules."""
    m = fx.molecules(spark, sf_dir)
    doubled = F.transform("positions", lambda p: F.struct((p["x"] * 2).alias("x"), p["y"].alias("y"), p["z"].alias("z")))
    return model.wide_atoms(model.to_atoms(m.withColumn("forces", doubled), only=("forces",))).select("mol_id", "fx", "atom_idx")


@query(fx.WITH + "SELECT mol_id, atom_idx, x * 3 AS vx, z AS vz, energy AS c0, energy + 8 AS c8, -energy AS s4, status = 'P' AS periodic FROM a JOIN m USING (mol_id)")
def set_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Velocities, cell, stress and periodicity set for all molecules and read again from a store."""
    ranges = fx.id_ranges(spark, sf_dir)
    m = fx.molecules(spark, sf_dir, ranges).drop("present", "mp_customer", "charges", "forces")
    moved = F.transform("positions", lambda p: F.struct((p["x"] * 3).alias("x"), p["y"].alias("y"), p["z"].alias("z")))
    nine = lambda f: F.array(*[f(k) for k in range(9)])
    periodic = F.struct(*[(F.col("mp_status") == "P").alias(k) for k in "abc"])
    m = m.withColumns({"velocities": moved, "cell": nine(lambda k: F.col("energy") + k), "stress": nine(lambda k: F.col("energy") * (k - 5.0)), "pbc": periodic})
    store = Store.create(spark, f"{scratch_dir(spark)}/s", layout="flat")
    store.append(m, order="mol_id", ranges=ranges)
    store.flush()
    rows = Store.open(spark, store.path).molecules()
    rows = rows.withColumns({"c0": F.get("cell", F.lit(0)), "c8": F.get("cell", F.lit(8)), "s4": F.get("stress", F.lit(4)), "periodic": F.col("pbc.b")})
    atoms = model.wide_atoms(model.to_atoms(rows, ("mol_id", "c0", "c8", "s4", "periodic"), only=("velocities",)))
    return atoms.select("mol_id", "atom_idx", "vx", "vz", "c0", "c8", "s4", "periodic")


@query(fx.WITH + "SELECT mol_id, 'Molecule(n_atoms=' || n_atoms || ', energy=' || CAST(energy AS VARCHAR) || ')' AS text FROM m")
def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.molecules(spark, sf_dir)
    return m.select("mol_id", model.describe(m).alias("text"))


# -- geometry -------------------------------------------------------------------------------------------------------

_PAIRS = fx.WITH + ", p AS (SELECT i.mol_id, i.atom_idx AS i, j.atom_idx AS j, sqrt((i.x-j.x)*(i.x-j.x) + (i.y-j.y)*(i.y-j.y) + (i.z-j.z)*(i.z-j.z)) AS d FROM a i JOIN a j ON i.mol_id = j.mol_id AND i.atom_idx < j.atom_idx) "  # noqa: E501


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of atoms inside a molecule, made from its own arrays: no join."""
    m = fx.molecules(spark, sf_dir).select("mol_id", "positions")
    first = m.select("*", F.posexplode("positions").alias("i", "p"))
    later = F.posexplode(F.slice("positions", F.col("i") + 2, F.size("positions"))).alias("k", "q")
    both = first.select("mol_id", "i", "p", later)
    return both.select("mol_id", "i", (F.col("i") + F.col("k") + 1).alias("j"), geo.distance(F.col("p"), F.col("q")).alias("d"))


@query(_PAIRS + "SELECT mol_id, i, j, round(d, 6) AS d FROM p")
def pair_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).withColumn("d", r6("d"))


@query(_PAIRS + "SELECT mol_id, i, round(min(d), 6) AS d FROM (SELECT mol_id, i, d FROM p UNION ALL SELECT mol_id, j, d FROM p) GROUP BY mol_id, i")
def nearest_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    both = F.explode(F.array("i", "j")).alias("i")
    return p.select("mol_id", both, "d").groupBy("mol_id", "i").agg(r6(F.min("d")).alias("d"))


@query("SELECT vec_id AS mol_id, round(CAST(embedding[6] AS DOUBLE), 6) AS xy, round(CAST(embedding[2] AS DOUBLE), 6) AS yy FROM embeddings")
def voigt_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = geo.matrix_of(F.col("voigt"))
    return fx.tensors(spark, sf_dir).select("mol_id", r6(F.get(m, F.lit(1)).cast("double")).alias("xy"), r6(F.get(m, F.lit(4)).cast("double")).alias("yy"))


@query("SELECT vec_id AS mol_id, CAST(i AS INTEGER) AS r, round(CAST(embedding[i * 3 + 1] AS DOUBLE) + CAST(embedding[i * 3 + 2] AS DOUBLE) + CAST(embedding[i * 3 + 3] AS DOUBLE), 5) AS total FROM embeddings, range(3) t(i)")  # noqa: E501
def cell_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.tensors(spark, sf_dir).select("mol_id", F.posexplode(geo.rows_of(geo.as_f64(F.col("cell")), 3)).alias("r", "v"))
    return rows.select("mol_id", "r", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("SELECT CAST(m AS BIGINT) AS mol_id, CAST(a AS INTEGER) AS atom_idx, CAST([8, 1, 14, 6, 26, 7][(m + a) % 6 + 1] AS SMALLINT) AS z_num, round((m * 7 + a * 3) % 101 / 10.0, 6) AS x, round((m * 11 + a * 5) % 103 / 10.0, 6) AS y, round((m * 13 + a * 17) % 107 / 10.0, 6) AS z, CAST(m % 997 AS DOUBLE) / 8 - 160 AS energy FROM range(100) t(m), range(64) u(a)")  # noqa: E501
def synthetic_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = stats.synthetic(spark, 100, 64)
    return made.select("mol_id", "atom_idx", "z_num", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"), "energy")


# -- schema lock ----------------------------------------------------------------------------------------------------

_L = "(VALUES (0, 'energy', 0, false, 8, 8), (1, 'mulliken', 3, true, 8, 8), (2, 'gap', 0, false, 8, 8)) AS {}(kind, key, type_tag, per_atom, elem_bytes, slot_bytes)"
_R = "(VALUES (0, 'energy', 0, false, 8, 8), (2, 'gap', 11, false, 4, 4), (2, 'phase', 2, false, 0, 0)) AS {}(kind, key, type_tag, per_atom, elem_bytes, slot_bytes)"


@query(f"SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'kept' WHEN a.type_tag = b.type_tag AND a.per_atom = b.per_atom AND a.elem_bytes = b.elem_bytes AND a.slot_bytes = b.slot_bytes THEN 'same' ELSE 'conflict' END AS outcome FROM {_L.format('a')} FULL JOIN {_R.format('b')} ON a.kind = b.kind AND a.key = b.key")  # noqa: E501
def schema_merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lock.Entry
    left = lock.lock_frame(spark, {(e.kind, e.key): e for e in (entry(0, "energy", 0, False, 8, 8), entry(1, "mulliken", 3, True, 8, 8), entry(2, "gap", 0, False, 8, 8))})
    right = lock.lock_frame(spark, {(e.kind, e.key): e for e in (entry(0, "energy", 0, False, 8, 8), entry(2, "gap", 11, False, 4, 4), entry(2, "phase", 2, False, 0, 0))})
    return lock.conflicts(left, right)


@query("SELECT CAST(kind AS INTEGER) AS kind, key, CAST(type_tag AS INTEGER) AS type_tag, per_atom, CAST(elem_bytes AS INTEGER) AS elem_bytes, CAST(slot_bytes AS INTEGER) AS slot_bytes FROM (VALUES (0, 'charges', 3, true, 8, 8), (0, 'energy', 0, false, 8, 8), (0, 'forces', 7, true, 24, 24), (0, 'name', 2, false, 0, 0), (0, 'positions', 7, true, 24, 24), (2, 'customer', 1, false, 8, 8), (2, 'status', 2, false, 0, 0)) AS t(kind, key, type_tag, per_atom, elem_bytes, slot_bytes)")  # noqa: E501
def schema_lock_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lock.lock_frame(spark, lock.derive(fx.molecules(spark, sf_dir).schema))


@query("SELECT * FROM (VALUES ('f64 positions', 3), ('plain', 2)) AS t(store, format)")
def record_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lambda key, tag: {(0, key): lock.Entry(0, key, int(tag), True, 0, 0)}
    rows = [("f64 positions", lock.record_format(entry("positions", Tag.VEC3_F64))), ("plain", lock.record_format(entry("positions", Tag.VEC3_F32)))]
    return spark.createDataFrame(rows, "store string, format int")


@query(fx.WITH + "SELECT mol_id, 'charges' AS section, 'length is not the number of atoms' AS reason FROM m WHERE mol_id % 10 = 0 AND n_atoms > 0")
def per_atom_length_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.molecules(spark, sf_dir)
    cut = F.when(F.col("mol_id") % 10 == 0, F.slice("charges", 2, F.size("charges"))).otherwise(F.col("charges"))
    return lock.violations(m.withColumn("charges", cut))


@query("SELECT event_type AS key, CAST(2 AS BIGINT) AS scopes FROM events GROUP BY 1 HAVING count(DISTINCT user_id % 2) = 2")
def scope_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "events")
    return lock.scope_conflicts(e.select((F.col("user_id") % 2 + 1).cast("int").alias("kind"), F.col("event_type").alias("key")))


# -- runs, chunks, statistics, samples ------------------------------------------------------------------------------


@query("WITH s AS (SELECT event_id, event_type, CASE WHEN lag(event_type) OVER (ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS c FROM events), r AS (SELECT event_id, event_type, CAST(sum(c) OVER (ORDER BY event_id) - 1 AS BIGINT) AS run FROM s) SELECT run, any_value(event_type) AS event_type, min(event_id) AS first_id, count(*) AS n FROM r GROUP BY run")  # noqa: E501
def run_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = stats.runs(fx.table(spark, sf_dir, "events"), "event_id", F.col("event_type"))
    return numbered.groupBy("run").agg(F.min("event_type").alias("event_type"), F.min("event_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS c FROM events) SELECT user_id, CAST(sum(c) AS BIGINT) AS runs FROM s GROUP BY user_id")  # noqa: E501
def run_counts_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = stats.runs(fx.table(spark, sf_dir, "events"), "event_id", F.col("event_type"), ["user_id"])
    return numbered.groupBy("user_id").agg((F.max("run") + 1).alias("runs"))


@query("SELECT o_orderkey // 512 AS chunk, count(*) AS n, min(o_orderkey) AS first_id FROM orders GROUP BY 1")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = stats.chunks(fx.table(spark, sf_dir, "orders"), "o_orderkey", 512)
    return cut.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_id"))


@query("WITH q AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, user_id AS mol_id FROM events) SELECT mol_id // 16 AS chunk, count(*) AS n, min(pos) AS first_pos FROM q GROUP BY 1")
def chunk_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read.exclusive_total(fx.table(spark, sf_dir, "events").withColumn("one", F.lit(1)), "event_id", "one", "pos", width=1024)
    grouped = stats.regroup(e.select("pos", F.col("user_id").alias("mol_id")), 16)
    return grouped.select("chunk", "n", F.get("items", F.lit(0))["pos"].alias("first_pos"))


@query("SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type")
def median_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.rate_summary(fx.table(spark, sf_dir, "events"), ["event_type"], "value").select("event_type", r6("median").alias("median"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd, round(CASE WHEN count(value) < 2 THEN 0 ELSE 1.96 * stddev_samp(value) / sqrt(count(value)) END, 6) AS ci95 FROM events GROUP BY event_type")  # noqa: E501
def ci95(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.rate_summary(fx.table(spark, sf_dir, "events"), ["event_type"], "value")
    return s.select("event_type", "n", *[r6(c).alias(c) for c in ("mean", "sd", "ci95")])


_RATES = "(SELECT l_returnflag AS backend, l_linenumber AS workers, sum(l_quantity) AS rate FROM lineitem GROUP BY 1, 2)"


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_returnflag").alias("backend"), F.col("l_linenumber").alias("workers")).agg(F.sum("l_quantity").alias("rate"))


@query(f"WITH r AS {_RATES} SELECT r.backend, r.workers, round(r.rate / b.rate, 6) AS speedup FROM r LEFT JOIN r b ON b.backend = r.backend AND b.workers = 1")
def speedup_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.speedup(_rates(spark, sf_dir), ["backend"], "workers", "rate").select("backend", "workers", r6("speedup").alias("speedup"))


@query("SELECT event_type, first, second, round(first / second, 6) AS ratio FROM (SELECT event_type, max(CASE WHEN r = 1 THEN value END) AS first, max(CASE WHEN r = 2 THEN value END) AS second FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 2 GROUP BY event_type)")  # noqa: E501
def top2_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = stats.top_two_ratio(fx.table(spark, sf_dir, "events"), ["event_type"], "value", "event_id")
    return top.select("event_type", "first", "second", r6("ratio").alias("ratio"))


@query("SELECT p_size FROM (SELECT DISTINCT p_size FROM part) ORDER BY abs(p_size - 64), p_size LIMIT 1")
def nearest_to_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.nearest(fx.table(spark, sf_dir, "part"), "p_size", 64)


@query("SELECT p_size FROM part GROUP BY p_size HAVING count(DISTINCT p_brand) = (SELECT count(DISTINCT p_brand) FROM part)")
def shared_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.shared_by_all(fx.table(spark, sf_dir, "part"), "p_size", "p_brand")


@query(f"WITH r AS {_RATES} SELECT backend, rate FROM r WHERE workers = (SELECT max(workers) FROM r)")
def max_workers_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.at_largest(_rates(spark, sf_dir), "workers").select("backend", "rate")


@query(f"WITH r AS {_RATES} SELECT workers, round(max(CASE WHEN backend = 'N' THEN rate END) / max(CASE WHEN backend = 'A' THEN rate END), 6) AS ratio FROM r GROUP BY workers")
def backend_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ratio_of(_rates(spark, sf_dir), ["workers"], "backend", "rate", "N", "A").select("workers", r6("ratio").alias("ratio"))


@query("SELECT event_type, CAST(row_number() OVER (ORDER BY CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_type) AS INTEGER) AS place FROM (SELECT DISTINCT event_type FROM events)")  # noqa: E501
def ordered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.in_order(fx.table(spark, sf_dir, "events"), "event_type", ["view", "click"])


@query("SELECT l_returnflag AS backend, round(sum(l_quantity) * 64, 6) AS atom_rate, CAST(round(sum(l_quantity)) AS BIGINT) AS shown FROM lineitem GROUP BY 1")
def derived_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("backend")).agg(F.sum("l_quantity").alias("q"))
    return lines.select("backend", r6(F.col("q") * 64).alias("atom_rate"), F.round("q").cast("long").alias("shown"))


@query(fx.WITH + "SELECT round(avg(n_atoms), 6) AS mean FROM (SELECT n_atoms FROM m ORDER BY mol_id LIMIT 200)")
def mean_atoms_of_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.first_k(fx.molecules(spark, sf_dir), "mol_id", 200).agg(r6(F.avg("n_atoms")).alias("mean"))


@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 100")
def sample_first_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.first_k(fx.table(spark, sf_dir, "events"), "event_id", 100).select("event_id", "value")


@query("SELECT event_id, value FROM events ORDER BY md5(event_id || ':7'), event_id LIMIT 100")
def hash_sample_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hash_sample(fx.table(spark, sf_dir, "events"), "event_id", 100, seed=7).select("event_id", "value")


@query("SELECT d AS draw, CAST('0x' || substr(md5(d || ':7'), 1, 15) AS BIGINT) % (SELECT count(*) FROM orders) AS mol_id FROM range(1000) t(d)")
def draws_with_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.draws(fx.table(spark, sf_dir, "orders"), "mol_id", 1000, seed=7)


@query("SELECT event_id, row_number() OVER (ORDER BY md5(event_id || ':3'), event_id) - 1 AS place FROM events")
def permuted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in a shuffled order, with their places in it: numbered two-level over ranges of the digest's first bits."""
    e = stats.permutation(fx.table(spark, sf_dir, "events").select("event_id"), "event_id", seed=3)
    digits = F.conv(F.substring("_order", 1, 4), 16, 10).cast("int")
    inside = Window.partitionBy("_range").orderBy("_order", "event_id")
    ranged = e.withColumn("_range", digits)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 rows at most
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return ranged.withColumn("k", F.row_number().over(inside) - 1).join(starts, "_range").select("event_id", (F.col("first") + F.col("k")).alias("place"))


@query("SELECT user_id AS atoms, least(4096, greatest(1, 1000000 // (user_id * 28 + 200))) AS batch FROM (SELECT DISTINCT user_id FROM events)".replace("least(", "CAST(least(").replace(")) AS batch", ")) AS INTEGER) AS batch"))  # noqa: E501
def recommended_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    atoms = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("atoms")).distinct()
    return atoms.select("atoms", stats.recommended_batch(F.col("atoms"), 1_000_000, 28, 200).alias("batch"))


# -- texts, JSON, interchange ---------------------------------------------------------------------------------------


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


_PATH = "CASE page_id % 4 WHEN 0 THEN ' /./' || url || '//' WHEN 1 THEN url || '/../x' WHEN 2 THEN '/ .' ELSE url END"


@query(f"SELECT page_id, CASE WHEN len(parts) > 0 AND NOT list_contains(parts, '..') THEN array_to_string(parts, '/') END AS normal FROM (SELECT page_id, list_filter(string_split(trim(trim({_PATH}, ' '), '/'), '/'), lambda x: x <> '' AND x <> '.') AS parts FROM pages)")  # noqa: E501
def normal_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths made of the pages' addresses, some with needless parts, some that go up."""
    return fx.table(spark, sf_dir, "pages").select("page_id", geo.normal_path(F.expr(_PATH)).alias("normal"))


_SPEC = "CASE o_orderkey % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'LZ4' WHEN 2 THEN 'zstd' WHEN 3 THEN 'zstd:' || (o_custkey % 22 + 1) WHEN 4 THEN 'gzip' WHEN 5 THEN 'lz4:1' ELSE ' ZSTD:-' || (o_custkey % 5 + 1) END"  # noqa: E501


@query("SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'lz4' WHEN 2 THEN 'zstd' WHEN 3 THEN 'zstd' WHEN 6 THEN 'zstd' END AS codec, CAST(CASE o_orderkey % 7 WHEN 2 THEN 3 WHEN 3 THEN o_custkey % 22 + 1 WHEN 6 THEN -(o_custkey % 5 + 1) END AS INTEGER) AS level FROM orders")  # noqa: E501
def codec_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = fx.table(spark, sf_dir, "orders").select("o_orderkey", geo.codec_of(F.expr(_SPEC)).alias("c"))
    return specs.select("o_orderkey", "c.codec", "c.level")


@query("SELECT conv_id, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS chars, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id")
def ragged_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fx.table(spark, sf_dir, "conversations")
    grouped = model.from_atoms(c, "conv_id", ["turn"], {"role": F.col("role"), "chars": F.char_length("text")})
    total = F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
    return grouped.select("conv_id", F.col("n_atoms").cast("long").alias("n_turns"), total.alias("chars"), F.get("role", F.lit(0)).alias("first_role"))


@query(fx.WITH + "SELECT mol_id, CASE WHEN status = 'P' THEN 'override' ELSE name END AS merged FROM m")
def property_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later sources of a property win: arrays, results, info, overrides."""
    m = fx.molecules(spark, sf_dir)
    low, high = F.create_map(F.lit("tag"), F.col("name")), F.when(F.col("mp_status") == "P", F.create_map(F.lit("tag"), F.lit("override")))
    return m.select("mol_id", bridge.merged_properties(low, high)["tag"].alias("merged"))


@query("SELECT vec_id AS mol_id, label % 2 = 1 AS has_cell FROM embeddings")
def cell_when_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    pbc = F.struct((F.col("label") % 2 == 1).alias("a"), F.lit(False).alias("b"), F.lit(False).alias("c"))
    return fx.tensors(spark, sf_dir).select("mol_id", bridge.periodic_cell(F.col("cell"), pbc).isNotNull().alias("has_cell"))


@query(fx.WITH + "SELECT mol_id, CASE WHEN n_atoms = 4 THEN 'arrays' ELSE 'info' END AS place FROM m")
def export_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = fx.molecules(spark, sf_dir).withColumn("mp_four", F.array(*[F.lit(float(i)) for i in range(4)]))
    return m.select("mol_id", bridge.export_place(m, "four").alias("place"))




# -- stores ---------------------------------------------------------------------------------------------------------


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.molecules(spark, sf_dir).drop("present")


def _middle(rows: DataFrame) -> int:
    """The id that parts the molecules in two halves."""
    return (rows.agg(F.max("mol_id")).first()[0] + 1) // 2


@query("SELECT step, CAST(visible AS INTEGER) AS visible FROM (SELECT 'before flush' AS step, 0 AS visible UNION ALL SELECT 'after flush', count(*) FILTER (o_orderkey < (SELECT (max(o_orderkey) + 1) // 2 FROM orders)) FROM orders UNION ALL SELECT 'second flush', count(*) FROM orders)")  # noqa: E501
def commit_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader sees of all molecules, staged and committed in two halves."""
    rows, path = _plain(spark, sf_dir), f"{scratch_dir(spark)}/s"
    middle = _middle(rows)
    store, steps = Store.create(spark, path), []
    for part, step in ((F.col("mol_id") < middle, "after flush"), (F.col("mol_id") >= middle, "second flush")):
        store.append(rows.where(part))
        if not steps:
            steps.append(("before flush", len(Store.open(spark, path))))
        store.flush()
        steps.append((step, len(Store.open(spark, path))))
    return spark.createDataFrame(steps, "step string, visible int")


@query("SELECT o_orderkey AS mol_id, o_totalprice AS energy FROM orders WHERE o_orderkey < (SELECT (max(o_orderkey) + 1) // 2 FROM orders)")
def generation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All molecules committed in two halves, the second commit damaged: the first half is read."""
    rows, path = _plain(spark, sf_dir), f"{scratch_dir(spark)}/s"
    middle = _middle(rows)
    store = Store.create(spark, path)
    for part in (F.col("mol_id") < middle, F.col("mol_id") >= middle):
        store.append(rows.where(part), order="mol_id")
        store.flush()
    store._files.write(f"_commits/{store.generation:012d}.json", '{"crc": 1, "body": "{}"}')
    return Store.open(spark, path).molecules().select("mol_id", "energy")


@query(fx.WITH + "SELECT codec, m.mol_id, atom_idx, x, charge FROM a JOIN m USING (mol_id), (VALUES ('none'), ('lz4'), ('zstd')) AS c(codec)")
def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of all molecules read back from stores of each codec; made for the first, which the others append as a table."""
    root, out, made, ranges = scratch_dir(spark), None, None, fx.id_ranges(spark, sf_dir)
    for codec in ("none", "lz4", "zstd"):
        store = Store.create(spark, f"{root}/{codec}", codec)
        if made is None:
            store.append(fx.molecules(spark, sf_dir, ranges).drop("present"), order="mol_id", ranges=ranges)
        else:
            store.append_table(made)
        store.flush()
        made = store if made is None else made
        rows = model.wide_atoms(model.to_atoms(Store.open(spark, store.path).molecules(), only=("positions", "charges")))
        rows = rows.select(F.lit(codec).alias("codec"), "mol_id", "atom_idx", "x", "charge")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT row_number() OVER (ORDER BY o_orderkey % 3, o_orderkey) - 1 AS mol_id, CAST(o_orderkey % 3 AS INTEGER) AS shard, o_totalprice AS energy FROM orders")
def shard_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All molecules in three shards, rewritten, read as one dataset."""
    root, rows = scratch_dir(spark), _plain(spark, sf_dir)
    for k in range(3):
        store = Store.create(spark, f"{root}/old/shard-{k}")
        store.append(rows.where(F.col("mol_id") % 3 == k), order="mol_id")
        store.flush()
    rewrite(spark, f"{root}/old", f"{root}/new")
    return ShardReader.open_path(spark, f"{root}/new").molecules().select("mol_id", "shard", "energy")


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS energy FROM orders")
def transferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All molecules in a store that is copied into a repository and read there."""
    root = scratch_dir(spark)
    store = Store.create(spark, f"{root}/mine")
    store.append(_plain(spark, sf_dir))
    store.flush()
    upload(spark, store.path, f"{root}/repository", "sets")
    there = open_repository(spark, f"{root}/repository", "sets").molecules()
    return there.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("energy"), 2).alias("energy"))


@query(fx.WITH + "SELECT m.mol_id, CAST(atom_idx * 3 + c AS INTEGER) AS k, round(CASE c WHEN 0 THEN x WHEN 1 THEN y ELSE z END, 6) AS place, z_num AS number, energy FROM m JOIN a USING (mol_id), range(3) t(c)")  # noqa: E501
def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Molecules as the plain columns from which objects are made: flat vectors, numbers, results."""
    p = bridge.payload_columns(fx.molecules(spark, sf_dir))
    each = p.select("mol_id", "numbers", "energy", F.posexplode("positions").alias("k", "place"))
    return each.select("mol_id", "k", r6("place").alias("place"), F.get("numbers", F.floor(F.col("k") / 3).cast("int")).alias("number"), "energy")


@query("SELECT m AS mol_id, CAST(a AS INTEGER) AS atom_idx, CAST([6, 8][a + 1] AS SMALLINT) AS z_num, CAST(m + a * 0.5 AS DOUBLE) AS x, CAST(m * 2 AS DOUBLE) AS gap FROM range(50) t(m), range(2) u(a)")  # noqa: E501
def batch_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked arrays as rows: single-precision positions, a property widened to 64 bits."""
    import numpy as np

    n = 50
    p = np.zeros((n, 2, 3), np.float32)
    p[:, :, 0] = np.arange(n)[:, None] + np.array([0, 0.5])
    z = np.tile(np.array([6, 8], np.uint8), (n, 1))
    rows = arrays_batch(spark, p, z, energy=np.arange(n, dtype=float), properties={"gap": np.arange(n, dtype=np.float32) * 2})
    rows = rows.withColumn("mol_id", F.col("energy").cast("long"))
    atoms = model.wide_atoms(model.to_atoms(rows, ("mol_id", "mp_gap"), only=("positions",)))
    return atoms.select("mol_id", "atom_idx", "z_num", F.col("x").cast("double").alias("x"), F.col("mp_gap").alias("gap"))


@query(fx.WITH + "SELECT mol_id, atom_idx, charge FROM a")
def payload_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charges of all molecules as bytes and back."""
    m = fx.molecules(spark, sf_dir).select("mol_id", payload.encoded(F.col("charges"), Tag.F64_ARRAY).alias("bytes"))
    back = m.select("mol_id", F.posexplode(payload.decoded(F.col("bytes"), Tag.F64_ARRAY)).alias("atom_idx", "charge"))
    return back.select("mol_id", "atom_idx", "charge")


@query(fx.WITH + "SELECT mol_id, n_atoms, CAST(13 * n_atoms AS INTEGER) AS bytes FROM m")
def raw_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the raw records of all molecules."""
    raw = payload.raw_records(fx.molecules(spark, sf_dir))
    return raw.select("mol_id", "n_atoms", F.octet_length("raw").alias("bytes"))


# -- report rows ----------------------------------------------------------------------------------------------------


@query("SELECT vec_id AS mol_id, round(CAST(embedding[(vec_id * 7) % 64 + 1] AS DOUBLE), 6) AS value FROM embeddings")
def touched_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fx.table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("mol_id"), r6(stats.touched(F.col("embedding"), F.col("vec_id") * 7).cast("double")).alias("value"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_custkey % 5 > 0 THEN round(o_totalprice * 10 / (o_custkey % 5)) ELSE o_totalprice END AS BIGINT) AS size FROM (SELECT o_orderkey, o_custkey, floor(o_totalprice) AS o_totalprice FROM orders)")  # noqa: E501
def normalised_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders").withColumn("size", F.floor("o_totalprice"))
    return o.select("o_orderkey", stats.normalised_size(F.col("size"), F.lit(10), F.col("o_custkey") % 5).alias("size"))


@query("SELECT event_type, key, value FROM (SELECT event_type, 'rss' AS key, CAST(max(user_id) - min(user_id) AS BIGINT) AS value FROM events GROUP BY 1 UNION ALL SELECT event_type, 'new', CAST(count(*) AS BIGINT) FROM events GROUP BY 1)")  # noqa: E501
def memory_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of two maps of readings; a key that only the later one has counts from 0."""
    e = fx.table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("user_id").alias("a"), F.max("user_id").alias("b"), F.count(F.lit(1)).alias("n"))
    delta = stats.map_delta(F.create_map(F.lit("rss"), F.col("a")), F.create_map(F.lit("rss"), F.col("b"), F.lit("new"), F.col("n")))
    return e.select("event_type", F.explode(delta).alias("key", "value"))


@query("SELECT l_returnflag AS backend, l_linenumber AS workers, CASE WHEN l_linenumber % 2 = 0 THEN 'zstd' ELSE 'none' END AS codec, CAST(coalesce(CASE WHEN l_linenumber % 3 = 0 THEN count(*) END, 3) AS BIGINT) AS trials FROM lineitem GROUP BY 1, 2")  # noqa: E501
def normalised_result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of results with gaps, filled from defaults."""
    raw = fx.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("backend"), F.col("l_linenumber").alias("workers")).agg(
        F.when(F.col("workers") % 2 == 0, "zstd").alias("codec"), F.when(F.col("workers") % 3 == 0, F.count(F.lit(1))).alias("trials")
    )
    return stats.normalised_rows(raw, ["backend", "workers"], {"codec": "none", "trials": 3})


_RESULT = "CASE event_id % 5 WHEN 0 THEN '{\"reads\": [' || event_id || '], \"meta\": 1}' WHEN 1 THEN '{\"memory\": ' || event_id || '}' WHEN 2 THEN '[1]' WHEN 3 THEN '{\"reads\": [], \"memory\": 0}' ELSE '{}' END"  # noqa: E501


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'read' WHEN 1 THEN 'memory' WHEN 3 THEN 'memory' END AS kind FROM events")
def result_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "events")
    return docs.select("event_id", stats.result_kind(F.expr(_RESULT), {"read": ["reads", "meta"], "memory": ["memory"]}).alias("kind"))


@query("SELECT count(*) AS found, CAST(25 AS BIGINT) AS expected, count(*) = 25 AS complete FROM nation")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.complete(fx.table(spark, sf_dir, "nation"), 25)


@query(fx.WITH + "SELECT m.mol_id, count(*) AS n, round(avg(x), 6) AS mean_x, CAST(max(z_num) AS INTEGER) AS top_z FROM m JOIN a USING (mol_id) WHERE energy > 200000 GROUP BY m.mol_id")  # noqa: E501
def sql_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value predicate, a join and an aggregate in SQL over the registered views."""
    register(fx.molecules(spark, sf_dir), "fixture_")
    return spark.sql(
        "SELECT mol_id, count(*) AS n, round(avg(x), 6) AS mean_x, CAST(max(z_num) AS INT) AS top_z "
        "FROM fixture_molecules JOIN fixture_atoms USING (mol_id) WHERE energy > 200000 GROUP BY mol_id"
    )


@query(fx.WITH + "SELECT mol_id, name, round(energy, 2) AS energy FROM m WHERE energy BETWEEN 100000 AND 150000 AND name LIKE '1%'")
def value_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters on values; they and the columns reach the scan."""
    m = fx.molecules(spark, sf_dir).where("energy between 100000 and 150000 and name like '1%'")
    return m.select("mol_id", "name", F.round("energy", 2).alias("energy"))
