"""The schema lock: what every section of a dataset looks like, merged strictly and only by addition.

A lock is derived from a DataFrame's schema and settled on the driver; it is as large as the schema. ``lock_frame`` and
``conflicts`` are the same as data, for reports and for locks that come from elsewhere.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from molframe.functions.geometry import tensor_ok
from molframe.functions.values import TENSORS, TYPES, Tag, tag_of

from .model import PER_ATOM, SCOPES

#: Kinds of sections.
BUILTIN, ATOM_PROPERTY, MOLECULE_PROPERTY = 0, 1, 2
#: Type tags of built-in sections in the older of the two record formats; any other needs the newer one.
FORMAT_2 = {
    "positions": Tag.VEC3_F32, "forces": Tag.VEC3_F32, "velocities": Tag.VEC3_F32, "charges": Tag.F64_ARRAY,
    "cell": Tag.MAT3_F64, "energy": Tag.F64, "stress": Tag.MAT3_F64, "pbc": Tag.BOOL3, "name": Tag.STRING,
}
#: Bookkeeping columns that are no sections.
IGNORED = ("mol_id", "shard", "local_idx", "n_atoms", "present", "atomic_numbers")


class LockError(ValueError):
    """A record or batch that does not fit the dataset's lock."""


@dataclass(frozen=True, order=True)
class Entry:
    kind: int
    key: str
    type_tag: int
    per_atom: bool
    elem_bytes: int
    slot_bytes: int  # bytes per molecule, or per atom; 0 if it varies


Lock = dict[tuple[int, str], Entry]


def _entry(column: str, kind: T.DataType, lengths: dict[str, int]) -> Entry:
    scope = ATOM_PROPERTY if column.startswith("ap_") else MOLECULE_PROPERTY if column.startswith("mp_") else BUILTIN
    key = column[3:] if scope != BUILTIN else column
    tag = Tag.NULL if isinstance(kind, T.NullType) else tag_of(kind, 9 if column in ("cell", "stress") else None)
    per_atom = scope == ATOM_PROPERTY or scope == BUILTIN and key in (*PER_ATOM, "positions")
    elem = TYPES[tag].elem_bytes
    if tag in TENSORS or tag in (Tag.STRING, Tag.NULL):
        slot = 0
    elif per_atom or not isinstance(TYPES[tag].spark, T.ArrayType) or tag in (Tag.MAT3_F64, Tag.MAT3_F32):
        slot = elem
    else:
        slot = elem * lengths.get(column, 0)
    return Entry(scope, key, int(tag), per_atom, elem, slot)


def derive(schema: T.StructType, lengths: dict[str, int] | None = None) -> Lock:
    """Lock of a schema; ``lengths`` has the common length of molecule-scope arrays, which is part of the lock.

    A key in both scopes is a conflict.
    """
    found = [_entry(f.name, f.dataType, lengths or {}) for f in schema.fields if f.name not in IGNORED]
    both = {e.key for e in found if e.kind == ATOM_PROPERTY} & {e.key for e in found if e.kind == MOLECULE_PROPERTY}
    if both:
        raise LockError(f"keys in both scopes: {sorted(both)}")
    return {(e.kind, e.key): e for e in found}


def merge(lock: Lock, new: Lock) -> Lock:
    """``lock`` with the sections that only ``new`` has; a section that differs in anything is a conflict.

    Length 0 is that of a column without values, which fits any.
    """
    out = dict(lock)
    for at, entry in new.items():
        known = out.get(at)
        if known is None or known.slot_bytes == 0 and _but_length(known) == _but_length(entry):
            out[at] = entry
        elif known != entry and not (entry.slot_bytes == 0 and _but_length(known) == _but_length(entry)):
            raise LockError(f"section {at[1]!r} is locked to {known}, not {entry}")
    scopes: dict[str, int] = {}
    for kind, key in out:
        if kind != BUILTIN and scopes.setdefault(key, kind) != kind:
            raise LockError(f"key {key!r} already lives in the other scope")
    return out


def _but_length(e: Entry) -> tuple:
    return e.kind, e.key, e.type_tag, e.per_atom, e.elem_bytes


def record_format(lock: Lock) -> int:
    """2 if every built-in section has the older format's type, else 3; custom tensors and floats of any kind are in both."""
    return 2 if all(FORMAT_2.get(e.key, e.type_tag) == e.type_tag for e in lock.values() if e.kind == BUILTIN) else 3


def to_json(lock: Lock) -> str:
    return json.dumps([asdict(e) for e in sorted(lock.values())])


def from_json(text: str) -> Lock:
    return {(e.kind, e.key): e for e in (Entry(**x) for x in json.loads(text))}


def lock_frame(spark: SparkSession, lock: Lock) -> DataFrame:
    schema = "kind int, key string, type_tag int, per_atom boolean, elem_bytes int, slot_bytes int"
    return spark.createDataFrame([tuple(asdict(e).values()) for e in sorted(lock.values())], schema)


def conflicts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(kind, key, outcome) of merging two locks given as data: ``same``, ``added``, ``kept`` or ``conflict``."""
    a, b = left.alias("a"), right.alias("b")
    names = ("type_tag", "per_atom", "elem_bytes", "slot_bytes")
    same = F.lit(True)
    for n in names:
        same &= F.col(f"a.{n}") == F.col(f"b.{n}")
    outcome = (
        F.when(F.col("a.key").isNull(), "added").when(F.col("b.key").isNull(), "kept").when(same, "same").otherwise("conflict")
    )
    joined = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.key") == F.col("b.key")), "full")
    return joined.select(F.coalesce("a.kind", "b.kind").alias("kind"), F.coalesce("a.key", "b.key").alias("key"), outcome.alias("outcome"))


def array_lengths(molecules: DataFrame) -> dict[str, int]:
    """Common length of every molecule-scope array; arrays of one column that differ in length are a conflict.

    One pass that returns one row.
    """
    columns = [
        f.name for f in molecules.schema.fields
        if f.name.startswith("mp_") and isinstance(f.dataType, T.ArrayType)
    ]
    if not columns:
        return {}
    sizes = [x for c in columns for x in (F.min(F.size(c).cast("int")).alias(f"a_{c}"), F.max(F.size(c)).alias(f"b_{c}"))]
    row = molecules.agg(*sizes).first()
    for c in columns:
        if row[f"a_{c}"] != row[f"b_{c}"]:
            raise LockError(f"arrays of property {c[3:]!r} differ in length")
    return {c: row[f"a_{c}"] or 0 for c in columns}


def violations(molecules: DataFrame) -> DataFrame:
    """(mol_id, section, reason) for rows whose per-atom sections or tensors have a wrong length."""
    n = F.size("atomic_numbers")
    tests: list[Column] = []

    def test(name: str, bad: Column, reason: str) -> None:
        tests.append(F.when(bad, F.struct(F.lit(name).alias("section"), F.lit(reason).alias("reason"))))

    for f in molecules.schema.fields:
        column = F.col(f.name)
        tensor = isinstance(f.dataType, T.StructType) and f.dataType.names == ["shape", "data"]
        if tensor:
            test(f.name, ~tensor_ok(column), "shape and data disagree")
            if f.name.startswith("ap_"):
                test(f.name, F.get(column["shape"], F.lit(0)) != n, "first length is not the number of atoms")
        elif f.name.startswith("ap_") or f.name in (*PER_ATOM, "positions"):
            test(f.name, F.size(column) != n, "length is not the number of atoms")
    found = F.filter(F.array(*tests), lambda x: x.isNotNull()) if tests else F.array()
    return molecules.select("mol_id", F.explode(found).alias("v")).select("mol_id", "v.section", "v.reason")


def scope_conflicts(keys: DataFrame) -> DataFrame:
    """Keys of rows (``kind, key``) that live in both property scopes."""
    return keys.where(F.col("kind") != BUILTIN).groupBy("key").agg(F.count_distinct("kind").alias("scopes")).where("scopes > 1")
