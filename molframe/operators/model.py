"""Molecules and atoms as DataFrames: builders, their inverses, getters, setters and properties.

``molecules`` has one row per molecule, its atoms in parallel arrays; ``atoms`` one row per atom. Custom properties are
typed columns: ``mp_<key>`` for the molecule, ``ap_<key>`` for its atoms. ``present`` lists the stored sections, which
tells an absent value from one stored as null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sections with a value per atom, and one per molecule, besides the two that every molecule has.
PER_ATOM = ("forces", "charges", "velocities")
PER_MOLECULE = ("energy", "cell", "stress", "pbc", "name")
BUILTINS = ("positions", "atomic_numbers", *PER_ATOM, *PER_MOLECULE)
#: Keys that custom properties may not take.
RESERVED = ("stress",)
SCOPES = {"molecule": "mp_", "atom": "ap_"}


class RecordError(ValueError):
    """A molecule, property or scope that breaks the model."""


def atom_columns(molecules: DataFrame) -> list[str]:
    """Columns of ``molecules`` that have one entry per atom."""
    return [c for c in molecules.columns if c in ("positions", "atomic_numbers", *PER_ATOM) or c.startswith("ap_")]


def from_atoms(
    atoms: DataFrame, key: str | list[str], order: list[str], fields: dict[str, Column | Callable[[Callable[[str], Column]], Column]]
) -> DataFrame:
    """Gathers atom rows into molecules: ``key`` (one column or more), ``n_atoms`` and one array per field, in ``order``.

    A field is a column of the atoms or, where the columns of ``order`` suffice to make it, a function of these by name:
    it is made when the rows are gathered, and takes no room on the way there.
    """
    keys = [key] if isinstance(key, str) else key
    columns = {k: v for k, v in fields.items() if isinstance(v, Column)}
    entry = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[v.alias(k) for k, v in columns.items()])

    def made(field) -> Column:
        return F.transform("_rows", lambda row: field(lambda c: row[f"_o{order.index(c)}"]))

    grouped = atoms.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_rows"))
    return grouped.select(*keys, F.size("_rows").alias("n_atoms"), *[(F.col(f"_rows.{k}") if k in columns else made(v)).alias(k) for k, v in fields.items()])


def to_atoms(molecules: DataFrame, keep: Iterable[str] = ("mol_id",), only: Iterable[str] | None = None) -> DataFrame:
    """One row per atom: ``keep``, ``atom_idx`` (from 0) and the entries of the per-atom columns.

    A section that is null stays null for every atom; a molecule without atoms gives no rows.
    """
    columns = [c for c in atom_columns(molecules) if c != "atomic_numbers" and (only is None or c in only)]
    # only the numbers are exploded; the other arrays are read by place, which keeps the whole step in generated code
    each = molecules.select(*keep, *columns, F.posexplode("atomic_numbers").alias("atom_idx", "_z"))
    entries = [F.get(c, F.col("atom_idx")).alias(c) for c in columns]
    return each.select(*keep, "atom_idx", *entries, F.col("_z").alias("atomic_numbers"))


#: Scalar columns of a vector section start with this.
WIDE = {"positions": "", "forces": "f", "velocities": "v"}


def plain_atoms(plain: DataFrame, keep: Iterable[str] = ("mol_id",)) -> DataFrame:
    """``wide_atoms`` of molecules whose vectors are flat arrays: numbers are read by place, no vector is made.

    Other per-atom columns (charges, ``ap_`` arrays as long as the molecule) follow under their names.
    """
    sections = [c for c in atom_columns(plain) if c != "atomic_numbers"]
    each = plain.select(*keep, "n_atoms", *sections, F.posexplode("atomic_numbers").alias("atom_idx", "_z"))
    out = [*keep, "atom_idx"]
    for c in sections:
        if c in WIDE:
            out += [F.get(c, F.col("atom_idx") * 3 + k).alias(WIDE[c] + n) for k, n in enumerate("xyz")]
        else:
            out.append(F.when(F.size(c) == F.col("n_atoms"), F.get(c, F.col("atom_idx"))).alias("charge" if c == "charges" else c))
    return each.select(*out, F.col("_z").alias("z_num"))


def wide_atoms(atoms: DataFrame) -> DataFrame:
    """Splits vectors into scalar columns: x, y, z; fx, fy, fz; vx, vy, vz; z_num; charge."""
    out = []
    for c in atoms.columns:
        if c in WIDE:
            out += [F.col(f"{c}.{k}").alias(WIDE[c] + k) for k in "xyz"]
        else:
            out.append(F.col(c).alias({"atomic_numbers": "z_num", "charges": "charge"}.get(c, c)))
    return atoms.select(*out)


def lengths_agree(molecules: DataFrame) -> Column:
    """Whether every per-atom column of a row is null or as long as the molecule has atoms."""
    ok = F.lit(True)
    for c in atom_columns(molecules):
        ok &= F.coalesce(F.size(F.col(c)) == F.size("atomic_numbers"), F.col(c).isNull())
    return ok


def checked(molecules: DataFrame) -> DataFrame:
    """``molecules``; a row whose arrays disagree in length stops the job."""
    message = F.concat(F.lit("atom arrays of unequal length in molecule "), F.col("mol_id").cast("string"))
    return molecules.withColumn("mol_id", F.when(lengths_agree(molecules), F.col("mol_id")).otherwise(F.raise_error(message)))


def with_default(molecules: DataFrame, section: str) -> DataFrame:
    """Gives ``section`` (forces, velocities or charges) zeros where it is absent, as a change in place would find it."""
    if section not in PER_ATOM:
        raise RecordError(f"no default for {section}")
    kind = dict(molecules.dtypes)[section]
    zero = F.lit(0.0) if section == "charges" else F.struct(*[F.lit(0.0).alias(c) for c in "xyz"])
    return molecules.withColumn(section, F.coalesce(section, F.array_repeat(zero, F.size("atomic_numbers")).cast(kind)))


def _scope_of(molecules: DataFrame, key: str) -> str | None:
    return next((s for s, p in SCOPES.items() if p + key in molecules.columns), None)


def get_property(molecules: DataFrame, key: str) -> Column:
    """Column of a custom property in whichever scope has it; a key that no column has is a ``KeyError``."""
    scope = _scope_of(molecules, key)
    if scope is None:
        raise KeyError(key)
    return F.col(SCOPES[scope] + key)


#: Types that a getter of one kind accepts.
KINDS = {
    "scalar": ("double", "float", "bigint", "int"),
    "float": ("array<double>", "array<float>"),
    "int": ("array<bigint>", "array<int>"),
    "vec3": ("array<struct<x:double,y:double,z:double>>", "array<struct<x:float,y:float,z:float>>"),
}


def get_scalar(molecules: DataFrame, key: str) -> Column:
    """A number of the molecule, integer or floating, as a double; null where the property is of another type or absent."""
    column = SCOPES["molecule"] + key
    fits = dict(molecules.dtypes).get(column) in KINDS["scalar"]
    return (F.col(column) if fits else F.lit(None)).cast("double")


def get_atom_property(molecules: DataFrame, key: str, kind: str) -> Column:
    """An atom property if it is of the ``kind`` float, int or vec3; null where it is of another type or absent."""
    column = SCOPES["atom"] + key
    found = dict(molecules.dtypes).get(column)
    return F.col(column) if found in KINDS[kind] else F.lit(None).cast(KINDS[kind][0])


def set_property(molecules: DataFrame, key: str, value: Column, scope: str = "molecule") -> DataFrame:
    """Adds or replaces a property. A key lives in one scope only, reserved keys are refused, atom values are checked."""
    if scope not in SCOPES:
        raise RecordError(f"unknown scope {scope!r}")
    if key in RESERVED:
        raise RecordError(f"{key!r} is reserved")
    if _scope_of(molecules, key) not in (None, scope):
        raise RecordError(f"{key!r} already lives in the other scope")
    column = SCOPES[scope] + key
    if scope == "atom":
        fits = value.isNull() | (F.size(value) == F.size("atomic_numbers"))
        value = F.when(fits, value).otherwise(F.raise_error(F.lit(f"wrong length of atom property {key}")))
    out = molecules.withColumn(column, value)
    if "present" in molecules.columns:
        out = out.withColumn("present", F.array_sort(F.array_union("present", F.array(F.lit(column)))))
    return out


def delete_property(molecules: DataFrame, key: str) -> DataFrame:
    """Drops a property from all rows; an unknown key is a ``KeyError``."""
    scope = _scope_of(molecules, key)
    if scope is None:
        raise KeyError(key)
    out = molecules.drop(SCOPES[scope] + key)
    if "present" in molecules.columns:
        out = out.withColumn("present", F.array_remove("present", SCOPES[scope] + key))
    return out


def property_keys(scope: str | None = None) -> Column:
    """Sorted keys of the custom properties stored in a row."""
    prefixes = [SCOPES[scope]] if scope else list(SCOPES.values())
    keys = F.filter("present", lambda k: F.substring(k, 1, 3).isin(prefixes))
    return F.array_sort(F.transform(keys, lambda k: F.substr(k, F.lit(4))))


def has_property(key: str, scope: str | None = None) -> Column:
    """Whether a row stores the property, be it as null."""
    prefixes = [SCOPES[scope]] if scope else list(SCOPES.values())
    return F.arrays_overlap("present", F.array(*[F.lit(p + key) for p in prefixes]))


def describe(molecules: DataFrame) -> Column:
    """Short text of a molecule."""
    return F.format_string("Molecule(n_atoms=%d, energy=%s)", F.size("atomic_numbers"), F.coalesce(F.col("energy").cast("string"), F.lit("None")))
