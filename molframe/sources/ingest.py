"""Rows from stacked numpy arrays, one entry per molecule along the first axis, through Arrow without Python rows."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from molframe.operators.model import RESERVED, RecordError


def _list(values: pa.Array, n: int, each: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * each), values)


def _vectors(a: np.ndarray) -> pa.Array:
    """(molecules, atoms, 3) as lists of (x, y, z)."""
    flat = np.ascontiguousarray(a.reshape(-1, 3))
    return _list(pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], list("xyz")), a.shape[0], a.shape[1])


def _tensors(a: np.ndarray) -> pa.Array:
    n, shape = a.shape[0], a.shape[1:]
    size = int(np.prod(shape))
    shapes = _list(pa.array(np.tile(np.asarray(shape, np.int32), n)), n, len(shape))
    return pa.StructArray.from_arrays([shapes, _list(pa.array(np.ascontiguousarray(a).ravel()), n, size)], ["shape", "data"])


def _expect(name: str, a: Any, shape: tuple[int, ...], kinds: str = "f") -> np.ndarray:
    a = np.asarray(a)
    if a.shape != shape:
        raise RecordError(f"{name} must have shape {shape}, not {a.shape}")
    if a.dtype.kind not in kinds or a.dtype.itemsize not in (1, 2, 4, 8):
        raise RecordError(f"{name} has unsupported type {a.dtype}")
    return a


def _custom(key: str, value: Any, n: int) -> pa.Array:
    """A molecule-scope column: strings, scalars (widened to 64 bits), arrays, vectors or tensors (as they are)."""
    if isinstance(value, (list, tuple)):
        if len(value) == n and all(isinstance(v, str) for v in value):
            return pa.array(list(value), pa.string())
        raise RecordError(f"property {key!r}: lists other than of strings are refused, stack them as an array")
    a = np.asarray(value)
    if a.ndim == 0 or a.shape[0] != n:
        raise RecordError(f"property {key!r} must have one entry per molecule")
    if a.dtype.kind == "U":
        return pa.array(a.tolist(), pa.string())
    if a.dtype.kind == "b":
        a = a.astype(np.int64)
    if a.dtype.str[1:] not in ("f4", "f8", "i4", "i8"):
        raise RecordError(f"property {key!r} has unsupported type {a.dtype}")
    if a.ndim == 1:
        return pa.array(a.astype(np.float64 if a.dtype.kind == "f" else np.int64))
    if a.ndim == 2:
        return _list(pa.array(np.ascontiguousarray(a).ravel()), n, a.shape[1])
    if a.ndim == 3 and a.shape[2] == 3 and a.dtype.kind == "f":
        return _vectors(a)
    return _tensors(a)


def _atom_custom(key: str, value: Any, n: int, atoms: int) -> pa.Array:
    a = np.asarray(value)
    if isinstance(value, (list, tuple)) or a.ndim < 2 or a.shape[:2] != (n, atoms):
        raise RecordError(f"atom property {key!r} must be an array of shape ({n}, {atoms}, ...)")
    if a.dtype.str[1:] not in ("f4", "f8", "i4", "i8"):
        raise RecordError(f"atom property {key!r} has unsupported type {a.dtype}")
    if a.ndim == 2:
        return _list(pa.array(np.ascontiguousarray(a).ravel()), n, atoms)
    if a.ndim == 3 and a.shape[2] == 3 and a.dtype.kind == "f":
        return _vectors(a)
    return _tensors(a)


def arrays_table(
    positions: Any, atomic_numbers: Any, *, energy: Any = None, forces: Any = None, charges: Any = None, velocities: Any = None,
    cell: Any = None, stress: Any = None, pbc: Any = None, name: Any = None, properties: Mapping[str, Any] | None = None,
    atom_properties: Mapping[str, Any] | None = None,
) -> pa.Table:
    """Arrow table of stacked molecules of one size; types of built-in sections stay what they are."""
    p = np.asarray(positions)
    if p.ndim != 3 or p.shape[2] != 3:
        raise RecordError(f"positions must have shape (molecules, atoms, 3), not {p.shape}")
    n, atoms = p.shape[:2]
    z = _expect("atomic_numbers", atomic_numbers, (n, atoms), "iu")
    if z.size and (z.min() < 0 or z.max() > 255):
        raise RecordError("atomic numbers are 0 to 255")
    out = {"positions": _vectors(_expect("positions", p, p.shape)), "atomic_numbers": _list(pa.array(z.astype(np.int16).ravel()), n, atoms)}
    if energy is not None:
        out["energy"] = pa.array(_expect("energy", energy, (n,)))
    for key, v in (("forces", forces), ("velocities", velocities)):
        if v is not None:
            out[key] = _vectors(_expect(key, v, (n, atoms, 3)))
    if charges is not None:
        out["charges"] = _list(pa.array(np.ascontiguousarray(_expect("charges", charges, (n, atoms))).ravel()), n, atoms)
    for key, v in (("cell", cell), ("stress", stress)):
        if v is not None:
            out[key] = _list(pa.array(np.ascontiguousarray(_expect(key, v, (n, 3, 3))).ravel()), n, 9)
    if pbc is not None:
        b = _expect("pbc", pbc, (n, 3), "b")
        out["pbc"] = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(b[:, i])) for i in range(3)], list("abc"))
    if name is not None:
        if len(name) != n or not all(isinstance(x, str) for x in name):
            raise RecordError("name must be one text per molecule")
        out["name"] = pa.array(list(name), pa.string())
    both = set(properties or {}) & set(atom_properties or {})
    if both:
        raise RecordError(f"keys in both scopes: {sorted(both)}")
    for key, v in (properties or {}).items():
        if key in RESERVED:
            raise RecordError(f"{key!r} is reserved")
        out[f"mp_{key}"] = _custom(key, v, n)
    for key, v in (atom_properties or {}).items():
        if key in RESERVED:
            raise RecordError(f"{key!r} is reserved")
        out[f"ap_{key}"] = _atom_custom(key, v, n, atoms)
    present = sorted(k for k in out if k not in ("positions", "atomic_numbers"))
    out["present"] = _list(pa.array(present * n, pa.string()), n, len(present))
    return pa.table(out)


def arrays_batch(spark: SparkSession, positions: Any, atomic_numbers: Any, **sections: Any) -> DataFrame:
    """``arrays_table`` as a DataFrame, in the order of the first axis."""
    return spark.createDataFrame(arrays_table(positions, atomic_numbers, **sections))
