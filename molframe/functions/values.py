"""Value types of records: tags, Spark types, and how Python and numpy values are classified."""

from __future__ import annotations

from dataclasses import dataclass
from enum import IntEnum
from typing import Any

import numpy as np
from pyspark.sql import types as T


class Tag(IntEnum):
    """The type tags of stored values."""

    F64 = 0
    I64 = 1
    STRING = 2
    F64_ARRAY = 3
    VEC3_F32 = 4
    I64_ARRAY = 5
    F32_ARRAY = 6
    VEC3_F64 = 7
    I32_ARRAY = 8
    BOOL3 = 9
    MAT3_F64 = 10
    F32 = 11
    MAT3_F32 = 12
    NULL = 13
    TENSOR_F32 = 14
    TENSOR_F64 = 15
    TENSOR_I32 = 16
    TENSOR_I64 = 17


def _vec3(kind: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(c, kind) for c in "xyz"]))


def _tensor(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(kind))])


@dataclass(frozen=True)
class TypeInfo:
    tag: Tag
    spark: T.DataType
    elem_bytes: int  # bytes of one element; 0 if it varies


_F, _D, _I, _L = T.FloatType(), T.DoubleType(), T.IntegerType(), T.LongType()
PBC = T.StructType([T.StructField(c, T.BooleanType()) for c in "abc"])

#: 3x3 matrices are arrays of nine, row by row; the lock, not the Spark type, tells them from other arrays.
TYPES: dict[Tag, TypeInfo] = {
    t.tag: t
    for t in (
        TypeInfo(Tag.F64, _D, 8),
        TypeInfo(Tag.I64, _L, 8),
        TypeInfo(Tag.STRING, T.StringType(), 0),
        TypeInfo(Tag.F64_ARRAY, T.ArrayType(_D), 8),
        TypeInfo(Tag.VEC3_F32, _vec3(_F), 12),
        TypeInfo(Tag.I64_ARRAY, T.ArrayType(_L), 8),
        TypeInfo(Tag.F32_ARRAY, T.ArrayType(_F), 4),
        TypeInfo(Tag.VEC3_F64, _vec3(_D), 24),
        TypeInfo(Tag.I32_ARRAY, T.ArrayType(_I), 4),
        TypeInfo(Tag.BOOL3, PBC, 3),
        TypeInfo(Tag.MAT3_F64, T.ArrayType(_D), 72),
        TypeInfo(Tag.F32, _F, 4),
        TypeInfo(Tag.MAT3_F32, T.ArrayType(_F), 36),
        TypeInfo(Tag.NULL, T.NullType(), 0),
        TypeInfo(Tag.TENSOR_F32, _tensor(_F), 4),
        TypeInfo(Tag.TENSOR_F64, _tensor(_D), 8),
        TypeInfo(Tag.TENSOR_I32, _tensor(_I), 4),
        TypeInfo(Tag.TENSOR_I64, _tensor(_L), 8),
    )
}

TENSORS = (Tag.TENSOR_F32, Tag.TENSOR_F64, Tag.TENSOR_I32, Tag.TENSOR_I64)
_ONE_D = {"f4": Tag.F32_ARRAY, "f8": Tag.F64_ARRAY, "i4": Tag.I32_ARRAY, "i8": Tag.I64_ARRAY}
_N_D = {"f4": Tag.TENSOR_F32, "f8": Tag.TENSOR_F64, "i4": Tag.TENSOR_I32, "i8": Tag.TENSOR_I64}


def classify(value: Any) -> Tag:
    """Tag of a property value: none, integers (booleans too) before floats, strings, then arrays by shape and dtype."""
    if value is None:
        return Tag.NULL
    if isinstance(value, (bool, int, np.bool_, np.integer)):
        return Tag.I64
    if isinstance(value, (float, np.floating)):
        return Tag.F64
    if isinstance(value, str):
        return Tag.STRING
    if isinstance(value, np.ndarray):
        code = value.dtype.str[1:]
        if value.ndim == 1 and code in _ONE_D:
            return _ONE_D[code]
        if value.ndim == 2 and value.shape[1] == 3 and code in ("f4", "f8"):
            return Tag.VEC3_F32 if code == "f4" else Tag.VEC3_F64
        if value.ndim >= 2 and code in _N_D:
            return _N_D[code]
    raise TypeError(f"unsupported property value: {type(value).__name__} {getattr(value, 'dtype', '')}".strip())


def to_cell(value: Any, tag: Tag) -> Any:
    """The value in the form that ``TYPES[tag].spark`` takes."""
    if value is None:
        return None
    if tag in TENSORS:
        return {"shape": list(value.shape), "data": value.ravel().tolist()}
    if tag in (Tag.VEC3_F32, Tag.VEC3_F64):
        return [dict(zip("xyz", row)) for row in np.asarray(value).tolist()]
    if tag == Tag.I64:
        return int(value)
    if tag in (Tag.F64, Tag.F32):
        return float(value)
    if tag == Tag.BOOL3:
        return dict(zip("abc", (bool(x) for x in value)))
    if tag == Tag.STRING:
        return str(value)
    return np.asarray(value).ravel().tolist()


def tag_of(kind: T.DataType, length: int | None = None) -> Tag:
    """Tag of a Spark type; arrays of nine floats named as matrices have ``length`` 9."""
    if length == 9 and kind in (T.ArrayType(_D), T.ArrayType(_F)):
        return Tag.MAT3_F64 if kind == T.ArrayType(_D) else Tag.MAT3_F32
    for tag, info in TYPES.items():
        if tag not in (Tag.MAT3_F64, Tag.MAT3_F32) and _same(info.spark, kind):
            return tag
    raise TypeError(f"no value type for {kind.simpleString()}")


def _same(a: T.DataType, b: T.DataType) -> bool:
    return a.simpleString() == b.simpleString()
