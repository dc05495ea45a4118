"""Values as plain little-endian bytes by type tag, and back: for exchange with what reads bytes, not for storage."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import TENSORS, TYPES, Tag, to_cell

#: A value of more bytes is refused, written or read.
MOST_BYTES = 1 << 30

_SCALARS = {Tag.F64: "<f8", Tag.I64: "<i8", Tag.F32: "<f4"}
_ARRAYS = {Tag.F64_ARRAY: "<f8", Tag.F32_ARRAY: "<f4", Tag.I64_ARRAY: "<i8", Tag.I32_ARRAY: "<i4", Tag.BOOL3: "|b1"}
_ROWS = {Tag.VEC3_F32: ("<f4", 3), Tag.VEC3_F64: ("<f8", 3), Tag.MAT3_F32: ("<f4", 9), Tag.MAT3_F64: ("<f8", 9)}
_SHAPED = {Tag.TENSOR_F32: "<f4", Tag.TENSOR_F64: "<f8", Tag.TENSOR_I32: "<i4", Tag.TENSOR_I64: "<i8"}


class PayloadError(ValueError):
    """Bytes that are no value of their tag."""


def _numbers(data: bytes, kind: str) -> np.ndarray:
    if len(data) % np.dtype(kind).itemsize:
        raise PayloadError(f"{len(data)} bytes are no whole number of {kind}")
    return np.frombuffer(data, kind)


def to_bytes(value: Any, tag: Tag) -> bytes | None:
    """A value of numpy or Python as bytes; a tensor's come after its number of lengths and these, in 32 bits each."""
    if value is None or tag == Tag.NULL:
        return None
    if tag == Tag.STRING:
        data = str(value).encode()
    elif tag in TENSORS:
        a = np.asarray(value, _SHAPED[tag])
        data = np.array([a.ndim, *a.shape], "<u4").tobytes() + a.tobytes()
    else:
        kind = _SCALARS.get(tag) or _ARRAYS.get(tag) or _ROWS[tag][0]
        data = np.asarray(value, kind).tobytes()
    if len(data) > MOST_BYTES:
        raise PayloadError(f"more than {MOST_BYTES} bytes")
    return data


def from_bytes(data: bytes | None, tag: Tag) -> Any:
    """The value of bytes: a number, a text, or an array in the shape that its tag gives."""
    if data is None or tag == Tag.NULL:
        return None
    if len(data) > MOST_BYTES:
        raise PayloadError(f"more than {MOST_BYTES} bytes")
    if tag == Tag.STRING:
        return data.decode()
    if tag in _SCALARS:
        (one,) = _numbers(data, _SCALARS[tag]) if len(data) == np.dtype(_SCALARS[tag]).itemsize else _wrong(data, tag)
        return one.item()
    if tag in _ROWS:
        kind, width = _ROWS[tag]
        flat = _numbers(data, kind)
        return flat.reshape(-1, width) if width == 3 and len(flat) % 3 == 0 else flat.reshape(3, 3) if len(flat) == width == 9 else _wrong(data, tag)
    if tag in TENSORS:
        head = _numbers(data[:4], "<u4")
        shape = _numbers(data[4 : 4 + 4 * int(head[0])], "<u4").tolist() if len(head) else _wrong(data, tag)
        flat = _numbers(data[4 + 4 * len(shape) :], _SHAPED[tag])
        return flat.reshape(shape) if len(shape) == head[0] and np.prod(shape, dtype=np.int64) == len(flat) else _wrong(data, tag)
    flat = _numbers(data, _ARRAYS[tag])
    return flat if tag != Tag.BOOL3 or len(flat) == 3 else _wrong(data, tag)


def _wrong(data: bytes, tag: Tag):
    raise PayloadError(f"{len(data)} bytes are no {tag.name}")


def _from_cell(cell: Any, tag: Tag) -> Any:
    """A value of a Spark column of ``TYPES[tag]``, as Arrow gives it to Python."""
    if cell is None:
        return None
    if tag in TENSORS:
        return np.asarray(cell["data"]).reshape(np.asarray(cell["shape"], np.int64))
    if tag in (Tag.VEC3_F32, Tag.VEC3_F64):
        return np.array([[v[k] for k in "xyz"] for v in cell]).reshape(-1, 3)
    return [cell[k] for k in "abc"] if tag == Tag.BOOL3 else cell


#: What stands for null in a column of numbers on its way to Python, where it would be no number.
_SOME = {tag: 0 for tag in _SCALARS}


def encoded(column: Column, tag: Tag) -> Column:
    """Bytes of a column of the type of ``tag``; null stays null."""

    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:  # each value in a list of one, for structs would come as a frame
            yield pd.Series([to_bytes(_from_cell(x[0], tag), tag) for x in part], dtype=object)

    return F.when(column.isNotNull(), F.pandas_udf(encode, T.BinaryType())(F.array(F.coalesce(column, F.lit(_SOME[tag])) if tag in _SOME else column)))


def decoded(column: Column, tag: Tag) -> Column:
    """Values of a column of bytes, in the type of ``tag``; null stays null, bytes that do not fit stop the job."""

    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([None if x is None else [to_cell(from_bytes(x, tag), tag)] for x in part], dtype=object)

    return F.get(F.pandas_udf(decode, T.ArrayType(TYPES[tag].spark))(column), F.lit(0))


def raw_records(molecules: DataFrame) -> DataFrame:
    """(mol_id, n_atoms, raw): positions in single precision and numbers of one byte, atom arrays one after the other."""

    def pack(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for flat, numbers in parts:
            yield pd.Series([np.asarray(p, "<f4").tobytes() + np.asarray(z, np.uint8).tobytes() for p, z in zip(flat, numbers)], dtype=object)

    places = F.flatten(F.transform("positions", lambda p: F.array(p["x"], p["y"], p["z"])))
    return molecules.select("mol_id", F.size("atomic_numbers").alias("n_atoms"), F.pandas_udf(pack, T.BinaryType())(places, "atomic_numbers").alias("raw"))


def raw_atoms(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(positions, numbers) of one raw record."""
    n, rest = divmod(len(raw), 13)
    if rest:
        raise PayloadError(f"{len(raw)} bytes are no whole number of atoms")
    return np.frombuffer(raw, "<f4", 3 * n).reshape(n, 3), np.frombuffer(raw, np.uint8, n, 12 * n)
