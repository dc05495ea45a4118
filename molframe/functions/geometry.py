"""Column functions over positions, matrices and tensors; all stay in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two (x, y, z) structs, in the type of their fields."""
    d = [a[c] - b[c] for c in "xyz"]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def as_f64(array: Column) -> Column:
    return F.transform(array, lambda x: x.cast("double"))


def flat3(vectors: Column) -> Column:
    """x0, y0, z0, x1, ... of an array of (x, y, z) structs."""
    return F.flatten(F.transform(vectors, lambda v: F.array(v["x"], v["y"], v["z"])))


#: Where the nine entries of a symmetric matrix, row by row, lie in (xx, yy, zz, yz, xz, xy).
VOIGT = (0, 5, 4, 5, 1, 3, 4, 3, 2)


def voigt_to_matrix(s: Column) -> Column:
    """Nine entries, row by row, of the symmetric matrix given as (xx, yy, zz, yz, xz, xy)."""
    return F.array(*[F.get(s, F.lit(i)) for i in VOIGT])


def matrix_of(s: Column) -> Column:
    """A stress of nine entries as it is, of six from Voigt order, else null."""
    return F.when(F.size(s) == 9, s).when(F.size(s) == 6, voigt_to_matrix(s))


def rows_of(flat: Column, width: int) -> Column:
    """Splits a flat array into rows of ``width``."""
    return F.when(F.size(flat) == 0, F.array()).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(flat) - 1) / width).cast("int")), lambda i: F.slice(flat, i * width + 1, width))
    )


def tensor_length(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1), lambda n, d: n * d)


def tensor_ok(tensor: Column) -> Column:
    """Whether the data of a tensor has as many values as its shape says."""
    return tensor_length(tensor["shape"]) == F.size(tensor["data"])


def at(array: Column, index: Column) -> Column:
    """Element at a 0-based index; a negative one counts from the end; null outside."""
    return F.try_element_at(array, F.when(index < 0, index).otherwise(index + 1))


def normal_path(path: Column) -> Column:
    """Repository path without outer blanks and slashes and without ``.`` parts; null if nothing is left or it goes up."""
    parts = F.filter(F.split(F.btrim(F.trim(path), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    return F.when((F.size(parts) > 0) & ~F.array_contains(parts, ".."), F.array_join(parts, "/"))


def codec_of(spec: Column) -> Column:
    """(codec, level) of a text ``none``, ``lz4`` or ``zstd[:level]``, 3 by default; null if it is none of these."""
    low = F.lower(F.trim(spec))
    name = F.regexp_extract(low, r"^(none|lz4|zstd)(?::-?\d+)?$", 1)
    level = F.regexp_extract(low, r"^zstd:(-?\d+)$", 1).try_cast("int")
    valid = (name != "") & ((name == "zstd") | ~F.contains(low, F.lit(":")))
    return F.when(valid, F.struct(name.alias("codec"), F.when(name == "zstd", F.coalesce(level, F.lit(3))).alias("level")))
