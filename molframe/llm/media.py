"""Media columns: bytes kept as greyscale PNG, read back with every check, and hashed by low cosine frequencies.

The codec is written here on zlib and numpy: chunks are framed and checksummed, scan lines are filtered and unfiltered
as arrays. A payload of a multiple of 64 bytes is an image 64 samples wide.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._runtime import bound_batches, text_bytes

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
#: Side of the reduced image, and of the block of low frequencies kept from its transform.
REDUCED, KEPT = 32, 8
#: Filters of the format.
NONE, SUB, UP, AVERAGE, PAETH = range(5)


class MediaError(ValueError):
    """A stored image that fails a check."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH, filter_type: int = UP, level: int = 1) -> bytes:
    """8-bit greyscale PNG of ``payload``, whose length is a positive multiple of ``width``. Equal input, equal bytes."""
    if not payload or len(payload) % width:
        raise MediaError("payload must fill whole rows")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0], lines[:, 1:] = filter_type, rows
    if filter_type == UP:
        lines[1:, 1:] -= rows[:-1]
    elif filter_type == SUB:
        lines[:, 2:] -= rows[:, :-1]
    elif filter_type != NONE:
        raise MediaError("only filters 0, 1 and 2 are written")
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """The chunks of a PNG after checking signature, lengths and checksums."""
    if data[:8] != SIGNATURE:
        raise MediaError("not a PNG")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise MediaError("cut off")
        (length,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        if len(body) != length or at + 12 + length > len(data):
            raise MediaError("cut off")
        if struct.unpack_from(">I", data, at + 8 + length)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise MediaError(f"bad checksum in {kind!r}")
        yield kind, body
        at += 12 + length
        if kind == b"IEND":
            if at != len(data):
                raise MediaError("bytes after the end")
            return
    raise MediaError("no end")


def _unfilter_slow(kind: int, line: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Average and Paeth refer to the sample just decoded, so they go sample by sample."""
    out = [0] * len(line)
    left = corner = 0
    for i, (x, up) in enumerate(zip(line.tolist(), above.tolist())):
        if kind == AVERAGE:
            guess = (left + up) >> 1
        else:
            to_left, to_up, to_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            guess = left if to_left <= to_up and to_left <= to_corner else up if to_up <= to_corner else corner
        left, corner = (x + guess) & 255, up
        out[i] = left
    return np.array(out, np.uint8)


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of filtered scan lines (filter type first); runs of lines with one filter are undone as one array."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if len(kinds) and kinds.max() > PAETH:
        raise MediaError("unknown filter")
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for run in np.split(np.arange(len(rows)), edges):
        if not len(run):
            continue
        kind, a, b = int(kinds[run[0]]), run[0], run[-1] + 1
        if kind == SUB:
            rows[a:b] = np.cumsum(rows[a:b], axis=1, dtype=np.uint8)
        elif kind == UP:
            if a:
                rows[a] += rows[a - 1]
            rows[a:b] = np.cumsum(rows[a:b], axis=0, dtype=np.uint8)
        elif kind in (AVERAGE, PAETH):
            for i in range(a, b):
                rows[i] = _unfilter_slow(kind, rows[i], rows[i - 1] if i else np.zeros_like(rows[i]))
    return rows


def decode_png(data: bytes) -> np.ndarray:
    """Samples (height x width) of an 8-bit greyscale PNG without interlacing; everything is checked."""
    shape, body = None, []
    for kind, chunk in png_chunks(data):
        if kind == b"IHDR":
            width, height, *rest = struct.unpack(">IIBBBBB", chunk)
            if rest != [8, 0, 0, 0, 0] or not width or not height:
                raise MediaError("not 8-bit greyscale without interlacing")
            shape = height, width
        elif kind == b"IDAT":
            body.append(chunk)
        elif not kind[0] & 32 and kind != b"IEND":
            raise MediaError(f"unknown critical chunk {kind!r}")
    if shape is None:
        raise MediaError("no header")
    try:
        raw = zlib.decompress(b"".join(body))  # tests the Adler checksum of the stream
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != shape[0] * (shape[1] + 1):
        raise MediaError("wrong number of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(shape[0], shape[1] + 1))


def _cosines(size: int, kept: int) -> np.ndarray:
    k, n = np.arange(kept)[:, None], np.arange(size)[None, :]
    return np.cos(np.pi * (2 * n + 1) * k / (2 * size)) * np.sqrt(np.where(k == 0, 1, 2) / size)


_BASIS = _cosines(REDUCED, KEPT)


def _reduce(samples: np.ndarray, axis: int) -> np.ndarray:
    size = samples.shape[axis]
    if size < REDUCED:
        return np.take(samples, np.arange(REDUCED) * size // REDUCED, axis=axis)
    edges = np.arange(REDUCED) * size // REDUCED
    widths = np.diff(np.append(edges, size))
    sums = np.add.reduceat(samples, edges, axis=axis, dtype=np.float64)
    return sums / (widths[:, None] if axis == 0 else widths)


def cosine_hash(samples: np.ndarray) -> bytes:
    """Eight bytes: which of the 8 x 8 lowest cosine frequencies of the reduced image exceed their median."""
    low = _BASIS @ _reduce(_reduce(samples, 0), 1) @ _BASIS.T
    low = np.round(low, 6).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def _encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for payloads in parts:
        yield pd.Series([None if p is None else encode_png(p) for p in payloads], dtype=object)


def _decode(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for stored in parts:
        out = []
        for data in stored:
            samples = None if data is None else decode_png(data)
            out.append((None, None) if samples is None else (samples.tobytes(), cosine_hash(samples)))
        yield pd.DataFrame(out, columns=["payload", "hash"])


_READ = T.StructType([T.StructField("payload", T.BinaryType()), T.StructField("hash", T.BinaryType())])
encode_column = F.pandas_udf(_encode, T.BinaryType())
decode_column = F.pandas_udf(_decode, _READ)


def padded(text: Column, width: int = WIDTH) -> Column:
    """UTF-8 bytes of a text, filled with bytes 0 up to a positive multiple of ``width``."""
    body = text_bytes(text)
    n = F.octet_length(body)
    whole = F.greatest(F.ceil(n / width), F.lit(1)) * width
    zeros = F.unhex(F.repeat(F.lit("00"), (whole - n).cast("int")))
    return F.concat(body, zeros)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as an image and reads it back: ``doc_id, n_bytes, media, payload, hash``.

    ``media`` is the PNG; ``payload`` the samples read from it; ``hash`` eight bytes of low cosine frequencies. Null
    and empty texts give 64 samples of 0. Repeated rows give equal values. An empty table gives no rows. A stored image
    that fails a check stops the job (``MediaError``). Only the named columns are read. Rows go through Arrow in the
    batches that the session sets, and a text costs a few times its own size while its batch lasts.
    """
    bound_batches(docs.sparkSession)
    stored = docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text_bytes(F.col(text_col))).cast("long").alias("n_bytes"),
        encode_column(padded(F.col(text_col))).alias("media"),
    )
    read = stored.withColumn("read", decode_column("media"))
    return read.select("doc_id", "n_bytes", "media", F.col("read.payload").alias("payload"), F.col("read.hash").alias("hash"))
