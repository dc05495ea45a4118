"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

Pieces are dealt to partitions of bounded size, and each is packed by best-fit decreasing. Dual feasible functions give
a lower bound on the sequences that any packing of the partition needs: where the packing meets it, the partition is
certified and done. Partitions with a gap keep their completely filled sequences and exchange the rest: these pieces
are dealt anew among fewer partitions and packed again, until a round saves nothing, one partition is left, or the
packing meets the bound of the whole table, which is computed from the counts of its piece lengths.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._runtime import bound_batches, settle

CAPACITY = 2048
END_ID = 0
#: Pieces dealt to one partition of the packing, about.
PER_PARTITION = 8192

_PIECES = (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))
_PLACED = (("group", T.LongType()), ("bin", T.LongType()), ("offset", T.LongType()), ("open", T.BooleanType()), ("bins", T.LongType()), ("bound", T.LongType()))
_ARROW = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.BooleanType(): pa.bool_()}


@lru_cache(maxsize=4)
def _encoder(vocabulary_path: str, ranks_path: str):
    """The byte-level BPE of the JSON vocabulary, run from its rank table; its added tokens are found in texts as such."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(vocabulary_path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def default_paths() -> tuple[str, str]:
    """The vocabulary ``byte_bpe_50k.json`` and its rank table: same ids (tested), several times as fast."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encode_ids(text: str | None, paths: tuple[str, str] | None = None) -> np.ndarray:
    """Ids of a whole text followed by END_ID, as unsigned 32-bit numbers."""
    encoder = _encoder(*(paths or default_paths()))
    if not text:
        return np.array([END_ID], "<u4")
    return np.append(encoder.encode_to_numpy(text, allowed_special="all"), END_ID).astype("<u4")


def cut(ids: np.ndarray, capacity: int) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of the pieces of one document: whole if it fits, else full pieces, the first taking what is left over."""
    first = (len(ids) - 1) % capacity + 1
    yield 0, ids[:first]
    for start in range(first, len(ids), capacity):
        yield start, ids[start : start + capacity]


def tokenise(
    docs: DataFrame, capacity: int = CAPACITY, id_col="doc_id", text_col="text", paths: tuple[str, str] | None = None, with_ids=False
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``. Ids of documents may have any type."""
    bound_batches(docs.sparkSession)
    paths = paths or default_paths()
    names = [n for n, _ in _PIECES] + ["ids"] * with_ids
    kinds = [_ARROW[k] for _, k in _PIECES] + [pa.list_(pa.int32())] * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of, known = [], [], {}
            for at, text in enumerate(batch.column(1).to_pylist()):
                found = known.get(text)
                if found is None:
                    found = known[text] = [
                        (i, start, len(x), zlib.crc32(x.tobytes()), *([x.astype(np.int32)] if with_ids else []))
                        for i, (start, x) in enumerate(cut(encode_ids(text, paths), capacity))
                    ]
                rows.extend(found)
                of.extend([at] * len(found))
            columns = list(zip(*rows)) or [()] * len(names)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *arrays], names=["doc_id", *names])

    fields = [T.StructField(n, k) for n, k in _PIECES] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids
    plain = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return plain.mapInArrow(pieces, T.StructType([T.StructField("doc_id", plain.schema["doc_id"].dataType), *fields]))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Sequences that any packing of ``lengths`` needs; see ``bound_of_counts``."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity) if len(lengths) else 0


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing of so many pieces of each length needs, by two families of dual feasible functions.

    First: for a cut e, lengths over capacity - e count as whole sequences, those under e as nothing. Second: for a
    divisor k, lengths are rounded to multiples of capacity / k wherever (k + 1) times the length is not a multiple of
    the capacity.
    """
    sizes = np.arange(capacity + 1, dtype=np.int64)
    number, mass = np.cumsum(counts), np.cumsum(counts * sizes)  # of lengths up to each size
    best = -(-int(mass[-1]) // capacity)
    cuts = np.arange(1, capacity // 2 + 1)
    whole = number[-1] - number[capacity - cuts]
    middle = mass[capacity - cuts] - mass[cuts - 1]
    best = max(best, int((whole - (-middle // capacity)).max()))
    for k in range(1, 21):
        up = (k + 1) * sizes
        value = np.where(up % capacity == 0, k * sizes, up // capacity * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) per length, and the number of bins. Each length, longest first, goes to the fullest bin it fits."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = used = 0  # bit r of mask: some open bin has room r
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - room
        if room > n:
            by_room[room - n].append(b)
            mask |= 1 << (room - n)
    return bins, offsets, used


def _pack_group(capacity: int):
    def pack(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        crc, start, lengths = (part[c].to_numpy() for c in ("ids_crc32", "start", "length"))
        part = part.take(pa.array(np.lexsort((crc, start, -lengths))))
        lengths = part["length"].to_numpy()
        bins, offsets, used = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=used).astype(np.int64)
        bound = lower_bound(lengths, capacity)
        one = np.ones(len(lengths), np.int64)
        for name, values in (("bin", bins), ("offset", offsets), ("open", (fill[bins] < capacity) & (used > bound)), ("bins", one * used), ("bound", one * bound)):
            part = part.append_column(name, pa.array(values))
        return part

    return pack


def corpus_bound(pieces: DataFrame, capacity: int = CAPACITY) -> int:
    """Sequences that any packing of all ``pieces`` needs. The driver gets one count per length, ``capacity`` at most."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return bound_of_counts(counts, capacity) if counts.any() else 0


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION) -> DataFrame:
    """Packs rows (``doc_id, piece, start, length, ids_crc32``), each of 1 to ``capacity`` tokens.

    Adds ``sequence_id``, ``offset``, and what the row's last partition used and needed at least (``bins``, ``bound``). An
    empty table gives no rows; repeated rows are packed one by one.
    """
    done: list[DataFrame] = []
    names = ["doc_id", *[n for n, _ in _PIECES]]
    schema = T.StructType([pieces.schema["doc_id"], *[T.StructField(n, k) for n, k in (*_PIECES, *_PLACED)]])
    total = corpus_bound(pieces, capacity)
    left, width, closed, turn, spare = pieces, max(1, -(-pieces.count() // per_partition)), 0, 0, None
    while True:
        salt = F.xxhash64("piece", "start", "ids_crc32", F.col("doc_id").cast("string"), F.lit(turn))
        if turn == 0:  # equal rows part too
            salt = F.xxhash64("piece", "ids_crc32", F.monotonically_increasing_id())
        dealt = left.select(*names, F.pmod(salt, F.lit(width)).alias("group"))
        packed = settle(dealt.groupBy("group").applyInArrow(_pack_group(capacity), schema)).withColumn(
            "sequence_id", F.lit(turn << 56) + F.col("group") * (1 << 24) + F.col("bin")
        )
        used = packed.groupBy("group").agg(F.max("bins").alias("b")).agg(F.coalesce(F.sum("b"), F.lit(0))).first()[0]
        if spare is not None and used >= spare[1]:  # the exchange saved nothing: keep what was there
            done.append(spare[0])
            return _union(done)
        still = packed.where("open")
        n, sequences = still.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        if n == 0 or width == 1 or closed + used <= total:
            done.append(packed)
            return _union(done)
        done.append(packed.where("not open"))
        closed += used - sequences
        spare, left, turn = (still, sequences), still, turn + 1
        width = max(1, min(-(-width // 2), -(-n // per_partition)))


def _union(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.select("doc_id", *[n for n, _ in _PIECES], "sequence_id", "offset", "bins", "bound")


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, id_col="doc_id", text_col="text", paths: tuple[str, str] | None = None,
    per_partition: int = PER_PARTITION,
) -> DataFrame:
    """Tokenises and packs all rows of ``docs``: one row per piece with its sequence and offset.

    Ids are those of the vocabulary's own tokenizer, which finds its added tokens (``<|endoftext|>``) in texts. A null or
    empty text is one piece of one token (the end id). Repeated rows are packed one by one. An empty table gives no rows.
    ``bins`` and ``bound`` are the sequences used and needed at least where the row was packed. Only the two named columns
    are read, so other columns may have any name; ids may have any type.
    """
    return pack(settle(tokenise(docs, capacity, id_col, text_col, paths)), capacity, per_partition)
