"""SentencePiece-style encoding and decoding with a relational lattice.

The distinct pre-tokens of all documents are the words; each is encoded once. Substrings of bounded length are exploded and
equi-joined to the piece table, which gives the edges of each word's lattice; edges are grouped by word and folded by a
higher-order aggregate that keeps the best path to every position (Viterbi). The piece table has as many rows as the
vocabulary, which bounds what is broadcast.

Words of more than LATTICE_CHARS characters, which are rare, have lattices too large to be rows; each chunk folds its own ones
by the same recurrence, whole, in time linear in their length.

Texts are split into words once and travel as blocks: the words of a block, and for each place the number of its word.
Blocks are dealt to chunks of bounded size, whatever their ids and texts. A chunk names the words it needs, the codes of
these come back to it, and numbers are replaced by codes. So of the occurrences of a word only one per chunk is moved.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from ._runtime import bound_batches, shuffle_width
from .pieces import Pieces, best_ids, default_model_path, load_pieces, words_of

#: Characters of text per block, and UTF-8 bytes of text per chunk, about. A task holds the blocks of a chunk compressed, and its words with their codes.
BLOCK_CHARS, CHUNK_BYTES = 4 << 20, 36 << 20
#: Longer words are folded where they stand; an edge's end and start are written in _PLACE_BITS each.
LATTICE_CHARS, _PLACE_BITS = 64, 8
_PLACES = 1 << _PLACE_BITS


def piece_table(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """(piece, id, score), one row per piece of the vocabulary."""
    rows = pa.table({"piece": list(pieces.ids), "id": pa.array(pieces.ids.values(), pa.int32()), "score": [pieces.scores[p] for p in pieces.ids]})
    return docs.sparkSession.createDataFrame(rows)


#: The best path to a position: score, minus its number of pieces; its last edge's end and start, and id or minus its bytes.
_NODE = "struct<s:double,m:int,k:int,id:int>"


def lattice_edges(words: DataFrame, table: DataFrame, pieces: Pieces) -> DataFrame:
    """(word, seen, edge): the edges of the lattices of ``words`` (``word, seen``).

    A substring that is a piece is an edge with its id, a character that is none one with minus its number of bytes.
    """
    # in the order in which edges are folded, so that sorting them finds them sorted
    ends = words.select("word", "seen", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("end"))
    spans = ends.select("*", F.explode(F.sequence(F.least(F.lit(pieces.longest), F.col("end")), F.lit(1), F.lit(-1))).alias("size"))
    spans = spans.withColumn("piece", F.substring("word", F.col("end") - F.col("size") + 1, F.col("size")))
    edges = spans.join(F.broadcast(table), "piece", "left").where("id is not null or size = 1")
    size = F.octet_length("piece")
    edge = F.struct(
        (F.col("end") * _PLACES + F.col("end") - F.col("size")).alias("k"), F.coalesce("score", size * pieces.byte_score).alias("s"),
        F.when(F.col("id").isNull(), -size).otherwise(-1).alias("m"), F.coalesce("id", -size).alias("id"),
    )
    return edges.select("word", "seen", edge.alias("edge"))


def fold_viterbi(edges: Column) -> Column:
    """Ids of the best path over an array of edges sorted by end; -k stands for k bytes.

    Equal scores go to fewer pieces, then to the shorter last piece. The state is the best edge into every position so far
    and the best one yet into the next position.
    """
    start = lambda x: x["k"].bitwiseAND(F.lit(_PLACES - 1))

    def step(acc: Column, e: Column) -> Column:
        done, top = acc["done"], acc["top"]
        before = F.when(start(e) == F.size(done), top).otherwise(F.get(done, start(e)))
        new = F.struct((before["s"] + e["s"]).alias("s"), (before["m"] + e["m"]).alias("m"), e["k"].alias("k"), e["id"].alias("id"))
        same_end = F.shiftright(e["k"], _PLACE_BITS) == F.size(done)
        further = F.struct(F.array_append(done, top).alias("done"), new.alias("top"))
        return F.when(same_end, F.struct(done.alias("done"), F.greatest(top, new).alias("top"))).otherwise(further)

    def path(acc: Column) -> Column:
        last = F.struct(acc["top"].alias("at"), F.expr("cast(array() as array<int>)").alias("ids"))

        def back(x: Column, _: Column) -> Column:
            longer = F.struct(F.get(acc["done"], start(x["at"])).alias("at"), F.array_append(x["ids"], x["at"]["id"]).alias("ids"))
            return F.when(x["at"]["k"] > 0, longer).otherwise(x)

        return F.reverse(F.aggregate(F.sequence(F.lit(1), -acc["top"]["m"]), last, back, lambda x: x["ids"]))

    nothing = F.expr(f"struct(cast(array() as array<{_NODE}>) as done, cast(struct(0.0d, 0, 0, 0) as {_NODE}) as top)")
    return F.aggregate(edges, nothing, step, path)


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``words`` (``word, seen``, no word twice, dealt by word) with ``codes``, the ids of the best path."""
    edges = lattice_edges(words, piece_table(words, pieces), pieces)
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list("edge")).alias("edges"), F.min("seen").alias("seen"))
    narrow = "array<smallint>" if max(pieces.ids.values(), default=0) < 1 << 15 else "array<int>"
    return grouped.select("word", "seen", fold_viterbi(F.col("edges")).cast(narrow).alias("codes"))


def _press(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level, write_content_size=True).compress(data)


def _open(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _packed_numbers(numbers: np.ndarray) -> bytes:
    """Numbers compressed byte by byte of their places, for most are small."""
    planes = np.ascontiguousarray(numbers.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return _press(planes.tobytes())


def _numbers(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_open(packed), np.uint8).reshape(4, -1).T).view("<u4").ravel()


_BLOCK = (("chunk", pa.int64()), ("sizes", pa.list_(pa.int32())), ("words", pa.binary()), ("lengths", pa.binary()), ("places", pa.binary()))


def _blocks_of(path: str, chunks: int, most: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(ids, chunk, sizes, words, lengths, places): texts as numbers of the block's words, commonest first."""
        find, part = words_of(path), TaskContext.get().partitionId() * 0x9E3779B1
        ids, sizes, numbers, places, held, count = [], [], {}, array("I"), 0, 0

        def block() -> pa.RecordBatch:
            nonlocal ids, sizes, numbers, places, held, count
            at = np.frombuffer(places, np.uint32) if places else np.zeros(0, np.uint32)
            order = np.argsort(-np.bincount(at, minlength=len(numbers)), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            words = list(numbers)
            words = [words[i] for i in order.tolist()]
            lengths = _packed_numbers(np.array([len(w) for w in words], np.uint32))
            row = [(part + count) % chunks, sizes, _press("".join(words).encode("utf-8", "surrogatepass"), 9), lengths, _packed_numbers(rank[at])]
            whole = pa.concat_arrays(ids)
            lists = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)
            ids, sizes, numbers, places, held, count = [], [], {}, array("I"), 0, count + 1
            return pa.RecordBatch.from_arrays([lists, *(pa.array([x], k) for x, (_, k) in zip(row, _BLOCK))], names=["ids", *(n for n, _ in _BLOCK)])

        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                text = text.as_py()
                found = find(text)
                places.extend([numbers.setdefault(w, len(numbers)) for w in found])
                ids.append(batch.column(0).slice(k, 1))
                sizes.append(len(found))
                held += len(text)
                if held >= most or len(ids) >= 10_000:
                    yield block()
        if ids:
            yield block()

    return blocks


def _words_in(words: bytes, lengths: bytes) -> list[str]:
    text, ends = _open(words).decode("utf-8", "surrogatepass"), np.cumsum(_numbers(lengths)).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, word) of a partition's chunks, each once, without long words."""
    words: dict[int, set[str]] = {}
    for batch in batches:
        for chunk, packed, lengths in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "lengths"))):
            words.setdefault(chunk, set()).update(_words_in(packed, lengths))
    for chunk, found in words.items():
        listed = sorted(w for w in found if len(w) <= LATTICE_CHARS)  # neighbours alike shuffle small
        for at in range(0, len(listed), 50_000):
            part = listed[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(part), pa.int64()), pa.array(part, pa.string())], names=["chunk", "word"])


def _spelt(word: str, codes: list[int], pieces: Pieces) -> list[int]:
    """Codes of a word with its bytes in full."""
    raw, at, out = word.encode("utf-8", "surrogatepass"), 0, []
    for i in codes:
        out += [pieces.bytes[b] for b in raw[at : at - i]] if i < 0 else [i]
        at += -i if i < 0 else pieces.sizes[i]
    return out


class _Codes:
    """Codes of a chunk's words, found by a hash of the word, or by the word where two share a hash."""

    def __init__(self, table: pa.Table, pieces: Pieces):
        names, flat, sizes = [], [], []
        for batch in table.select(["word", "codes"]).to_batches(max_chunksize=20_000):
            words, lists = batch.column(0).to_pylist(), batch.column(1)
            ends = lists.offsets.to_numpy()
            size, values = np.diff(ends), lists.values.to_numpy()[ends[0] : ends[-1]].astype(np.int32)
            if len(values) and values.min() < 0:
                full = [_spelt(w, c, pieces) if min(c) < 0 else c for w, c in zip(words, lists.to_pylist())]
                size, values = np.array([len(c) for c in full]), np.array([i for c in full for i in c], np.int32)
            names.append(self.named(words))
            flat.append(values)
            sizes.append(size)
        names = np.concatenate(names) if names else np.zeros(0, np.uint64)
        self.flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        self.sizes = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
        self.starts, self.order = np.cumsum(self.sizes) - self.sizes, np.argsort(names)
        self.names = names[self.order]
        # every word asked for is in the table, so hashes stand for words unless two of these share one
        self.exact = None if (self.names[1:] != self.names[:-1]).all() else {w: k for k, w in enumerate(table["word"].to_pylist())}

    @staticmethod
    def named(words: list[str]) -> np.ndarray:
        return pd.util.hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, np.uint64)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids): ids of all ``words``, one after another."""
        if self.exact is None:
            at = self.order[np.searchsorted(self.names, self.named(words))]
        else:
            at = np.fromiter((self.exact[w] for w in words), np.int64, len(words))
        return self.sizes[at], self.flat[_ranges(self.starts[at], self.sizes[at])]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size says, one run after another."""
    return np.repeat((starts - (np.cumsum(sizes) - sizes)).astype(np.int32), sizes) + np.arange(sizes.sum(), dtype=np.int32)


#: Places of a block that are replaced by codes at a time.
_PLACES_AT_ONCE = 200_000


def _joiner(path: str, id_type: pa.DataType):
    schema = pa.schema([("doc_id", id_type), ("ids", pa.list_(pa.int32()))])

    def of_block(ids: pa.Array, doc_sizes: np.ndarray, listed: list[str], at: np.ndarray, codes: _Codes, pieces: Pieces) -> Iterator[pa.RecordBatch]:
        short = np.array([len(w) <= LATTICE_CHARS for w in listed], bool)
        sizes, runs = np.zeros(len(listed), np.int64), []
        sizes[short], flat = codes.of([w for w in listed if len(w) <= LATTICE_CHARS])
        for k in np.flatnonzero(~short):
            runs.append(np.array(best_ids(listed[k], pieces), np.int32))
            sizes[k] = len(runs[-1])
        flat, order = np.concatenate([flat, *runs]), np.concatenate([np.flatnonzero(short), np.flatnonzero(~short)])
        starts = np.zeros(len(listed), np.int64)
        starts[order] = np.cumsum(sizes[order]) - sizes[order]
        ends = np.cumsum(doc_sizes)
        first = 0
        while first < len(ids):  # some documents at a time, one at least
            begin = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, begin + _PLACES_AT_ONCE, "right")))
            mine = at[begin : ends[last - 1]]
            n = sizes[mine]
            bounds = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], ends[first:last] - begin])]
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat[_ranges(starts[mine], n)], pa.int32()))
            yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), lists], schema=schema)
            first = last

    def join(blocks: pa.Table, words: pa.Table) -> pa.Table:
        pieces, out = load_pieces(path), []
        codes = _Codes(words, pieces)
        for row in range(len(blocks)):
            ids, sizes, packed, lengths, places = (blocks[c][row] for c in ("ids", "sizes", "words", "lengths", "places"))
            listed = _words_in(packed.as_py(), lengths.as_py())
            out += of_block(ids.values, sizes.values.to_numpy().astype(np.int64), listed, _numbers(places.as_py()), codes, pieces)
        return pa.Table.from_batches(out, schema=schema)

    return join


def encode_documents(
    docs: DataFrame, id_col="doc_id", text_col="text", model_path: str | None = None, chunk_bytes: int = CHUNK_BYTES, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``doc_id, ids``: the pieces of every whole text on the best path of its pre-tokens' lattices.

    Null and empty texts have no ids. A character that no piece covers goes as its UTF-8 bytes, so decoding gives every
    text back. Texts are split only where no piece can cross, and words of any length are encoded whole. Repeated rows are
    encoded one by one. An empty table gives no rows. Only the named columns are read, so other columns may have any name;
    ids may have any type.
    """
    bound_batches(docs.sparkSession)
    path = model_path or default_model_path()
    pieces = load_pieces(path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    chunks = max(1, -(-(plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // chunk_bytes))
    kind = plain.schema["doc_id"].dataType
    fields = [T.StructField("ids", T.ArrayType(kind)), *(T.StructField(n, from_arrow_type(k)) for n, k in _BLOCK)]
    # more partitions than chunks, so that few get several
    dealt = plain.mapInArrow(_blocks_of(path, chunks, block_chars), T.StructType(fields)).repartition(4 * chunks, "chunk")
    width = max(chunks, shuffle_width(docs.sparkSession))
    needed = dealt.mapInArrow(_needed, "chunk long, word string").repartition(width, "word")
    # a chunk rides along with each word so that both uses of ``needed`` read one and the same shuffle
    coded = encode_words(needed.groupBy("word").agg(F.min("chunk").alias("seen")), pieces)
    # both sides grow with the corpus, so neither is broadcast; sorted by word, they also shuffle smaller
    sent = needed.join(coded.hint("merge"), "word").select(F.when(F.col("seen") >= 0, F.col("chunk")).alias("of"), "word", "codes")
    sent = sent.repartition(4 * chunks, "of")
    result = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return dealt.groupBy("chunk").cogroup(sent.groupBy("of")).applyInArrow(_joiner(path, to_arrow_type(kind)), result)


def decode_ids(ids: Column, model_path: str | None = None) -> Column:
    """Text of an array of ids; null for null. Bytes that are no UTF-8 are replaced; ids that stand for no text add nothing."""
    pieces = load_pieces(model_path or default_model_path())
    words = {i: p.encode() for p, i in pieces.ids.items()}
    raw = {i: bytes([b]) for b, i in enumerate(pieces.bytes)}
    first = max(raw, default=-1) + 1  # ids from here on are all text

    def table(names: dict[int, bytes]) -> Column:
        return F.split(F.lit(",".join(names.get(i, b"").hex() for i in range(max(names, default=0) + 1))), ",")  # folded into one literal

    spelt = F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table(words | raw), i)), "")).cast("string")
    marks = "".join(words.get(i, b"").decode() for i in range(first, max(words, default=0) + 1))
    mark = next(chr(c) for c in range(1, 0x110000) if chr(c) not in marks)
    plain = F.split(F.lit(mark.join(words.get(i, b"").decode() for i in range(max(words, default=0) + 1))), f"[{re.escape(mark)}]")
    text = F.array_join(F.transform(ids, lambda i: F.get(plain, i)), "")
    return F.when(F.array_min(ids) >= first, text).otherwise(F.make_valid_utf8(spelt))
