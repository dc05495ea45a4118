"""Removal of long repeated strings.

Two ways to find the starts of strings of THRESHOLD bytes that also start elsewhere:

``starts_by_doubling`` is distributed prefix doubling. Every position gets the rank of its first eight bytes; then Spark sorts
the pairs of ranks at growing offsets, a pair's place in the order is the new rank of its positions, and positions whose pair
is unique drop out, until the ranked prefixes reach the threshold. It moves every byte position of the corpus through
several sorts, which the budgets of a large corpus do not allow (figures in README), so it serves small tables and
as a check of the other.

``starts_by_anchors``, the default, thins the positions. A string of THRESHOLD bytes is a window, and the anchor of a
window is its GRAM with the least hash (the leftmost of equals), which depends on the window alone: equal windows have
equal anchors. Windows in a row that share an anchor are a run, one row for about 80 positions. Runs are compared by the
name of all they cover (the span): runs of equal spans are repeats as a whole. The rest is told by the string that all
windows of a run hold (the core): a run whose core is unique is done, for none of its windows can repeat; the others are cut
into shorter runs, at fixed distances from the anchor, whose cores are longer prefixes, until the core is the window itself.

Spans are named by 128 bits and compared within one gram. Every step is an aggregation or an equi-join: a passage that
very many documents share is counted before the shuffle or split by the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._runtime import Scratch, bound_batches, settle, text_bytes, text_key

#: Length of the repeated strings that are removed.
THRESHOLD = 200
#: Length of the gram that anchors a window: the first core.
GRAM = 32
#: Windows per run in the rounds after the first; the cores are THRESHOLD + 1 less this.
RUNS = (32, 4, 1)
#: Starts of a text that are hashed at a time; it bounds memory, not the text.
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_random = np.random.default_rng(20240602)
_BYTES, _BYTES2 = (_random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base``, kept for later calls."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        out = np.full(max(n, 1 << 14), base, np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def anchors(text: bytes, threshold: int = THRESHOLD, gram: int = GRAM, block: int = BLOCK) -> tuple[np.ndarray, ...] | None:
    """Runs of a text: (gram hash, two span hashes, anchor, first and last start of its windows); None if it is too short.

    A run that a block of the text ends goes on as another one.
    """
    parts = []
    for begin in range(0, max(0, len(text) - threshold + 1), block):
        found = _anchors(text[begin : begin + block + threshold - 1], threshold, gram)
        parts.append((*found[:3], *(x + begin for x in found[3:])))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else None


def _anchors(text: bytes, threshold: int, gram: int) -> tuple[np.ndarray, ...]:
    n = len(text)
    power, inverse = _powers(_BASE, n + 1), _powers(_INVERSE, n + 1)
    codes = np.frombuffer(text, np.uint8)
    sums, sums2 = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[codes] * power[:n], out=sums[1:])
    np.cumsum(_BYTES2[codes] * power[:n], out=sums2[1:])
    grams = _finish((sums[gram:] - sums[: n - gram + 1]) * inverse[: n - gram + 1])
    m, width = len(grams), threshold - gram + 1
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    # minimum of every run of ``width`` keys: of the rest of its block and of the start of the next one
    pad = -m % width
    rows = np.append(keys, np.full(pad, 0xFFFFFFFFFFFFFFFF, np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[: m - width + 1], ahead[width - 1 : m])
    first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    at = (low[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    last = np.append(first[1:] - 1, len(low) - 1)
    place = (at - first).astype(np.uint64) * np.uint64(512) + (last - first).astype(np.uint64)
    spans = [_finish(_finish((x[last + threshold] - x[first]) * inverse[first]) + place) for x in (sums, sums2)]
    return grams[at], *spans, at, first, last


_ANCHORS = "uid long, gram long, span long, span2 long, at int, first int, last int"


def _anchor_rows(block: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, size = [], [], 0
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = anchors(text.as_py().encode("utf-8", "surrogatepass"), block=block)
                if found is not None:
                    ids.append((uid, len(found[0])))
                    parts.append(found)
                    size += len(found[0])
                if size >= 100_000:
                    yield _to_batch(ids, parts)
                    ids, parts, size = [], [], 0
            if parts:
                yield _to_batch(ids, parts)

    return rows


def _to_batch(ids: list, parts: list) -> pa.RecordBatch:
    uid = np.repeat(np.array([u for u, _ in ids], np.int64), [n for _, n in ids])
    gram, span, span2, *places = (np.concatenate(x) for x in zip(*parts))
    columns = [uid, *(x.view(np.int64) for x in (gram, span, span2)), *(x.astype(np.int32) for x in places)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in _ANCHORS.split(", ")])


def _told(rows: DataFrame) -> DataFrame:
    """Rows (``gram, core, span, span2, uid, at, run, low, high, wanted``) that are repeats or are to be cut, flagged ``repeat`` and ``left``.

    Repeats are wanted rows whose span occurs again. To be cut are, where a core occurs again and a wanted span of it does
    not, the rows of such spans, and one row of each repeated span, for the others may share a part of it.
    """
    span = ["gram", "core", "span", "span2"]
    spans = rows.groupBy(*span).agg(
        F.count(F.lit(1)).alias("n"), F.max("wanted").alias("w"), F.min(F.struct("uid", "at", "run")).alias("some")
    )
    cores = spans.groupBy("gram", "core").agg(F.sum("n").alias("total"), F.max(F.col("w") & (F.col("n") == 1)).alias("open"))
    shared = spans.join(cores.where("total > 1"), ["gram", "core"]).where("(n > 1 and w) or open").select(*span, "n", "some", "open")
    told = rows.join(shared, span)
    repeat = F.col("wanted") & (F.col("n") > 1)
    left = F.col("open") & ((F.col("n") == 1) | (F.struct("uid", "at", "run") == F.col("some")))
    told = told.select("gram", "uid", "at", "run", "low", "high", (F.col("wanted") & ~repeat).alias("wanted"), repeat.alias("repeat"), left.alias("left"))
    return told.where("repeat or left")


def _starts(rows: DataFrame) -> DataFrame:
    """Runs of starts of runs of windows given relative to their anchors."""
    return rows.where("repeat").select("uid", (F.col("at") - F.col("high")).alias("low"), (F.col("at") - F.col("low")).alias("high"))


def starts_by_anchors(texts: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """``(uid, low, high)``: runs of starts of windows that also start elsewhere, for rows (``uid, text``); no ``uid`` twice."""
    every = scratch.keep(texts.select("uid", "text").mapInArrow(_anchor_rows(block), _ANCHORS))
    # 64 bits do here: only a gram whose runs all had one name and yet differed would be told wrong
    mixed = F.min("span") != F.max("span")
    grams = every.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), mixed.alias("mixed")).where("n > 1").select("gram", "mixed")
    hits = scratch.keep(every.join(scratch.keep(grams), "gram"))  # a table, so that Spark can split a very common gram's rows
    # of a gram with one span only, every row is a repeat
    found = [hits.where("not mixed").select("uid", F.col("first").alias("low"), F.col("last").alias("high"))]
    low = F.col("at") - F.col("last")
    runs = hits.where("mixed").select(
        "gram", F.lit(0).alias("core"), "span", "span2", "uid", "at", low.alias("run"), low.alias("low"),
        (F.col("at") - F.col("first")).alias("high"), F.lit(True).alias("wanted"),
    )
    told = scratch.keep(_told(runs))
    found.append(_starts(told))
    # one list per text, of some of its own runs
    edges = told.where("left").groupBy("uid").agg(F.collect_list(F.struct("at", "run", "low", "high", "gram", "wanted")).alias("edges"))
    cut = texts.join(edges, "uid").select("uid", text_bytes(F.col("text")).alias("body"), F.explode("edges").alias("e"))
    begin, size = F.col("e.at") - F.col("e.high"), F.col("e.high") - F.col("e.low") + THRESHOLD
    cut = scratch.keep(cut.select("uid", "e.*", F.substring("body", begin + 1, size).alias("bytes")))
    longest = THRESHOLD - GRAM
    cells = cut.select("*", F.explode(F.sequence(F.floor(F.col("low") / RUNS[0]), F.floor(F.col("high") / RUNS[0]))).alias("cell"))
    for turn, width in enumerate(RUNS):
        r1, r2 = (F.col("cell") * width).cast("int"), F.least(F.col("cell") * width + width - 1, F.lit(longest)).cast("int")
        cells = cells.withColumns({"p": F.greatest("low", r1), "q": F.least("high", r2)}).where("p <= q")
        core = F.substring("bytes", F.col("high") - r1 + 1, THRESHOLD - (r2 - r1))
        span = F.substring("bytes", F.col("high") - F.col("q") + 1, F.col("q") - F.col("p") + THRESHOLD)
        rows = cells.select(
            "gram", F.xxhash64("cell", core).alias("core"), F.xxhash64("p", "q", span).alias("span"), F.xxhash64(F.lit("2"), "p", "q", span).alias("span2"),
            "uid", "at", "run", F.col("p").alias("low"), F.col("q").alias("high"), "wanted",
        )
        told = scratch.keep(_told(scratch.keep(rows)))
        found.append(_starts(told))
        if turn + 1 < len(RUNS):  # a run that is left holds so many runs of the next round
            ratio = width // RUNS[turn + 1]
            first = F.floor(F.col("low") / width) * ratio
            left = told.where("left").select("uid", "at", "run", first.alias("first"), F.col("wanted").alias("w"))
            cells = cut.drop("wanted").join(left, ["uid", "at", "run"]).select(
                "uid", "at", "run", "low", "high", "gram", "bytes", F.col("w").alias("wanted"),
                F.explode(F.sequence(F.col("first"), F.col("first") + ratio - 1)).alias("cell"),
            )
    runs = found[0]
    for f in found[1:]:
        runs = runs.unionByName(f)
    return runs


def _position_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, at, rank): every position with eight bytes from it on, read as a number whose order is theirs."""
    for batch in batches:
        for uid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            body = text.as_py().encode("utf-8", "surrogatepass")
            for begin in range(0, max(0, len(body) - 7), BLOCK):
                part = np.frombuffer(body[begin : begin + BLOCK + 7], np.uint8)
                rank = np.lib.stride_tricks.sliding_window_view(part, 8).copy().view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)
                at = np.arange(begin, begin + len(rank), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rank), uid, np.int64)), pa.array(at), pa.array(rank.view(np.int64))], names=["uid", "at", "rank"])


def starts_by_doubling(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """As ``starts_by_anchors``, by prefix doubling over all positions."""
    ranked, reach = scratch.keep(texts.select("uid", "text").mapInArrow(_position_rows, "uid long, at long, rank long")), 8
    while reach < THRESHOLD:
        offset = min(reach, THRESHOLD - reach)
        later = ranked.select("uid", (F.col("at") - offset).alias("at"), F.col("rank").alias("next"))
        # a position whose partner has dropped out holds a unique string, and one without a partner is too near the end
        pairs = scratch.keep(ranked.join(later, ["uid", "at"]))
        again = pairs.groupBy("rank", "next").count().where("count > 1").orderBy("rank", "next")
        places = scratch.keep(again.select("rank", "next", F.monotonically_increasing_id().alias("place")))
        ranked = scratch.keep(pairs.join(places, ["rank", "next"]).select("uid", "at", F.col("place").alias("rank")))
        reach += offset
    return ranked.select("uid", F.col("at").alias("low"), F.col("at").alias("high"))


_CUT = T.StructType(
    [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType()),
    ]
)


def remove(
    text: bytes, lows: np.ndarray, highs: np.ndarray, threshold: int = THRESHOLD, whole_characters: bool = False
) -> tuple[int, int, int, bytes]:
    """(length, bytes removed, maximal removed runs, what is left) for runs of starts of repeated windows.

    With ``whole_characters`` a run that begins or ends inside a UTF-8 character takes all of it.
    """
    order = np.argsort(lows, kind="stable")
    lows, ends = lows[order], np.maximum.accumulate(highs[order] + threshold)
    new = np.append(True, lows[1:] > ends[:-1])
    begins, ends = lows[new], ends[np.append(new[1:], True)]
    if whole_characters:
        inside = (np.frombuffer(text + b"\0", np.uint8) & 0xC0) == 0x80
        while inside[begins].any():
            begins = begins - inside[begins]
        while inside[ends].any():
            ends = ends + inside[ends]
        new = np.append(True, begins[1:] > ends[:-1])  # runs that meet in a character are one
        begins, ends = begins[new], ends[np.append(new[1:], True)]
    edges = np.concatenate([[0], ends]), np.concatenate([begins, [len(text)]])
    kept = b"".join(text[a:b] for a, b in zip(*edges))
    return len(text), len(text) - len(kept), len(begins), kept


def _removed(whole_characters: bool):
    def removed(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lows, highs in parts:
            out = []
            for text, a, b in zip(texts, lows, highs):
                body = text.encode("utf-8", "surrogatepass")
                if a is None or not len(a):
                    out.append((len(body), 0, 0, body))
                else:
                    out.append(remove(body, np.asarray(a, np.int64), np.asarray(b, np.int64), whole_characters=whole_characters))
            yield pd.DataFrame(out, columns=_CUT.names)

    return F.pandas_udf(removed, _CUT)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), starts=starts_by_anchors,
    whole_characters: bool = False,
) -> DataFrame:
    """Removes from every text each byte covered by a 200-byte string that also starts anywhere else in the table.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept`` (remaining bytes) and the columns named in ``keep``. Matches
    stay within a row; strings are judged on the input. Null texts count as empty; texts under 200 bytes stay whole. Repeated
    rows are rows of their own, so they are repeats of each other. An empty table gives no rows. Only named columns are read.
    With ``whole_characters`` a cut inside a character takes the rest of it too, so that what is left is text.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    key, text = text_key(F.col(text_col)), F.coalesce(F.col(text_col), F.lit(""))
    with Scratch(spark) as scratch:
        # numbered as they are written, so that a number names one row for good
        plain = scratch.keep(docs.select(F.monotonically_increasing_id().alias("uid"), key.alias("key"), text.alias("text")))
        gone = starts(plain.select("uid", "text"), scratch).groupBy("uid").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
        # equal texts lose the same, so one row speaks for all of them
        first = plain.groupBy("key").agg(F.min("uid").alias("uid"))
        gone = settle(gone.join(first, "uid").select("key", "runs"))
    rows = docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), text.alias("text"), *[F.col(c).alias(f"kept_{c}") for c in keep])
    both = rows.join(gone, "key", "left").withColumn("cut", _removed(whole_characters)("text", F.col("runs.low"), F.col("runs.high")))
    return both.select("doc_id", "cut.*", *[F.col(f"kept_{c}").alias(c) for c in keep])
