"""Minimax contiguous sharding.

Equal texts form one atomic group. Groups are put in one fixed order (by the digest of their text, so the order does
not depend on where rows lie) and cut into ``shards`` contiguous runs so that the largest run is as small as any
contiguous cut allows. The smallest feasible capacity is found by binary search; a capacity is checked greedily:
fill a shard up to the capacity, cut, go on.

The search runs over running totals, never over rows held by the driver. Each round Spark reduces the totals to at
most ``grid`` (largest total in a value range) points, and the driver brackets the answer: it treats an unknown total
as the start of its range (a feasible capacity then is truly feasible) or as the end of it (an infeasible one then is
truly infeasible). The next round looks only into ranges where a cut can still fall, on a finer grid, until the
bracket closes on one capacity.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._runtime import settle, shuffle_width, text_bytes

#: Order buckets: leading bits of the digest. Running totals are windows inside a bucket plus the totals before it.
BUCKET_BITS = 12
#: Points the driver may hold in one round of the search.
GRID = 16384
#: Bytes that each row costs besides its text.
ROW_OVERHEAD = 16


def _running(groups: DataFrame) -> DataFrame:
    """Adds inclusive running totals ``cum_bytes`` and ``cum_rows`` in digest order, with no global sort."""
    per_bucket = groups.groupBy("bucket").agg(F.sum("g_bytes").alias("b_bytes"), F.sum("g_rows").alias("b_rows"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 2 ** BUCKET_BITS rows at most
    starts = per_bucket.select(
        "bucket",
        F.coalesce(F.sum("b_bytes").over(before), F.lit(0)).alias("before_bytes"),
        F.coalesce(F.sum("b_rows").over(before), F.lit(0)).alias("before_rows"),
    )
    inside = Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    return groups.join(starts, "bucket").select(
        "digest",
        "g_rows",
        "g_bytes",
        (F.col("before_bytes") + F.sum("g_bytes").over(inside)).alias("cum_bytes"),
        (F.col("before_rows") + F.sum("g_rows").over(inside)).alias("cum_rows"),
    )


class _Totals:
    """What the driver knows of the set of running totals: ranges of values with the extremes of what lies in them."""

    def __init__(self, lows: list[int], highs: list[int]):
        self.lows, self.highs = lows, highs  # smallest and largest total of each non-empty range, both true totals

    def floor(self, value: int) -> tuple[int, int]:
        """Bounds (both true or reachable) for the largest total that is at most ``value``."""
        i = bisect_right(self.lows, value) - 1
        if i < 0:
            return 0, 0
        if self.highs[i] <= value:
            return self.highs[i], self.highs[i]
        return self.lows[i], value


def _greedy(totals: _Totals, end: int, shards: int, capacity: int) -> tuple[bool, bool, list[tuple[int, int]]]:
    """Greedy check: (surely feasible, possibly feasible, bounds of each cut)."""
    sure = maybe = 0
    spans = []
    for _ in range(shards):
        if sure >= end:
            break
        sure = max(sure, totals.floor(sure + capacity)[0])
        maybe = max(maybe, totals.floor(maybe + capacity)[1])
        spans.append((sure, maybe))
    return sure >= end, maybe >= end, spans


def _least(low: int, high: int, holds) -> int:
    """Smallest value in ``low..high`` for which ``holds`` is true; it is true at ``high`` and monotone."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if holds(mid) else (mid + 1, high)
    return low


def minimax_cuts(running: DataFrame, shards: int, grid: int = GRID) -> tuple[int, list[int]]:
    """Smallest capacity that ``shards`` contiguous runs can keep to, and the running totals to cut at.

    ``running`` has one row per group with ``g_bytes`` (positive) and its inclusive running total ``cum_bytes``.
    An empty table gives capacity 0 and no cuts.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    end, largest = running.agg(F.max("cum_bytes"), F.max("g_bytes")).first()
    if end is None:
        return 0, []
    low, high = max(largest, -(-end // shards)), end
    grid = max(grid, 4 * shards * (shards + 1))  # cut j can lie in j + 1 ranges of a round, so a finer grid always narrows
    width, wanted = None, None  # ranges of the last round: their width, and the numbers of those a cut can fall in
    known: list[tuple[int, int]] = []  # smallest and largest running total of each non-empty range
    cell = lambda w: F.floor((F.col("cum_bytes") - 1) / F.lit(w)).cast("long")
    while True:
        rows, finer = running, max(1, -(-(end if wanted is None else width * len(wanted)) // (grid // 2)))
        if wanted is not None:
            numbers = F.explode(F.from_json(F.lit(str(sorted(wanted))), "array<bigint>")).alias("inside")
            few = running.sparkSession.range(1).select(numbers)  # fewer than ``grid`` numbers
            rows = running.withColumn("inside", cell(width)).join(F.broadcast(few), "inside", "left_semi")
        found = rows.groupBy(cell(finer).alias("cell")).agg(F.min("cum_bytes").alias("lo"), F.max("cum_bytes").alias("hi"))
        seen = [(r["lo"], r["hi"]) for r in found.collect()]  # about ``grid`` rows at most
        known = sorted(seen + [x for x in known if (x[0] - 1) // width not in wanted])
        totals = _Totals([x[0] for x in known], [x[1] for x in known])
        sure = _least(low, high, lambda c: _greedy(totals, end, shards, c)[0])
        low, high = _least(low, sure, lambda c: _greedy(totals, end, shards, c)[1]), sure
        width, wanted = finer, set()
        for least, most in zip(_greedy(totals, end, shards, low)[2], _greedy(totals, end, shards, high)[2]):
            first, last = max(0, bisect_right(totals.lows, least[0]) - 1), bisect_right(totals.lows, most[1])
            wanted.update((lo - 1) // width for lo, hi in known[first:last] if lo < hi)
        if not wanted or low == high and _greedy(totals, end, shards, low)[0]:
            break
    spans = _greedy(totals, end, shards, high)[2]
    return high, [s for s, _ in spans[:-1]]


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Assigns every row of ``docs`` to a shard.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``. The law is ``bytes``: sizes are as equal as
    whole groups of equal texts allow. ``size`` is the UTF-8 length of the text plus 16; a null text has no bytes, its
    checksum is that of no bytes (0), and null texts form one group, apart from empty ones. Repeated rows are kept, one
    slot each. Slots run from 0 in every non-empty shard; ``grown_shard`` is null under this law. An empty table gives
    no rows. Only the two named columns are read, so other columns may have any name.
    """
    spark = docs.sparkSession
    salts = shuffle_width(spark)
    raw = F.col(text_col)
    body = text_bytes(raw)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(body) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        # a prefix keeps null apart from the empty text
        F.unhex(F.sha2(F.when(raw.isNull(), F.lit(b"n")).otherwise(F.concat(F.lit(b"t"), body)), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    # texts are read once; rows keep the number that they are written with, so copies of a text part whatever their ids
    rows = settle(rows).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    cells = rows.groupBy("digest", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    groups = cells.groupBy("digest").agg(F.sum("n").alias("g_rows"), F.sum("bytes").alias("g_bytes"))
    bucket = F.shiftright(F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int"), 16 - BUCKET_BITS)
    running = settle(_running(groups.withColumn("bucket", bucket)))
    _, cuts = minimax_cuts(running, shards)
    shard: Column = F.lit(0)
    if cuts:
        shard = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("cum_bytes")))
    placed = running.select(
        "digest", shard.alias("shard"), (F.col("cum_rows") - F.col("g_rows")).alias("first_row")
    )
    firsts = placed.groupBy("shard").agg(F.min("first_row").alias("shard_start")).collect()  # one row per shard
    start = F.lit(0).cast("long")
    if firsts:
        start = F.element_at(F.create_map(*[F.lit(x) for r in firsts for x in (r["shard"], r["shard_start"])]), F.col("shard"))
    placed = placed.select("digest", "shard", (F.col("first_row") - start).alias("group_slot"))
    # rows of a hot text are numbered per salt; salts of a text follow each other
    before = Window.partitionBy("digest").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.join(placed, "digest").select(
        "digest",
        "salt",
        "shard",
        (F.col("group_slot") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("base"),
    )
    inside = Window.partitionBy("digest", "salt").orderBy("doc_id", "row")
    return (
        rows.withColumn("nth", F.row_number().over(inside) - 1)
        .join(bases, ["digest", "salt"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            F.col("shard").cast("int").alias("shard"),
            (F.col("base") + F.col("nth")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
