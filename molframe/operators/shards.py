"""An ordered set of shards as one index space."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .read import MOST_IDS


def shard_offsets(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """(shard, length, first): rows per shard and rows in all shards before, in the order of the shards' names.

    Shards are files, so this table is as small as a listing of them.
    """
    lengths = rows.groupBy(F.col(shard).alias("shard")).agg(F.count(F.lit(1)).alias("length"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return lengths.select("shard", "length", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("first"))


def last_at_or_before(starts: Column, value: Column) -> Column:
    """Place in an ascending array of the last entry that is not above ``value``, by binary search; -1 if all are above."""

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"] + 1) / 2).cast("int")
        fits = F.get(starts, middle) <= value
        halved = F.struct(F.when(fits, middle).otherwise(span["low"]).alias("low"), F.when(fits, span["high"]).otherwise(middle - 1).alias("high"))
        return F.when(span["low"] < span["high"], halved).otherwise(span)

    whole = F.struct(F.lit(-1).alias("low"), (F.size(starts) - 1).alias("high"))
    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(starts) + 1)).cast("int")), whole, halve, lambda span: span["low"])


def locate(offsets: DataFrame, ids: Sequence[int]) -> DataFrame:
    """(pos, wanted, shard, local_idx) of a request; negative ids count from the end, unknown ones have a null shard.

    The offsets become one row with an array, in which every id is searched for by halving.
    """
    if len(ids) > MOST_IDS:
        raise ValueError(f"more than {MOST_IDS} ids")
    text = "[" + ",".join(map(str, ids)) + "]"
    asked = offsets.sparkSession.range(1).select(F.posexplode(F.from_json(F.lit(text), "array<bigint>")).alias("pos", "wanted"))
    listed = F.array_sort(F.collect_list(F.struct("first", "length", "shard"))).alias("all")
    table = offsets.where("length > 0").agg(listed, F.coalesce(F.sum("length"), F.lit(0)).alias("total"))
    full = asked.crossJoin(F.broadcast(table)).withColumn("at", F.when(F.col("wanted") < 0, F.col("wanted") + F.col("total")).otherwise(F.col("wanted")))
    found = full.withColumn("hit", F.when((F.col("at") >= 0) & (F.col("at") < F.col("total")), F.get("all", last_at_or_before(F.col("all.first"), F.col("at")))))
    return found.select("pos", "wanted", F.col("hit.shard").alias("shard"), (F.col("at") - F.col("hit.first")).alias("local_idx"))


def shard_get(rows: DataFrame, ids: Sequence[int], strict: bool = True) -> DataFrame:
    """Rows (``shard, local_idx, ...``) of a request over all shards, with ``pos``. Unknown ids stop the job if ``strict``."""
    asked = locate(shard_offsets(rows), ids)
    if strict:
        message = F.concat(F.lit("no molecule "), F.col("wanted").cast("string"))
        asked = asked.withColumn("wanted", F.when(F.col("shard").isNotNull(), F.col("wanted")).otherwise(F.raise_error(message)))
    return asked.join(rows, ["shard", "local_idx"])
