"""Ranges of a column whose rows are counted: rows dealt to them and sorted have places that are known before they move."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column with the range of a dealt row.
RANGE = "_range"
#: Rows that a range has at least, where there are as many, and about at most, but for equal values.
LEAST_ROWS, MOST_ROWS = 1 << 14, 1 << 15
#: Types of columns that can have ranges.
KINDS = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Ranges:
    starts: list[Any]  # least value of each range; the first one takes what lies before, and null
    counts: list[int]
    kind: T.DataType

    @classmethod
    def counted(cls, rows: DataFrame, column: str) -> Ranges:
        """As many ranges as shuffles have partitions, fewer of LEAST_ROWS or more of MOST_ROWS. Only ``column`` is read and moved."""

        def found(parts: int) -> list:
            ranged = rows.select(F.col(column).alias("_key")).repartitionByRange(parts, "_key").groupBy(F.spark_partition_id().alias("part"))
            return sorted(ranged.agg(F.min("_key").alias("key"), F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["part"])

        each = found(parts := int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        if (wanted := sum(r["n"] for r in each) // MOST_ROWS + 1) > parts:
            each = found(wanted)
        starts, counts = [], []
        for r in each:
            if not counts or counts[-1] >= LEAST_ROWS:
                starts.append(r["key"])
                counts.append(0)
            counts[-1] += r["n"]
        return cls(starts or [None], counts or [0], rows.schema[column].dataType)

    def of(self, column: str) -> Column:
        """Range of a value: the last one that starts at it or before, found by halves."""
        known = F.array(*[F.lit(x) for x in self.starts]).cast(T.ArrayType(self.kind))
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(self.starts).bit_length()))])
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(known, at + step) <= F.col(column), at + step).otherwise(at))

    def deal(self, rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with their ``RANGE``, one partition for each. Tables dealt alike are grouped and joined on it and more without being moved."""
        return rows.withColumn(RANGE, self.of(column)).repartitionById(len(self.starts), RANGE)
