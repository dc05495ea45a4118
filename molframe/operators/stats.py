"""Summaries of measurements, run batching, chunking and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rate_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, median, mean, sample deviation (0 for one row) and 95 % half-width of the mean per group."""
    n, sd = F.count(value), F.coalesce(F.stddev_samp(value), F.lit(0.0))
    return df.groupBy(*by).agg(
        n.alias("n"), F.median(value).alias("median"), F.avg(value).alias("mean"), sd.alias("sd"),
        F.when(n < 2, F.lit(0.0)).otherwise(F.lit(1.96) * sd / F.sqrt(n)).alias("ci95"),
    )


def speedup(df: DataFrame, by: list[str], level: str, value: str, baseline: int = 1) -> DataFrame:
    """``value`` against that of the same group at the baseline level; null where a group has none, or it is 0."""
    base = df.where(F.col(level) == baseline).groupBy(*by).agg(F.max(value).alias("base"))
    return df.join(base, by, "left").withColumn("speedup", F.try_divide(value, "base"))


def top_two_ratio(df: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """Largest over second largest value per group. Only two rows per group and task leave the first stage."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), tie))).where("_rank <= 2")
    pick = lambda k: F.max(F.when(F.col("_rank") == k, F.col(value)))
    return ranked.groupBy(*by).agg(pick(1).alias("first"), pick(2).alias("second"), F.try_divide(pick(1), pick(2)).alias("ratio"))


def nearest(df: DataFrame, column: str, target: float) -> DataFrame:
    """The value of ``column`` nearest to ``target``; the smaller of two equally near ones."""
    return df.agg(F.min_by(column, F.struct(F.abs(F.col(column) - target), F.col(column))).alias(column))


def shared_by_all(df: DataFrame, column: str, source: str) -> DataFrame:
    """Values of ``column`` that every source has."""
    sources = df.agg(F.count_distinct(source).alias("_all"))
    counts = df.groupBy(column).agg(F.count_distinct(source).alias("_n"))
    return counts.crossJoin(F.broadcast(sources)).where("_n = _all").select(column)


def at_largest(df: DataFrame, column: str) -> DataFrame:
    """Rows at the largest value of ``column``."""
    top = df.agg(F.max(column).alias("_top"))
    return df.join(F.broadcast(top), F.col(column) == F.col("_top"), "left_semi")


def ratio_of(df: DataFrame, by: list[str], name: str, value: str, over: str, under: str) -> DataFrame:
    """``value`` of the row named ``over`` divided by that of ``under``, per group."""
    pick = lambda n: F.max(F.when(F.col(name) == n, F.col(value)))
    return df.groupBy(*by).agg(F.try_divide(pick(over), pick(under)).alias("ratio"))


def in_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Distinct values with ``place``: those of ``order`` first, as listed, then the others by name."""
    listed = F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column))
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    place = F.row_number().over(Window.orderBy(F.when(listed > 0, listed).otherwise(len(order) + 1), column))
    return values.select(column, place.alias("place"))  # as many rows as there are names


def runs(df: DataFrame, order: str, signature: Column, by: list[str] | None = None, width: int = 1 << 16) -> DataFrame:
    """Numbers the runs of consecutive rows with one signature: adds ``run`` (from 0), in ``order``, per group.

    Without ``by`` the column ``order`` must be an integer: rows are numbered inside ranges of ``width`` orders, and a table of one
    row per range tells whether a range goes on with the run before it and how many runs there were.
    """
    marked = df.withColumn("_sig", F.struct(signature.alias("s")))
    keys = list(by or ["_range"])
    if not by:
        marked = marked.withColumn("_range", F.floor(F.col(order) / F.lit(width)).cast("long"))
    window = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.lag("_sig").over(window) == F.col("_sig"), 0).otherwise(1)
    inside = F.sum("_change").over(window.rowsBetween(Window.unboundedPreceding, 0)) - 1
    numbered = marked.withColumn("_change", change).withColumn("run", inside)
    if by:
        return numbered.drop("_sig", "_change")
    ranges = marked.groupBy("_range").agg(F.min_by("_sig", order).alias("first"), F.max_by("_sig", order).alias("last"))
    counts = numbered.groupBy("_range").agg(F.sum("_change").alias("n"))
    before = Window.orderBy("_range")  # as many rows as there are ranges
    goes_on = F.coalesce((F.lag("last").over(before) == F.col("first")).cast("int"), F.lit(0))
    starts = ranges.join(counts, "_range").withColumn("n", F.col("n") - goes_on).select(
        "_range", (F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") - goes_on).alias("_start")
    )
    return numbered.join(starts, "_range").withColumn("run", F.col("run") + F.col("_start")).drop("_sig", "_change", "_range", "_start")


def chunks(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds ``chunk``: every ``size`` consecutive values of the dense 0-based column ``order`` are one."""
    return df.withColumn("chunk", F.floor(F.col(order) / size).cast("long"))


def regroup(ids: DataFrame, size: int) -> DataFrame:
    """Groups a request (``pos, mol_id``) by chunk of ids: ``chunk``, how many, and the places they go back to."""
    chunk = F.floor(F.col("mol_id") / size).cast("long")
    return ids.groupBy(chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("pos", "mol_id"))).alias("items"))


def first_k(df: DataFrame, order: str, k: int) -> DataFrame:
    return df.orderBy(order).limit(k)


def _drawn(key: Column, seed: int) -> Column:
    """A digest that depends on a key and the seed alone, the same on any engine."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))


def hash_sample(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` rows without replacement, the same ones for a seed on any cluster."""
    return df.orderBy(_drawn(F.col(key), seed), key).limit(k)


def draws(df: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """``k`` draws with replacement of the dense 0-based ``key``: (draw, key). A draw depends on its number and the seed."""
    spark = df.sparkSession
    size = df.agg(F.count(F.lit(1)).alias("_n"))
    number = F.conv(F.substring(_drawn(F.col("id"), seed), 1, 15), 16, 10).cast("long")  # 60 bits
    return spark.range(k).crossJoin(F.broadcast(size)).where("_n > 0").select(F.col("id").alias("draw"), (number % F.col("_n")).alias(key))


def permutation(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """All rows with ``_order``, a digest to sort by: the same shuffled order for a seed."""
    return df.withColumn("_order", _drawn(F.col(key), seed))


def recommended_batch(atoms: Column, budget_bytes: int, per_atom: int, fixed: int, most: int = 4096) -> Column:
    """Molecules per batch so that a batch takes about the budget: at least one, at most ``most``."""
    return F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.lit(budget_bytes) / (atoms * per_atom + fixed)).cast("int")))


def synthetic(spark, n_molecules: int, n_atoms: int) -> DataFrame:
    """Deterministic molecules, one row per atom: places on a grid of tenths by remainders, no two molecules alike."""
    atom = F.explode(F.sequence(F.lit(0), F.lit(n_atoms - 1))).alias("atom_idx")
    rows = spark.range(n_molecules).select(F.col("id").alias("mol_id"), atom)
    place = lambda step, turn, size: (F.col("mol_id") * step + F.col("atom_idx") * turn) % size / 10.0
    elements = F.array(*[F.lit(z).cast("smallint") for z in (8, 1, 14, 6, 26, 7)])
    return rows.select(
        "mol_id", "atom_idx", F.get(elements, ((F.col("mol_id") + F.col("atom_idx")) % 6).cast("int")).alias("z_num"),
        place(7, 3, 101).alias("x"), place(11, 5, 103).alias("y"), place(13, 17, 107).alias("z"),
        (F.lit(0.125) * (F.col("mol_id") % 997) - 2.5 * n_atoms).alias("energy"),
    )


def touched(array: Column, seed: Column) -> Column:
    """The element at ``seed`` modulo the length; null for an empty array."""
    return F.when(F.size(array) > 0, F.get(array, F.pmod(seed, F.size(array)).cast("int")))


def normalised_size(size: Column, requested: Column, written: Column) -> Column:
    """A size scaled from the number of rows written to the number asked for; the size itself if nothing was written."""
    return F.when(written > 0, F.round(size * requested / written)).otherwise(size).cast("long")


def map_delta(before: Column, after: Column) -> Column:
    """After less before, per key of either; a key that one lacks counts 0 there."""
    return F.map_zip_with(before, after, lambda k, b, a: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))


def normalised_rows(df: DataFrame, required: list[str], defaults: dict[str, object]) -> DataFrame:
    """Fills absent columns and null values from ``defaults``; a row that lacks a required value stops the job."""
    lacking = [c for c in required if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns {lacking}")
    out = df.withColumns({c: F.coalesce(c, F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})
    for c in required:
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"missing value of {c}"))))
    return out


def result_kind(text: Column, kinds: dict[str, list[str]]) -> Column:
    """Which kind of result a JSON text is: the first whose keys it all has at the top; null for none."""
    keys = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    out = F.lit(None).cast("string")
    for kind, wanted in reversed(kinds.items()):
        out = F.when(F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), keys)) == 0, F.lit(kind)).otherwise(out)
    return out


def complete(df: DataFrame, expected: int) -> DataFrame:
    """(found, expected, complete): whether a dataset has as many rows as it should."""
    found = F.count(F.lit(1)).alias("found")
    return df.agg(found).select("found", F.lit(expected).cast("long").alias("expected"), (F.col("found") == expected).alias("complete"))


def total_size(spark, path: str) -> DataFrame:
    """(files, bytes) of all files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
