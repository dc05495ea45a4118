"""Shared-folder checkpoints and small column helpers used by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure that reliable checkpoints have a folder every executor sees.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset does this pick one: a temporary
    folder in local mode, a folder under the warehouse otherwise.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if context.master.startswith("local") and not context.master.startswith("local-cluster"):
            named = tempfile.mkdtemp(prefix="molframe-checkpoint-")
        else:
            named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_molframe_checkpoints"
    context.setCheckpointDir(named)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and cut its lineage there.

    A lost executor then costs a read, not a recomputation. Spark's cleaner owns the files; it frees those of steps
    that nothing refers to any more, shuffles included, when the driver collects garbage, so that is asked for here.
    """
    ensure_checkpoint_dir(df.sparkSession)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.checkpoint(eager=True)


#: Texts that go to a Python worker at a time, at most.
BATCH_ROWS = 1000


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS if they are larger: texts are long, and workers hold a batch whole."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class Scratch:
    """Tables of one computation, as Parquet in the shared checkpoint folder; all are deleted when it ends.

    For steps that are consumed before the ``with`` block is left. Parquet keeps them several times smaller than a
    checkpoint's rows, and a lost executor costs a read.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> Scratch:
        ensure_checkpoint_dir(self.spark)
        self.root = f"{self.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/scratch-{uuid.uuid4().hex}"
        self.count = 0
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()  # frees shuffle files of steps that are through
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_: object) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions that the session asks for in a shuffle; salts and buckets follow it, so they grow with the cluster."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; no bytes for null."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def text_key(text: Column) -> Column:
    """Sixteen bytes of the SHA-256 of a text; equal texts, equal keys. Null counts as empty."""
    return F.substring(F.unhex(F.sha2(text_bytes(text), 256)), 1, 16)


def bounded_sample(df: DataFrame, keys: list[str], most: int, within: str | None = None, values: int = 256) -> DataFrame:
    """At most ``most`` rows of ``df`` (of each value of ``within``), the first by a hash of ``keys``.

    A count fixes a bound on the hash that about twice as many rows keep to, so only those are ever moved or sorted.
    Of the values of ``within`` the ``values`` with the most rows take part; their counts come to the driver.
    """
    span = 1 << 62
    order = F.shiftrightunsigned(F.xxhash64(*keys), 2)
    share = lambda n: min(span, span * 2 * (most + 10) // max(1, n))
    if within is None:
        bound = F.lit(share(df.count()))
    else:
        counts = df.groupBy(within).count().orderBy(F.desc("count"), within).limit(values).collect()
        if not counts:
            return df
        bound = F.create_map(*[F.lit(x) for r in counts for x in (r[within], share(r["count"]))])[F.col(within)]
    chosen = df.withColumn("_order", order).where(F.col("_order") <= bound)
    if within is None:
        return chosen.orderBy("_order", *keys).limit(most).drop("_order")
    ranked = Window.partitionBy(within).orderBy("_order", *keys)
    return chosen.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= most).drop("_order", "_rank")
