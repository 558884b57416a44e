"""Shared helpers: scratch tables in the cluster's shared folder and distributed prefix sums."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
import pyarrow.compute

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None

ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one on this machine is set only where that is unset and Spark runs here alone."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="fixwave-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Scratch:
    """Tables written as Parquet under the shared folder, so that a lost executor costs no lineage.

    ``save`` writes a frame and returns a reader of it; ``drop`` deletes one that no later plan reads.
    What is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/fixwave/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        schema, path = df.schema, self.path(name)
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
        release(self.spark)
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, name: str = "") -> None:
        try:
            jvm, path = self.spark.sparkContext._jvm, self.path(name).rstrip("/")
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone by the time the driver ends
            if name:
                raise


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files of finished plans that nothing refers to any more.

    It does so only when the driver collects garbage, by default every half hour; executors' disks would hold the shuffles of
    all earlier steps until then. Tables are saved a few dozen times in an operator, and the driver's heap is small.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_bases(df: DataFrame, part: str, amount: str, base: str) -> DataFrame:
    """Add to each row the sum of ``amount`` over all parts below its own: the second pass of a two-pass prefix sum.

    The totals table has one row per part (an input split), so its size is bounded by the number of splits, not of
    rows; it is summed in two levels so that no task ever sees more than about 1,024 parts or 1/1,024 of them.
    """
    totals = df.groupBy(part).agg(F.sum(amount).alias("__t")).withColumn("__b", F.floor(F.col(part) / 1024))
    inner = totals.withColumn("__in", F.sum("__t").over(Window.partitionBy("__b").orderBy(part)) - F.col("__t"))
    blocks = totals.groupBy("__b").agg(F.sum("__t").alias("__bt"))
    blocks = blocks.withColumn("__out", F.sum("__bt").over(Window.orderBy("__b")) - F.col("__bt"))
    bases = inner.join(F.broadcast(blocks), "__b").select(part, (F.col("__in") + F.col("__out")).alias(base))
    return df.join(F.broadcast(bases), part)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` or lambdas within it refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, combine, zero: int, size: int = 256) -> Column:
    """For each element of an array of longs, what ``combine`` makes of those before it (from ``zero``).

    Folding copies what it has collected at each step, so it goes over slices of ``size`` elements, each from the total of the
    slices before; arrays of a million elements are a matter of seconds.
    """
    none = F.array().cast("array<bigint>")
    zero = F.lit(zero).cast("bigint")

    def fold(part, start):
        step = lambda acc, x: F.struct(combine(acc["at"], x).cast("bigint").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def whole(v):
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / size).cast("int")), lambda k: F.slice(v, k * size + 1, size))
        total = lambda part: F.aggregate(part, zero, lambda acc, x: combine(acc, x).cast("bigint"))
        sums = lambda ps: let(fold(F.transform(ps, total), zero), lambda starts: F.flatten(F.zip_with(ps, starts, fold)))
        return F.when(F.size(v) > 0, let(parts, sums)).otherwise(none)

    return let(values, whole)


def lookup(rows: DataFrame, table: DataFrame, key: str, heavy: int = 20_000) -> DataFrame:
    """Left join of rows with a table that has one row for each key of theirs, where a few keys may have most of the rows.

    Keys with more than a ``heavy``-th of all rows, which are ``heavy`` keys at most, are met by a broadcast; the rest by a
    shuffle that no key dominates. Rows without a key get nulls. ``rows`` are read several times: they should be a saved table.
    """
    many = rows.count() // heavy
    often = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > max(many, 64)).select(key)
    often = Scratch(rows.sparkSession, "lookup").save(often, "often")
    hot = F.broadcast(often)
    common = rows.join(F.broadcast(table.join(hot, key, "left_semi")), key)
    rest = rows.where(F.col(key).isNotNull()).join(hot, key, "left_anti").join(table.hint("merge"), key, "left")
    none = rows.where(F.col(key).isNull()).select(*rows.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name != key])
    return common.unionByName(rest).unionByName(none, allowMissingColumns=True)


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package.

    Session settings are left alone: Spark ends an Arrow batch at ``spark.sql.execution.arrow.maxBytesPerBatch``, however many
    rows that is, and the functions here cut batches into slices of their own.
    """
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])


def trim() -> None:
    """Give memory that this worker has freed back to the system; workers are kept and would otherwise hold their peak."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(batches, column: str = "text", size: int = 1 << 20):
    """Cut Arrow batches into runs of rows with about ``size`` bytes of the column (one row at least)."""
    for batch in batches:
        col = batch.column(column)
        if batch.num_rows == 0:
            continue
        ends = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(ends.searchsorted(before + size, side="right")))
            yield batch.slice(at, end - at)
            at = end
            trim()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
