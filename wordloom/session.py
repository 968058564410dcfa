"""Session-level helpers: tables written between the rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder, from ``spark.checkpoint.dir``.

    A temporary one is made only for a local master without that setting; a cluster
    without it is an error, because a machine-local folder would not outlive the loss of
    an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="wordloom-checkpoint-"))
    return context.getCheckpointDir()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``checkpoint`` wrote, wherever the cluster keeps it."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class Rounds:
    """The state of an iteration: each round's table replaces the last one's.

    ``write`` works like ``checkpoint``. When it is done, the new table depends on no
    earlier one, and those are removed: an iteration leaves one folder, whatever the number
    of its rounds. Used as a context it removes all of them if the work inside fails.
    """

    def __init__(self) -> None:
        self._written: list[tuple[SparkSession, str]] = []

    def write(self, df: DataFrame) -> DataFrame:
        spark, path = df.sparkSession, table_path(df.sparkSession)
        df.write.parquet(path)
        self.drop()
        self._written.append((spark, path))
        return spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Remove the last table, when what was read from it is written elsewhere."""
        while self._written:
            drop_folder(*self._written.pop())

    def __enter__(self) -> Rounds:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: object) -> None:
        if kind is not None:
            self.drop()


class Collected:
    """A table that grows by the results of one wave of work after the other."""

    def __init__(self, spark: SparkSession, schema: str):
        self._spark, self._path = spark, table_path(spark)
        self.add(spark.createDataFrame([], schema))

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self._path)
        self._schema = df.schema

    def table(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(self._path)


def table_path(spark: SparkSession) -> str:
    """A new path for a written table."""
    return f"{checkpoint_folder(spark)}/wordloom-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the checkpoint folder and go on from the written copy.

    Used for iteration state, vocabularies, graphs and intermediate results that several
    later steps read. A table rather than
    ``DataFrame.checkpoint``: that keeps the size estimate of the plan it cuts off, and
    an iteration's estimates, being products, grow until planning takes longer than the
    work. A table has the size of its files.
    """
    path = table_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sums(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows with a smaller ``order``.

    The values of ``order`` must differ. The rows are sorted in ranges and written; the sum
    runs inside each range, which one task holds, and starts where the sums of the ranges before it
    end. Only those, one row for each range, are summed in one task.
    """
    ranged = df.repartitionByRange(F.col(order)).withColumn("wl_range", F.spark_partition_id())
    ranged = checkpoint(ranged)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("wl_range").agg(F.sum(value).alias("wl_size"))
    starts = sizes.select("wl_range", F.coalesce(F.sum("wl_size").over(before.orderBy("wl_range")), F.lit(0)).alias("wl_start"))
    inside = F.coalesce(F.sum(value).over(before.partitionBy("wl_range").orderBy(order)), F.lit(0))
    summed = ranged.withColumn("wl_inside", inside).join(starts, "wl_range")
    return summed.select(*df.columns, (F.col("wl_start") + F.col("wl_inside")).alias(name))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with whole numbers ``name`` from 0 in the order of column ``order``.

    The rows are sorted in ranges, each by one task, and written; a range's numbers start
    where the sizes of the ranges before it end. Only those sizes, one for each range, are
    summed in one task. ``name`` is an int, so a table may have two thousand million rows.
    """
    place = F.monotonically_increasing_id()
    ranged = checkpoint(df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("wl_place", place))
    ranged = ranged.withColumn("wl_range", F.shiftright("wl_place", 33)).withColumn("wl_place", F.col("wl_place") % (1 << 33))
    sizes = ranged.groupBy("wl_range").agg(F.count(F.lit(1)).alias("wl_size"))
    before = Window.orderBy("wl_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("wl_range", F.coalesce(F.sum("wl_size").over(before), F.lit(0)).alias("wl_start"))
    joined = ranged.join(starts, "wl_range").withColumn(name, (F.col("wl_start") + F.col("wl_place")).cast("int"))
    return joined.select(*df.columns, name)
