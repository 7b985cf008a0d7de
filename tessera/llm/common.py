"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import shared_folder as shared_dir

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def stage(df: DataFrame, name: str, codec: str = "snappy", files: int = 0) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a cut in the lineage that survives lost executors.

    ``files`` bounds the number of files of a table known to be small.
    """
    df = df.coalesce(files) if files else df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Delete a table made by ``stage`` once nothing reads it any more."""
    path = getattr(df, "staged_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that nothing refers to any more, before a step that needs room."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other letter stays as it is."""
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def running_start(df: DataFrame, order: list[str], amount: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over all rows before in this order (nulls first).

    One sort by ranges, written once with a running sum within each range; the ranges' own sums are as few as the partitions. Which of
    rows equal in ``order`` comes first is open; where the rest of such rows is equal too, so is the result.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    names, at = rows.columns, rows.columns.index(amount)

    def run(batches):
        total = 0
        for b in batches:
            ends = total + np.cumsum(b.column(at).to_numpy(), dtype=np.int64)
            if len(ends):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ends - b.column(at).to_numpy())], names=[*names, "_in"])
                total = int(ends[-1])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows = stage(rows.mapInArrow(run, f"{kinds}, _in long"), "ranges")
    sums = rows.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    sums = sums.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_first"))
    joined = rows.join(F.broadcast(sums), F.col("_part") == F.col("_p"))
    return joined.withColumn(out, (F.col("_in") + F.col("_first")).cast("long")).select(*df.columns, out)


def sliced(batches, rows: int = 512):
    """Arrow batches in smaller pieces, so that a worker holds few rows as Python objects at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
