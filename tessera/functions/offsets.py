"""Positions and running totals without a single-partition sort."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import shared_folder


def running_total(df: DataFrame, keys: list[str], order: str, amount: str, out: str, shift: int = 12) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over the rows of the same keys with a smaller ``order`` (a long, unique within the keys).

    Summed in blocks of 2**shift order values first, so a long series is spread over many tasks; the block sums are 2**-shift of
    the rows.
    """
    rows = df.withColumn("_block", F.shiftright(F.col(order), shift))
    sums = rows.groupBy(*keys, "_block").agg(F.sum(amount).alias("_sum"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    total: Column = F.sum("_sum").over(before(Window.partitionBy(*keys).orderBy("_block")))
    sums = sums.select(*keys, "_block", F.coalesce(total, F.lit(0)).alias("_first"))
    inside: Column = F.sum(amount).over(before(Window.partitionBy(*keys, "_block").orderBy(order)))
    rows = rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(sums, [*keys, "_block"])
    return rows.withColumn(out, (F.col("_inside") + F.col("_first")).cast("long")).drop("_block", "_inside", "_first")


def positions(df: DataFrame, order: list[str], out: str = "pos") -> DataFrame:
    """Number the rows from 0 in this order: a range-partitioned sort, then each partition's offset from the counts before it.

    The sorted rows are written to the shared folder once: a second run of the sort may cut the partitions elsewhere. The driver
    sees one count per partition. ``order`` must be a total order for the numbers to be repeatable.
    """
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    parts = parts.withColumn("_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    path = f"{shared_folder(df.sparkSession)}/tessera/positions-{uuid.uuid4().hex}"
    parts.write.parquet(path)
    parts = df.sparkSession.read.schema(parts.schema).parquet(path)
    counts = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    first, total = {}, 0
    for k in sorted(counts):
        first[k], total = total, total + counts[k]
    if not first:
        return df.withColumn(out, F.lit(0).cast("long"))
    offset = F.create_map(*(F.lit(x).cast("long") for kv in first.items() for x in kv))
    return parts.withColumn(out, F.col("_row") + offset[F.col("_part").cast("long")]).drop("_part", "_row")
