"""Versioned copy-on-write insert, update, append and delete by logical position.

A store is a folder of two tables. ``data`` has the window rows, by commit and bucket of 4096 windows; a row's positions are those within its
bucket, so a change in one bucket leaves all others as they are. ``buckets/v=N`` has a row per bucket in version N: which commit holds
it, how many records it has and where it starts; it's one row to half a million records, and all that a commit writes besides the touched
buckets. A version is in force once Spark has marked its ``buckets`` table as whole: readers see the old or the new version, never a
mixture, and old versions stay readable. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.offsets import running_total
from tessera.operators.windows import MAX_BITS, MAX_RECORDS, WINDOW, build, decode, encode

BUCKET_SHIFT = 12
#: Cells of positions by which edits meet buckets, and of positions in a bucket by which they meet windows: a bucket or window of usual size
#: lies in one or two.
BUCKET_CELL, WINDOW_CELL = 19, 7
EDITS = "series_id string, op string, pos long, seq long, value double"
TOO_BIG = f"a window would go beyond {MAX_RECORDS} records or {MAX_BITS} bits"


def _bucket(window_id: Column | str) -> Column:
    return F.shiftright(window_id, BUCKET_SHIFT)


def _cells(first: str, end: str, shift: int) -> Column:
    return F.explode(F.sequence(F.shiftright(first, shift), F.shiftright(F.col(end) - 1, shift)))


class WindowStore:
    """A window table on shared storage with numbered versions."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """The version in force, the last whole one; 0 where nothing is stored yet."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        done = jvm.org.apache.hadoop.fs.Path(f"{self.path}/buckets/v=*/_SUCCESS")
        return max((int(f.getPath().getParent().getName()[2:]) for f in done.getFileSystem(conf).globStatus(done) or []), default=0)

    def buckets(self, version: int | None = None) -> DataFrame:
        """series_id, bucket, held (the commit), cnt, windows, full (last window with records), start_pos, end_pos."""
        return self.spark.read.parquet(f"{self.path}/buckets/v={version or self.version()}")

    def total_records(self, series_id: str, version: int | None = None) -> int:
        """Records of a series, from the buckets alone."""
        return self.buckets(version).where(F.col("series_id") == series_id).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n")).first()["n"]

    def _data(self, held: DataFrame, where: Column | None = None) -> DataFrame:
        """The window rows of some buckets with their positions in the series. ``where`` reaches the scan: folders by ``bucket``, row groups
        by ``rel_start`` and ``rel_end``."""
        data = self.spark.read.parquet(f"{self.path}/data").withColumn("bucket", F.col("bucket").cast("long"))
        data = data.where(where) if where is not None else data
        held = held.select("series_id", "bucket", F.col("held").alias("commit"), F.col("start_pos").alias("_first"))
        rows = data.join(held, ["series_id", "bucket", "commit"]).withColumn("start_pos", F.col("rel_start") + F.col("_first"))
        return rows.withColumn("end_pos", F.col("rel_end") + F.col("_first")).drop("_first", "commit")

    def windows(self, version: int | None = None) -> DataFrame:
        """All window rows of a version."""
        return self._data(self.buckets(version))

    def range_windows(self, series_id: str, start: int, length: int, version: int | None = None) -> DataFrame:
        """Windows that meet a range. The buckets say which folders and, in the first and last of them, which positions the scan needs."""
        hit = self.buckets(version).where((F.col("series_id") == series_id) & (F.col("start_pos") < start + length) & (F.col("end_pos") > start))
        at = hit.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"), F.min("start_pos").alias("first"), F.max("start_pos").alias("last")).first()
        if at["low"] is None:
            return self._data(hit, F.lit(False))
        bucket = F.col("bucket").between(at["low"], at["high"])
        head = (F.col("bucket") > at["low"]) | (F.col("rel_end") > start - at["first"])
        tail = (F.col("bucket") < at["high"]) | (F.col("rel_start") < start + length - at["last"])
        if at["low"] == at["high"]:
            head, tail = F.col("rel_end") > start - at["first"], F.col("rel_start") < start + length - at["last"]
        return self._data(hit, (F.col("series_id") == series_id) & bucket & head & tail)

    def validate(self, version: int | None = None) -> None:
        """Every window's counts and widths, and every bucket's totals, or an error."""
        rows = self.windows(version)
        wrong = (F.col("cnt") < 0) | (F.col("cnt") > MAX_RECORDS) | (F.col("bit_len") > MAX_BITS) | (F.col("n_raw") + F.col("n_zero") + F.col("n_esc") != F.col("cnt")) | (F.col("end_pos") - F.col("start_pos") != F.col("cnt"))
        sums = rows.groupBy("series_id", "bucket").agg(F.sum("cnt").alias("n"), F.count("*").alias("k"), F.count_if(wrong).alias("bad"))
        held = self.buckets(version).join(sums, ["series_id", "bucket"], "full")
        bad = held.where("n is null or cnt is null or n <> cnt or k <> windows or bad > 0 or end_pos - start_pos <> cnt").select("series_id", "bucket").first()
        if bad:
            raise ValueError(f"a bucket's windows don't fit its totals: {bad}")

    def _commit(self, rows: DataFrame, touched: DataFrame | None, old: int) -> int:
        """Write ``rows`` (all windows of the touched buckets), then the next version's buckets, which puts it in force."""
        commit = uuid.uuid4().hex
        # Widths are checked as rows are written: a failure leaves the version in force.
        fits = F.when((F.col("cnt") > MAX_RECORDS) | (F.col("bit_len") > MAX_BITS), F.raise_error(F.lit(TOO_BIG)).cast("int")).otherwise(F.col("cnt"))
        before = Window.partitionBy("series_id", "bucket").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("cnt", fits).repartition("series_id", "bucket").withColumn("rel_end", F.sum("cnt").over(before)).withColumn("rel_start", F.col("rel_end") - F.col("cnt"))
        try:
            rows.sortWithinPartitions("bucket", "series_id", "window_id").write.partitionBy("bucket").parquet(f"{self.path}/data/commit={commit}")
        except PySparkException as e:
            raise ValueError(TOO_BIG) if TOO_BIG in str(e) else e from None
        written = self.spark.read.parquet(f"{self.path}/data/commit={commit}").withColumn("bucket", F.col("bucket").cast("long"))
        held = written.groupBy("series_id", "bucket").agg(F.sum("cnt").alias("cnt"), F.count("*").alias("windows"), F.max(F.when(F.col("cnt") > 0, F.col("window_id"))).alias("full"), F.min("window_id").alias("least"))
        held = held.withColumn("held", F.lit(commit))
        if touched is not None:
            held = self.buckets(old).select(*held.columns).join(touched, ["series_id", "bucket"], "left_anti").unionByName(held)
        held = running_total(held, ["series_id"], "bucket", "cnt", "start_pos").withColumn("end_pos", F.col("start_pos") + F.col("cnt"))
        held.sort("series_id", "bucket").write.parquet(f"{self.path}/buckets/v={old + 1}")
        return old + 1

    def create(self, series: DataFrame, window: int = WINDOW) -> int:
        """Store (series_id, pos, value) as version 1."""
        if self.version():
            raise ValueError(f"{self.path} holds a store already")
        return self._commit(build(series, window).drop("start_pos", "end_pos").withColumn("bucket", _bucket("window_id")), None, 0)

    def apply(self, edits: DataFrame) -> int:
        """Apply edits (``EDITS``) and return the new version. Positions are those before the commit.

        update p: the record at p gets the value. insert p: before the record at p (p equal to the length appends to the
        last window with records), several at one place in order of ``seq``. delete p: a window may become empty and
        is then skipped by every query. Windows without an edit keep their bytes; a bucket without one keeps its files.
        Out-of-range positions raise an error before anything is written; without edits no version is made.
        """
        version = self.version()
        held = self.buckets(version)
        size = held.groupBy("series_id").agg(F.sum("cnt").alias("n"), F.max("full").alias("full"), F.min("least").alias("least"))
        edits = edits.join(size, "series_id", "left").cache()
        try:
            limit = F.col("n") + F.when(F.col("op") == "insert", 1).otherwise(0)
            bad = F.col("n").isNull() | (F.col("pos") < 0) | (F.col("pos") >= limit) | ~F.col("op").isin("update", "insert", "delete")
            seen = edits.agg(F.count("*").alias("n"), F.min(F.when(bad, F.struct("series_id", "op", "pos"))).alias("bad")).first()
            if seen["bad"]:
                raise ValueError(f"no such record: {seen['bad']}")
            return self._apply(edits, held, version) if seen["n"] else version
        finally:
            edits.unpersist()

    def _apply(self, edits: DataFrame, held: DataFrame, version: int) -> int:
        cols = ["series_id", "bucket", "op", "pos", "seq", "value"]
        spread = held.where("cnt > 0").select("series_id", "bucket", "start_pos", "end_pos", _cells("start_pos", "end_pos", BUCKET_CELL).alias("cell"))
        near = edits.where("pos < n").withColumn("cell", F.shiftright("pos", BUCKET_CELL)).join(spread, ["series_id", "cell"])
        near = near.where((F.col("pos") >= F.col("start_pos")) & (F.col("pos") < F.col("end_pos"))).select(*cols)
        # Appends go to the last window that has records, or to the first window.
        last = edits.where("pos = n").withColumn("window_id", F.coalesce("full", "least")).withColumn("bucket", _bucket("window_id")).select(*cols, "window_id")
        touched = near.select("series_id", "bucket").union(last.select("series_id", "bucket")).distinct()
        low, high = touched.agg(F.min("bucket"), F.max("bucket")).first()
        rows = self._data(held.join(touched, ["series_id", "bucket"], "left_semi"), F.col("bucket").between(low, high))
        places = rows.where("cnt > 0").select("series_id", "bucket", "window_id", "start_pos", "end_pos", _cells("start_pos", "end_pos", WINDOW_CELL).alias("cell"))
        keyed = near.withColumn("cell", F.shiftright("pos", WINDOW_CELL)).join(places, ["series_id", "bucket", "cell"])
        keyed = keyed.where((F.col("pos") >= F.col("start_pos")) & (F.col("pos") < F.col("end_pos"))).select(*cols, "window_id").unionByName(last).cache()
        try:
            hit = keyed.select("series_id", "window_id").distinct()
            keep = rows.join(hit, ["series_id", "window_id"], "left_anti")
            old = decode(rows.join(hit, ["series_id", "window_id"], "left_semi"))
            kind = lambda op: keyed.where(F.col("op") == op)
            latest = Window.partitionBy("series_id", "pos").orderBy(F.desc("seq"))
            upd = kind("update").withColumn("_k", F.row_number().over(latest)).where("_k = 1").select("series_id", "pos", F.col("value").alias("new"), F.lit(True).alias("is_new"))
            now = old.join(kind("delete").select("series_id", "pos").distinct(), ["series_id", "pos"], "left_anti").join(upd, ["series_id", "pos"], "left")
            now = now.select("series_id", "window_id", "pos", F.lit(1).alias("side"), F.lit(0).cast("long").alias("seq"), F.when(F.col("is_new"), F.col("new")).otherwise(F.col("value")).alias("value"))
            ins = kind("insert").select("series_id", "window_id", "pos", F.lit(0).alias("side"), "seq", "value")
            in_order = F.transform(F.sort_array(F.collect_list(F.struct("pos", "side", "seq", "value"))), lambda r: r["value"])
            full = now.unionByName(ins).groupBy("series_id", "window_id").agg(in_order.alias("values"))
            groups = hit.join(full, ["series_id", "window_id"], "left").withColumn("values", F.coalesce("values", F.array().cast("array<double>")))
            changed = encode(groups).withColumn("bucket", _bucket("window_id"))
            return self._commit(keep.select(*changed.columns).unionByName(changed), touched, version)
        finally:
            keyed.unpersist()

    def _one(self, op: str, series_id: str, pos: int, value: float | None) -> int:
        return self.apply(self.spark.createDataFrame([(series_id, op, pos, 0, value)], EDITS))

    def update(self, series_id: str, pos: int, value: float) -> int:
        return self._one("update", series_id, pos, value)

    def insert(self, series_id: str, pos: int, value: float) -> int:
        return self._one("insert", series_id, pos, value)

    def delete(self, series_id: str, pos: int) -> int:
        return self._one("delete", series_id, pos, None)
