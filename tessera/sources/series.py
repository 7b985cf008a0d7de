"""Series sources and sinks: CSV under three policies, raw big-endian doubles, Parquet with a never-overwrite rule."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import f64_bits
from tessera.sources.scratch import shared_folder

BOM = "﻿"

#: Up to so many splits (some 200 bytes each) their line counts are broadcast; beyond, the join shuffles.
MAX_BROADCAST_SPLITS = 200_000


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header as strings, only rows without an empty or 'nan' cell (complete cases)."""
    df = spark.read.csv(path, header=True)
    keep = F.lit(True)
    for c in df.columns:
        keep &= F.coalesce((F.trim(F.col(f"`{c}`")) != "") & (F.lower(F.col(f"`{c}`")) != "nan"), F.lit(False))
    return df.where(keep)


def csv_lines(spark: SparkSession, path: str, recursive: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """Numbered lines of every ``*.csv`` below ``path`` (series_id, file, line, text, head), files with lines (file, head, lines), files in all.

    ``line`` counts from 0 within a file, ``head`` is the file's first line. Files are split: how many lines lie before the byte at which
    a split begins depends on the file alone, so the counts of one pass hold in another, and a split that the first pass did not have
    ends the job. The counts (a row per split) are written to the shared folder; within a split a task numbers its lines as it reads them.
    A cell can't go over a line's end.
    """
    reader = spark.read.option("pathGlobFilter", "*.[cC][sS][vV]").option("recursiveFileLookup", recursive).text(path)
    rows = reader.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.col("value").alias("text"))
    # A split lies in one task, so its first line is the first that the task saw.
    splits = rows.groupBy("file", "part").agg(F.count("*").alias("n"), F.first("text").alias("head"))
    by_file = Window.partitionBy("file").orderBy("part")
    before = F.coalesce(F.sum("n").over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = f"{shared_folder(spark)}/tessera/lines-{uuid.uuid4().hex}"
    splits.select("file", "part", "n", before.alias("first"), F.regexp_replace(F.first("head").over(by_file), f"^{BOM}", "").alias("head")).write.parquet(held)
    splits = spark.read.parquet(held)
    small = splits.count() <= MAX_BROADCAST_SPLITS

    def run(batches):
        last, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            files, parts = b.column("file").dictionary_encode(), b.column("part").to_numpy()
            names, code = files.dictionary.to_pylist(), files.indices.to_numpy()
            starts = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (parts[1:] != parts[:-1])])
            at = np.arange(len(parts)) - np.repeat(starts, np.diff(np.r_[starts, len(parts)]))
            if (names[code[0]], parts[0]) == last:
                at[: starts[1] if len(starts) > 1 else len(at)] += n
            last, n = (names[code[-1]], parts[-1]), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=["file", "part", "text", "at"])

    first = splits.select("file", "part", "first", "head")
    lines = rows.mapInArrow(run, "file string, part long, text string, at long").join(F.broadcast(first) if small else first, ["file", "part"], "left")
    line = F.when(F.col("first").isNull(), F.raise_error(F.concat(F.lit("the splits changed: "), "file"))).otherwise(F.col("at") + F.col("first"))
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"(?<=.)\.[^.]*$", "")
    lines = lines.select(name.alias("series_id"), "file", line.cast("long").alias("line"), "text", "head")
    lines = lines.withColumn("text", F.when(F.col("line") == 0, F.regexp_replace("text", f"^{BOM}", "")).otherwise(F.col("text")))
    return lines, splits.groupBy("file").agg(F.first("head").alias("head"), F.sum("n").alias("lines")), len(reader.inputFiles())


def csv_number(text: Column, column: int) -> tuple[Column, Column]:
    """The cell of a line without quotes and margins (null: there is none), and its number (null: it is none)."""
    cell = F.get(csv_cells(text), F.lit(column))
    cell = F.trim(F.when(F.contains(cell, F.lit('"')), F.regexp_replace(cell, r'^\s*"|"\s*$', "")).otherwise(cell))
    return cell, cell.try_cast("double")


def csv_values(spark: SparkSession, path: str, column: int = 0, header: bool | None = None, missing: str = "skip", recursive: bool = False) -> DataFrame:
    """(series_id, line, value) of one column of every ``*.csv`` below ``path``; ``series_id`` is the file's name without extension.

    missing: 'skip' leaves out cells that are no finite number, 'null' keeps them as null, 'error' ends the job at the first.
    header: True, False, or None (a first line whose cell is no number is a header). Lines count from 0 without the header, in file
    order; cells may be quoted; a byte order mark is dropped. Large files are split (``csv_lines``).
    """
    rows, _, _ = csv_lines(spark, path, recursive)
    rows = rows.select("series_id", "line", csv_number(F.col("text"), column)[1].alias("value"))
    first_is_header = F.lit(header) if header is not None else F.col("value").isNull()
    rows = rows.where(~((F.col("line") == 0) & first_is_header))
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    if missing == "error":
        rows = rows.withColumn("value", F.when(bad, F.raise_error(F.concat(F.lit("no number in line "), F.col("line"), F.lit(" of "), F.col("series_id")))).otherwise(F.col("value")))
    elif missing == "skip":
        rows = rows.where(~bad)
    return rows


def csv_strict(spark: SparkSession, path: str, column: int, header: bool | None, block: int = 0, recursive: bool = False) -> DataFrame:
    """(series_id, pos, block_id, value) of files in which every record must have a number: a line without the column, with an empty
    cell (blank lines too) or with anything but a number ends the job, and so does a file without values.

    ``pos`` counts the records from 0 without the header (None: a first record that is no number is one). ``block`` records make a
    block, the last may be short; 0: one block. NaN and infinities are numbers here.
    """
    if column < 0 or block < 0:
        raise ValueError("column and block are not negative")
    rows, files, found = csv_lines(spark, path, recursive)
    of_head, number = csv_number(F.col("head"), column)
    if header is not None:
        skipped = F.lit(int(header))
    else:
        skipped = F.when(number.isNull() & (F.coalesce(of_head, F.lit("")) != ""), 1).otherwise(0)
    if files.where(F.col("lines") > skipped).count() < found:
        raise ValueError(f"a file without values in {path}")
    rows = rows.withColumn("pos", F.col("line") - skipped).where("pos >= 0")
    # Columns of their own: each cell is taken and parsed once, not for every check.
    rows = rows.withColumn("cell", csv_number(F.col("text"), column)[0]).withColumn("number", F.col("cell").try_cast("double"))
    cell, value = F.col("cell"), F.col("number")
    where = F.concat(F.lit(" at record "), F.col("line") + 1, F.lit(" of "), F.col("file"))
    checked = (
        F.when(cell.isNull(), F.raise_error(F.concat(F.lit("missing column"), where)))
        .when(cell == "", F.raise_error(F.concat(F.lit("missing value"), where)))
        .when(value.isNull(), F.raise_error(F.concat(F.lit("invalid value"), where)))
        .otherwise(value)
    )
    part = F.floor(F.col("pos") / block).cast("long") if block else F.lit(0).cast("long")
    return rows.select("series_id", "pos", part.alias("block_id"), checked.alias("value"))


def csv_cells(line: Column) -> Column:
    """Cells of a CSV line; commas inside double quotes do not separate."""
    return F.when(F.contains(line, F.lit('"')), F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)')).otherwise(F.split(line, ","))


def invalid_rows(values: DataFrame) -> DataFrame:
    """Rows and invalid rows by series, of ``csv_values(missing='null')``."""
    bad = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    return values.groupBy("series_id").agg(F.count("*").alias("rows"), F.count_if(bad).alias("invalid_rows"))


def doubles_file(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, pos, value) of files of raw big-endian 64-bit doubles; a length that is no multiple of 8 ends the job."""

    def run(batches):
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(data) % 8:
                    raise ValueError(f"{name}: {len(data)} bytes are no whole number of doubles")
                x = np.frombuffer(data, ">f8").astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[-1]] * len(x), pa.string()), pa.array(np.arange(len(x))), pa.array(x)], names=["series_id", "pos", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "series_id string, pos long, value double")


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file: recorded before a run and compared after it."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_new(df: DataFrame, path: str, fmt: str = "parquet", **options) -> None:
    """Write, but never over something that is there."""
    df.write.mode("errorifexists").format(fmt).options(**options).save(path)


def changed_sources(spark: SparkSession, path: str, before: DataFrame) -> DataFrame:
    """(path, change) of the files that were changed, added or removed since ``before``, a table of ``fingerprints``; empty if none."""
    now = fingerprints(spark, path).select("path", F.col("sha256").alias("now"))
    change = F.when(F.col("now").isNull(), "removed").when(F.col("sha256").isNull(), "added").otherwise("changed")
    return before.select("path", "sha256").join(now, "path", "full").where(~F.col("now").eqNullSafe(F.col("sha256"))).select("path", change.alias("change"))


def big_endian_blocks(series: DataFrame, block: int = 8192) -> DataFrame:
    """(series_id, block_id, payload): the values as raw big-endian doubles, ``block`` positions a row, in Column expressions."""
    rows = series.select("series_id", F.floor(F.col("pos") / block).cast("long").alias("block_id"), "pos", F.lpad(F.hex(f64_bits(F.col("value"))), 16, "0").alias("hex"))
    rows = rows.groupBy("series_id", "block_id").agg(F.sort_array(F.collect_list(F.struct("pos", "hex"))).alias("v"))
    return rows.select("series_id", "block_id", F.unhex(F.array_join(F.transform("v", lambda r: r["hex"]), "")).alias("payload"))


def shuffled(series: DataFrame, seed: int = 42, block: int = 1 << 16) -> DataFrame:
    """The same values in a random cyclic order, so that none of two or more stays in place: each position gets the value of the next
    position in an order drawn by hash. The multiset of values stays.

    The order is cut by the drawn number into blocks of about ``block`` positions, each sorted by a task of its own; the last position of
    a block gets the first value of the next one, from a table of one row a block.
    """
    rows = series.withColumn("_draw", F.xxhash64(F.lit(seed), "series_id", "pos"))
    sizes = series.groupBy("series_id").agg(F.ceil(F.count("*") / block).alias("_blocks"))
    # The highest 31 bits of the draw, from 0, times the blocks.
    high = F.shiftright("_draw", 33) + F.lit(1 << 30)
    rows = rows.join(sizes, "series_id").withColumn("_block", F.shiftright(high * F.col("_blocks"), 31)).drop("_blocks")
    order = F.struct("_draw", "pos")
    firsts = rows.groupBy("series_id", "_block").agg(F.min_by("value", order).alias("_value"))
    w = Window.partitionBy("series_id").orderBy("_block")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = F.when(F.lead("_block").over(w).isNull(), F.first("_value").over(whole)).otherwise(F.lead("_value").over(w))
    firsts = firsts.select("series_id", "_block", follows.alias("_next"))
    inside = Window.partitionBy("series_id", "_block").orderBy("_draw", "pos")
    moved = F.when(F.lead("pos").over(inside).isNull(), F.col("_next")).otherwise(F.lead("value").over(inside))
    return rows.join(firsts, ["series_id", "_block"]).withColumn("value", moved).select(*series.columns)
