"""Report sinks: CSV folders with a header, never written over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import codecs, transitions, windows
from tessera.sources.series import write_new


def write_report(df: DataFrame, path: str) -> None:
    """One CSV file; reports are small whatever the input."""
    write_new(df.coalesce(1), path, "csv", header=True)


def write_stream(blocks: DataFrame, path: str) -> None:
    """Compressed blocks by codec and series."""
    blocks.write.mode("errorifexists").partitionBy("codec", "series_id").parquet(path)


def write_decoded(table: DataFrame, path: str) -> None:
    """All values of a window table as CSV below ``path``, a folder a series; the files' order is that of the positions."""
    rows = windows.decode(table).select("series_id", "pos", "value").repartitionByRange("series_id", "pos").sortWithinPartitions("series_id", "pos")
    rows.write.mode("errorifexists").partitionBy("series_id").csv(path, header=True)


def distribution_reports(rows: DataFrame, path: str) -> None:
    """The six reports of the transition statistics below ``path``, from symbols."""
    by = ["series_id"]
    counts = transitions.key_counts(rows, by)
    both = transitions.pooled(counts).select("scope", "series_id", *transitions.KEY, "count")
    write_report(transitions.distribution(both, ["scope", "series_id"]), f"{path}/key_distribution")
    write_report(transitions.coverage(both, ["scope", "series_id"]), f"{path}/topk_coverage")
    write_report(transitions.centred_region(both, ["scope", "series_id"]), f"{path}/concentration_regions")
    write_report(transitions.dataset_summary(rows), f"{path}/dataset_summary")
    write_report(transitions.block_counts(rows).join(transitions.block_stability(rows), ["series_id", "block_id"], "left"), f"{path}/block_summary")
    write_report(transitions.global_summary(rows), f"{path}/summary")


def checked_reports(series: DataFrame, names: list[str], path: str, block: int = codecs.BLOCK, protocol: str = "") -> None:
    """Sizes joined with the outcome of the round trip by (series, codec), and the protocol in words."""
    blocks = codecs.encode_blocks(series, names, block)
    sizes = codecs.size_report(blocks).where("block_id is null").drop("block_id")
    write_report(sizes.join(codecs.verify(series, blocks, block), ["series_id", "codec"], "left"), f"{path}/summary")
    spark = series.sparkSession
    write_new(spark.createDataFrame([(protocol or f"block {block}; sizes are of payloads; every value is compared by position",)], "value string").select(F.col("value")), f"{path}/protocol", "text")
