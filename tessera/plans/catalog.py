"""Registered queries over compressed series, and their DuckDB SQL.

Every query that is about values takes them from decoded windows or blocks, never from the source column.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import numeric
from tessera.operators import codecs, position_query, transitions, windows
from tessera.operators.mutate import EDITS, WindowStore
from tessera.sources.scratch import shared_folder
from tessera.sources.reports import write_decoded
from tessera.sources.series import csv_strict, csv_table, csv_values, invalid_rows, shuffled

BLOCK = 1_000
LINE_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice"]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.value as a series; event_id is its position."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("events").alias("series_id"), F.col("event_id").alias("pos"), "value")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.functions.offsets import positions

    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_totalprice").alias("value"))
    return positions(rows, ["o_orderkey"]).select(F.lit("orders").alias("series_id"), "pos", "value")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem.l_extendedprice in a total order."""
    from tessera.functions.offsets import positions

    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*LINE_ORDER)
    return positions(rows, LINE_ORDER).select(F.lit("lineitem").alias("series_id"), "pos", F.col("l_extendedprice").alias("value"))


_stores: dict[tuple, WindowStore] = {}


def events_store(spark: SparkSession, sf_dir: str) -> WindowStore:
    """The stored window table of events, built once a session and table file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    stamp = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime()
    key = spark.sparkContext.applicationId, sf_dir, stamp
    if key not in _stores:
        store = WindowStore(spark, f"{shared_folder(spark)}/tessera/windows-{uuid.uuid4().hex}")
        store.create(events(spark, sf_dir))
        _stores[key] = store
    return _stores[key]


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_store(spark, sf_dir).windows(1)


def _decoded(spark: SparkSession, sf_dir: str, both: bool = False) -> DataFrame:
    series = events(spark, sf_dir)
    if both:
        series = series.unionByName(orders(spark, sf_dir))
    return windows.decode(windows.build(series)).select("series_id", "pos", "value")


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.symbols(_decoded(spark, sf_dir, both=True), BLOCK)


def window_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir).select("pos", "value")


def window_roundtrip_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.decode(windows.build(prices(spark, sf_dir))).select("pos", "value")


def window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("window_id", "start_pos", "end_pos", F.col("cnt").cast("long").alias("cnt"), F.col("w_min").alias("min_value"), F.col("w_max").alias("max_value"), "first_value")


def prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return position_query.prefix_sums(_windows(spark, sf_dir)).select("window_id", F.col("cnt").cast("long").alias("cnt"), "records_before")


def total_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).groupBy("series_id").agg(F.sum("cnt").alias("n"))


def locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return position_query.locate(events_store(spark, sf_dir).range_windows("events", 777, 1), "events", 777)


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, found = events_store(spark, sf_dir), None
    for p in (0, 127, 128, 999):
        one = position_query.points(store.range_windows("events", p, 1), "events", [p])
        found = one if found is None else found.unionByName(one)
    return found


def range_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = events_store(spark, sf_dir)
    return position_query.range_values(store.range_windows("events", 100, 500), "events", 100, 500, store.total_records("events"))


def range_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = events_store(spark, sf_dir)
    return position_query.range_decimals(store.range_windows("events", 100, 500), "events", 100, 500, store.total_records("events"))


def range_exact_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return position_query.exact_sum(range_decimals(spark, sf_dir))


def window_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each window of a range decodes and selects."""
    part = position_query.window_partials(events_store(spark, sf_dir).range_windows("events", 100, 850), 100, 850)
    return part.select("window_id", F.col("decoded").cast("long").alias("decoded"), F.col("selected").cast("long").alias("selected"), F.col("lo").alias("min_value"), F.col("hi").alias("max_value"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("n", F.round("sum", 2).alias("sum_value"), F.round("avg", 6).alias("avg_value"), F.col("min").alias("min_value"), F.col("max").alias("max_value"))


def range_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = events_store(spark, sf_dir)
    return _rounded(position_query.range_aggregate(store.range_windows("events", 100, 850), "events", 100, 850, n=store.total_records("events")))


def range_aggregate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = events_store(spark, sf_dir)
    return _rounded(position_query.range_aggregate(store.range_windows("events", 100, 850), "events", 100, 850, True, store.total_records("events")))


def _edited(spark: SparkSession, sf_dir: str, edits: list[tuple], at_end: list[tuple] = ()) -> DataFrame:
    store = WindowStore(spark, f"{shared_folder(spark)}/tessera/windows-{uuid.uuid4().hex}")
    store.create(events(spark, sf_dir))
    n = store.total_records("events", 1) if at_end else 0
    store.apply(spark.createDataFrame([("events", *e) for e in edits] + [("events", op, n + p, *e) for op, p, *e in at_end], EDITS))
    return windows.decode(store.windows()).select("pos", "value")


def update_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, [("update", 5, 0, -1.5), ("update", 128, 0, 0.1234567890123456), ("update", 900, 0, 0.0)])


def insert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, [("insert", 128, 0, 7.25), ("insert", 128, 1, 8.25)])


def delete_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, [("delete", 127, 0, None), ("delete", 500, 0, None)])


def append_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edited(spark, sf_dir, [], [("insert", 0, 0, 3.5), ("insert", 0, 1, -4.25)])


def delete_to_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of the second window: it stays, empty, and every query skips it."""
    return _edited(spark, sf_dir, [("delete", p, 0, None) for p in range(128, 256)])


def bucket_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The buckets of the stored table: records, windows and positions of each."""
    return events_store(spark, sf_dir).buckets(1).select("series_id", "bucket", "cnt", "windows", "start_pos", "end_pos")


def zero_residual_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).agg(F.sum("n_zero").alias("n_zero"), F.sum("n_raw").alias("n_raw"))


def decimal_places_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, both=True).groupBy("series_id", numeric.decimal_places(F.col("value")).alias("places")).agg(F.count("*").alias("n"))


def exponent_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decoded(spark, sf_dir, both=True).where("value <> 0").groupBy("series_id", numeric.exponent(F.col("value")).alias("e")).agg(F.count("*").alias("n"))


def _r(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns))


def key_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = transitions.key_counts(_symbols(spark, sf_dir), ["series_id"])
    return _r(transitions.distribution(counts, ["series_id"]), "probability", "cumulative_coverage")


def topk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = transitions.key_counts(_symbols(spark, sf_dir), ["series_id"])
    return _r(transitions.coverage(counts, ["series_id"]), "coverage", "savings_bits_per_symbol").withColumn("code_bits", F.col("code_bits").cast("int"))


def pooled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.pooled(transitions.key_counts(_symbols(spark, sf_dir), ["series_id"])).select("scope", "series_id", *transitions.KEY, "count")


def key_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = transitions.key_counts(_symbols(spark, sf_dir), ["series_id"])
    return _r(transitions.entropy(counts, ["series_id"]), "entropy", "effective_keys", "normalized_entropy", digits=6)


def block_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.block_counts(_symbols(spark, sf_dir))


def block_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(transitions.block_stability(_symbols(spark, sf_dir)), "previous_hit_rate", "jaccard", "net_savings_bits_per_symbol")


def centred_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = transitions.key_counts(_symbols(spark, sf_dir), ["series_id"])
    return _r(transitions.centred_region(counts, ["series_id"]), "actual_coverage")


def codebook_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transitions.choose_codebook(transitions.key_counts(_symbols(spark, sf_dir), ["series_id", "block_id"]), ["series_id", "block_id"])


def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transitions.dataset_summary(_symbols(spark, sf_dir))
    return _r(out, "zero_rate", "entropy", "effective_keys", "normalized_entropy", *(f"top{k}_coverage" for k in transitions.SUMMARY_K), digits=6)


def global_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(transitions.global_summary(_symbols(spark, sf_dir)), "value", digits=6)


def heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transitions.heat_map(transitions.key_counts(_symbols(spark, sf_dir), []))
    return out.select("delta_u", *(F.col(str(e)).alias(f"e{'m' if e < 0 else ''}{abs(e)}") for e in range(-3, 4)))


def transition_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeat has no key: zeros stand in its place, so that no column holds nulls."""
    return _symbols(spark, sf_dir).na.fill(0, transitions.KEY)


def top_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = transitions.key_counts(_symbols(spark, sf_dir), ["series_id"])
    return transitions.top_keys(counts, ["series_id"], 32)


def codec_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = events(spark, sf_dir).unionByName(orders(spark, sf_dir))
    return codecs.size_report(codecs.encode_blocks(series, list(codecs.CODECS), BLOCK))


def codec_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = events(spark, sf_dir)
    return codecs.verify(series, codecs.encode_blocks(series, list(codecs.CODECS), BLOCK), BLOCK).select("series_id", "codec", "records", "decoded_records", "mismatches", "zero_sign_differences", "status")


def compression_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.compression_summary(codecs.encode_blocks(events(spark, sf_dir), list(codecs.CODECS), 100))


def neighbour_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codecs.neighbour_zeros(_decoded(spark, sf_dir), BLOCK)


def decoded_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All windows decoded into CSV files, read again."""
    path = f"{shared_folder(spark)}/tessera/export-{uuid.uuid4().hex}"
    write_decoded(_windows(spark, sf_dir), path)
    return spark.read.csv(path, header=True, schema="pos long, value double, series_id string").select("series_id", "pos", "value")


def _csv_folder(spark: SparkSession, rows: DataFrame) -> str:
    path = f"{shared_folder(spark)}/tessera/csv-{uuid.uuid4().hex}"
    rows.write.csv(path, header=True)
    return path


def strict_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of CSV files, read strictly one at a time and brought together by file and position."""
    # By a folder, as a task without rows then writes no file; else the first task writes one of only a header, which is refused.
    path = f"{shared_folder(spark)}/tessera/csv-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value", F.lit("events").alias("series"))
    rows.write.partitionBy("series").csv(path, header=True)
    ids, values = csv_strict(spark, path, 0, None, BLOCK), csv_strict(spark, path, 1, True, BLOCK)
    joined = ids.withColumnRenamed("value", "event_id").join(values, ["series_id", "pos", "block_id"])
    return joined.select(F.col("event_id").cast("long").alias("event_id"), "value")


def _gaps(spark: SparkSession, sf_dir: str) -> str:
    """Events as CSV, every seventh value empty, every eleventh of the others 'nan'."""
    cell = F.when(F.col("event_id") % 7 == 0, "").when(F.col("event_id") % 11 == 0, "nan").otherwise(F.col("value").cast("string"))
    return _csv_folder(spark, spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", cell.alias("value")))


def csv_invalid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = invalid_rows(csv_values(spark, _gaps(spark, sf_dir), 1, True, "null"))
    return found.agg(F.sum("rows").alias("rows"), F.sum("invalid_rows").alias("invalid_rows"))


def csv_complete_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_table(spark, _gaps(spark, sf_dir)).select(F.col("event_id").cast("long").alias("event_id"), F.col("value").cast("double").alias("value"))


def shuffled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multiset of a shuffled series, which is that of the series."""
    return shuffled(events(spark, sf_dir)).groupBy("value").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        window_roundtrip, window_roundtrip_prices, window_index, prefix_sums, total_records, locate, point_lookup, range_values, range_aggregate,
        range_aggregate_stats, range_decimals, range_exact_sum, window_partials, update_records, insert_records, delete_records, append_records, delete_to_empty, bucket_index, zero_residual_count, decimal_places_hist, exponent_hist,
        key_distribution, topk_coverage, pooled_counts, key_entropy, block_counts, block_stability, centred_region, codebook_choice,
        dataset_summary, global_summary, heat_map, transition_symbols, top_keys, codec_sizes, codec_roundtrip, compression_summary, neighbour_zeros,
        shuffled_series, decoded_export, strict_csv, csv_invalid_rows, csv_complete_cases,
    )
}

_SERIES = """
series as (select 'events' as series_id, event_id as pos, value from events
  union all select 'orders', row_number() over (order by o_orderkey) - 1, o_totalprice from orders)"""
# Both series have two decimals, so hundredths are exact integers. The search is a recursion over positions: r holds the last four values
# that were no repeats, u and e the shapes of the differences that led to them, a the place of the oldest.
_SHAPES = "list_transform(list_transform(s.r, lambda y: s.h[s.n] - y), lambda d: {'d': d, 'u': case when d % 100 = 0 then 0 when d % 10 = 0 then 1 else 2 end, 'e': case when d = 0 then -1023 else cast(floor(log2(abs(d) / 100.0)) as int) end})"
_BITS = "greatest(0, least(52, case when z.e < 0 then z.e - cast(floor(-z.u * 3.3219280948873626) as int) else z.e + cast(ceil(z.u * 3.3219280948873626) as int) end))"
_SYMBOLS = f"""{_SERIES},
lists as (select series_id, list(cast(round(value * 100) as bigint) order by pos) as h, count(*) as total from series group by series_id),
walk as (select series_id, h, total, 1::bigint as n, [10, 10, 10, 10]::bigint[] as r, [1, 1, 1, 1]::int[] as u, [-4, -4, -4, -4]::int[] as e, 0 as a, null::struct(zero boolean, sign int, du int, de int) as symbol from lists
  union all select series_id, h, total, n + 1,
    case when m is null then r else list_transform(range(1, 5), lambda i: case when i = a + 1 then h[n] else r[i] end) end,
    case when m is null then u else list_transform(range(1, 5), lambda i: case when i = a + 1 then m.u else u[i] end) end,
    case when m is null then e else list_transform(range(1, 5), lambda i: case when i = a + 1 then m.e else e[i] end) end,
    case when m is null then a else (a + 1) % 4 end,
    case when m is null then {{'zero': true, 'sign': null, 'du': null, 'de': null}} else {{'zero': false, 'sign': case when m.d < 0 then 1 else 0 end, 'du': m.u - m.u0, 'de': m.e - m.e0}} end
  from (select series_id, h, total, n, r, u, e, a, case when list_contains(r, h[n]) then null else list_sort(list_transform(range(0, 4), lambda i: {{
      'cost': case when abs(x[(a + i) % 4 + 1].u - u[(a + i) % 4 + 1]) > 3 then 7 else 3 end + case when abs(x[(a + i) % 4 + 1].e - e[(a + i) % 4 + 1]) > 3 then 14 else 3 end + b[(a + i) % 4 + 1],
      'i': i, 'd': x[(a + i) % 4 + 1].d, 'u': x[(a + i) % 4 + 1].u, 'e': x[(a + i) % 4 + 1].e, 'u0': u[(a + i) % 4 + 1], 'e0': e[(a + i) % 4 + 1]}}))[1] end as m
    from (select s.*, list_transform(x, lambda z: {_BITS}) as b from (select s.*, {_SHAPES} as x from walk s where s.n <= s.total) s) s) t),
symbols as (select series_id, (n - 2) // {BLOCK} as block_id, n - 2 as pos, symbol.zero as is_zero, symbol.sign as sign, symbol.du as delta_u, symbol.de as delta_e from walk where n > 1),
counts as (select series_id, sign, delta_u, delta_e, count(*) as count from symbols where not is_zero group by all),
ranked as (select *, row_number() over (partition by series_id order by count desc, sign, delta_u, delta_e) as rank,
  sum(count) over (partition by series_id) as total,
  1 + case when abs(delta_u) > 3 then 7 else 3 end + case when abs(delta_e) > 3 then 14 else 3 end as key_bits from counts),
bcounts as (select series_id, block_id, sign, delta_u, delta_e, count(*) as count from symbols where not is_zero group by all),
branked as (select *, row_number() over (partition by series_id, block_id order by count desc, sign, delta_u, delta_e) as rank,
  1 + case when abs(delta_u) > 3 then 7 else 3 end + case when abs(delta_e) > 3 then 14 else 3 end as key_bits from bcounts),
ent as (select series_id, count(*) as distinct_keys, -sum(count * 1.0 / total * log2(count * 1.0 / total)) as entropy from ranked group by series_id)"""
_STABILITY = """, ks as (select unnest([16, 32]) as k),
prev as (select series_id, block_id + 1 as block_id, k, sign, delta_u, delta_e from branked, ks where rank <= k),
psize as (select series_id, block_id, k, count(*) as prev_size from prev group by all),
hit as (select b.series_id, b.block_id, b.k, sum(b.count) as symbols, sum(case when p.sign is not null then b.count else 0 end) as hits,
  count(case when p.sign is not null and rank <= b.k then 1 end) as shared, count(case when rank <= b.k then 1 end) as top,
  sum(case when p.sign is not null then b.count * key_bits else 0 end) as saved
  from (select * from branked, ks) b left join prev p on b.series_id = p.series_id and b.block_id = p.block_id and b.k = p.k and b.sign = p.sign and b.delta_u = p.delta_u and b.delta_e = p.delta_e
  group by b.series_id, b.block_id, b.k),
stability as (select h.series_id, h.block_id, h.k, cast(symbols as bigint) as symbols, case when prev_size is not null then hits * 1.0 / symbols end as previous_hit_rate,
  case when prev_size is not null then shared * 1.0 / (top + prev_size - shared) end as jaccard,
  case when prev_size is not null then (saved - symbols * ceil(log2(h.k + 2)) - 21 - 17 * prev_size) * 1.0 / symbols end as net_savings_bits_per_symbol
  from hit h left join psize s on h.series_id = s.series_id and h.block_id = s.block_id and h.k = s.k)"""


def _with(select: str, more: str = "") -> str:
    return f"with recursive {_SYMBOLS.strip()}{more} {select}"


_AGGREGATE = "select count(*) as n, round(cast(sum(cast(value as decimal(18,2))) as double), 2) as sum_value, round(cast(sum(cast(value as decimal(18,2))) as double) / count(*), 6) as avg_value, min(value) as min_value, max(value) as max_value from events where event_id >= 100 and event_id < 950"
_ROUNDTRIP = "select event_id as pos, value from events"

ORACLES: dict[str, str] = {
    "window_roundtrip": _ROUNDTRIP,
    "window_roundtrip_prices": f"select row_number() over (order by {', '.join(LINE_ORDER)}) - 1 as pos, l_extendedprice as value from lineitem",
    "window_index": "select event_id // 128 as window_id, min(event_id) as start_pos, max(event_id) + 1 as end_pos, count(*) as cnt, min(value) as min_value, max(value) as max_value, arg_min(value, event_id) as first_value from events group by 1",
    "prefix_sums": "select event_id // 128 as window_id, count(*) as cnt, (event_id // 128) * 128 as records_before from events group by 1, 3",
    "total_records": "select 'events' as series_id, count(*) as n from events",
    "locate": "select cast(777 // 128 as bigint) as window_id, cast(777 % 128 as bigint) as \"offset\"",
    "point_lookup": _ROUNDTRIP + " where event_id in (0, 127, 128, 999)",
    "range_values": _ROUNDTRIP + " where event_id >= 100 and event_id < 600",
    "range_aggregate": _AGGREGATE,
    "range_aggregate_stats": _AGGREGATE,
    "range_decimals": "select event_id as pos, case when value = trunc(value) then cast(cast(value as decimal(18,1)) as varchar) else rtrim(cast(cast(value as decimal(18,2)) as varchar), '0') end as value from events where event_id >= 100 and event_id < 600",
    "range_exact_sum": "select count(*) as n, rtrim(rtrim(cast(sum(cast(value as decimal(18,2))) as varchar), '0'), '.') as sum from events where event_id >= 100 and event_id < 600",
    "window_partials": "select event_id // 128 as window_id, count(*) as decoded, count(case when event_id >= 100 and event_id < 950 then 1 end) as selected, min(case when event_id >= 100 and event_id < 950 then value end) as min_value, max(case when event_id >= 100 and event_id < 950 then value end) as max_value from events where event_id // 128 <= 949 // 128 group by 1",
    "append_records": _ROUNDTRIP + " union all select (select count(*) from events), 3.5 union all select (select count(*) + 1 from events), -4.25",
    "delete_to_empty": "select row_number() over (order by event_id) - 1 as pos, value from events where event_id not between 128 and 255",
    "bucket_index": "select 'events' as series_id, event_id // 524288 as bucket, count(*) as cnt, count(distinct event_id // 128) as windows, min(event_id) as start_pos, max(event_id) + 1 as end_pos from events group by 2",
    "update_records": "select event_id as pos, case event_id when 5 then -1.5 when 128 then cast('0.1234567890123456' as double) when 900 then 0.0 else value end as value from events",
    "insert_records": "select case when event_id >= 128 then event_id + 2 else event_id end as pos, value from events union all select 128, 7.25 union all select 129, 8.25",
    "delete_records": "select row_number() over (order by event_id) - 1 as pos, value from events where event_id not in (127, 500)",
    "zero_residual_count": "with w as (select value, event_id, first_value(value) over (partition by event_id // 128 order by event_id) as f from events) select cast(sum(case when value = f and event_id % 128 <> 0 then 1 else 0 end) as bigint) as n_zero, cast(0 as bigint) as n_raw from w",
    "decimal_places_hist": f"with {_SERIES.strip()} select series_id, cast(case when round(value * 100) % 100 = 0 then 0 when round(value * 100) % 10 = 0 then 1 else 2 end as int) as places, count(*) as n from series group by all",
    "exponent_hist": f"with {_SERIES.strip()} select series_id, cast(floor(log2(abs(value))) as int) as e, count(*) as n from series where value <> 0 group by all",
    "key_distribution": _with("select series_id, cast(rank as int) as rank, sign, delta_u, delta_e, count, round(count * 1.0 / total, 9) as probability, round(sum(count) over (partition by series_id order by rank) * 1.0 / total, 9) as cumulative_coverage from ranked"),
    "topk_coverage": _with(
        ", ".join([
            "select series_id, k, cast(sum(case when rank <= k then count else 0 end) as bigint) as covered", "cast(max(total) as bigint) as total", "round(sum(case when rank <= k then count else 0 end) * 1.0 / max(total), 9) as coverage",
            "cast(greatest(1, ceil(log2(k + 2))) as int) as code_bits",
            "cast(sum(case when rank <= k then count * key_bits else 0 end) - max(total) * greatest(1, ceil(log2(k + 2))) - 21 - 17 * count(case when rank <= k then 1 end) as bigint) as net_savings_bits",
            "round((sum(case when rank <= k then count * key_bits else 0 end) - max(total) * greatest(1, ceil(log2(k + 2))) - 21 - 17 * count(case when rank <= k then 1 end)) * 1.0 / max(total), 9) as savings_bits_per_symbol",
        ])
        + " from ranked, (select unnest([1,2,4,8,16,32,64,128,256]) as k) group by series_id, k"
    ),
    "pooled_counts": _with("select 'dataset' as scope, series_id, sign, delta_u, delta_e, count from counts union all select 'global', 'ALL', sign, delta_u, delta_e, cast(sum(count) as bigint) from counts group by sign, delta_u, delta_e"),
    "key_entropy": _with("select series_id, distinct_keys, round(entropy, 6) as entropy, round(pow(2, entropy), 6) as effective_keys, round(case when distinct_keys > 1 then entropy / log2(distinct_keys) else 0 end, 6) as normalized_entropy from ent"),
    "block_counts": _with('select series_id, block_id, count(*) as "values", count(case when is_zero then 1 end) as zeros, count(distinct case when not is_zero then (sign, delta_u, delta_e) end) as distinct_keys from symbols group by series_id, block_id'),
    "block_stability": _with("select series_id, block_id, k, symbols, round(previous_hit_rate, 9) as previous_hit_rate, round(jaccard, 9) as jaccard, round(net_savings_bits_per_symbol, 9) as net_savings_bits_per_symbol from stability", _STABILITY),
    "centred_region": _with(
        "select series_id, target, ulp_radius, exponent_radius, cast(cells as bigint) as cells, cast(covered as bigint) as covered, cast(total as bigint) as total, round(covered * 1.0 / total, 9) as actual_coverage from best where k = 1",
        """, c as (select series_id, abs(delta_u) as au, abs(delta_e) as ae, sum(count) as n from counts group by all),
within as (select c.series_id, r.u, c.ae, sum(c.n) as n from c join (select distinct series_id, au as u from c) r on r.series_id = c.series_id and c.au <= r.u group by all),
upto as (select series_id, u, ae, sum(n) over (partition by series_id, u order by ae) as covered from within),
ok as (select upto.*, t.total, g.target, row_number() over (partition by upto.series_id, g.target, u order by ae) as first from upto
  join (select series_id, sum(n) as total from c group by series_id) t on t.series_id = upto.series_id, (select unnest([0.9::double, 0.95::double, 0.99::double]) as target) g where covered >= ceil(g.target * t.total)),
best as (select series_id, target, u as ulp_radius, ae as exponent_radius, 2 * (2 * u + 1) * (2 * ae + 1) as cells, covered, total,
  row_number() over (partition by series_id, target order by 2 * (2 * u + 1) * (2 * ae + 1), covered desc, u) as k from ok where first = 1)""",
    ),
    "codebook_choice": _with(
        "select series_id, block_id, cast(case when net > 0 then bits else 0 end as int) as code_bits, case when net > 0 then entries else 0 end as entries, cast(case when net > 0 then net else 0 end as bigint) as net_savings_bits from best where k = 1",
        """, nets as (select series_id, block_id, bits, count(case when rank <= (1 << bits) - 2 then 1 end) as entries,
  sum(case when rank <= (1 << bits) - 2 then count * key_bits else 0 end) - sum(count) * bits - 21 - 17 * count(case when rank <= (1 << bits) - 2 then 1 end) as net
  from branked, (select unnest(range(2, 16)) as bits) group by series_id, block_id, bits),
best as (select *, row_number() over (partition by series_id, block_id order by net desc, bits) as k from nets)""",
    ),
    "dataset_summary": _with(
        """select b.series_id, "values", zeros, blocks, "values" - zeros as symbols, round(zeros * 1.0 / "values", 6) as zero_rate, distinct_keys, round(entropy, 6) as entropy, round(pow(2, entropy), 6) as effective_keys,
  round(case when distinct_keys > 1 then entropy / log2(distinct_keys) else 0 end, 6) as normalized_entropy, cast(0 as bigint) as invalid_rows, """
        + ", ".join(f"round(top{k}, 6) as top{k}_coverage" for k in transitions.SUMMARY_K)
        + """
  from (select series_id, count(*) as "values", count(case when is_zero then 1 end) as zeros, count(distinct block_id) as blocks from symbols group by series_id) b join ent using (series_id)
  join (select series_id, """
        + ", ".join(f"sum(case when rank <= {k} then count else 0 end) * 1.0 / max(total) as top{k}" for k in transitions.SUMMARY_K)
        + """ from ranked group by series_id) t using (series_id)"""
    ),
    "global_summary": _with(
        "select metric, round(value, 6) as value from one unpivot (value for metric in (datasets, \"values\", zeros, distinct_keys, entropy, effective_keys, normalized_entropy, pooled_hit_rate, pooled_hit_rate_32, pooled_net_savings, pooled_net_savings_32))",
        _STABILITY
        + """, g as (select sign, delta_u, delta_e, sum(count) as n from counts group by all),
ge as (select count(*) as k, -sum(n * 1.0 / t * log2(n * 1.0 / t)) as h from (select n, sum(n) over () as t from g)),
one as (select cast(count(distinct series_id) as double) as datasets, cast(count(*) as double) as "values", cast(count(case when is_zero then 1 end) as double) as zeros,
  cast((select k from ge) as double) as distinct_keys, (select h from ge) as entropy, pow(2, (select h from ge)) as effective_keys, (select h / log2(k) from ge) as normalized_entropy,
  cast((select sum(previous_hit_rate * symbols) / sum(case when previous_hit_rate is not null then symbols end) from stability where k = 16) as double) as pooled_hit_rate, cast((select sum(previous_hit_rate * symbols) / sum(case when previous_hit_rate is not null then symbols end) from stability where k = 32) as double) as pooled_hit_rate_32, cast((select sum(net_savings_bits_per_symbol * symbols) / sum(case when net_savings_bits_per_symbol is not null then symbols end) from stability where k = 16) as double) as pooled_net_savings, cast((select sum(net_savings_bits_per_symbol * symbols) / sum(case when net_savings_bits_per_symbol is not null then symbols end) from stability where k = 32) as double) as pooled_net_savings_32 from symbols)""",
    ),
    "transition_symbols": _with("select series_id, block_id, pos, is_zero, coalesce(sign, 0) as sign, coalesce(delta_u, 0) as delta_u, coalesce(delta_e, 0) as delta_e from symbols"),
    "top_keys": _with("select series_id, sign, delta_u, delta_e, count, cast(rank as int) as rank from ranked where rank <= 32"),
    "heat_map": _with("select delta_u, " + ", ".join(f"cast(sum(case when delta_e = {e} then count else 0 end) as bigint) as e{'m' if e < 0 else ''}{abs(e)}" for e in range(-3, 4)) + " from counts where abs(delta_u) <= 3 and abs(delta_e) <= 3 group by delta_u"),
    "codec_roundtrip": "select 'events' as series_id, codec, n as records, n as decoded_records, cast(0 as bigint) as mismatches, cast(0 as bigint) as zero_sign_differences, 'PASS_RAW_BITS' as status from (select unnest(['xor','look_back','erased','decimal','window']) as codec), (select count(*) as n from events)",
    "decoded_export": "select 'events' as series_id, event_id as pos, value from events",
    "strict_csv": "select event_id, value from events",
    "csv_invalid_rows": "select count(*) as rows, count(*) filter (where event_id % 7 = 0 or event_id % 11 = 0) as invalid_rows from events",
    "csv_complete_cases": "select event_id, value from events where event_id % 7 <> 0 and event_id % 11 <> 0",
    "shuffled_series": "select value, count(*) as n from events group by value",
}
