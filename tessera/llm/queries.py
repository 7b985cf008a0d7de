"""Registered queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import ann, chunk_store, decontaminate, html_extract, ngram_join, packing, quality, secrets, sharding, token_counts
from tessera.llm.common import shared_dir


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_classes(_docs(spark, sf_dir))


def op2_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(_docs(spark, sf_dir))


def op3_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_small_world_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_report(_docs(spark, sf_dir))


def op6_zstd_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_docs(spark, sf_dir))


def op7_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir))


def op8_content_addressed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tessera/store-{uuid.uuid4().hex}"
    chunk_store.write_store(_docs(spark, sf_dir), path)
    return chunk_store.with_starts(chunk_store.read_store(spark, path))


def op9_dom_tree_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_benchmark_hash_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.report(_docs(spark, sf_dir), benchmark).drop("key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_signature_tree_join": op1_signature_tree_join,
    "op2_weighted_hash_tree": op2_weighted_hash_tree,
    "op3_factorisation_machine": op3_factorisation_machine,
    "op4_small_world_graph": op4_small_world_graph,
    "op5_prefix_token_counts": op5_prefix_token_counts,
    "op6_zstd_secret_scan": op6_zstd_secret_scan,
    "op7_complement_packing": op7_complement_packing,
    "op8_content_addressed_ids": op8_content_addressed_ids,
    "op9_dom_tree_model": op9_dom_tree_model,
    "op10_benchmark_hash_set": op10_benchmark_hash_set,
}


def _tree_sql() -> tuple[str, str]:
    """The edges of both trees (grown or not, parent, child, load) and their leaves, as VALUES."""
    edges, ends = [], []
    for grown, tree in ((0, sharding.topology(16)), (1, sharding.topology(17))):
        todo = [tree]
        while todo:
            node = todo.pop()
            edges += [f"({grown}, '{node.name}', '{c.name}', {float(c.load)}::double)" for c in node.children]
            todo += node.children
        ends += [f"({grown}, '{name}', {shard})" for name, shard in sharding.leaves(tree).items()]
    return ", ".join(edges), ", ".join(ends)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_LEVEL = """{name} as (select doc_id, n, grown, child as at from (select p.*, e.child, row_number() over (partition by n, p.grown order by -ln((('0x' || substr(md5(concat(coalesce(doc_id::varchar, 'null'), '|', e.child)), 1, 12))::bigint::double + 0.5) / 281474976710656) / e.load, e.child) as k
  from {before} p join edges e on e.grown = p.grown and e.parent = p.at) where k = 1)"""

ORACLES: dict[str, str] = {
    "op1_signature_tree_join": rf"""with recursive w as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as s from w),
x as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b from x a join x b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r as (select doc_id as node, doc_id as seen from s union select r.node, p.b from r join p on p.a = r.seen)
select s.doc_id, len(s.s) as n_shingles, min(r.seen) as component_id from s join r on r.node = s.doc_id group by s.doc_id, len(s.s)""",
    "op2_weighted_hash_tree": f"""with crc_table as (select list(e order by i) as tab from (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as e from range(256) r(i))),
b as (select doc_id, row_number() over () as n, coalesce(text, '') as text from documents),
y as (select *, list_transform(regexp_extract_all(hex(text), '..'), lambda x: ('0x' || x)::bigint) as bytes from b),
c as (select doc_id, n, strlen(text) + 1 as size, xor(list_reduce(list_prepend(4294967295::bigint, bytes), lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) as text_crc32 from y, crc_table),
edges as (select * from (values {_tree_sql()[0]}) t(grown, parent, child, load)), ends as (select * from (values {_tree_sql()[1]}) t(grown, leaf, shard)),
l0 as (select doc_id, n, grown, '' as at from b, (values (0), (1)) g(grown)),
{_LEVEL.format(name="l1", before="l0")}, {_LEVEL.format(name="l2", before="l1")}, {_LEVEL.format(name="l3", before="l2")},
s as (select l.n, max(case when l.grown = 0 then e.shard end) as shard, max(case when l.grown = 1 then e.shard end) as grown_shard from l3 l join ends e on e.grown = l.grown and e.leaf = l.at group by l.n)
select c.doc_id, c.size, c.text_crc32, 'key' as law, cast(s.shard as int) as shard, row_number() over (partition by s.shard order by ('0x' || substr(md5(concat(coalesce(doc_id::varchar, 'null'), '|', text_crc32, '|', size)), 1, 8))::bigint % {sharding.SLOT_BUCKETS}, doc_id, text_crc32, size) - 1 as slot,
cast(s.grown_shard as int) as grown_shard from c join s on s.n = c.n""",
    "op4_small_world_graph": """with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
d as (select a.vec_id as query_id, b.vec_id, sqrt(list_reduce(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda s, x: s + x)) as score from v a, v b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score, vec_id) as int) as rank, vec_id, score from d qualify row_number() over (partition by query_id order by score, vec_id) <= 10""",
    "op10_benchmark_hash_set": f"""with d as (select doc_id, {_WORDS} as w from documents), b as (select item_id::varchar as item, {_WORDS} as w from benchmark),
g as (select distinct item, least(len(w), 13) as size, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) as gram from b where len(w) > 0),
sizes as (select distinct size from g), a as (select doc_id, size, w, unnest(range(1, len(w) - size + 2)) as pos from d, sizes where len(w) >= size),
h as (select a.doc_id, a.pos, a.size, g.item from a join g on g.size = a.size and g.gram = array_to_string(a.w[a.pos:a.pos + a.size - 1], ' ')),
hw as (select doc_id, count(distinct u) as n_hit from (select doc_id, unnest(range(pos, pos + size)) as u from h) group by doc_id),
hi as (select doc_id, count(distinct item) as n_items, sha256(array_to_string(list_sort(list(distinct item)), ',')) as sha from h group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(sha, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join hw using (doc_id) left join hi using (doc_id)""",
}
