"""Benchmark decontamination by a broadcast hash set of test n-grams (operator 10), in native DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, stage

N = 13
#: Words are runs of a-z (after lower-casing), digits and everything beyond ASCII.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Most bytes of windows (text, hash and row) that are broadcast; beyond that the join shuffles hashes instead.
MAX_BROADCAST_BYTES = 64 << 20
ROW_BYTES = 64


def words(text: Column) -> Column:
    """The words of a text as an array; null and empty texts have none."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.filter(parts, lambda w: w != "")


def item_windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """A row per item and window in it: ``item``, ``gram`` (its words with a space between) and ``size``; repeats stay."""
    w = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    w = w.withColumn("size", size).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)))
    return w.select("item", "size", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("gram"))


def hits(docs: DataFrame, windows: DataFrame, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Every occurrence of an item window in a document: doc_id, key (a hash of the text), at (word, from 1), size, gram.

    The set of distinct windows is broadcast while it takes at most ``max_broadcast`` bytes; beyond that it's joined by a shuffle, in
    which a word of a document costs its place and a hash.
    """
    grams = windows.select("gram", "size").distinct().withColumn("hash", F.xxhash64(F.split("gram", " ")))
    known = grams.groupBy("size").agg(F.sum(F.octet_length("gram") + ROW_BYTES).alias("bytes")).collect()  # at most n rows
    small = sum(r["bytes"] for r in known) <= max_broadcast
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), words(F.col("text")).alias("w"))
    if not known:
        return rows.select("doc_id", "key", F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit("").alias("gram")).where("false")
    # All sizes in one pass over the texts. The outer form keeps Catalyst from computing the words once more for a filter below.
    at = lambda k: F.sequence(F.lit(1), F.size("w") - (k - 1))
    each = lambda k: F.transform(at(k), lambda i: F.struct(i.alias("at"), F.lit(k).alias("size")))
    places = [F.when(F.size("w") >= r["size"], each(r["size"])) for r in known]
    if len(places) == 1:
        k = known[0]["size"]
        scan = rows.select("doc_id", "key", "w", F.explode_outer(F.when(F.size("w") >= k, at(k))).alias("at"), F.lit(k).alias("size"))
    else:
        scan = rows.select("doc_id", "key", "w", F.explode_outer(F.flatten(F.filter(F.array(*places), lambda x: x.isNotNull()))).alias("p")).select("doc_id", "key", "w", "p.at", "p.size")
    scan = scan.withColumn("hash", F.xxhash64(F.slice("w", F.col("at"), F.col("size"))))
    # Of a text's words only places and hashes go into the join; the few texts with hits are then met again to verify the words.
    places = scan.where("at is not null").select("doc_id", "key", "at", "size", "hash")
    found = places.join(F.broadcast(grams) if small else grams, ["hash", "size"])
    found = found.groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "size", "gram")).alias("found"))
    found = stage(found.withColumnsRenamed({"doc_id": "_d", "key": "_k"}), "candidates")
    weight = found.agg(F.sum(F.aggregate("found", F.lit(0).cast("long"), lambda a, f: a + F.octet_length(f["gram"]) + ROW_BYTES))).first()[0] or 0
    texts = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    back = texts.join(F.broadcast(found) if weight <= max_broadcast else found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")))
    back = back.select("doc_id", "key", words(F.col("text")).alias("w"), "found").select("doc_id", "key", "w", F.explode("found").alias("f"))
    same = F.array_join(F.slice("w", F.col("f.at"), F.col("f.size")), " ") == F.col("f.gram")
    return back.where(same).select("doc_id", "key", "f.*")


def report(docs: DataFrame, benchmark: DataFrame, n: int = N, share: int = 20, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: n_words, n_hit (words inside any hit window), n_items, items_sha256 and contaminated.

    Contaminated means some hit and at least 1 / ``share`` of the words hit. Null and empty texts have no words. Rows with the
    same id and text get the same result; an empty benchmark hits nothing; no other column plays a part.
    """
    windows = item_windows(benchmark, n)
    found = hits(docs, windows, max_broadcast).distinct()
    # A window counts from where the windows before it have ended.
    end = F.col("at") + F.col("size")
    past = F.max(end).over(Window.partitionBy("doc_id", "key").orderBy("at", "size").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("at"), F.coalesce(past, F.lit(0))))
    spans = found.withColumn("fresh", fresh).groupBy("doc_id", "key").agg(F.sum("fresh").alias("n_hit"))
    # Which items: a document's distinct windows meet the items' distinct windows, so neither side is a list.
    items = found.select("doc_id", "key", "gram", "size").distinct().join(windows.distinct(), ["gram", "size"]).select("doc_id", "key", "item").distinct()
    items = items.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list("item")).alias("ids"))
    per = spans.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "n_hit")
    ids = items.select(F.col("doc_id").alias("_di"), F.col("key").alias("_ki"), F.size("ids").alias("n_items"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("sha"))
    per = per.join(ids, F.col("_d").eqNullSafe(F.col("_di")) & (F.col("_k") == F.col("_ki")))
    all_docs = docs.select("doc_id", F.xxhash64("text").alias("key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = all_docs.join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return out.select(
        "doc_id", "key", "n_words", n_hit.alias("n_hit"), F.coalesce(F.col("n_items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.col("sha"), F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = N, share: int = 20) -> DataFrame:
    """``docs`` without its contaminated rows, all columns kept; null and empty texts stay, repeated rows go or stay together."""
    bad = report(docs, benchmark, n, share).where("contaminated").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_d"]) & (F.xxhash64(docs["text"]) == bad["_k"]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """``docs`` with the words of every hit window taken out: texts with hits become their remaining words, joined by a space.

    Texts without hits stay as they are, null and empty ones too; repeated rows are changed alike; other columns stay, whatever they are
    called.
    """
    found = hits(docs, item_windows(benchmark, n)).groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "size")).alias("spans"))
    found = found.select(F.struct(F.col("doc_id").alias("d"), F.col("key").alias("k"), "spans").alias("found"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    out = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("found.d")) & (F.xxhash64("row.text") == F.col("found.k")), "left")
    gone = F.array_distinct(F.flatten(F.transform("found.spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))
    w = words(F.col("row.text"))
    left = F.filter(F.arrays_zip(w.alias("w"), F.sequence(F.lit(1), F.size(w)).alias("i")), lambda x: ~F.array_contains(gone, x["i"]))
    text = F.when(F.col("found").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda x: x["w"]), " "))
    return out.select(*(text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
