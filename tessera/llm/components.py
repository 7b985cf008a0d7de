"""Connected components of a link table by alternating star contraction, in joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import drop_staged, stage


LINKS_PER_FILE = 200_000


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: longs, any direction) to (node, root): the least node of its component, for every node with a link.

    Each round turns every node's neighbours to the least among them, first the larger ones, then the smaller; a round
    shuffles the links and writes them to the shared folder, so a lost executor costs no more than that. Rounds grow with the
    logarithm of the longest path. The driver sees counts only.
    """
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        files = max(1, edges.count() // LINKS_PER_FILE)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least", files=files)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = stage(large, "large", files=files)
        least2 = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least", files=files)
        small = large.join(least2, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = stage(small.select("e.a", "e.b").where("a <> b").distinct(), "links", files=files)
        for x in (edges, least, large, least2):
            drop_staged(x)
        edges = after
        # Done when every node has one neighbour below it and no such neighbour has one itself.
        roots = edges.select(F.col("b").alias("a")).distinct()
        if not edges.join(roots, "a", "left_semi").limit(1).count() and not edges.groupBy("a").count().where("count > 1").limit(1).count():
            out = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select(F.col("a").alias("node"), F.col("a").alias("root")))
            return stage(out, "roots", files=files)
