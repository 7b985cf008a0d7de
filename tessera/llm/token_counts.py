"""Exact token counts at every prefix (operator 5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import prefix_counter
from tessera.llm.common import sliced

VOCABULARY = "byte_bpe_50k.json"


def prefix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_tokens`` and ``steps``.

    ``steps`` holds one signed byte per character; its running sum is the exact token count of the prefix that ends at that
    character (see ``count_at`` and ``longest_prefix``). Null texts count as empty (0 bytes, 0 tokens, no steps); null
    ids, repeated rows and ties pass through; an empty table gives an empty table; other columns are not carried.
    """

    def run(batches):
        counter = prefix_counter(vocabulary)
        for b in sliced(batches):
            texts = [t or "" for t in b.column(1).to_pylist()]
            got = [counter.prefixes(t) for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.binary())],
                names=[id_col, "n_bytes", "n_tokens", "steps"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, steps binary")


def count_at(steps: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` characters, from the stored steps alone."""

    @F.pandas_udf("long")
    def at(s, n):
        return s.combine(n, lambda x, k: int(np.frombuffer(x, "i1")[: int(k)].sum(dtype=np.int64)))

    return at(steps, n_chars)


def longest_prefix(steps: Column, budget: Column) -> Column:
    """The most characters that fit in ``budget`` tokens (the longest prefix whose count is within it)."""

    @F.pandas_udf("long")
    def fit(s, b):
        def one(x, most):
            ok = np.flatnonzero(np.cumsum(np.frombuffer(x, "i1"), dtype=np.int64) <= int(most))
            return int(ok[-1]) + 1 if len(ok) else 0

        return s.combine(b, one)

    return fit(steps, budget)


def token_report(docs: DataFrame, limit: int = 512, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the text goes over ``limit`` tokens; null texts are empty."""
    return prefix_counts(docs, vocabulary=vocabulary).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
