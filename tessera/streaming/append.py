"""Streams of values into window rows: an open window per series is the state, a row leaves when the window is full."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.windows import FIELDS, WINDOW, encode_window

OUT = f"series_id string, window_id long, {FIELDS}, start_pos long, end_pos long"
STATE = "next_window long, held array<double>"


def stream_windows(stream: DataFrame, order: str = "ts", window: int = WINDOW) -> DataFrame:
    """A stream (series_id, ``order``, value) to window rows, in append mode.

    Values of a series are numbered as they come, by ``order`` within a micro-batch. Only full windows leave; what is
    left in the state when a stream ends is fewer than ``window`` values a series and stays in the checkpoint for the next run.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        next_window, held = state.get if state.exists else (0, [])
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        values = np.array([*held, *rows["value"]], np.float64)
        full = len(values) // window
        out = []
        for k in range(full):
            first = (next_window + k) * window
            out.append({"series_id": key[0], "window_id": next_window + k, **encode_window(values[k * window : (k + 1) * window]), "start_pos": first, "end_pos": first + window})
        state.update((next_window + full, values[full * window :].tolist()))
        if out:
            yield pd.DataFrame(out)

    return stream.select("series_id", order, "value").groupBy("series_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")


def event_windows(stream: DataFrame, ts: str = "ts", size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Count, sum, least and largest value by series and event-time window, with late rows up to ``late`` behind."""
    marked = stream.withWatermark(ts, late)
    return marked.groupBy("series_id", F.window(ts, size).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))
