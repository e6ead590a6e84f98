"""Windowed metrics over streams; the same functions work on static frames. An extension: batch windows are tumbling only."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, time_col: str, late: str | None) -> DataFrame:
    return df.withWatermark(time_col, late) if late and df.isStreaming else df


def tumbling(df: DataFrame, time_col: str, size: str, keys: Sequence[str], aggs: Sequence[Column], late: str | None = "1 hour") -> DataFrame:
    """Aggregates by keys and window; rows later than `late` behind the newest are left out of a stream."""
    out = _late(df, time_col, late).groupBy(F.window(time_col, size), *keys).agg(*aggs)
    return out.select("window.start", "window.end", *[c for c in out.columns if c != "window"])


def sessions(df: DataFrame, time_col: str, gap: str, keys: Sequence[str], aggs: Sequence[Column], late: str | None = "1 hour") -> DataFrame:
    """Aggregates by keys and session: events no further apart than the gap."""
    out = _late(df, time_col, late).groupBy(F.session_window(time_col, gap), *keys).agg(*aggs)
    return out.select("session_window.start", "session_window.end", *[c for c in out.columns if c != "session_window"])


def consecutive_dedup(df: DataFrame, key: str, event: str, time_col: str) -> DataFrame:
    """Of a stream of events, those that differ from the one before of their key, as they come. State: one event a key."""
    kinds = dict(df.dtypes)
    schema = f"{key} {kinds[key]}, {time_col} {kinds[time_col]}, {event} {kinds[event]}"

    def keep(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for pdf in frames:
            pdf = pdf.sort_values(time_col)
            before = pdf[event].shift().fillna(last if last is not None else "")
            last = pdf[event].iloc[-1]
            yield pdf.loc[pdf[event] != before, [key, time_col, event]]
        state.update((last,))

    return df.select(key, time_col, event).groupBy(key).applyInPandasWithState(keep, schema, f"last {kinds[event]}", "append", "NoTimeout")
