"""Derivations over streams: row formulas as they are, grouped ones in event-time windows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.compile import formula


def derived(stream: DataFrame, targets: Mapping[str, str], **bound) -> DataFrame:
    """stream with a column for each formula; they must not group rows."""
    return stream.withColumns({name: formula(stream, text, **bound) for name, text in targets.items()})


def windowed_max(stream: DataFrame, time: str, keys: list[str], value: str, size: str, late: str) -> DataFrame:
    """The largest value of each key in each window; rows later than `late` no longer count."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.max(value).alias("value"), F.count("*").alias("rows"))


def latest_state(stream: DataFrame, time: str, key: str, late: str) -> DataFrame:
    """The first row of each key and time, as jobs are reported again and again."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key, time])
