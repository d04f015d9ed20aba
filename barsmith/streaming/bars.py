"""Bars from a stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barsmith.operators.bars import ohlc


def streamed_ohlc(ticks: DataFrame, minutes: int, late: str = "10 minutes", tie: str = "tick_id") -> DataFrame:
    """ohlc over a stream (instrument, ts, price, volume, tick_id): a bar comes out when no tick can be late for it."""
    return ohlc(ticks.withWatermark("ts", late), minutes, tie)
