"""Where stops and targets lie relative to price levels, and levels made relative to price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.operators.bars import KEYS

#: The level columns of a feature frame.
LEVELS = (
    "support", "resistance", "SMA_20", "SMA_50", "SMA_100", "SMA_200", "EMA_8", "EMA_13", "EMA_21", "EMA_50",
    "BB_upper_20", "BB_lower_20", "ATR_level_up_1x_14", "ATR_level_down_1x_14",
)


def levels_of(columns: list[str]) -> list[str]:
    return [c for c in LEVELS if c in columns]


def enriched(outcomes: DataFrame, features: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """Outcomes with four columns for each level: distances of stop and target in basis points of the close, and placements.

    Joined on the entry time; outcomes without features go. Zero denominators give NULL.
    """
    levels = levels or levels_of(features.columns)
    f = features.select(*KEYS, F.col("time").alias("entry_time"), F.col("close").alias("_close"), *(F.col(c).alias(f"_{c}") for c in levels))
    joined = outcomes.join(f, [*KEYS, "entry_time"])
    new = {}
    for side in ("sl", "tp"):
        price = F.col(f"{side}_price")
        for c in levels:
            new[f"{side}_dist_to_{c}_bps"] = F.try_divide(price - F.col(f"_{c}"), F.col("_close")) * 10_000
            new[f"{side}_place_pct_to_{c}"] = F.try_divide(price - F.col("_close"), F.col(f"_{c}") - F.col("_close"))
    return joined.withColumns(new).drop("_close", *(f"_{c}" for c in levels))


def level_price(entry: Column, level: Column, kind: Column, place: Column) -> Column:
    """Price at the middle of a bin: kind Pct counts tenths of the way to the level, BPS steps of 5 basis points from it."""
    return F.when(kind.endswith("Pct"), entry + (level - entry) * (place + 0.5) / 10).otherwise(level + entry * (place + 2.5) / 10_000)


def price_relative(features: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """Levels become (level - close) / close, named <level>_dist_norm; prices and volume go."""
    levels = levels or levels_of(features.columns)
    new = features.withColumns({f"{c}_dist_norm": F.try_divide(F.col(c) - F.col("close"), F.col("close")) for c in levels})
    return new.drop(*levels, "open", "high", "low", "close", "volume")
