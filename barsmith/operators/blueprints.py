"""Blueprints: recurring placements of winning stops and targets, and how often each bar has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.functions.positioning import LEVELS
from barsmith.operators.bars import KEYS


def _bin(value: Column, kind: str) -> Column:
    return (F.floor(value * 10) if kind == "Pct" else F.floor(value / 5) * 5).cast("int")


def blueprint_rows(enriched: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """One row for each outcome and blueprint it belongs to; bins outside the ranges (20 tenths, 50 basis points) go.

    All levels and kinds are unpivoted in one pass: type, level, bin, and the ratio of the other side in units of 0.0001.
    """
    levels = levels or [c for c in LEVELS if f"sl_place_pct_to_{c}" in enriched.columns]
    parts = []
    for c in levels:
        for side, other in (("sl", "tp"), ("tp", "sl")):
            for kind, column, most in (("Pct", f"{side}_place_pct_to_{c}", 20), ("BPS", f"{side}_dist_to_{c}_bps", 50)):
                b = _bin(F.col(column), kind)
                item = F.struct(F.lit(f"{side.upper()}-{kind}").alias("type"), F.lit(c).alias("level"), b.alias("bin"), F.col(other).cast("int").alias("ratio"))
                parts.append(F.when(b.between(-most, most), item))
    at = [c for c in ("entry_time", "entry_idx") if c in enriched.columns]
    return enriched.select(*KEYS, *at, F.inline(F.array_compact(F.array(*parts))))


def blueprint_counts(enriched: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """trade_count of each (blueprint, entry_time): one aggregation for all kinds."""
    rows = blueprint_rows(enriched, levels)
    return rows.groupBy(*KEYS, "type", "level", "bin", "ratio", "entry_time").agg(F.count(F.lit(1)).alias("trade_count"))


def keyed(counts: DataFrame) -> DataFrame:
    """Adds key: the first 16 hex digits of SHA-256 of the blueprint's parts, from integers and names only."""
    sl_first = F.col("type").startswith("SL")
    own, other = F.concat_ws("-", "level", F.col("bin").cast("string")), F.concat_ws("-", F.lit("ratio"), F.col("ratio").cast("string"))
    text = F.concat_ws("-", "instrument", F.col("timeframe").cast("string"), "type", F.when(sl_first, F.concat_ws("-", own, other)).otherwise(F.concat_ws("-", other, own)))
    return counts.withColumn("key", F.substring(F.sha2(text, 256), 1, 16))


def targets(counts: DataFrame) -> DataFrame:
    """(key, entry_time, trade_count)."""
    return keyed(counts).select("key", *KEYS, "entry_time", "trade_count")


def combinations(counts: DataFrame) -> DataFrame:
    """One row for each blueprint with its definition in typed columns and num_candles, the bars that have it."""
    return defined(counts.groupBy(*KEYS, "type", "level", "bin", "ratio").agg(F.count(F.lit(1)).alias("num_candles")))


def defined(groups: DataFrame) -> DataFrame:
    """Combinations from (KEYS, type, level, bin, ratio, num_candles)."""
    sl = F.col("type").startswith("SL")
    return keyed(groups).select(
        "key", *KEYS, "type",
        F.when(sl, F.col("level")).alias("sl_level"), F.when(~sl, F.col("ratio") / 10_000).alias("sl_ratio"), F.when(sl, F.col("bin")).alias("sl_bin"),
        F.when(~sl, F.col("level")).alias("tp_level"), F.when(sl, F.col("ratio") / 10_000).alias("tp_ratio"), F.when(~sl, F.col("bin")).alias("tp_bin"),
        "num_candles",
    )


def with_definitions(strategies: DataFrame) -> DataFrame:
    """Typed columns from the text columns sl_def and tp_def: a number is a ratio, other text a level."""
    for side in ("sl", "tp"):
        if f"{side}_def" in strategies.columns:
            text = F.trim(F.col(f"{side}_def").cast("string"))
            ratio = F.expr(f"try_cast(trim(cast({side}_def as string)) as double)")
            strategies = strategies.withColumns({f"{side}_ratio": ratio, f"{side}_level": F.when(ratio.isNull() & (text != ""), text)}).drop(f"{side}_def")
    return strategies


def write_bucketed(found: DataFrame, table: str, on: list[str], buckets: int) -> None:
    """A catalog table dealt and sorted by `on`, so that later joins and aggregations on those columns need no shuffle of it."""
    found.write.mode("overwrite").format("parquet").bucketBy(buckets, *on).sortBy(*on).saveAsTable(table)


def write_targets(found: DataFrame, path: str) -> None:
    """All targets as one table, rows of a key together and in time order."""
    found.repartition("key").sortWithinPartitions("key", "entry_time").write.mode("overwrite").parquet(path)
