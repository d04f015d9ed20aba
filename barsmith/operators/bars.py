"""Price bars: from ticks, numbered, and cut into overlapping blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

KEYS = ["instrument", "timeframe"]
BLOCK = 1024


def ohlc(ticks: DataFrame, minutes: int, tie: str = "tick_id") -> DataFrame:
    """Bars of `minutes` from (instrument, ts, price, volume, tick_id); open and close by time, ties by tick_id."""
    order = F.struct("ts", tie)
    start = F.window("ts", f"{minutes} minutes")["start"]
    bars = ticks.groupBy("instrument", start.alias("time")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("volume").alias("volume"),
    )
    return bars.select("instrument", F.lit(minutes).alias("timeframe"), "time", "open", "high", "low", "close", "volume")


def one_per_time(bars: DataFrame) -> DataFrame:
    """One bar for each time of a market: of several, the one with the greatest volume, then close."""
    rest = [c for c in bars.columns if c not in (*KEYS, "time")]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce("volume", F.lit(0.0)), "close")).alias("_bar")
    return bars.groupBy(*KEYS, "time").agg(best).select(*KEYS, "time", "_bar.*")


def indexed(bars: DataFrame, span: str = "30 days") -> DataFrame:
    """bars with idx, the place of a bar in its market from 0, and n_bars of the market.

    Places are counted within spans of time, and the few counts of spans are summed up, so no task holds a whole series.
    """
    cut = bars.withColumn("_span", F.window("time", span)["start"])
    counts = cut.groupBy(*KEYS, "_span").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*KEYS).orderBy("_span")
    offsets = counts.withColumn("_before", F.sum("_n").over(w) - F.col("_n"))
    offsets = offsets.withColumn("n_bars", F.sum("_n").over(Window.partitionBy(*KEYS))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*KEYS, "_span").orderBy("time")) - 1
    placed = cut.withColumn("_local", local).join(offsets, [*KEYS, "_span"])
    return placed.withColumn("idx", (F.col("_before") + F.col("_local")).cast("long")).drop("_span", "_local", "_before")


def blocked(bars: DataFrame, behind: int = 0, ahead: int = 0, size: int = BLOCK) -> DataFrame:
    """Indexed bars dealt to blocks of `size`, each with `behind` bars before and `ahead` after it as a halo."""
    low = F.floor(F.greatest(F.lit(0), F.col("idx") - ahead) / size)
    high = F.floor(F.least(F.col("n_bars") - 1, F.col("idx") + behind) / size)
    return bars.withColumn("block", F.explode(F.sequence(low, high)))


def in_block(size: int = BLOCK) -> Column:
    """True for the bars that a block is responsible for."""
    return F.col("block") == F.floor(F.col("idx") / size)


def block_window() -> WindowSpec:
    return Window.partitionBy(*KEYS, "block").orderBy("idx")


def unblocked(frame: DataFrame, size: int = BLOCK) -> DataFrame:
    return frame.filter(in_block(size)).drop("block")


# Stop-loss and take-profit ratios in units of 0.0001 (first, last, step) and look-ahead, by minutes.
PRESETS = {
    1: ((5, 100, 5), (5, 200, 5), 200), 5: ((10, 150, 5), (10, 300, 5), 300), 15: ((20, 250, 10), (20, 500, 10), 400),
    30: ((30, 350, 10), (30, 700, 10), 500), 60: ((50, 500, 10), (50, 1000, 10), 600), 240: ((100, 1000, 10), (100, 2000, 10), 800),
}


def grid(spark: SparkSession, minutes: int) -> DataFrame:
    """(sl, tp) of a timeframe in units of 0.0001: integers, so no ratio drifts."""
    (a, b, c), (d, e, f), _ = PRESETS[minutes]
    sl = spark.range(1).select(F.explode(F.sequence(F.lit(a), F.lit(b), F.lit(c))).alias("sl"))
    return sl.select("sl", F.explode(F.sequence(F.lit(d), F.lit(e), F.lit(f))).alias("tp"))


def pip_size(instrument: Column) -> Column:
    """0.01 for markets quoted in yen or gold, else 0.0001."""
    return F.when(F.upper(instrument).rlike("JPY|XAU"), 0.01).otherwise(0.0001)


# Spread in pips by instrument, for labelling.
SPREADS = {"DEFAULT": 3.0, "EURUSD": 1.5, "GBPUSD": 2.0, "AUDUSD": 2.5, "USDJPY": 2.0, "USDCAD": 2.5, "XAUUSD": 20.0}

# Market, spread (pips), commission per lot, pip value, slippage (pips). DEFAULT holds for all others.
COSTS = [
    ("DEFAULT", 2.5, 7.0, 0.0001, 0.5),
    ("XAUUSD", 20.0, 7.0, 0.01, 2.0),
    ("EURUSD", 1.5, 7.0, 0.0001, 0.3),
    ("GBPUSD", 2.0, 7.0, 0.0001, 0.4),
    ("AUDUSD", 2.5, 7.0, 0.0001, 0.5),
    ("USDJPY", 2.0, 7.0, 0.01, 0.4),
    ("USDCAD", 2.5, 7.0, 0.0001, 0.5),
]
COST_SCHEMA = "market string, spread_pips double, commission_per_lot double, pip_value double, slippage_pips double"


def spread_cost(instrument: Column) -> Column:
    """Spread in price units: pips of the instrument times its pip size."""
    pips = F.create_map(*(F.lit(x) for kv in SPREADS.items() for x in kv))
    return F.coalesce(F.try_element_at(pips, F.upper(instrument)), F.lit(SPREADS["DEFAULT"])) * pip_size(instrument)


def cost_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COSTS, COST_SCHEMA)


def with_costs(frame: DataFrame, costs: DataFrame) -> DataFrame:
    """frame with the cost columns of its market (instrument without the digits at its end), else those of DEFAULT."""
    names = [c for c in costs.columns if c != "market"]
    own = costs.filter("market <> 'DEFAULT'").select(F.col("market").alias("_market"), *(F.col(c).alias(f"_own_{c}") for c in names))
    default = costs.filter("market = 'DEFAULT'").limit(1).select(*(F.col(c).alias(f"_default_{c}") for c in names))
    market = F.regexp_replace("instrument", r"\d+$", "")
    joined = frame.withColumn("_key", market).join(own, F.col("_key") == F.col("_market"), "left").join(F.broadcast(default), F.lit(True), "left")
    joined = joined.withColumns({c: F.coalesce(f"_own_{c}", f"_default_{c}") for c in names})
    return joined.drop("_key", "_market", *(f"_{a}_{c}" for c in names for a in ("own", "default")))
