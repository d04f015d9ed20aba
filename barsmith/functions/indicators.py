"""Indicators over indexed bars, computed in overlapping blocks.

All work on one frame from `framed`, so a set of indicators costs one shuffle. Values are NULL until enough bars exist.
Smoothed averages e[t] = (1 - a) e[t-1] + b[t] are sums of b[s] (1 - a)^(t-s); within a block that is a running sum, and
what lies before the halo weighs less than a double can hold. Where the powers of a short average would not fit a double over a
block, the last values that still count are folded instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.operators.bars import BLOCK, KEYS, block_window, blocked, in_block, unblocked

HALO = 1152  # bars: two smoothings of 1/14 forget their start in it
AHEAD = 10
MOST_POWER = 600.0  # exponent of e that powers of a running sum may reach


def framed(bars: DataFrame) -> DataFrame:
    return blocked(bars, behind=HALO, ahead=AHEAD)


def done(frame: DataFrame) -> DataFrame:
    """The frame without halo rows and helper columns."""
    return unblocked(frame).drop(*(c for c in frame.columns if c.startswith("_")))


def _rows(n: int):
    return block_window().rowsBetween(-(n - 1), 0)


def rolling(value: Column, n: int, how=F.avg) -> Column:
    return F.when(F.col("idx") >= n - 1, how(value).over(_rows(n)))


def before(column: str, n: int = 1) -> Column:
    return F.lag(column, n).over(block_window())


def smoothed(b: Column, a: float) -> Column:
    """e[t] = (1 - a) e[t-1] + b[t] in a block, as a running sum, or for short averages as a fold of the last values."""
    if a >= 1:
        return b
    if -math.log(1 - a) * (HALO + BLOCK + AHEAD) > MOST_POWER:
        last = F.collect_list(b).over(_rows(math.ceil(math.log(1e-18) / math.log(1 - a))))
        return F.aggregate(last, F.lit(0.0), lambda e, x: e * (1 - a) + x)
    k = F.col("_place")
    w = block_window().rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(b * F.pow(F.lit(1 - a), -k)).over(w) * F.pow(F.lit(1 - a), k)


def placed(frame: DataFrame) -> DataFrame:
    """_place: rows since the start of the block's halo; the value of row 0 stands for all before it."""
    if "_place" in frame.columns:
        return frame
    start = F.min("idx").over(block_window().rowsBetween(Window.unboundedPreceding, 0))
    return frame.withColumn("_place", (F.col("idx") - start).cast("double"))


def ema_of(frame: DataFrame, value: Column, a: float, name: str, first: int = 0) -> DataFrame:
    """Adds name: e[first] = value, then (1 - a) e + a * value. NULL handling is the caller's."""
    frame = placed(frame)
    b = F.when(F.col("idx") < first, 0.0).when((F.col("idx") == first) | (F.col("_place") == 0), value).otherwise(value * a)
    return frame.withColumn(name, smoothed(F.coalesce(b, F.lit(0.0)), a))


def wilder_of(frame: DataFrame, value: str, n: int, name: str, first: int) -> DataFrame:
    """Adds name: seeded at bar first + n - 1 with the mean of n values, then a = 1/n. NULL before."""
    frame = placed(frame)
    seed = first + n - 1
    mean = F.avg(value).over(_rows(n))
    b = F.when(F.col("idx") < seed, 0.0).when((F.col("idx") == seed) | (F.col("_place") == 0), mean).otherwise(F.col(value) / n)
    frame = frame.withColumn("_b", F.coalesce(b, F.lit(0.0)))
    return frame.withColumn(name, F.when(F.col("idx") >= seed, smoothed(F.col("_b"), 1 / n))).drop("_b")


def sma(frame: DataFrame, periods=(20, 50, 100, 200)) -> DataFrame:
    return frame.withColumns({f"SMA_{p}": rolling(F.col("close"), p) for p in periods})


def ema(frame: DataFrame, periods=(8, 13, 21, 50)) -> DataFrame:
    for p in periods:
        frame = ema_of(frame, F.col("close"), 2 / (p + 1), f"_ema_{p}").withColumn(f"EMA_{p}", F.when(F.col("idx") >= p - 1, F.col(f"_ema_{p}")))
    return frame


def bollinger(frame: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    mid, dev = rolling(F.col("close"), n), rolling(F.col("close"), n, F.stddev_pop)
    frame = frame.withColumns({"_mid": mid, "_dev": dev})
    up, low = F.col("_mid") + k * F.col("_dev"), F.col("_mid") - k * F.col("_dev")
    return frame.withColumns({f"BB_upper_{n}": up, f"BB_lower_{n}": low, f"BB_width_{n}": F.try_divide(up - low, F.col("_mid")) * 100})


def rsi(frame: DataFrame, n: int = 14) -> DataFrame:
    frame = frame.withColumn("_step", F.col("close") - before("close"))
    for name, part in (("_gain", F.col("_step")), ("_loss", -F.col("_step"))):
        frame = ema_of(frame, F.greatest(F.coalesce(part, F.lit(0.0)), F.lit(0.0)), 1 / n, name)
    value = F.when(F.col("_loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.try_divide(F.col("_gain"), F.col("_loss"))))
    return frame.withColumn(f"RSI_{n}", F.when(F.col("idx") >= n - 1, value))


def macd(frame: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Histogram: the line starts at bar slow - 1, its signal average with the line's first value."""
    for p, name in ((fast, "_fast"), (slow, "_slow")):
        frame = ema_of(frame, F.col("close"), 2 / (p + 1), name)
    frame = frame.withColumn("_line", F.col("_fast") - F.col("_slow"))
    frame = ema_of(frame, F.col("_line"), 2 / (signal + 1), "_signal", first=slow - 1)
    return frame.withColumn(f"MACD_hist_{fast}_{slow}_{signal}", F.when(F.col("idx") >= slow + signal - 2, F.col("_line") - F.col("_signal")))


def true_range(frame: DataFrame) -> DataFrame:
    if "_tr" in frame.columns:
        return frame
    last = before("close")
    return frame.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last)))


def atr(frame: DataFrame, n: int = 14) -> DataFrame:
    frame = wilder_of(true_range(frame), "_tr", n, f"ATR_{n}", first=0)
    return frame.withColumns({f"ATR_level_up_1x_{n}": F.col("close") + F.col(f"ATR_{n}"), f"ATR_level_down_1x_{n}": F.col("close") - F.col(f"ATR_{n}")})


def adx(frame: DataFrame, n: int = 14) -> DataFrame:
    frame = true_range(frame)
    frame = frame.withColumns({"_rise": F.col("high") - before("high"), "_fall": before("low") - F.col("low")})
    plus = F.when((F.col("_rise") > F.col("_fall")) & (F.col("_rise") > 0), F.col("_rise")).otherwise(0.0)
    minus = F.when((F.col("_fall") > F.col("_rise")) & (F.col("_fall") > 0), F.col("_fall")).otherwise(0.0)
    frame = frame.withColumns({"_plus": plus, "_minus": minus})
    for name in ("_tr", "_plus", "_minus"):
        frame = wilder_of(frame, name, n, f"{name}_s", first=1)
    up, down = (F.coalesce(F.try_divide(F.col(f"{x}_s"), F.col("_tr_s")), F.lit(0.0)) for x in ("_plus", "_minus"))
    dx = F.coalesce(F.try_divide(F.abs(up - down), up + down), F.lit(0.0)) * 100
    frame = frame.withColumn("_dx", F.when(F.col("idx") >= n, dx))
    return wilder_of(frame, "_dx", n, f"ADX_{n}", first=n)


def roc(frame: DataFrame, n: int = 10) -> DataFrame:
    last = before("close", n)
    return frame.withColumn(f"MOM_{n}", F.try_divide(F.col("close") - last, last) * 100)


def cci(frame: DataFrame, n: int = 20) -> DataFrame:
    frame = frame.withColumn("_tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    frame = frame.withColumns({"_tps": F.collect_list("_tp").over(_rows(n)), "_tp_mean": F.avg("_tp").over(_rows(n))})
    mad = F.aggregate("_tps", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("_tp_mean"))) / n
    return frame.withColumn(f"CCI_{n}", F.when(F.col("idx") >= n - 1, F.try_divide(F.col("_tp") - F.col("_tp_mean"), 0.015 * mad))).drop("_tps")


def price_action(frame: DataFrame, spans=(3, 5, 10, 20, 50)) -> DataFrame:
    parts = {"bullish_ratio": (F.col("close") > F.col("open")).cast("double"), "avg_body": F.abs(F.col("close") - F.col("open")), "avg_range": F.col("high") - F.col("low")}
    return frame.withColumns({f"{name}_last_{n}": rolling(x, n) for n in spans for name, x in parts.items()})


def obv(bars: DataFrame) -> DataFrame:
    """On-balance volume of indexed bars: running sums in blocks plus the sums of the blocks before."""
    frame = blocked(bars, behind=1)
    last = before("close")
    signed = F.when(F.col("close") < last, -F.col("volume")).otherwise(F.col("volume"))
    frame = frame.withColumn("_signed", signed).filter(in_block())
    frame = frame.withColumn("_local", F.sum("_signed").over(block_window().rowsBetween(Window.unboundedPreceding, 0)))
    sums = frame.groupBy(*KEYS, "block").agg(F.sum("_signed").alias("_sum"))
    carried = sums.withColumn("_carry", F.sum("_sum").over(Window.partitionBy(*KEYS).orderBy("block")) - F.col("_sum")).drop("_sum")
    return frame.join(carried, [*KEYS, "block"]).withColumn("OBV", F.col("_carry") + F.col("_local")).drop("_signed", "_local", "_carry", "block")


def regimes(frame: DataFrame, n: int = 14, adx_least: float = 25.0, mean: int = 50) -> DataFrame:
    """trend_regime and vol_regime; needs ADX and ATR. Missing values: range, low_vol."""
    usual = rolling(F.col(f"ATR_{n}"), mean)
    usual = F.when(F.col("idx") >= n + mean - 2, usual)
    return frame.withColumns(
        {
            f"trend_regime_{n}": F.when(F.col(f"ADX_{n}") > adx_least, "trend").otherwise("range"),
            f"vol_regime_{n}": F.when(F.col(f"ATR_{n}") > usual, "high_vol").otherwise("low_vol"),
        }
    )


def pivots(frame: DataFrame, reach: int = AHEAD) -> DataFrame:
    """low_pivot and high_pivot: extremes of the 2 * reach + 1 bars around, in full frames only; equal extremes all count."""
    w = block_window().rowsBetween(-reach, reach)
    full = (F.col("idx") >= reach) & (F.col("idx") < F.col("n_bars") - reach)
    low, high = (F.col(c).cast("float") for c in ("low", "high"))
    return frame.withColumns({"low_pivot": F.when(full & (low == F.min(low).over(w)), F.col("low")), "high_pivot": F.when(full & (high == F.max(high).over(w)), F.col("high"))})


def support_resistance(bars: DataFrame, confirm: int = 0) -> DataFrame:
    """Last pivot low and high up to each bar (indexed bars with pivots). confirm: bars that a pivot is held back.

    In blocks: the last pivot in the block so far, else the last one of the blocks before.
    """
    frame = bars
    if confirm:
        frame = blocked(bars, behind=confirm)
        frame = unblocked(frame.withColumns({p: before(p, confirm) for p in ("low_pivot", "high_pivot")}))
    frame = frame.withColumn("block", F.floor(F.col("idx") / BLOCK))
    w = block_window().rowsBetween(Window.unboundedPreceding, 0)
    frame = frame.withColumns({"_s": F.last("low_pivot", True).over(w), "_r": F.last("high_pivot", True).over(w)})
    ends = frame.groupBy(*KEYS, "block").agg(F.max_by("_s", "idx").alias("_es"), F.max_by("_r", "idx").alias("_er"))
    w2 = Window.partitionBy(*KEYS).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*KEYS, "block", F.last("_es", True).over(w2).alias("_cs"), F.last("_er", True).over(w2).alias("_cr"))
    joined = frame.join(ends, [*KEYS, "block"])
    return joined.withColumns({"support": F.coalesce("_s", "_cs"), "resistance": F.coalesce("_r", "_cr")}).drop("_s", "_r", "_cs", "_cr", "block")


def session(hour: Column, scheme: str = "six") -> Column:
    """Market session of an hour (0 to 23)."""
    if scheme == "four":
        return F.when(hour.between(7, 11), "London").when(hour.between(12, 15), "London_NY_Overlap").when(hour.between(16, 20), "New_York").otherwise("Asian")
    return (
        F.when(hour == 0, "Tokyo").when(hour <= 8, "Tokyo_London_Overlap").when(hour == 9, "London").when(hour <= 13, "London_NY_Overlap").when(hour <= 17, "New_York").otherwise("Sydney")
    )


def calendar(frame: DataFrame, scheme: str = "six") -> DataFrame:
    frame = frame.withColumns({"hour": F.hour("time"), "weekday": F.weekday("time")})
    return frame.withColumn("session", session(F.col("hour"), scheme))
