"""Candlestick patterns over one to three bars, 100, -100 or 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.functions.indicators import before

NAMES = ("doji", "hammer", "shooting_star", "marubozu", "engulfing", "harami", "piercing", "dark_cloud", "three_line", "star")


def _flag(test: Column, value: int) -> Column:
    return F.when(test, value).otherwise(0)


def _either(up: Column, down: Column) -> Column:
    return F.when(up, 100).when(down, -100).otherwise(0)


def patterns(frame: DataFrame) -> DataFrame:
    """Adds CDL_<name> columns; a pattern that lacks earlier bars is 0."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    frame = frame.withColumns({f"_{x}{n}": before(x, n) for n in (1, 2) for x in ("open", "high", "low", "close")})
    o1, l1, c1, h1 = (F.col(f"_{x}1") for x in ("open", "low", "close", "high"))
    o2, c2 = F.col("_open2"), F.col("_close2")
    body, span = F.abs(c - o), h - lo
    body1, body2 = F.abs(c1 - o1), F.abs(c2 - o2)
    up, dn = h - F.greatest(o, c), F.least(o, c) - lo
    green, red, green1, red1, green2, red2 = c > o, c < o, c1 > o1, c1 < o1, c2 > o2, c2 < o2
    top, bottom, top1, bottom1 = F.greatest(o, c), F.least(o, c), F.greatest(o1, c1), F.least(o1, c1)
    covers, inside = (top >= top1) & (bottom <= bottom1), (top <= top1) & (bottom >= bottom1)
    mid1, mid2 = (o1 + c1) / 2, (o2 + c2) / 2
    found = {
        "doji": _flag(body <= 0.1 * span, 100),
        "hammer": _flag((dn >= 2 * body) & (up <= 0.1 * span) & (body > 0), 100),
        "shooting_star": _flag((up >= 2 * body) & (dn <= 0.1 * span) & (body > 0), -100),
        "marubozu": F.when((body >= 0.95 * span) & (span > 0), _either(green, red)).otherwise(0),
        "engulfing": _either(green & red1 & covers, red & green1 & covers),
        "harami": _either(green & red1 & inside, red & green1 & inside),
        "piercing": _flag(red1 & green & (o < l1) & (c > mid1) & (c < o1), 100),
        "dark_cloud": _flag(green1 & red & (o > h1) & (c < mid1) & (c > o1), -100),
        "three_line": _either(green & green1 & green2 & (c > c1) & (c1 > c2), red & red1 & red2 & (c < c1) & (c1 < c2)),
        "star": _either(red2 & (body1 <= 0.3 * body2) & green & (c > mid2), green2 & (body1 <= 0.3 * body2) & red & (c < mid2)),
    }
    flat = (body == 0) & (span == 0)
    found["doji"] = F.when(flat, 0).otherwise(found["doji"])
    return frame.withColumns({f"CDL_{k}": v for k, v in found.items()})


def score(value: Column, strong: int = 100) -> Column:
    """Pattern value to -1, -0.5, 0, 0.5 or 1; missing to 0."""
    v = F.coalesce(value, F.lit(0))
    return F.when(v >= strong, 1.0).when(v > 0, 0.5).when(v <= -strong, -1.0).when(v < 0, -0.5).otherwise(0.0)
