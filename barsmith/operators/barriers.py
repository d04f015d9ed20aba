"""Which price levels the bars after an entry touch first, and which stop-loss/take-profit pairs win."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from barsmith.operators.bars import BLOCK, KEYS, blocked, spread_cost

UNIT = 10_000  # ratios are integers of 0.0001


def _next_beyond(values: np.ndarray) -> np.ndarray:
    """For each value the place of the first later one that is greater, the length where there is none: a monotone stack."""
    out, stack = np.full(len(values), len(values)), []
    for i, v in enumerate(values.tolist()):
        while stack and stack[-1][1] < v:
            out[stack.pop()[0]] = i
        stack.append((i, v))
    return out


def _chains(values: np.ndarray, own: np.ndarray, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and places: for each place in `own` those of the next `ahead` values that go beyond all before them.

    The first value ahead starts a chain, and the next link of a value is the first one beyond it, so only records are visited.
    """
    beyond, at, rows, found = np.append(_next_beyond(values), len(values)), own + 1, [], []
    row = np.arange(len(own))
    while True:
        live = (at < len(values)) & (at <= own[row] + ahead)
        row, at = row[live], at[live]
        if not len(row):
            break
        rows.append(row)
        found.append(at)
        at = beyond[at]
    rows, found = (np.concatenate(x) if x else np.zeros(0, int) for x in (rows, found))
    some = values[found] > -np.inf  # a missing price is no record
    rows, found = rows[some], found[some]
    order = np.argsort(rows, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(own)))]), found[order]


def with_records(bars: DataFrame, look_ahead: int) -> DataFrame:
    """Indexed bars with `highs` and `lows`: record highs and lows of the next `look_ahead` bars, arrays of (idx, price).

    The first bar that touches a level is the first record beyond it, so any number of levels is found in a few steps each
    without a join. A block of bars and its halo are scanned once: each bar's records are a chain of links "next bar beyond",
    some log L of L bars, and no bar takes a copy of the bars ahead.
    """
    size = max(BLOCK, look_ahead)
    record = ArrayType(StructType([StructField("idx", LongType()), StructField("price", DoubleType())]))
    columns = bars.columns
    schema = StructType([*bars.schema.fields, StructField("highs", record), StructField("lows", record)])

    def of_block(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        idx = rows.column("idx").to_numpy()
        own = np.flatnonzero(idx // size == key[-1].as_py())
        out = rows.select(columns).take(pa.array(own))
        for name, price, sign in (("highs", "high", 1.0), ("lows", "low", -1.0)):
            values = sign * rows.column(price).cast(pa.float64()).to_numpy(zero_copy_only=False)
            offsets, found = _chains(np.where(np.isnan(values), -np.inf, values), own, look_ahead)
            pairs = pa.StructArray.from_arrays([pa.array(idx[found], pa.int64()), pa.array(sign * values[found], pa.float64())], ["idx", "price"])
            out = out.append_column(name, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs))
        return out

    return blocked(bars, ahead=look_ahead, size=size).groupBy(*KEYS, "block").applyInArrow(of_block, schema)


def touched_up(level: Column) -> Column:
    return F.get(F.filter("highs", lambda r: r["price"] >= level), F.lit(0))["idx"]


def touched_down(level: Column) -> Column:
    return F.get(F.filter("lows", lambda r: r["price"] <= level), F.lit(0))["idx"]


def first_touch(bars: DataFrame, ratios: list[int], look_ahead: int) -> DataFrame:
    """For each bar and ratio: the first later bar with high >= close * (1 + r), and with low <= close * (1 - r)."""
    each = with_records(bars, look_ahead).withColumn("ratio", F.explode(F.array(*map(F.lit, ratios))))
    r = F.col("ratio") / UNIT
    return each.select(*KEYS, "idx", "ratio", touched_up(F.col("close") * (1 + r)).alias("up_idx"), touched_down(F.col("close") * (1 - r)).alias("down_idx"))


def barrier_outcomes(bars: DataFrame, sl: list[int], tp: list[int], look_ahead: int, spread: bool = True, ties_win: bool = True) -> DataFrame:
    """Winning (bar, direction, sl, tp): take-profit touched, and before the stop (in the same bar too if ties_win).

    Entries are closes with look_ahead bars after them. Stops and targets are searched apart, so a bar costs
    2 * (nSL + nTP) searches, and only winning pairs leave the row.
    """
    eligible = with_records(bars, look_ahead).filter(F.col("idx") < F.col("n_bars") - look_ahead)
    e = F.col("close")
    frame = eligible.withColumn("spread", spread_cost(F.col("instrument")) if spread else F.lit(0.0))

    def hits(ratios: list[int], touch) -> Column:
        return F.array(*(F.struct(F.lit(r).alias("ratio"), touch(F.lit(r) / UNIT).alias("idx")) for r in ratios))

    sides = {
        "buy": (hits(tp, lambda r: touched_up(e * (1 + r) + F.col("spread"))), hits(sl, lambda r: touched_down(e * (1 - r)))),
        "sell": (hits(tp, lambda r: touched_down(e * (1 - r) - F.col("spread"))), hits(sl, lambda r: touched_up(e * (1 + r)))),
    }
    both = F.array(*(F.struct(F.lit(side).alias("trade_type"), a.alias("tps"), b.alias("sls")) for side, (a, b) in sides.items()))
    frame = frame.select(*KEYS, "time", "idx", e.alias("entry_price"), F.inline(both))
    frame = frame.select(*KEYS, "time", "idx", "entry_price", "trade_type", "sls", F.explode(F.filter("tps", lambda x: x["idx"].isNotNull())).alias("t"))

    def wins(s: Column) -> Column:
        t = F.col("t.idx")
        return s["idx"].isNull() | ((t <= s["idx"]) if ties_win else (t < s["idx"]))

    frame = frame.select("*", F.explode(F.filter("sls", wins)).alias("s"))
    sign = F.when(F.col("trade_type") == "buy", 1).otherwise(-1)
    return frame.select(
        *KEYS, F.col("time").alias("entry_time"), F.col("idx").alias("entry_idx"), "trade_type", "entry_price",
        F.col("s.ratio").alias("sl"), F.col("t.ratio").alias("tp"),
        (F.col("entry_price") * (1 - sign * F.col("s.ratio") / UNIT)).alias("sl_price"),
        (F.col("entry_price") * (1 + sign * F.col("t.ratio") / UNIT)).alias("tp_price"),
        F.col("t.idx").alias("exit_idx"), F.lit("win").alias("outcome"),
    )


def with_exit_time(outcomes: DataFrame, bars: DataFrame) -> DataFrame:
    times = bars.select(*KEYS, F.col("idx").alias("exit_idx"), F.col("time").alias("exit_time"))
    return outcomes.join(times, [*KEYS, "exit_idx"], "left")


def extremes(bars: DataFrame, fan: int, levels: int) -> list[DataFrame]:
    """A tree of extremes over the bars of each market: of each level (KEYS, node, kids), kids: (n, high, low) of at most `fan` parts.

    The parts of level 1 are bars; those of level k + 1 are the nodes of level k. Node n has the parts fan * n and up.
    """
    parts, out = bars.select(*KEYS, F.col("idx").alias("n"), "high", "low"), []
    for _ in range(levels):
        kids = F.sort_array(F.collect_list(F.struct("n", "high", "low"))).alias("kids")
        nodes = parts.groupBy(*KEYS, F.floor(F.col("n") / fan).alias("node")).agg(kids, F.max("high").alias("high"), F.min("low").alias("low"))
        out.append(nodes.select(*KEYS, "node", "kids"))
        parts = nodes.select(*KEYS, F.col("node").alias("n"), "high", "low")
    return out


def exits(orders: DataFrame, bars: DataFrame, look_ahead: int = 5000, block: int | None = None) -> DataFrame:
    """orders (KEYS, order_id, idx, trade_type, sl_price, tp_price) with sl_idx and tp_idx, the first touches within look_ahead.

    An order walks a tree of extremes: up, through the later parts of its own node on each level and the next node at the top, until
    a part reaches the price, and from there down to the bar. Each step joins an order with one node, whose parts (`block`, by default the root
    of look_ahead) it searches, so an order takes a few rows for both prices, however far ahead the touch lies.
    """
    fan = block or max(16, math.ceil(math.sqrt(look_ahead)))
    levels = 1
    while fan**levels < look_ahead:
        levels += 1
    tree = extremes(bars, fan, levels)
    up = F.col("trade_type") == "buy"
    sides = {"tp": up, "sl": ~up}  # whether the price lies above
    o = orders.select(*KEYS, "order_id", "idx", "sl_price", "tp_price", *(above.alias(f"_{s}_above") for s, above in sides.items()))

    def joined(o: DataFrame, level: int, node: Column, name: str) -> DataFrame:
        t = tree[level - 1].select(*(F.col(k).alias(f"_{k}") for k in KEYS), F.col("node").alias("_node"), F.col("kids").alias(name))
        same = [F.col(k) == F.col(f"_{k}") for k in KEYS]
        return o.withColumn("_at", node).join(t, same[0] & same[1] & (F.col("_at") == F.col("_node")), "left").drop("_at", "_node", *(f"_{k}" for k in KEYS))

    def first(kids: str, after: Column, side: str) -> Column:
        """The first part behind `after` that reaches the price."""
        level, above = F.col(f"{side}_price"), F.col(f"_{side}_above")
        reach = lambda c: F.when(above, c["high"] >= level).otherwise(c["low"] <= level)
        return F.get(F.filter(kids, lambda c: (c["n"] > after) & reach(c)), F.lit(0))["n"]

    # Up: _<side>_part is the first part found, _<side>_level the level of its node.
    for level in range(1, levels + 2):
        top = min(level, levels)
        node = F.floor(F.col("idx") / fan**top) + int(level > levels)
        after = F.floor(F.col("idx") / fan ** (top - 1)) if level <= levels else F.lit(-1)
        o = joined(o, top, node, "_kids")
        for side in sides:
            here = first("_kids", after, side)
            o = o.withColumn(f"_{side}_part", here if level == 1 else F.coalesce(f"_{side}_part", here))
            at = F.when(F.col(f"_{side}_part").isNotNull(), top)
            o = o.withColumn(f"_{side}_level", at if level == 1 else F.coalesce(f"_{side}_level", at))
        o = o.drop("_kids")
    # Down: where a node was found on a level above, into it; others look where they are, which says nothing.
    for level in range(levels - 1, 0, -1):
        for side in sides:
            deep = F.col(f"_{side}_level") > level
            o = joined(o, level, F.when(deep, F.col(f"_{side}_part")).otherwise(F.floor(F.col("idx") / fan**level)), "_kids")
            o = o.withColumn(f"_{side}_part", F.when(deep, first("_kids", F.lit(-1), side)).otherwise(F.col(f"_{side}_part"))).drop("_kids")
    found = [F.when(F.col(f"_{s}_part") <= F.col("idx") + look_ahead, F.col(f"_{s}_part")).alias(f"{s}_idx") for s in sides]
    return orders.join(o.select("order_id", *found), "order_id", "left")
