"""Strategies as trades: signals, orders, exits, equity and metrics, for all strategies and markets in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.functions.positioning import LEVELS, level_price
from barsmith.operators.bars import KEYS, with_costs
from barsmith.operators.barriers import exits
from barsmith.operators.bitmaps import matches_by_index

STRATEGY = ["strategy_id", "timeframe", "market_rule", "trade_type", "type", "sl_level", "sl_ratio", "sl_bin", "tp_level", "tp_ratio", "tp_bin"]
TRADE = ["strategy_id", *KEYS, "idx", "order_id", "entry_time", "exit_time", "entry_price", "r"]  # what equity, metrics and logs read


def with_ids(strategies: DataFrame) -> DataFrame:
    """strategy_id: key and rule; a missing trade_type is buy."""
    side = F.coalesce("trade_type", F.lit("buy")) if "trade_type" in strategies.columns else F.lit("buy")
    return strategies.withColumn("trade_type", side).withColumn("strategy_id", F.concat_ws("_", "key", "market_rule"))


def top_per_rule(strategies: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("market_rule").orderBy(F.desc("avg_density"), "key")
    return strategies.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def signals(strategies: DataFrame, features: DataFrame, rule_features: list[str]) -> DataFrame:
    """(strategy, market, bar): the bars that meet the strategy's rule, with close, regimes and levels by name.

    A strategy with a timeframe is tried on the markets of that timeframe alone.
    """
    hit = matches_by_index(strategies, features, rule_features, timed=False, of=strategies.select(*(c for c in STRATEGY if c in strategies.columns)))
    levels = [c for c in LEVELS if c in features.columns]
    by_name = F.create_map(*(x for c in levels for x in (F.lit(c), F.col(c).cast("double")))) if levels else F.create_map().cast("map<string,double>")
    regimes = [c for c in ("session", "trend_regime_14", "vol_regime_14") if c in features.columns]
    bars = features.select(*KEYS, "idx", "time", "n_bars", "close", by_name.alias("levels"), *regimes)
    return hit.join(bars.hint("merge"), [*KEYS, "idx"])  # hits look as small as their bitmaps, but are not to be broadcast


def orders(found: DataFrame, costs: DataFrame) -> DataFrame:
    """Signals with entry after slippage, stop and target; orders with a level on the wrong side of the entry go."""
    o = with_costs(found, costs)
    sign = F.when(F.col("trade_type") == "buy", 1.0).otherwise(-1.0)
    entry = F.col("close") + sign * F.col("slippage_pips") * F.col("pip_value")

    def price(side: str, way: Column) -> Column:
        level = F.try_element_at("levels", F.col(f"{side}_level"))
        fixed = F.col("close") * (1 + way * F.col(f"{side}_ratio"))
        return F.when(F.col(f"{side}_level").isNotNull(), level_price(F.col("close"), level, F.col("type"), F.col(f"{side}_bin"))).otherwise(fixed)

    o = o.withColumns({"entry_price": entry, "sl_price": price("sl", -sign), "tp_price": price("tp", sign)})
    right = (sign * (F.col("entry_price") - F.col("sl_price")) > 0) & (sign * (F.col("tp_price") - F.col("entry_price")) > 0)
    o = o.filter(right & (F.col("idx") + 1 < F.col("n_bars")))
    return o.withColumn("order_id", F.concat_ws("|", "strategy_id", "instrument", F.col("timeframe").cast("string"), F.col("idx").cast("string")))


def trades(placed: DataFrame, bars: DataFrame, look_ahead: int = 5000) -> DataFrame:
    """Orders that a later bar closes, with their return per unit of risk; in a tie the stop counts."""
    t = exits(placed, bars, look_ahead)
    win = F.col("tp_idx").isNotNull() & (F.col("sl_idx").isNull() | (F.col("tp_idx") < F.col("sl_idx")))
    t = t.filter("tp_idx IS NOT NULL OR sl_idx IS NOT NULL").withColumns({"exit_idx": F.when(win, F.col("tp_idx")).otherwise(F.col("sl_idx")), "won": win})
    sign = F.when(F.col("trade_type") == "buy", 1.0).otherwise(-1.0)
    move = sign * (F.when(win, F.col("tp_price")).otherwise(F.col("sl_price")) - F.col("entry_price"))
    cost = F.col("spread_pips") * F.col("pip_value") + F.col("commission_per_lot") / 100_000
    t = t.withColumn("r", (move - cost) / F.abs(F.col("entry_price") - F.col("sl_price")))
    times = bars.select(*KEYS, F.col("idx").alias("exit_idx"), F.col("time").alias("exit_time"))
    return t.withColumnRenamed("time", "entry_time").join(times, [*KEYS, "exit_idx"])


def _earlier(t: DataFrame, values: dict, block: int = 4096) -> DataFrame:
    """Aggregates of the earlier trades of a strategy and market, for each trade: {name: (function, column)}, sum or max.

    Counted within blocks of bars and carried over from the few block totals, so no task holds all trades of a market.
    """
    group = ["strategy_id", *KEYS]
    t = t.withColumn("_block", F.floor(F.col("idx") / block))
    w = Window.partitionBy(*group, "_block").orderBy("idx", "order_id").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({f"_own_{n}": how(x).over(w) for n, (how, x) in values.items()})
    totals = t.groupBy(*group, "_block").agg(*(how(x).alias(f"_all_{n}") for n, (how, x) in values.items()))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*group, "_block", *(how(f"_all_{n}").over(before).alias(f"_from_{n}") for n, (how, _) in values.items()))
    t = t.join(carried, [*group, "_block"])
    both = {n: F.greatest(f"_own_{n}", f"_from_{n}") if how is F.max else F.coalesce(f"_own_{n}", F.lit(0)) + F.coalesce(f"_from_{n}", F.lit(0)) for n, (how, _) in values.items()}
    return t.withColumns(both).drop("_block", *(f"_{x}_{n}" for n in values for x in ("own", "from")))


def equity(found: DataFrame, start: float = 10_000.0, risk: float = 0.02) -> DataFrame:
    """Trades with capital and pnl: each risks a share of the capital before it, in entry order.

    Capital is start times the product of 1 + risk * r, a running sum of logarithms. The first trade that brings it to zero
    or below stays, later ones go.
    """
    t = found.withColumn("_x", 1 + risk * F.col("r"))
    logs = F.when(F.col("_x") > 0, F.log("_x")).otherwise(0.0)
    t = _earlier(t, {"_ruined": (F.max, (F.col("_x") <= 0).cast("int")), "_logs": (F.sum, logs), "_count": (F.sum, F.lit(1))})
    t = t.filter(F.coalesce("_ruined", F.lit(0)) == 0).withColumn("_before", F.exp("_logs") * start)
    t = t.withColumn("capital", F.col("_before") * F.col("_x")).withColumn("pnl", F.col("capital") - F.col("_before"))
    return t.withColumn("seq", (F.col("_count") + 1).cast("long")).drop("_x", "_ruined", "_logs", "_count", "_before")


def trade_log(done: DataFrame) -> DataFrame:
    return done.select("strategy_id", *KEYS, "entry_time", "exit_time", "pnl", "entry_price")


def performance(done: DataFrame, start: float = 10_000.0, risk_free: float = 0.04, per_year: int = 252, undefined_sharpe: float = 0.0) -> DataFrame:
    """Metrics for each strategy and market. Profit factor is infinite without losses."""
    group = ["strategy_id", *KEYS]
    t = _earlier(done, {"_peak": (F.max, F.col("capital"))}).withColumn("_peak", F.greatest("_peak", "capital"))
    gains, losses = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.abs(F.sum(F.when(F.col("pnl") <= 0, F.col("pnl")).otherwise(0.0)))
    excess = F.col("pnl") / start - risk_free / per_year
    top = F.max("_peak")
    out = t.groupBy(*group).agg(
        gains.alias("_gain"), losses.alias("_loss"), F.avg(excess).alias("_mean"), F.stddev_samp(excess).alias("_std"),
        F.when(top > 0, F.max(F.col("_peak") - F.col("capital")) / top * 100).otherwise(0.0).alias("max_drawdown_pct"),
        (F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)) * 100).alias("win_rate_pct"), F.max_by("capital", "seq").alias("final_capital"), F.count(F.lit(1)).alias("total_trades"),
    )
    sharpe = F.when(F.coalesce(F.col("_std"), F.lit(0.0)) == 0, undefined_sharpe).otherwise(F.try_divide(F.col("_mean"), F.col("_std")) * F.sqrt(F.lit(float(per_year))))
    factor = F.when(F.col("_loss") > 0, F.try_divide(F.col("_gain"), F.col("_loss"))).otherwise(float("inf"))
    return out.withColumns({"profit_factor": factor, "sharpe_ratio": sharpe}).select(*group, "profit_factor", "sharpe_ratio", "max_drawdown_pct", "win_rate_pct", "final_capital", "total_trades")


SEGMENT = ("prefix", "suffix", "longest", "length")


def _joined(a: Column, b: Column) -> Column:
    """A segment of trades followed by another: runs at its start and end, the longest one, and its length."""
    values = {
        "prefix": F.when(a["prefix"] == a["length"], a["length"] + b["prefix"]).otherwise(a["prefix"]),
        "suffix": F.when(b["suffix"] == b["length"], b["length"] + a["suffix"]).otherwise(b["suffix"]),
        "longest": F.greatest(a["longest"], b["longest"], a["suffix"] + b["prefix"]), "length": a["length"] + b["length"],
    }
    return F.struct(*(values[k].alias(k) for k in SEGMENT))


def longest_runs(done: DataFrame, block: int = 4096) -> DataFrame:
    """max_wins and max_losses of each strategy and market: the longest runs of trades that won and that lost.

    Runs are measured within blocks of bars; blocks are segments that are joined in order, so no task sorts all trades of a strategy.
    """
    group = ["strategy_id", *KEYS]
    t = done.select(*group, "seq", "won", F.floor(F.col("idx") / block).alias("_block"))
    run = F.col("seq") - F.row_number().over(Window.partitionBy(*group, "_block", "won").orderBy("seq"))
    runs = t.withColumn("_run", run).groupBy(*group, "_block", "won", "_run").agg(F.min("seq").alias("_from"), F.max("seq").alias("_to"), F.count(F.lit(1)).alias("_n"))
    ends = [by(F.struct("won", "_n"), at).alias(name) for by, at, name in ((F.min_by, "_from", "_first"), (F.max_by, "_to", "_last"))]
    most = [F.coalesce(F.max(F.when(F.col("won") == won, F.col("_n"))), F.lit(0)).alias(f"_longest_{won}") for won in (True, False)]
    blocks = runs.groupBy(*group, "_block").agg(F.sum("_n").alias("_length"), *ends, *most)

    def segment(won: bool) -> Column:
        at = lambda c: F.when(F.col(c)["won"] == won, F.col(c)["_n"]).otherwise(0)
        values = {"prefix": at("_first"), "suffix": at("_last"), "longest": F.col(f"_longest_{won}"), "length": F.col("_length")}
        return F.struct(*(values[k].cast("long").alias(k) for k in SEGMENT))

    parts = blocks.select(*group, F.struct("_block", segment(True).alias("wins"), segment(False).alias("losses")).alias("_part"))
    parts = parts.groupBy(*group).agg(F.sort_array(F.collect_list("_part")).alias("_parts"))
    empty = F.struct(*(F.lit(0).cast("long").alias(k) for k in SEGMENT))

    def whole(c: str) -> Column:
        return F.aggregate("_parts", empty, lambda s, x: _joined(s, x[c]), lambda s: s["longest"]).alias(f"max_{c}")

    return parts.select(*group, whole("wins"), whole("losses"))


def more_metrics(done: DataFrame, block: int = 4096) -> DataFrame:
    """Mean duration in bars, longest runs of wins and losses, SQN (mean r / deviation of r * sqrt(n)), Calmar (return % / drawdown %)."""
    group = ["strategy_id", *KEYS]
    t = _earlier(done, {"_peak": (F.max, F.col("capital"))}, block).withColumn("_peak", F.greatest("_peak", "capital"))
    out = t.groupBy(*group).agg(
        F.avg(F.col("exit_idx") - F.col("idx")).alias("avg_bars"), (F.try_divide(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.count(F.lit(1)))).alias("sqn"),
        F.max_by("capital", "seq").alias("_final"), (F.max(F.col("_peak") - F.col("capital")) / F.max("_peak") * 100).alias("_dd"),
    )
    out = out.join(longest_runs(done, block), group)
    calmar = F.try_divide((F.col("_final") / 10_000 - 1) * 100, F.col("_dd")).alias("calmar")
    return out.select(*group, "avg_bars", "max_wins", "max_losses", "sqn", calmar)


def regime_mix(found: DataFrame, column: str) -> DataFrame:
    """Share in percent of each value of column over the signals of a strategy and market, one row each."""
    group = ["strategy_id", *KEYS]
    counts = found.groupBy(*group, F.col(column).alias("regime")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.withColumn("pct", F.col("_n") / F.sum("_n").over(Window.partitionBy(*group)) * 100).drop("_n")


def regime_maps(found: DataFrame, columns: tuple[str, ...] = ("session", "trend_regime_14", "vol_regime_14")) -> DataFrame:
    """The shares as maps, one column <column>_pct for each."""
    group = ["strategy_id", *KEYS]
    out = found.select(*group).distinct()
    for c in columns:
        pairs = F.sort_array(F.collect_list(F.struct("regime", "pct")))
        out = out.join(regime_mix(found, c).groupBy(*group).agg(F.map_from_entries(pairs).alias(f"{c}_pct")), group, "left")
    return out


def passed(report: DataFrame, factor: float = 1.5, drawdown: float = 25.0, least: int = 50, strict: bool = False) -> DataFrame:
    pf, dd = F.col("profit_factor"), F.col("max_drawdown_pct")
    good = ((pf > factor) & (dd < drawdown)) if strict else ((pf >= factor) & (dd <= drawdown))
    return report.filter(good & (F.col("total_trades") >= least))


def failed(report: DataFrame, good: DataFrame) -> DataFrame:
    return report.join(good.select("strategy_id").distinct(), "strategy_id", "left_anti")
