"""Chains of operators: bars to outcomes, features, learning tables, rules and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.functions import indicators as ind
from barsmith.functions.patterns import patterns
from barsmith.functions.positioning import enriched, price_relative
from barsmith.functions.preprocess import one_hot, pattern_scores, scaled, scaler, scaler_of, scaler_state
from barsmith.operators import bars as b
from barsmith.operators import evaluate as ev
from barsmith.operators import reports
from barsmith.operators.barriers import barrier_outcomes, with_exit_time
from barsmith.sources.state import written


def outcomes(indexed: DataFrame, minutes: int) -> DataFrame:
    """Winning outcomes of indexed bars over the whole grid of their timeframe."""
    (a, z, step), (c, y, jump), look = b.PRESETS[minutes]
    won = barrier_outcomes(indexed, list(range(a, z + 1, step)), list(range(c, y + 1, jump)), look)
    return with_exit_time(won, indexed)


def features(indexed: DataFrame, warmup: int = 200, scheme: str = "six", least: int = 0) -> DataFrame:
    """All indicators, patterns, sessions and regimes of indexed bars, from bar `warmup` on: one shuffle for the windows.

    Markets of fewer than `least` bars are left out.
    """
    f = ind.framed(indexed.filter(F.col("n_bars") >= least))
    for step in (ind.sma, ind.ema, ind.bollinger, ind.rsi, ind.macd, ind.atr, ind.adx, ind.roc, ind.cci, ind.price_action, ind.regimes, ind.pivots, patterns):
        f = step(f)
    f = ind.support_resistance(ind.done(f))
    return ind.calendar(f, scheme).filter(F.col("idx") >= warmup).drop("low_pivot", "high_pivot")


def enriched_outcomes(won: DataFrame, feats: DataFrame) -> DataFrame:
    return enriched(won, feats)


def learnable(feats: DataFrame) -> tuple[DataFrame, list[str]]:
    """Numeric features before scaling, and the columns to scale: levels relative to price, labels one-hot, patterns scored."""
    f = pattern_scores(one_hot(price_relative(feats)))
    whole = {"idx", "n_bars", "hour", "weekday"}
    plain = [c for c, t in f.dtypes if t == "double" and c not in whole and not c.startswith("CDL_") and not any(c.startswith(p) for p in ("session_", "trend_regime_", "vol_regime_"))]
    return f, plain


def learning_table(feats: DataFrame, fit_on: str | None = None) -> DataFrame:
    """Learnable features, scaled. fit_on: the instrument whose means and deviations are used for all; else each market has its own."""
    f, plain = learnable(feats)
    fit = scaler(f.filter(F.col("instrument") == fit_on), plain, b.KEYS) if fit_on else None
    return scaled(f, plain, b.KEYS, fit)


def prepared(feats: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(learning table of the markets that are new, state of the scaler): one scaler for all, that grows with the markets.

    before: the state of earlier calls, whose markets are done. The new markets are counted into it, and scaled by the whole.
    """
    f, plain = learnable(feats)
    f = f.join(before.select(*b.KEYS).distinct(), b.KEYS, "left_anti") if before is not None else f
    state = scaler_state(f, plain, b.KEYS)
    state = written(state if before is None else before.unionByName(state), "scaler")
    return scaled(f, plain, b.KEYS, scaler_of(state, plain)), state


def backtest(strategies: DataFrame, feats: DataFrame, indexed: DataFrame, costs: DataFrame, rule_features: list[str], look_ahead: int = 5000, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(trade log, report with regime maps) of all strategies on all markets given; only: pairs (strategy_id, KEYS) to try.

    Signals, trades and equity are written, as each of the next steps reads its input several times.
    """
    found = ev.signals(strategies, feats, rule_features)
    if only is not None:
        found = found.join(only, ["strategy_id", *b.KEYS], "left_semi")
    found = written(found, "signals")
    closed = written(ev.trades(ev.orders(found, costs), indexed, look_ahead).select(*ev.TRADE), "trades")
    done = written(ev.equity(closed), "equity")
    report = ev.performance(done).join(ev.regime_maps(found), ["strategy_id", *b.KEYS], "left")
    return ev.trade_log(done), report


def validation(detailed: DataFrame, mastery: DataFrame) -> DataFrame:
    return reports.ranked(reports.master_view(reports.summary(detailed), mastery))
