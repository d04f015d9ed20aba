"""Runs with state: discovery, mastery and validation, each going on from the tables that earlier runs left.

A run takes its state as tables and returns the next state as tables; nothing is changed in place. `saved` writes them to a new
folder and then switches to it, and `resumed` reads what the last complete run left. All strategies and markets of a run are one job.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.operators import blueprints as bp
from barsmith.operators import evaluate as ev
from barsmith.operators import reports, rules
from barsmith.operators.bars import KEYS
from barsmith.plans.pipelines import backtest
from barsmith.sources.state import append_distinct, current, known, not_done, publish, table_there, upsert_last, written


@dataclass
class Market:
    """What strategies are tried on: features, indexed bars, costs, and the features that rules may name."""

    features: DataFrame
    bars: DataFrame
    costs: DataFrame
    rule_features: list[str]
    look_ahead: int = 5000

    def only(self, condition: str) -> Market:
        return Market(self.features.filter(condition), self.bars.filter(condition), self.costs, self.rule_features, self.look_ahead)


@dataclass
class Discovery:
    strategies: DataFrame  # key, market_rule, n_candles, avg_density
    exhausted: DataFrame  # key
    done: DataFrame  # key


def discovery_run(combos: DataFrame, rows: DataFrame, features: list[str], blacklist: DataFrame, state: Discovery, least: int = 100, **grow) -> Discovery:
    """Rules of new blueprints, and new rules of blueprints with feedback (blacklist: key, market_rule or NULL).

    rows: training rows. Known rules, found earlier or blacklisted, count against a blueprint's bars and are not found again.
    Blueprints without a new rule are exhausted.
    """
    new = written(rules.to_learn(combos, state.done, state.exhausted, least).select("key").distinct(), "new")
    again = rules.to_relearn(combos, blacklist, state.exhausted, least).select("key").distinct()
    tried = written(new.unionByName(again).distinct(), "tried")
    old = state.strategies.select("key", "market_rule").unionByName(blacklist.select("key", "market_rule")).filter("market_rule IS NOT NULL").distinct()
    found = written(rules.mined(rows.join(tried, "key", "left_semi"), features, known=old.join(tried, "key", "left_semi"), **grow), "found")
    return Discovery(
        upsert_last(state.strategies, found, ["key", "market_rule"]), append_distinct(state.exhausted.select("key"), rules.exhausted(tried, found), ["key"]),
        append_distinct(state.done.select("key"), new, ["key"]),
    )


@dataclass
class Mastery:
    report: DataFrame  # a row for each strategy tried, best Sharpe ratio first
    passed: DataFrame  # strategies for validation
    blacklist: DataFrame  # key
    done: DataFrame  # strategy_id


def mastery_run(
    origin: str, strategies: DataFrame, market: Market, state: Mastery | None = None, top: int | None = None, factor: float = 1.5, drawdown: float = 25.0, least: int = 50
) -> tuple[Mastery, DataFrame]:
    """(next state, trade log): the strategies of a market tried on it, the best `top` of each rule, but for those done.

    origin: a condition that only rows of the market meet. Strategies without a trade report nothing, yet are done. Of a
    strategy tried twice the later row counts; one that passed stays passed; keys of those that fail are blacklisted.
    """
    mine = ev.with_ids(bp.with_definitions(strategies))
    mine = ev.top_per_rule(mine, top) if top else mine
    mine = written(not_done(mine, state.done, ["strategy_id"]) if state else mine, "strategies")
    here = market.only(origin)
    log, found = backtest(mine, here.features, here.bars, here.costs, here.rule_features, here.look_ahead)
    about = mine.select(*(c for c in mine.columns if c not in KEYS))
    report = written(about.join(found, "strategy_id"), "mastery")
    if state:
        report = upsert_last(state.report, report, ["strategy_id"])
    good = ev.passed(report, factor, drawdown, least)
    bad = ev.failed(report, good).select("key").distinct()
    tried = mine.select("strategy_id").distinct()
    if state:
        good, bad, tried = append_distinct(state.passed, good, ["strategy_id"]), append_distinct(state.blacklist, bad, ["key"]), append_distinct(state.done, tried, ["strategy_id"])
    return Mastery(reports.by_sharpe(report), good, bad, tried), log


@dataclass
class Validation:
    detailed: DataFrame  # a row for each strategy and market
    done: DataFrame  # strategy_id, instrument, timeframe
    summary: DataFrame | None = None  # a row for each strategy, most markets passed first


def validation_run(timeframe: int, passed: DataFrame, market: Market, state: Validation | None = None) -> tuple[Validation, DataFrame]:
    """(next state, trade log): the passed strategies of a timeframe tried on all its markets, but for the pairs done.

    Strategies of other timeframes are left alone; without a column timeframe all count. A strategy that passes later is tried
    on markets that others have been tried on before.
    """
    here = market.only(f"timeframe = {int(timeframe)}")
    mine = passed.filter(F.col("timeframe") == int(timeframe)) if "timeframe" in passed.columns else passed.withColumn("timeframe", F.lit(int(timeframe)))
    mine = mine.select(*(c for c in mine.columns if c in (*ev.STRATEGY, "key")))
    pairs = mine.select("strategy_id", "timeframe").distinct().join(here.bars.select(*KEYS).distinct(), "timeframe").select("strategy_id", *KEYS)
    todo = written(not_done(pairs, state.done, ["strategy_id", *KEYS]) if state else pairs, "todo")
    left = Market(known(here.features, todo, KEYS), known(here.bars, todo, KEYS), here.costs, here.rule_features, here.look_ahead)
    log, found = backtest(mine, left.features, left.bars, left.costs, left.rule_features, left.look_ahead, only=todo)
    detailed, tried = written(found, "detailed"), todo
    if state:
        detailed, tried = upsert_last(state.detailed, detailed, ["strategy_id", *KEYS]), append_distinct(state.done, tried, ["strategy_id", *KEYS])
    summary = reports.summary(detailed).join(passed.select(*(c for c in passed.columns if c in (*ev.STRATEGY, "key"))), "strategy_id", "left")
    return Validation(detailed, tried, reports.ranked(summary)), log


def saved(spark: SparkSession, root: str, state: Discovery | Mastery | Validation) -> None:
    """The state of a run as the current one of its folder: all its tables, or none if the run ends before."""
    publish(spark, root, {f.name: getattr(state, f.name) for f in fields(state) if getattr(state, f.name) is not None})


def resumed(spark: SparkSession, root: str, kind: type) -> Discovery | Mastery | Validation | None:
    """The state that the last complete run left; None before the first one."""
    at = current(spark, root)
    if at is None:
        return None
    found = {name: spark.read.parquet(f"{at}/{name}") for name in (f.name for f in fields(kind)) if table_there(spark, f"{at}/{name}")}
    return kind(**found)
