"""Reports across markets, and the tables behind dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.operators.bars import KEYS

METRICS = ("profit_factor", "sharpe_ratio", "max_drawdown_pct", "win_rate_pct", "final_capital", "total_trades")


def capped(value: Column, most: float) -> Column:
    """Infinities and greater values as `most`."""
    return F.when(F.abs(value) == float("inf"), most).otherwise(F.least(value, F.lit(most)))


def summary(detailed: DataFrame) -> DataFrame:
    """One row for each strategy: markets tested and passed (profit factor over 1), means, trades; best first."""
    out = detailed.groupBy("strategy_id").agg(
        F.count(F.lit(1)).alias("markets_tested"), F.avg("profit_factor").alias("avg_profit_factor"), F.avg("sharpe_ratio").alias("avg_sharpe_ratio"),
        F.avg("max_drawdown_pct").alias("avg_max_drawdown_pct"), F.sum("total_trades").alias("total_trades"),
        F.count_if(F.col("profit_factor") > 1).alias("validation_markets_passed_count"),
    )
    text = F.concat(F.col("validation_markets_passed_count").cast("string"), F.lit("/"), F.col("markets_tested").cast("string"))
    return out.withColumn("validation_markets_passed", text)


def ranked(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("validation_markets_passed_count"), F.desc("avg_sharpe_ratio"), "strategy_id")


def by_sharpe(report: DataFrame) -> DataFrame:
    return report.orderBy(F.desc("sharpe_ratio"), "strategy_id")


def master_view(validation: DataFrame, mastery: DataFrame) -> DataFrame:
    """Summaries with the strategy's results on its first market (NULL without), profit factors capped at 100, Sharpe at 10."""
    m = mastery.select("strategy_id", *(F.col(c).alias(f"mastery_{c}") for c in METRICS))
    both = validation.join(m, "strategy_id", "left")
    caps = {c: 100.0 if "profit_factor" in c else 10.0 for c in both.columns if "profit_factor" in c or "sharpe_ratio" in c}
    return both.withColumns({c: capped(F.col(c), most) for c, most in caps.items()})


def survivors(view: DataFrame, factor: float = 0.0, sharpe: float = 0.0, markets: int = 0, trades: int = 0) -> DataFrame:
    """Rows at or over four minimums; missing values count as 0."""
    least = {"avg_profit_factor": factor, "avg_sharpe_ratio": sharpe, "validation_markets_passed_count": markets, "total_trades": trades}
    for c, value in least.items():
        view = view.filter(F.coalesce(F.col(c), F.lit(0)) >= value)
    return view


def by_market(mastery: DataFrame, validation: DataFrame) -> DataFrame:
    """Results of each strategy on every market, the first market marked."""
    rows = mastery.withColumn("phase", F.lit("mastery")).unionByName(validation.withColumn("phase", F.lit("validation")), allowMissingColumns=True)
    return rows.withColumns({"profit_factor": capped(F.col("profit_factor"), 100.0), "sharpe_ratio": capped(F.col("sharpe_ratio"), 10.0)})


def regime_rows(report: DataFrame, column: str, most: float = 5.0) -> DataFrame:
    """The shares of a regime map as rows beside the capped profit factor."""
    return report.select("strategy_id", *KEYS, F.explode(column).alias("regime", "pct"), capped(F.col("profit_factor"), most).alias("profit_factor"))


def internals(features: DataFrame) -> DataFrame:
    """Character of each market: shares of bars in trend and in high volatility, mean band width, change of price in percent."""
    first, last = F.min_by("close", "time"), F.max_by("close", "time")
    return features.groupBy(*KEYS).agg(
        (F.avg(F.when(F.col("trend_regime_14") == "trend", 1.0).otherwise(0.0)) * 100).alias("time_in_trend_pct"),
        (F.avg(F.when(F.col("vol_regime_14") == "high_vol", 1.0).otherwise(0.0)) * 100).alias("time_high_vol_pct"),
        F.avg("BB_width_20").alias("avg_bb_width"), (F.try_divide(last - first, first) * 100).alias("price_change_pct"),
    )


def internals_with_results(market: DataFrame, report: DataFrame) -> DataFrame:
    best = report.groupBy(*KEYS).agg(F.avg(capped(F.col("profit_factor"), 100.0)).alias("profit_factor"))
    return market.join(best, KEYS, "left").fillna(0.0, ["profit_factor"])


def entries_on_prices(log: DataFrame, bars: DataFrame) -> DataFrame:
    """Entries of trades on the bars of their market, with whether they won."""
    t = log.select("strategy_id", *KEYS, F.col("entry_time").alias("time"), "pnl", (F.col("pnl") > 0).alias("won"))
    return bars.select(*KEYS, "time", "close").join(t, [*KEYS, "time"])


def all_passes(report: DataFrame, good: DataFrame) -> DataFrame:
    """The passing strategies of all report origins, one row for each origin and strategy."""
    return report.join(good.select("strategy_id").distinct(), "strategy_id", "left_semi").dropDuplicates(["origin", "strategy_id"])
