"""Features for learning: one-hot labels, pattern scores, standard scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.functions.patterns import score

# The labels of each categorical column, so that every market has the same columns.
LABELS = {
    "session": ("Tokyo", "Tokyo_London_Overlap", "London", "London_NY_Overlap", "New_York", "Sydney", "Asian"),
    "trend_regime_14": ("trend", "range"),
    "vol_regime_14": ("high_vol", "low_vol"),
}


def one_hot(frame: DataFrame, drop_first: bool = False) -> DataFrame:
    here = [c for c in LABELS if c in frame.columns]
    new = {f"{c}_{v}": F.when(F.col(c) == v, 1.0).otherwise(0.0) for c in here for v in LABELS[c][drop_first:]}
    return frame.withColumns(new).drop(*here)


def pattern_scores(frame: DataFrame, strong: int = 100) -> DataFrame:
    return frame.withColumns({c: score(F.col(c), strong) for c in frame.columns if c.startswith("CDL_")})


def scaler(frame: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Mean and population deviation (0 counts as 1) of columns, missing values as 0; one row for each `by`."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    stats = [f(x).alias(f"_{n}_{c}") for c, x in zip(columns, filled, strict=True) for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return frame.groupBy(*by).agg(*stats)


def scaled(frame: DataFrame, columns: list[str], by: list[str], fit: DataFrame | None = None) -> DataFrame:
    """Columns minus mean over deviation. fit: a scaler row to use for all (broadcast: one row); else one for each `by`."""
    joined = frame.join(F.broadcast(fit.drop(*by)), F.lit(True)) if fit is not None else frame.join(scaler(frame, columns, by), by)
    new = {}
    for c in columns:
        std = F.col(f"_std_{c}")
        new[c] = (F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col(f"_mean_{c}")) / F.when(std == 0, 1.0).otherwise(std)
    return joined.withColumns(new).drop(*(f"_{n}_{c}" for c in columns for n in ("mean", "std")))


def scaler_state(frame: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """(by, feature, n, mean, m2): what a scaler needs of each market, m2 the sum of squared deviations. Missing values count as 0."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    stats = [F.struct(F.lit(c).alias("feature"), F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(F.lit(1))).alias("m2")) for c, x in zip(columns, filled, strict=True)]
    return frame.groupBy(*by).agg(F.array(*stats).alias("_stats")).select(*by, F.inline("_stats"))


def _pooled(a: Column, b: Column) -> Column:
    """Two sets as one: counts add up, and means that lie apart add to the deviations."""
    n = a["n"] + b["n"]
    step = b["mean"] - a["mean"]
    return F.struct(n.alias("n"), (a["mean"] + step * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + step * step * a["n"] * b["n"] / n).alias("m2"))


def scaler_of(state: DataFrame, columns: list[str]) -> DataFrame:
    """One scaler (a row as `scaler` makes it) of all rows of the state: markets are pooled feature by feature, whatever run they came from."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    parts = state.filter("n > 0").groupBy("feature").agg(F.sort_array(F.collect_list(F.struct("n", "mean", "m2"))).alias("_parts"))
    whole = parts.select("feature", F.aggregate("_parts", none, _pooled).alias("s"))
    values = [F.first(F.when(F.col("feature") == c, x), True).alias(f"_{n}_{c}") for c in columns for n, x in (("mean", F.col("s.mean")), ("std", F.sqrt(F.col("s.m2") / F.col("s.n"))))]
    return whole.agg(*values)
