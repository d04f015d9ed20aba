"""Feature rules: parsing, matching, and mining by regression trees that grow for all keys at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.operators.bars import KEYS, indexed
from barsmith.sources.state import written

CONDITION = r"^\s*`([^`]+)`\s*(<=|>)\s*(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)\s*$"


def conditions(rules: DataFrame, features: list[str], rule: str = "market_rule") -> DataFrame:
    """(market_rule, feature, lo, hi, n_cond): lo < value <= hi for each feature of a rule.

    Rules are text such as `` `RSI_14` <= 30.5 and `hour` > 7 ``. Text of another form, or an unknown feature, raises.
    """
    part = F.col("_part")
    each = rules.select(rule).distinct().withColumn("_part", F.explode(F.split(rule, r"\s+and\s+")))
    bad = F.raise_error(F.concat(F.lit("not a condition: "), part)).cast("string")
    name = F.when(part.rlike(CONDITION), F.regexp_extract(part, CONDITION, 1)).otherwise(bad)
    unknown = F.raise_error(F.concat(F.lit("unknown feature: "), F.col("feature"))).cast("string")
    each = each.withColumn("feature", name).withColumn("feature", F.when(F.col("feature").isin(features), F.col("feature")).otherwise(unknown))
    value, below = F.regexp_extract(part, CONDITION, 3).cast("double"), F.regexp_extract(part, CONDITION, 2) == "<="
    each = each.select(rule, "feature", F.when(~below, value).alias("lo"), F.when(below, value).alias("hi"))
    merged = each.groupBy(rule, "feature").agg(F.coalesce(F.max("lo"), F.lit(float("-inf"))).alias("lo"), F.coalesce(F.min("hi"), F.lit(float("inf"))).alias("hi"))
    return merged.withColumn("n_cond", F.count(F.lit(1)).over(Window.partitionBy(rule)))


def within(value: Column) -> Column:
    """Whether a value meets the bounds lo and hi of a condition; without a lower bound minus infinity does too, NaN never does."""
    return ((F.col("lo") == float("-inf")) | (value > F.col("lo"))) & (value <= F.col("hi"))


def matches(rules: DataFrame, frame: DataFrame, features: list[str], rule: str = "market_rule") -> DataFrame:
    """(market_rule, KEYS, time, idx) of the bars that meet a rule.

    Division: bars are unpivoted to (bar, feature, value) over the features that rules may name, joined to conditions by
    feature, and a bar meets a rule when it meets all its conditions. A NULL value meets none.
    """
    cond = conditions(rules, features, rule)
    items = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))
    long = frame.select(*KEYS, "time", "idx", F.inline(items)).filter("value IS NOT NULL")
    met = long.join(cond, "feature").filter(within(F.col("value")))
    found = met.groupBy(rule, *KEYS, "time", "idx").agg(F.count(F.lit(1)).alias("_met"), F.first("n_cond").alias("_all"))
    return found.filter("_met = _all").drop("_met", "_all")


def training(targets: DataFrame, features: DataFrame) -> DataFrame:
    """Bars of each key with at least one win, and their features."""
    f = features.withColumnRenamed("time", "entry_time")
    return targets.join(f, [*KEYS, "entry_time"])


def without_known(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """trade_count 0 on bars that known rules of the key match; hits: (key, KEYS, entry_time)."""
    seen = hits.select("key", *KEYS, "entry_time").distinct().withColumn("_seen", F.lit(True))
    out = rows.join(seen, ["key", *KEYS, "entry_time"], "left")
    return out.withColumn("trade_count", F.when(F.col("_seen"), 0).otherwise(F.col("trade_count"))).drop("_seen")


def thresholds(rows: DataFrame, features: list[str], bins: int = 32) -> dict[str, list[float]]:
    """At most bins - 1 split values of each feature: quantiles over all rows (a few numbers, on the driver)."""
    points = [i / bins for i in range(1, bins)]
    row = rows.agg(*(F.percentile_approx(F.col(f).cast("double"), points, 10_000).alias(f) for f in features)).first()
    return {f: sorted({round(x, 5) for x in row[f] or []}) for f in features}


def key_thresholds(rows: DataFrame, features: list[str], bins: int = 32, by: str = "key") -> DataFrame:
    """(key, cuts): the split values of each key, an array for each feature in order, from quantile sketches of its own rows.

    The sketches are merged on the way, so a key's rows meet nowhere, and nothing goes through the driver.
    """
    points = [i / bins for i in range(1, bins)]
    sketches = [F.percentile_approx(F.col(f).cast("double"), points, 10_000).alias(f"_{i}") for i, f in enumerate(features)]
    none = F.array().cast("array<double>")
    cuts = [F.coalesce(F.sort_array(F.array_distinct(F.transform(f"_{i}", lambda x: F.round(x, 5)))), none) for i in range(len(features))]
    return rows.groupBy(by).agg(*sketches).select(by, F.array(*cuts).alias("cuts"))


def _places(features: list[str], cuts: dict[str, list[float]] | None) -> Column:
    """The bin of each feature in order, as an array; bin k: value <= cuts[k] first holds at k. NULL counts as 0."""
    values = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]

    def below(i: int, v: Column) -> Column:
        return F.size(F.filter(F.col("cuts")[i], lambda x: x < v))

    if cuts is None:  # the key's own, in column cuts
        return F.array(*(below(i, v) for i, v in enumerate(values)))
    return F.array(*(sum([F.when(v > x, 1).otherwise(0) for x in cuts[f]], F.lit(0)).cast("int") for f, v in zip(features, values, strict=True)))


def best_splits(cells: DataFrame, least: int) -> DataFrame:
    """The split of each (key, node) with the greatest drop in squared error, both sides of at least `least` rows.

    cells: key, node, feature, bin, n, s (sum of targets). n1: rows on the left side, n0: of the node. Ties go to the first
    feature, then bin.
    """
    w = Window.partitionBy("key", "node", "feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("key", "node", "feature")
    c = cells.withColumns({"n1": F.sum("n").over(w), "s1": F.sum("s").over(w), "n0": F.sum("n").over(whole), "s0": F.sum("s").over(whole)})
    c = c.filter((F.col("n1") >= least) & (F.col("n0") - F.col("n1") >= least))
    gain = F.pow("s1", F.lit(2)) / F.col("n1") + F.pow(F.col("s0") - F.col("s1"), F.lit(2)) / (F.col("n0") - F.col("n1")) - F.pow("s0", F.lit(2)) / F.col("n0")
    order = Window.partitionBy("key", "node").orderBy(F.desc(F.round("gain", 9)), "feature", "bin")
    ranked = c.withColumn("gain", gain).filter("gain > 1e-9").withColumn("_rank", F.row_number().over(order)).filter("_rank = 1")
    return ranked.select("key", "node", "feature", "bin", "gain", "n1", "n0")


def counted(state: DataFrame, features: list[str]) -> DataFrame:
    """Cells (key, node, feature, bin, n, s) of rows (key, node, y, places)."""
    names = F.array(*map(F.lit, features))
    each = state.select("key", "node", "y", F.posexplode("places").alias("_at", "bin")).groupBy("key", "node", "_at", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    return each.select("key", "node", F.get(names, F.col("_at")).alias("feature"), "bin", "n", "s")


def next_cells(cells: DataFrame, splits: DataFrame, state: DataFrame, features: list[str], least: int) -> DataFrame:
    """Cells of the children that may still be split, of 2 * least rows or more.

    Only the smaller child of a split is counted from rows; its sibling is what is left of the parent's cells.
    """
    s = splits.withColumn("_left", F.col("n1") * 2 <= F.col("n0"))
    s = s.select("key", F.col("node").alias("_parent"), (F.col("node") * 2 + (~F.col("_left")).cast("int")).alias("_small"), (F.col("node") * 2 + F.col("_left").cast("int")).alias("_big"),
                 F.least("n1", F.col("n0") - F.col("n1")).alias("_few"), F.greatest("n1", F.col("n0") - F.col("n1")).alias("_many")).filter(F.col("_many") >= 2 * least)
    s = written(s, "siblings")
    small = written(counted(state.join(s.select("key", F.col("_small").alias("node")), ["key", "node"], "left_semi"), features), "counted")
    parents = cells.join(s, (cells["key"] == s["key"]) & (cells["node"] == s["_parent"])).select(cells["key"], "feature", "bin", "n", "s", "_small", "_big")
    took = small.select(F.col("key").alias("_key"), F.col("node").alias("_node"), F.col("feature").alias("_feature"), F.col("bin").alias("_bin"), F.col("n").alias("_n"), F.col("s").alias("_s"))
    both = parents.join(took, (F.col("key") == F.col("_key")) & (F.col("_small") == F.col("_node")) & (F.col("feature") == F.col("_feature")) & (F.col("bin") == F.col("_bin")), "left")
    big = both.select("key", F.col("_big").alias("node"), "feature", "bin", (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n"), (F.col("s") - F.coalesce("_s", F.lit(0.0))).alias("s")).filter("n > 0")
    open_ = s.filter(F.col("_few") >= 2 * least).select("key", F.col("_small").alias("node"))
    return big.unionByName(small.join(open_, ["key", "node"], "left_semi"))


def grow(rows: DataFrame, cuts: dict[str, list[float]] | DataFrame, depth: int = 7, least: int = 50, features: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Trees of all keys, level by level: (leaves, splits).

    cuts: split values of each feature for all keys, or (key, cuts) of `key_thresholds` with `features` in the same order.
    leaves: key, node, n_candles, avg_density. splits: key, node, feature, bin, gain, cut; children of node are 2 * node and + 1.
    A level counts rows into (key, node, feature, bin) cells for the smaller child of each split alone, takes the sibling's from the
    parent's, and joins the few splits back to the rows.
    """
    own = not isinstance(cuts, dict)
    features = features if own else [f for f in features or cuts if f in cuts]
    if own:  # a key has at most one row for each bar, so no key is hot
        rows = rows.join(cuts, "key")
    # First the places alone: within one select a name in them could mean the new column y.
    placed = rows.select("key", "trade_count", _places(features, None if own else cuts).alias("places"))
    state = written(placed.select("key", F.col("trade_count").cast("double").alias("y"), "places", F.lit(1).alias("node")), "tree")
    number = F.array_position(F.array(*map(F.lit, features)), F.col("_f")).cast("int")
    cells, all_splits = written(counted(state, features), "cells"), None
    for level in range(depth):
        splits = written(best_splits(cells, least), "splits")
        if splits.isEmpty():
            break
        all_splits = splits if all_splits is None else all_splits.unionByName(splits)
        s = splits.select("key", "node", F.col("feature").alias("_f"), F.col("bin").alias("_b"))
        joined = state.join(s, ["key", "node"], "left")
        child = F.when(F.col("_f").isNull(), F.col("node")).otherwise(F.col("node") * 2 + (F.element_at("places", number) > F.col("_b")).cast("int"))
        state = written(joined.select("key", "y", "places", child.alias("node")), "tree")
        if level + 1 < depth:
            cells = written(next_cells(cells, splits, state, features, least), "cells")
    leaves = state.groupBy("key", "node").agg(F.count(F.lit(1)).alias("n_candles"), F.avg("y").alias("avg_density"))
    if all_splits is None:
        return leaves, rows.sparkSession.createDataFrame([], "key string, node int, feature string, bin int, gain double, cut double")
    if own:
        at = F.array_position(F.array(*map(F.lit, features)), F.col("feature")).cast("int")
        valued = all_splits.join(cuts, "key").withColumn("cut", F.element_at(F.element_at("cuts", at), F.col("bin") + 1))
    else:
        value = F.create_map(*(F.lit(x) for f, v in cuts.items() for x in (f, F.array(*map(F.lit, v)) if v else F.array().cast("array<double>"))))
        valued = all_splits.withColumn("cut", F.element_at(F.element_at(value, F.col("feature")), F.col("bin") + 1))
    return leaves, valued.select("key", "node", "feature", "bin", "gain", "cut")


def leaf_rules(leaves: DataFrame, splits: DataFrame) -> DataFrame:
    """(key, market_rule, n_candles, avg_density): the path to each leaf as text, one bound a side for each feature."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.log2(F.col("node").cast("double")) + 1e-9).cast("int")))
    path = leaves.filter("node > 1").withColumn("_up", F.explode(steps))
    path = path.withColumns({"_parent": F.expr("shiftright(node, _up)"), "_right": F.expr("shiftright(node, _up - 1) % 2 = 1")})
    s = splits.select("key", F.col("node").alias("_parent"), "feature", F.col("cut").alias("x"))
    on = path.join(s, ["key", "_parent"]).select("key", "node", "n_candles", "avg_density", "feature", "_right", "x")
    bound = on.groupBy("key", "node", "n_candles", "avg_density", "feature", "_right").agg(F.max("x").alias("lo"), F.min("x").alias("hi"))
    x = F.when(F.col("_right"), F.col("lo")).otherwise(F.col("hi"))
    text = F.concat(F.lit("`"), "feature", F.when(F.col("_right"), "` > ").otherwise("` <= "), F.round(x, 5).cast("string"))
    joined = bound.groupBy("key", "node", "n_candles", "avg_density").agg(F.array_join(F.sort_array(F.collect_list(text)), " and ").alias("market_rule"))
    return joined.select("key", "market_rule", "n_candles", "avg_density")


def by_key(rules: DataFrame) -> DataFrame:
    """(key, rules): the different rules of each key as a sorted array, for display."""
    return rules.groupBy("key").agg(F.sort_array(F.collect_set("market_rule")).alias("rules"))


def mined(
    rows: DataFrame, features: list[str], depth: int = 7, least: int = 50, lift: float = 1.5, known: DataFrame | None = None, bins: int = 32, cuts: dict[str, list[float]] | None = None
) -> DataFrame:
    """Rules of leaves with density >= lift times the key's baseline (mean over its training rows), known rules left out.

    rows: key, KEYS, entry_time, trade_count, features. known: (key, market_rule), whose bars count as 0.
    cuts: split values of each feature for all keys, else quantiles of each key's own rows.
    """
    from barsmith.operators.bitmaps import matches_by_index

    base = rows.groupBy("key").agg(F.avg("trade_count").alias("baseline"))
    used = rows
    if known is not None:
        bars = written(indexed(rows.select(*KEYS, F.col("entry_time").alias("time"), *features).distinct()), "bars")
        found = matches_by_index(known, bars, features)
        hits = known.join(found, "market_rule").withColumnRenamed("time", "entry_time")
        used = without_known(rows, hits)
    cuts = cuts or written(key_thresholds(rows, features, bins), "cuts")
    leaves, splits = grow(used, cuts, depth, least, features)
    rules = leaf_rules(leaves, splits).join(base, "key").filter("baseline > 0 AND avg_density >= baseline * " + repr(float(lift))).drop("baseline")
    return rules.join(known.select("key", "market_rule"), ["key", "market_rule"], "left_anti") if known is not None else rules


def exhausted(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """Keys that got no new rule."""
    return keys.select("key").distinct().join(rules.select("key").distinct(), "key", "left_anti")


def to_learn(combos: DataFrame, done: DataFrame, spent: DataFrame, least: int = 100) -> DataFrame:
    """Blueprints with enough bars, neither exhausted nor processed."""
    return combos.filter(F.col("num_candles") >= least).join(spent.select("key"), "key", "left_anti").join(done.select("key"), "key", "left_anti")


def to_relearn(combos: DataFrame, blacklist: DataFrame, spent: DataFrame, least: int = 100) -> DataFrame:
    """Blueprints with feedback, enough bars, not exhausted."""
    return combos.filter(F.col("num_candles") >= least).join(blacklist.select("key").distinct(), "key", "left_semi").join(spent.select("key"), "key", "left_anti")
