"""Registered queries of runs with state, preset grids, deeper trees, and series that grow with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barsmith.functions import indicators as ind
from barsmith.functions.positioning import LEVELS, level_price
from barsmith.operators import bars as b
from barsmith.operators import barriers as br
from barsmith.operators import bitmaps as bm
from barsmith.operators import blueprints as bp
from barsmith.operators import evaluate as ev
from barsmith.operators import rules
from barsmith.plans import pipelines, runs
from barsmith.plans import queries as q
from barsmith.plans.queries import PERF, PERF_COLS, SUMMARY, SUMMARY_COLS, TRADES, TREE, query, rounded, sql

SHORT = ("a1", "b2")
OF_SHORT = "(strategy_id LIKE 'a1%' OR strategy_id LIKE 'b2%')"


# --- strategies on markets of their timeframe, and runs -------------------------------------------------------------------
@query(sql(f"SELECT strategy_id, instrument, CASE WHEN {OF_SHORT} THEN 60 ELSE 15 END AS timeframe, time, idx, round(close, 6) + 0.0 AS close FROM od", "feat", **{k: TRADES[k] for k in ("st", "sg", "od")}))
def timeframe_signals(spark, sf_dir):
    """The same bars under two timeframes: each strategy meets those of its own only."""
    f = q.features(spark, sf_dir)
    both = f.unionByName(f.withColumn("timeframe", F.lit(15)))
    mine = q.strategies(spark).withColumn("timeframe", F.when(F.col("key").isin(*SHORT), 60).otherwise(15))
    return rounded(ev.signals(mine, both, q.RULE_FEATURES).select("strategy_id", *b.KEYS, "time", "idx", "close"))


def market(spark, sf_dir) -> runs.Market:
    numbered = q.written(q.indexed(spark, sf_dir), "numbered")
    return runs.Market(q.features(spark, sf_dir, numbered), numbered, b.cost_table(spark), q.RULE_FEATURES)


def mastery_of(spark, sf_dir) -> runs.Mastery:
    """On the market 'view', the best strategy of each rule; one strategy is done already and has an older row."""
    some = q.strategies(spark)
    done = some.filter("key = 'd4'").select("strategy_id")
    old = done.select("strategy_id", F.lit("d4").alias("key"), *(F.lit(0.5).alias(c) for c in q.METRICS), F.lit(7).cast("long").alias("total_trades"))
    state = runs.Mastery(old, old.limit(0), old.select("key").limit(0), done)
    return runs.mastery_run("instrument = 'view'", some.drop("strategy_id"), market(spark, sf_dir), state, 1, 0.5, 95.0, 10)[0]


IN_RUN = "SELECT * FROM pf WHERE instrument = 'view' AND strategy_id[1:2] IN ('a1', 'b2', 'c3')"
PASS = "profit_factor >= 0.5 AND max_drawdown_pct <= 95 AND total_trades >= 10"


@query(sql(f"""SELECT strategy_id, strategy_id[1:2] AS key, {PERF_COLS}, total_trades, {PASS} AS passed, NOT ({PASS}) AS blacklisted FROM rn
 UNION ALL SELECT strategy_id, 'd4', 0.5, 0.5, 0.5, 0.5, 0.5, 7, false, true FROM st WHERE key = 'd4'""", "feat", **TRADES, **PERF, rn=IN_RUN))
def mastery_run(spark, sf_dir):
    got = mastery_of(spark, sf_dir)
    good, bad = got.passed.select("strategy_id", F.lit(True).alias("passed")), got.blacklist.select("key", F.lit(True).alias("blacklisted"))
    rows = got.report.select("strategy_id", "key", *q.METRICS, "total_trades").join(good, "strategy_id", "left").join(bad, "key", "left").fillna(False)
    return rounded(rows, 4)


@query(sql(f"""SELECT {SUMMARY_COLS}, t.key, t.trade_type FROM sy JOIN st t USING (strategy_id)""", "feat", **TRADES, **PERF, rn=IN_RUN,
           pv=f"SELECT * FROM pf WHERE strategy_id IN (SELECT strategy_id FROM rn WHERE {PASS})", sy=SUMMARY.replace("FROM pf", "FROM pv")))
def validation_run(spark, sf_dir):
    """Two runs: the first knows two markets, the second goes on with the rest."""
    m, passed = market(spark, sf_dir), mastery_of(spark, sf_dir).passed
    first, _ = runs.validation_run(60, passed, m.only("instrument IN ('view', 'click')"))
    second, _ = runs.validation_run(60, passed, m, first)
    return rounded(second.summary.select(*(c.strip().split(" AS ")[-1] for c in SUMMARY_COLS.split(", ") if "(" not in c or " AS " in c), "key", "trade_type"), 4)


@query(sql(f"SELECT strategy_id, instrument, CASE WHEN {OF_SHORT} THEN 60 ELSE 15 END AS timeframe, {PERF_COLS}, total_trades FROM pf", "feat", **TRADES, **PERF))
def validation_timeframes(spark, sf_dir):
    """Markets of two timeframes: runs of either try its own strategies alone, and the second goes on from the first.

    One strategy of the first timeframe passes only before the last run, which tries it on the markets done without it.
    """
    m = market(spark, sf_dir)
    both = runs.Market(*(q.written(f.unionByName(f.withColumn("timeframe", F.lit(15))), "both") for f in (m.features, m.bars)), m.costs, m.rule_features)
    mine = q.strategies(spark).withColumn("timeframe", F.when(F.col("key").isin(*SHORT), 60).otherwise(15))
    first, _ = runs.validation_run(60, mine.filter("key <> 'b2'"), both)
    second, _ = runs.validation_run(15, mine, both, first)
    last, _ = runs.validation_run(60, mine, both, second)
    return rounded(last.detailed.select("strategy_id", *b.KEYS, *q.METRICS, "total_trades"), 4)


@query(q.SQL["combinations"])
def combinations_in_runs(spark, sf_dir):
    """Blueprints counted in three runs over overlapping thirds of the outcomes, as sets of bars that are merged."""
    rows = q.written(bp.blueprint_rows(q.enriched_bars(spark, sf_dir), q.LEVELS), "placements")
    runs_of = [bm.blueprint_bitmaps(rows.filter(c)) for c in ("entry_idx % 3 <> 0", "entry_idx % 3 <> 1", "entry_idx % 3 = 1")]
    known = bm.merged(*runs_of[:2])
    return bp.defined(bm.bar_counts(bm.merged(known, runs_of[2])))


# Bounds that lie beside those of `rule_matches`, so that with two edges a feature some of them cut bins.
CUT_RULES = {
    "`RSI_14` > 41.5": '"RSI_14" > 41.5', "`RSI_14` <= 47.25 and `hour` > 3.0": '"RSI_14" <= 47.25 AND hour > 3', "`ADX_14` > 11.5 and `ADX_14` <= 18.75": '"ADX_14" > 11.5 AND "ADX_14" <= 18.75',
    "`hour` > 4.0 and `hour` <= 4.0": "false", "`weekday` <= 2.0 and `RSI_14` > 52.125 and `ADX_14` > 13.0": 'weekday <= 2 AND "RSI_14" > 52.125 AND "ADX_14" > 13',
}


@query(sql(" UNION ALL ".join(f"SELECT '{r}' AS market_rule, instrument, timeframe, time, idx FROM feat WHERE {x}" for r, x in {**q.RULES, **CUT_RULES}.items()), "feat"))
def rule_index_cut_bins(spark, sf_dir):
    """Rules by an index of two edges a feature: bars in bins that a bound cuts are tested one by one."""
    texts = q.strategies(spark).select("market_rule").union(spark.createDataFrame([(r,) for r in CUT_RULES], "market_rule string"))
    return bm.matches_by_index(texts, q.features(spark, sf_dir), q.RULE_FEATURES, most=2)


BEST = "SELECT * FROM gains WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(gain, 9) DESC, feature, bin) = 1"
LEARNT = "SELECT * FROM best WHERE key <> 'view-buy' AND n0 >= 100"


@query(sql("""SELECT * FROM (SELECT key, '`' || feature || '` <= ' || bin || '.0' AS market_rule, n1::BIGINT AS n_candles, round(s1 / n1, 6) + 0.0 AS avg_density FROM lt WHERE s1 / n1 >= 1.02 * s0 / n0
 UNION ALL SELECT key, '`' || feature || '` > ' || bin || '.0', (n0 - n1)::BIGINT, round((s0 - s1) / (n0 - n1), 6) + 0.0 FROM lt WHERE (s0 - s1) / (n0 - n1) >= 1.02 * s0 / n0)""", "won",
           **{**TREE, "gains": TREE["gains"].replace("AS gain", "AS gain, n1, s1, n0, s0")}, best=BEST, lt=LEARNT))
def discovery_run(spark, sf_dir):
    """New keys but those of 'view', which are done; one of these has feedback and is learnt again."""
    rows = q.written(q.tree_rows(spark, sf_dir), "rows")
    combos = rows.groupBy("key").agg(F.count(F.lit(1)).alias("num_candles"))
    none = rows.select("key", F.lit("").alias("market_rule"), F.lit(0).cast("long").alias("n_candles"), F.lit(0.0).alias("avg_density")).limit(0)
    state = runs.Discovery(none, none.select("key"), rows.select("key").filter("key LIKE 'view-%'").distinct())
    feedback = rows.select("key", F.lit(None).cast("string").alias("market_rule")).filter("key = 'view-sell'").distinct()
    got = runs.discovery_run(combos, rows, list(q.CUTS), feedback, state, depth=1, lift=1.02, cuts=q.CUTS)
    return rounded(got.strategies)


CELLS_2 = "SELECT key, node, 'hour' AS feature, hour AS bin, y FROM t2 UNION ALL SELECT key, node, 'weekday', weekday, y FROM t2"
LEVEL_2 = {
    "b1": BEST,
    "t2": "SELECT t.*, 2 + (CASE WHEN b.feature = 'hour' THEN t.hour ELSE t.weekday END > b.bin)::INT AS node FROM tr t JOIN b1 b USING (key)",
    "cell2": f"SELECT key, node, feature, bin, count(*) AS n, sum(y) AS s FROM ({CELLS_2}) GROUP BY ALL",
    "cum2": TREE["cum"].replace("PARTITION BY key, feature", "PARTITION BY key, node, feature").replace("FROM cell", "FROM cell2"),
    "gains2": TREE["gains"].replace("SELECT key,", "SELECT key, node,").replace("FROM cum", "FROM cum2"),
}


@query(sql("""SELECT key, 1 AS node, feature, bin, round(gain, 6) + 0.0 AS gain FROM b1 UNION ALL
 (SELECT key, node, feature, bin, round(gain, 6) + 0.0 FROM gains2 WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY key, node ORDER BY round(gain, 9) DESC, feature, bin) = 1)""", "won", **TREE, **LEVEL_2))
def rule_tree_levels(spark, sf_dir):
    _, splits = rules.grow(q.tree_rows(spark, sf_dir), q.CUTS, depth=2)
    return rounded(splits.select("key", "node", "feature", "bin", "gain"))


def deep_sql(depth: int, least: int) -> dict[str, str]:
    """Levels of trees over hour and weekday: rows with their node, cells, gains and best splits of each."""
    out = {"d1": "SELECT *, 1 AS node FROM tr"}
    for k in range(1, depth + 1):
        here = f"(SELECT * FROM d{k} WHERE node >= {2 ** (k - 1)})"
        out[f"c{k}"] = f"SELECT key, node, feature, bin, count(*) AS n, sum(y) AS s FROM (SELECT key, node, 'hour' AS feature, hour AS bin, y FROM {here} UNION ALL SELECT key, node, 'weekday', weekday, y FROM {here}) GROUP BY ALL"
        out[f"u{k}"] = TREE["cum"].replace("PARTITION BY key, feature", "PARTITION BY key, node, feature").replace("FROM cell", f"FROM c{k}")
        out[f"g{k}"] = TREE["gains"].replace("SELECT key,", "SELECT key, node,").replace("FROM cum", f"FROM u{k}").replace("50", str(least))
        out[f"s{k}"] = f"SELECT * FROM g{k} WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY key, node ORDER BY round(gain, 9) DESC, feature, bin) = 1"
        out[f"d{k + 1}"] = f"""SELECT d.* EXCLUDE node, CASE WHEN s.key IS NULL THEN d.node ELSE 2 * d.node + (CASE WHEN s.feature = 'hour' THEN d.hour ELSE d.weekday END > s.bin)::INT END AS node
 FROM d{k} d LEFT JOIN s{k} s ON s.key = d.key AND s.node = d.node"""
    return out


DEPTH, LEAF = 7, 20


@query(sql(f"SELECT key, node, count(*) AS n_candles, round(avg(y), 6) + 0.0 AS avg_density FROM d{DEPTH + 1} GROUP BY key, node", "won", tr=TREE["tr"], **deep_sql(DEPTH, LEAF)))
def rule_tree_leaves(spark, sf_dir):
    """Leaves of trees of depth 7, each with its rows and their mean."""
    leaves, _ = rules.grow(q.tree_rows(spark, sf_dir), q.CUTS, DEPTH, LEAF)
    return rounded(leaves.select("key", "node", "n_candles", "avg_density"))


# --- what discovery leaves out, text definitions, and costs of named markets ---------------------------------------------------
FOUND = "SELECT key FROM lt WHERE s1 / n1 >= 1.02 * s0 / n0 OR (s0 - s1) / (n0 - n1) >= 1.02 * s0 / n0"


@query(sql(f"""SELECT key, key NOT IN (SELECT key FROM ({FOUND})) AS exhausted, key LIKE 'view-%' AS done_before FROM (SELECT key FROM tr WHERE key <> 'view-buy' GROUP BY key HAVING count(*) >= 100)""", "won",
           **{**TREE, "gains": TREE["gains"].replace("AS gain", "AS gain, n1, s1, n0, s0")}, best=BEST, lt=LEARNT))
def exhausted_keys(spark, sf_dir):
    """Blueprints that were tried, and which of them gave no rule."""
    rows = q.written(q.tree_rows(spark, sf_dir), "rows")
    combos = rows.groupBy("key").agg(F.count(F.lit(1)).alias("num_candles"))
    none = rows.select("key", F.lit("").alias("market_rule"), F.lit(0).cast("long").alias("n_candles"), F.lit(0.0).alias("avg_density")).limit(0)
    before = rows.select("key").filter("key LIKE 'view-%'").distinct()
    feedback = rows.select("key", F.lit(None).cast("string").alias("market_rule")).filter("key = 'view-sell'").distinct()
    got = runs.discovery_run(combos, rows, list(q.CUTS), feedback, runs.Discovery(none, none.select("key"), before), depth=1, lift=1.02, cuts=q.CUTS)
    spent = got.exhausted.select("key", F.lit(True).alias("exhausted"))
    tried = combos.filter("num_candles >= 100 AND key <> 'view-buy'").select("key")
    return tried.join(spent, "key", "left").select("key", F.coalesce("exhausted", F.lit(False)).alias("exhausted"), F.col("key").like("view-%").alias("done_before"))


KNOWN = {"view-buy": ("`hour` > 11.0 and `weekday` <= 3.0", "hour > 11 AND weekday <= 3"), "click-sell": ("`hour` <= 5.0", "hour <= 5"), "error-buy": ("`weekday` > 4.0 and `hour` > 20.0", "weekday > 4 AND hour > 20")}


@query(sql("SELECT key, entry_time, CASE WHEN " + " OR ".join(f"(key = '{k}' AND {x})" for k, (_, x) in KNOWN.items()) + " THEN 0 ELSE y END AS trade_count FROM tr", "won", **TREE))
def excluded_targets(spark, sf_dir):
    """Targets with the bars set to 0 that known rules of their key match."""
    rows = q.written(q.tree_rows(spark, sf_dir), "rows")
    known = spark.createDataFrame([(k, r) for k, (r, _) in KNOWN.items()], "key string, market_rule string")
    bars = q.written(b.indexed(rows.select(*b.KEYS, F.col("entry_time").alias("time"), *q.CUTS).distinct()), "bars")
    hits = known.join(bm.matches_by_index(known, bars, list(q.CUTS)), "market_rule").withColumnRenamed("time", "entry_time")
    return rules.without_known(rows, hits).select("key", "entry_time", F.col("trade_count").cast("long").alias("trade_count"))


@query(sql("SELECT strategy_id, instrument, idx, round(sl_price, 6) + 0.0 AS sl_price, round(tp_price, 6) + 0.0 AS tp_price FROM ok", "feat", **{k: TRADES[k] for k in ("st", "sg", "od", "ok")}))
def orders_from_text(spark, sf_dir):
    """Orders of strategies whose stops and targets are text: a number is a ratio, other text a level."""
    some = q.strategies(spark)
    text = {f"{s}_def": F.coalesce(f"{s}_level", F.concat(F.lit(" "), F.col(f"{s}_ratio").cast("string"))) for s in ("sl", "tp")}
    typed = bp.with_definitions(some.withColumns(text).drop("sl_level", "sl_ratio", "tp_level", "tp_ratio"))
    placed = ev.orders(ev.signals(typed, q.features(spark, sf_dir), q.RULE_FEATURES), b.cost_table(spark))
    return rounded(placed.select("strategy_id", "instrument", "idx", "sl_price", "tp_price"))


# Event types as markets: some with costs of their own, with and without digits, one quoted in yen, one unknown.
NAMED = {"view": "EURUSD60", "click": "XAUUSD15", "error": "gbpusd", "purchase": "USDJPY", "signup": "NZDJPY240"}
COST_COLUMNS = ("spread_pips", "commission_per_lot", "pip_value", "slippage_pips")
COST_SQL = "SELECT * FROM (VALUES " + ", ".join(str(x) for x in b.COSTS) + ") v(market, " + ", ".join(COST_COLUMNS) + ")"
NAMES_SQL = "CASE instrument " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMED.items()) + " END"
SPREAD_SQL = "coalesce(CASE upper(name) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in b.SPREADS.items()) + f" END, {b.SPREADS['DEFAULT']}) * CASE WHEN upper(name) LIKE '%JPY%' OR upper(name) LIKE '%XAU%' THEN 0.01 ELSE 0.0001 END"


@query(sql(f"""SELECT name AS instrument, time, {", ".join(f"coalesce(o.{c}, d.{c})::DOUBLE AS {c}" for c in COST_COLUMNS)}, round(({SPREAD_SQL})::DOUBLE, 6) + 0.0 AS spread_cost
 FROM (SELECT {NAMES_SQL} AS name, time FROM bars) x LEFT JOIN cs o ON o.market <> 'DEFAULT' AND o.market = regexp_replace(name, '[0-9]+$', '') JOIN cs d ON d.market = 'DEFAULT'""", "bars", cs=COST_SQL))  # fmt: skip
def market_costs(spark, sf_dir):
    """Costs of trades, and the spread of labels, on bars of named markets."""
    name = F.create_map(*(F.lit(x) for kv in NAMED.items() for x in kv))
    bars = q.bars(spark, sf_dir).select(F.element_at(name, F.col("instrument")).alias("instrument"), "time")
    return rounded(b.with_costs(bars, b.cost_table(spark)).withColumn("spread_cost", b.spread_cost(F.col("instrument"))).select("instrument", "time", *COST_COLUMNS, "spread_cost"))


# --- the whole preset grid -----------------------------------------------------------------------------------------------
(SL_A, SL_Z, SL_STEP), (TP_A, TP_Z, TP_STEP), PRESET_LOOK = b.PRESETS[q.MINUTES]
PRESET = {
    "el": f"SELECT *, CASE WHEN instrument ILIKE '%JPY%' OR instrument ILIKE '%XAU%' THEN 0.03 ELSE 0.0003 END AS spread FROM ix WHERE idx < n_bars - {PRESET_LOOK}",
    "rt": f"SELECT DISTINCT unnest(range({SL_A}, {SL_Z + 1}, {SL_STEP}) || range({TP_A}, {TP_Z + 1}, {TP_STEP})) AS r",
    "to": f"""SELECT a.instrument, a.idx, t.r, min(CASE WHEN f.high >= a.close * (1 + t.r / 10000) + a.spread THEN f.idx END) AS tb, min(CASE WHEN f.low <= a.close * (1 - t.r / 10000) THEN f.idx END) AS sb,
 min(CASE WHEN f.low <= a.close * (1 - t.r / 10000) - a.spread THEN f.idx END) AS ts, min(CASE WHEN f.high >= a.close * (1 + t.r / 10000) THEN f.idx END) AS ss
 FROM el a CROSS JOIN rt t JOIN ix f ON f.instrument = a.instrument AND f.idx > a.idx AND f.idx <= a.idx + {PRESET_LOOK} GROUP BY ALL""",
    "pw": f"""SELECT s.instrument, v.side AS trade_type, s.r AS sl, t.r AS tp, CASE WHEN v.side = 'buy' THEN t.tb ELSE t.ts END AS e, CASE WHEN v.side = 'buy' THEN s.sb ELSE s.ss END AS x
 FROM "to" s JOIN "to" t ON s.instrument = t.instrument AND s.idx = t.idx CROSS JOIN (VALUES ('buy'), ('sell')) v(side) WHERE s.r IN (SELECT unnest(range({SL_A}, {SL_Z + 1}, {SL_STEP}))) AND t.r IN (SELECT unnest(range({TP_A}, {TP_Z + 1}, {TP_STEP})))""",
}


@query(sql("""SELECT p.instrument, trade_type, sl, tp, count(*) AS wins, max(i.time) AS last_exit FROM pw p JOIN ix i ON i.instrument = p.instrument AND i.idx = p.e
 WHERE e IS NOT NULL AND (x IS NULL OR e <= x) GROUP BY ALL""", "ix", **{('"to"' if k == "to" else k): v for k, v in PRESET.items()}))  # fmt: skip
def preset_outcomes(spark, sf_dir):
    """All pairs of the preset of hourly bars, 600 bars ahead."""
    won = pipelines.outcomes(q.indexed(spark, sf_dir), q.MINUTES)
    return won.groupBy("instrument", "trade_type", F.col("sl").cast("long").alias("sl"), F.col("tp").cast("long").alias("tp")).agg(F.count(F.lit(1)).alias("wins"), F.max("exit_time").alias("last_exit"))


# --- all levels, and prices from bins ------------------------------------------------------------------------------------
F14 = "SELECT f.*, " + ", ".join(
    [f'CASE WHEN f.idx >= {n - 1} THEN avg(f.close) OVER (PARTITION BY f.instrument ORDER BY f.idx ROWS {n - 1} PRECEDING) END AS "SMA_{n}"' for n in (50, 100, 200)]
    + [f'CASE WHEN f.idx >= {n - 1} THEN s.e{n} END AS "EMA_{n}"' for n in (8, 21, 50)]
    + [f'CASE WHEN f.idx >= 13 THEN f.close {sign} s.atr END AS "ATR_level_{way}_1x_14"' for way, sign in (("up", "+"), ("down", "-"))]
) + " FROM feat f JOIN sm s ON s.instrument = f.instrument AND s.idx = f.idx"


@query(sql("SELECT instrument, type, level, bin, count(DISTINCT entry_time) AS bars, count(*) AS outcomes FROM bb GROUP BY ALL", "won", "feat", "sm", f14=F14, en=q.enriched_sql(LEVELS, "f14"), eb=q.EB, bb=q.bins_sql(LEVELS)))
def all_levels(spark, sf_dir):
    """Placements against all 14 levels of the whole feature chain."""
    bars = q.written(q.indexed(spark, sf_dir), "bars")
    won = br.barrier_outcomes(bars, q.SL, q.TP, q.LOOK)
    rows = bp.blueprint_rows(pipelines.enriched_outcomes(won, pipelines.features(bars, warmup=0)))
    return rows.groupBy("instrument", "type", "level", "bin").agg(F.count_distinct("entry_time").alias("bars"), F.count(F.lit(1)).alias("outcomes"))


PLACES = (-9, 0, 8)
PRICE_SQL = """SELECT f.instrument, f.idx, l.level, k.kind, p.place, round(CASE WHEN k.kind LIKE '%Pct' THEN close + (l.value - close) * (p.place + 0.5) / 10 ELSE l.value + close * (p.place + 2.5) / 10000 END + 3e-8, 4) + 0.0 AS price
 FROM feat f CROSS JOIN LATERAL (VALUES {}) l(level, value) CROSS JOIN (VALUES ('SL-Pct'), ('TP-BPS')) k(kind) CROSS JOIN (VALUES {}) p(place) WHERE l.value IS NOT NULL"""


@query(sql(PRICE_SQL.format(", ".join(f"('{c}', f.\"{c}\")" for c in q.LEVELS), ", ".join(f"({x})" for x in PLACES)), "feat"))
def bin_prices(spark, sf_dir):
    """Prices in the middle of bins of both kinds, from levels of every bar."""
    levels = F.inline(F.array(*(F.struct(F.lit(c).alias("level"), F.col(c).alias("value")) for c in q.LEVELS)))
    bins = F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(x).alias("place")) for k in ("SL-Pct", "TP-BPS") for x in PLACES)))
    rows = q.features(spark, sf_dir).select("instrument", "idx", "close", levels).filter("value IS NOT NULL").select("*", bins)
    price = level_price(F.col("close"), F.col("value"), F.col("kind"), F.col("place"))
    return rows.select("instrument", "idx", "level", "kind", "place", (F.round(price + 3e-8, 4) + 0.0).alias("price"))  # halves round alike


# --- series that grow with the tables ------------------------------------------------------------------------------------
HALVES = "round({} + 1e-7, 4) + 0.0"  # prices of a unit often end in an exact half


def cents(name: str):
    return (F.round(F.col(name) + 1e-7, 4) + 0.0).alias(name)


def brand_indexed(spark, sf_dir):
    """Daily bars of brands: extreme prices of a unit, open and close its mean price, volume the units sold."""
    sold = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("l_partkey") == F.col("p_partkey"))
    price, units = F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double"), F.sum(F.col("l_quantity").cast("double"))
    mean = F.sum(F.col("l_extendedprice").cast("double")) / units
    days = sold.groupBy(F.col("p_brand").alias("instrument"), F.col("l_shipdate").cast("timestamp").alias("time")).agg(mean.alias("close"), F.max(price).alias("high"), F.min(price).alias("low"), units.alias("volume"))
    return b.indexed(days.select("instrument", F.lit(1440).alias("timeframe"), "time", F.col("close").alias("open"), "high", "low", "close", "volume"), "3650 days")


BRAND = {
    "bd": """SELECT p_brand AS instrument, 1440 AS timeframe, l_shipdate::TIMESTAMP AS time, sum(l_extendedprice::DOUBLE) / sum(l_quantity::DOUBLE) AS close,
 max(l_extendedprice::DOUBLE / l_quantity::DOUBLE) AS high, min(l_extendedprice::DOUBLE / l_quantity::DOUBLE) AS low, sum(l_quantity::DOUBLE) AS volume FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3""",
    "bi": "SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY instrument) AS n_bars FROM bd WINDOW w AS (PARTITION BY instrument ORDER BY time)",
    "be": """SELECT instrument, idx, close AS e2, close AS e5, close AS e50 FROM bi WHERE idx = 0
 UNION ALL SELECT c.instrument, c.idx, r.e2 + (c.close - r.e2) * 2 / 3, r.e5 + (c.close - r.e5) * 2 / 6, r.e50 + (c.close - r.e50) * 2 / 51 FROM be r JOIN bi c ON c.instrument = r.instrument AND c.idx = r.idx + 1""",
}


@query(sql(f"SELECT instrument, timeframe, time, idx, n_bars, {HALVES.format('close')} AS close, {HALVES.format('high')} AS high, {HALVES.format('low')} AS low, volume FROM bi", **BRAND))
def brand_bars(spark, sf_dir):
    return brand_indexed(spark, sf_dir).select(*b.KEYS, "time", "idx", "n_bars", *(cents(c) for c in ("close", "high", "low")), "volume")


@query(sql("""SELECT i.instrument, i.idx, CASE WHEN i.idx >= 199 THEN round(avg(i.close) OVER (w ROWS 199 PRECEDING) + 1e-7, 4) + 0.0 END AS "SMA_200", CASE WHEN i.idx >= 1 THEN round(e.e2 + 1e-7, 4) + 0.0 END AS "EMA_2",
 CASE WHEN i.idx >= 4 THEN round(e.e5 + 1e-7, 4) + 0.0 END AS "EMA_5", CASE WHEN i.idx >= 49 THEN round(e.e50 + 1e-7, 4) + 0.0 END AS "EMA_50",
 round(max(i.high) OVER (w ROWS 19 PRECEDING) + 1e-7, 4) + 0.0 AS top_20 FROM bi i JOIN be e USING (instrument, idx) WINDOW w AS (PARTITION BY i.instrument ORDER BY i.idx)""", **BRAND))  # fmt: skip
def brand_averages(spark, sf_dir):
    """Long and very short averages over series of several blocks."""
    f = ind.ema(ind.sma(ind.framed(brand_indexed(spark, sf_dir)), (200,)), (2, 5, 50))
    f = ind.done(f.withColumn("top_20", F.max("high").over(ind._rows(20))))
    return f.select("instrument", "idx", *(cents(c) for c in ("SMA_200", "EMA_2", "EMA_5", "EMA_50", "top_20")))


USER_SQL = sql("SELECT instrument, timeframe, time, idx, n_bars, round(close, 6) + 0.0 AS close, CASE WHEN idx >= 19 THEN round(avg(close) OVER (w ROWS 19 PRECEDING), 6) + 0.0 END AS \"SMA_20\" FROM ix WINDOW w AS (PARTITION BY instrument ORDER BY idx)", "ix")


@query(USER_SQL.replace("event_type AS instrument", "'u' || user_id AS instrument"))
def user_series(spark, sf_dir):
    """Hourly bars of each user's events: as many series as users."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ticks = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("event_id").alias("tick_id"))
    f = ind.sma(ind.framed(b.indexed(b.ohlc(ticks, q.MINUTES))), (20,))
    return rounded(ind.done(f).select(*b.KEYS, "time", "idx", "n_bars", "close", "SMA_20"))


Q, SQL = q.Q, q.SQL
