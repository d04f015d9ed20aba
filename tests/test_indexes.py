"""Bitmap index, trees from sibling cells, trees of extremes, and segments of runs, against plain versions."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsmith.operators import barriers as br
from barsmith.operators import bars as b
from barsmith.operators import bitmaps as bm
from barsmith.operators import blueprints as bp
from barsmith.operators import evaluate as ev
from barsmith.operators import rules

START = datetime(2024, 1, 1)
FEATURES = ["f0", "f1", "f2", "f3"]


def frame_of(spark, n, seed=1, markets=("A", "B"), first=0):
    """Numbered bars with features; some values missing, NaN or infinite."""
    rng, data, values = random.Random(seed), [], {}
    for m in markets:
        for i in range(n):
            row = [rng.choice([None, float("nan"), float("inf"), float("-inf")]) if rng.random() < 0.05 else float(rng.randint(0, 40)) / (1 + k) for k in range(len(FEATURES))]
            values[m, first + i] = row
            data.append((m, 60, START + timedelta(hours=i), first + i, *row))
    return spark.createDataFrame(data, "instrument string, timeframe int, time timestamp, idx long, " + ", ".join(f"{f} double" for f in FEATURES)), values


def rule_of(rng):
    parts = []
    for f in rng.sample(FEATURES, rng.randint(1, 3)):
        x = rng.choice([rng.randint(0, 40) / (1 + FEATURES.index(f)), rng.uniform(-1, 41)])
        parts.append(f"`{f}` {rng.choice(['<=', '>'])} {round(x, 5)}")
    return " and ".join(parts)


def meets(rule, row):
    for part in rule.split(" and "):
        f, how, x = part.split()
        v = row[FEATURES.index(f.strip("`"))]
        if v is None or np.isnan(v) or not (v <= float(x) if how == "<=" else v > float(x) and v <= float("inf")):
            return False
    return True


@pytest.mark.parametrize("most", [2, 64])
def test_index_equals_filters(spark, most):
    """With two edges a feature most bounds cut a bin, with 64 none does; bars lie on both sides of a bitmap's end."""
    rng = random.Random(most)
    frame, values = frame_of(spark, 150, first=bm.BITS - 70)
    texts = sorted({rule_of(rng) for _ in range(60)} | {"`f0` > 3.0 and `f0` <= 3.0", "`f1` <= 1e999"})
    given = spark.createDataFrame([(t,) for t in texts], "market_rule string")
    got = {(r.market_rule, r.instrument, r.idx) for r in bm.matches_by_index(given, frame, FEATURES, most=most).collect()}
    assert got == {(t, m, i) for t in texts for (m, i), row in values.items() if meets(t, row)}
    plain = {(r.market_rule, r.instrument, r.idx) for r in rules.matches(given.filter("market_rule NOT LIKE '%e999'"), frame, FEATURES).collect()}
    assert plain == {x for x in got if "e999" not in x[0]}
    assert bm.matches_by_index(given.limit(0), frame, FEATURES).count() == 0
    assert bm.matches_by_index(given, frame.limit(0), FEATURES).count() == 0


@pytest.mark.parametrize("most", [1, 64])
def test_strategies_meet_bitmaps(spark, most):
    """Strategies that share a rule each have its bars, those of a timeframe on its markets; bitmaps are unpacked in several tasks."""
    frame, values = frame_of(spark, 60, 3, tuple("ABCDEF"))
    both = frame.unionByName(frame.withColumn("timeframe", F.lit(15)))
    rows = [("s1", "`f0` > 11.5", 60), ("s2", "`f0` > 11.5", 60), ("s3", "`f0` > 11.5", 15), ("s4", "`f0` <= 30.0 and `f1` > 4.5", 15)]
    of = spark.createDataFrame(rows, "strategy_id string, market_rule string, timeframe int")
    found = bm.matches_by_index(of, both, FEATURES, most=most, timed=False, of=of)
    want = sorted((s, t, m, i) for s, rule, t in rows for (m, i), row in values.items() if meets(rule, row))
    assert sorted((r.strategy_id, r.timeframe, r.instrument, r.idx) for r in found.collect()) == want and want
    if most > 1:
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_ten_thousand_rules(spark):
    """A mined set: bounds are cuts of features, so no bar is looked up, and bars join rules by bound, not by feature."""
    rng = random.Random(5)
    frame, values = frame_of(spark, 1500, 6, ("A",))
    cuts = {f: [round(k / (1 + i), 5) for k in range(0, 40, 2)] for i, f in enumerate(FEATURES)}
    texts = set()
    while len(texts) < 10_000:
        texts.add(" and ".join(f"`{f}` {rng.choice(['<=', '>'])} {rng.choice(cuts[f])}" for f in sorted(rng.sample(FEATURES, 3))))
    found = bm.matches_by_index(spark.createDataFrame([(t,) for t in sorted(texts)], "market_rule string"), frame, FEATURES, timed=False)
    got = {r.market_rule: r.n for r in found.groupBy("market_rule").agg(F.count("*").alias("n")).collect()}
    table = np.array([[np.nan if v is None else v for v in values["A", i]] for i in range(1500)])
    for t in sorted(texts):
        on = np.ones(1500, bool)
        for part in t.split(" and "):
            f, how, x = part.split()
            v = table[:, FEATURES.index(f.strip("`"))]
            on &= v <= float(x) if how == "<=" else (v > float(x)) & (v <= np.inf)
        assert got.get(t, 0) == on.sum(), t


def test_blueprint_bars_of_overlapping_runs(spark):
    rng = random.Random(7)
    rows = [("A", 60, "SL-Pct", rng.choice("xy"), rng.randint(0, 2), 100, rng.randint(bm.BITS - 50, bm.BITS + 50)) for _ in range(600)]
    schema = "instrument string, timeframe int, type string, level string, bin int, ratio int, entry_idx long"
    halves = [bm.blueprint_bitmaps(spark.createDataFrame(x, schema)) for x in (rows[:400], rows[200:])]
    got = {(r.level, r.bin): r.num_candles for r in bm.bar_counts(bm.merged(*halves)).collect()}
    want = Counter((lv, k) for _, _, _, lv, k, _, _ in {r for r in rows})
    assert got == want
    assert bp.defined(bm.bar_counts(bm.merged(*halves))).count() == len(want)


def plain_tree(rows, cuts, depth, least):
    """Leaves (node, rows, sum) of a greedy tree that tries every cut of every feature from the rows themselves."""
    out, work = {}, [(1, rows, depth)]
    while work:
        node, own, left = work.pop()
        best = None
        for f in sorted(cuts):
            for k, c in enumerate(cuts[f]):
                low = [y for v, y in own if v[f] <= c]
                if left and least <= len(low) <= len(own) - least:
                    s, s0 = sum(low), sum(y for _, y in own)
                    gain = s * s / len(low) + (s0 - s) ** 2 / (len(own) - len(low)) - s0 * s0 / len(own)
                    if gain > 1e-9 and (best is None or round(gain, 9) > best[0]):
                        best = (round(gain, 9), f, c)
        if best is None:
            out[node] = (len(own), sum(y for _, y in own))
            continue
        _, f, c = best
        work += [(2 * node, [r for r in own if r[0][f] <= c], left - 1), (2 * node + 1, [r for r in own if r[0][f] > c], left - 1)]
    return out


def test_deep_trees_equal_a_plain_one(spark):
    """Depth 7 from sibling cells: each key with cuts of its own, and with given ones."""
    rng, data = random.Random(11), []
    for key in ("a", "b"):
        for i in range(900):
            x, y, z = rng.uniform(0, 1), rng.uniform(0, 1 if key == "a" else 9), float(rng.randint(0, 3))
            data.append((key, "A", 60, START + timedelta(hours=i), int(4 * (x > 0.6) + 3 * (y > 0.5) * (z > 1) + rng.randint(0, 2)), x, y, z))
    rows = spark.createDataFrame(data, "key string, instrument string, timeframe int, entry_time timestamp, trade_count int, x double, y double, z double").cache()
    names = ["x", "y", "z"]
    own = rules.key_thresholds(rows, names, 8)
    for cuts in (own, {"x": [0.2, 0.4, 0.6, 0.8], "y": [0.5, 2.0, 5.0], "z": [0.0, 1.0, 2.0]}):
        leaves, splits = rules.grow(rows, cuts, 7, 20, names)
        got, text = leaves.collect(), rules.leaf_rules(leaves, splits).collect()
        for key in ("a", "b"):
            mine = cuts if isinstance(cuts, dict) else dict(zip(names, own.filter(F.col("key") == key).first().cuts, strict=True))
            want = plain_tree([(dict(zip(names, r[5:], strict=True)), r[4]) for r in data if r[0] == key], mine, 7, 20)
            assert {r.node: (r.n_candles, round(r.n_candles * r.avg_density)) for r in got if r.key == key} == want and len(want) > 8
            assert sum(r.n_candles for r in text if r.key == key) == 900
    assert own.filter("size(cuts) = 3").count() == 2


def test_only_smaller_children_are_counted(spark):
    """Cells counted from rows and those taken from the parent's: both right, and the rows that are counted halve."""
    rng = random.Random(3)
    rows = [("k", float(rng.randint(0, 5)), [rng.randint(0, 3)], 1) for _ in range(400)]
    state = spark.createDataFrame(rows, "key string, y double, places array<int>, node int")
    cells = rules.counted(state, ["f"])
    n1 = sum(r[2][0] <= 2 for r in rows)
    split = spark.createDataFrame([("k", 1, "f", 2, 1.0, n1, 400)], "key string, node int, feature string, bin int, gain double, n1 long, n0 long")
    moved = state.withColumn("node", F.when(F.col("places")[0] <= 2, 2).otherwise(3))
    got = rules.next_cells(cells, split, moved, ["f"], 10)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in rules.counted(moved, ["f"]).collect()}
    assert n1 > 200 and {r.node for r in rules.next_cells(cells, split, moved.filter("node = 3"), ["f"], 10).collect()} == {2, 3}
    assert {r.node for r in rules.next_cells(cells, split, moved, ["f"], 80).collect()} == {2}  # the smaller child has under 160 rows


@pytest.mark.parametrize(("look", "fan"), [(60, 4), (60, 16), (25, None), (5000, None)])
def test_walk_to_exits(spark, look, fan):
    """Trees of one to three levels; touches in the own node, in later ones, beyond the look-ahead, and never."""
    rng, price, rows = random.Random(look), 100.0, []
    for _ in range(500):
        price *= 1 + rng.uniform(-0.01, 0.01)
        rows.append((price * 1.004, price * 0.996))
    bars = spark.createDataFrame([("A", 60, i, h, lo) for i, (h, lo) in enumerate(rows)], "instrument string, timeframe int, idx long, high double, low double")
    data = [("A", 60, f"{i}{s}", i, s, rows[i][1] * (1 - d if s == "buy" else 1 + d), rows[i][0] * (1 + u if s == "buy" else 1 - u)) for i in range(0, 500, 3) for s in ("buy", "sell") for d, u in [(rng.uniform(0, 0.05), rng.uniform(0, 0.2))]]
    orders = spark.createDataFrame(data, "instrument string, timeframe int, order_id string, idx long, trade_type string, sl_price double, tp_price double")
    got = {r.order_id: (r.tp_idx, r.sl_idx) for r in br.exits(orders, bars, look, fan).collect()}
    assert len(got) == len(data)
    for _, _, name, i, side, sl, tp in data:
        ahead = range(i + 1, min(i + look + 1, len(rows)))
        up, down = (tp, sl) if side == "buy" else (sl, tp)
        above, below = next((j for j in ahead if rows[j][0] >= up), None), next((j for j in ahead if rows[j][1] <= down), None)
        assert got[name] == ((above, below) if side == "buy" else (below, above))
    plan = br.exits(orders, bars, look, fan)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan  # one row for each order all the way


def test_records_are_those_of_a_scan(spark):
    """Records ahead by links: flat, rising and falling stretches, missing prices, several blocks."""
    rng, rows, price = random.Random(2), [], 50.0
    for i in range(2300):
        price += 0 if 300 < i < 400 else 1 if 600 < i < 800 else -1 if 1000 < i < 1150 else rng.choice([-2, -1, 0, 1, 2])
        rows.append((None if i % 97 == 0 else price + rng.randint(0, 2), None if i % 89 == 0 else price - rng.randint(0, 2)))
    bars = spark.createDataFrame([("A", 60, i, 2300, h, lo) for i, (h, lo) in enumerate(rows)], "instrument string, timeframe int, idx long, n_bars long, high double, low double").repartition(5)
    found = br.with_records(bars, 60)
    got = {r.idx: ([tuple(x) for x in r.highs], [tuple(x) for x in r.lows]) for r in found.collect()}
    for i in range(2300):
        highs, lows = [], []
        for j in range(i + 1, min(i + 61, 2300)):
            h, lo = rows[j]
            if h is not None and (not highs or h > highs[-1][1]):
                highs.append((j, h))
            if lo is not None and (not lows or lo < lows[-1][1]):
                lows.append((j, lo))
        assert got[i] == (highs, lows), i
    assert "collect_list" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [3, 8, 4096])
def test_longest_runs_by_segments(spark, block):
    """Blocks without trades, of one trade, and of one long run."""
    rng, data, want = random.Random(1), [], {}
    for name, p in (("even", 0.5), ("wins", 1.0), ("losses", 0.0), ("streaks", 0.9)):
        at, wins = 0, []
        for seq in range(1, 60):
            at += rng.choice([1, 1, 2, 9])
            wins.append(rng.random() < p)
            data.append((name, "A", 60, at, seq, wins[-1]))
        best = {True: 0, False: 0}
        run = 0
        for k, w in enumerate(wins):
            run = run + 1 if k and wins[k - 1] == w else 1
            best[w] = max(best[w], run)
        want[name] = (best[True], best[False])
    done = spark.createDataFrame(data, "strategy_id string, instrument string, timeframe int, idx long, seq long, won boolean").repartition(4)
    got = {r.strategy_id: (r.max_wins, r.max_losses) for r in ev.longest_runs(done, block).collect()}
    assert got == want
