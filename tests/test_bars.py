"""Bars, barriers and indicators against plain loops."""

import math
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barsmith.functions import indicators as ind
from barsmith.operators import bars as b
from barsmith.operators import barriers as br

START = datetime(2024, 1, 1)


def make(spark, rows, name="EURUSD", minutes=60):
    """rows: (open, high, low, close)"""
    data = [(name, minutes, START + timedelta(minutes=minutes * i), *map(float, r), 1.0) for i, r in enumerate(rows)]
    return b.indexed(spark.createDataFrame(data, "instrument string, timeframe int, time timestamp, open double, high double, low double, close double, volume double"))


def walk(n, seed=1):
    rng, price, out = random.Random(seed), 100.0, []
    for _ in range(n):
        o = price
        c = o * (1 + rng.uniform(-0.02, 0.02))
        out.append((o, max(o, c) * 1.005, min(o, c) * 0.995, c))
        price = c
    return out


def naive_wins(rows, sl, tp, look, spread, ties=True):
    found, n = set(), len(rows)
    for i in range(n - look):
        e = rows[i][3]
        for side, sign in (("buy", 1), ("sell", -1)):
            for s in sl:
                for t in tp:
                    stop, goal = e * (1 - sign * s / 10000), e * (1 + sign * t / 10000)
                    for j in range(i + 1, i + look + 1):
                        _, h, lo, _ = rows[j]
                        win = h >= goal + spread if sign == 1 else lo <= goal - spread
                        loss = lo <= stop if sign == 1 else h >= stop
                        if win and (ties or not loss):
                            found.add((i, side, s, t, j))
                        if win or loss:
                            break
    return found


@pytest.mark.parametrize("ties", [True, False])
def test_factorised_labels_equal_the_triple_loop(spark, ties):
    rows = walk(120)
    got = br.barrier_outcomes(make(spark, rows), [100, 300], [150, 400], 12, ties_win=ties).collect()
    assert {(r.entry_idx, r.trade_type, r.sl, r.tp, r.exit_idx) for r in got} == naive_wins(rows, [100, 300], [150, 400], 12, 1.5 * 0.0001, ties)
    assert got


def test_edges_of_labelling(spark):
    flat = (100, 100, 100, 100)
    both = (100, 110, 90, 100)
    rows = [flat, flat, both, flat, flat]
    bars = make(spark, rows, "X")
    wins = br.barrier_outcomes(bars, [500], [500], 2, spread=False)
    assert {(r.entry_idx, r.exit_idx) for r in wins.filter("trade_type = 'buy'").collect()} == {(0, 2), (1, 2)}  # ties win
    assert br.barrier_outcomes(bars, [500], [500], 2, spread=False, ties_win=False).count() == 0
    assert br.barrier_outcomes(bars, [500], [500], 1, spread=False).filter("entry_idx = 0").count() == 0  # touched at L + 1
    assert br.barrier_outcomes(bars, [500], [500], 5, spread=False).count() == 0  # n <= L


def test_exits_by_blocks_equal_a_scan(spark):
    rows = walk(400, 3)
    bars = make(spark, rows)
    data = [("EURUSD", 60, f"{i}{s}", i, s, rows[i][3] * (0.97 if s == "buy" else 1.03), rows[i][3] * (1.04 if s == "buy" else 0.96)) for i in range(0, 390, 7) for s in ("buy", "sell")]
    orders = spark.createDataFrame(data, "instrument string, timeframe int, order_id string, idx long, trade_type string, sl_price double, tp_price double")
    got = {r.order_id: (r.tp_idx, r.sl_idx) for r in br.exits(orders, bars, 60, block=16).collect()}
    for _, _, name, i, side, sl, tp in data:
        ahead = range(i + 1, min(i + 61, len(rows)))
        up, down = (tp, sl) if side == "buy" else (sl, tp)
        first_up = next((j for j in ahead if rows[j][1] >= up), None)
        first_down = next((j for j in ahead if rows[j][2] <= down), None)
        assert got[name] == ((first_up, first_down) if side == "buy" else (first_down, first_up))


def test_indicators_in_blocks_equal_plain_loops(spark, monkeypatch):
    rows = walk(2600, 5)
    close = pd.Series([r[3] for r in rows])
    f = ind.framed(make(spark, rows))
    for step in (ind.sma, ind.ema, ind.rsi, ind.atr, ind.macd):
        f = step(f)
    got = ind.done(f).orderBy("idx").toPandas()
    assert len(got) == len(rows)
    pd.testing.assert_series_equal(got["SMA_200"], close.rolling(200).mean(), check_names=False, rtol=1e-9)
    for p in (8, 50):
        want = close.ewm(span=p, adjust=False, min_periods=p).mean()
        pd.testing.assert_series_equal(got[f"EMA_{p}"], want, check_names=False, rtol=1e-9)
    step = close.diff()
    gain, loss = (x.clip(lower=0).fillna(0).ewm(alpha=1 / 14, adjust=False).mean() for x in (step, -step))
    pd.testing.assert_series_equal(got["RSI_14"][13:], (100 - 100 / (1 + gain / loss))[13:], check_names=False, rtol=1e-9)
    line = close.ewm(span=12, adjust=False).mean() - close.ewm(span=26, adjust=False).mean()
    want = line - line[25:].ewm(span=9, adjust=False).mean()
    pd.testing.assert_series_equal(got["MACD_hist_12_26_9"][33:], want[33:], check_names=False, rtol=1e-6, atol=1e-9)


def test_support_and_obv_across_blocks(spark):
    rows = walk(2500, 9)
    bars = make(spark, rows)
    p = ind.done(ind.pivots(ind.framed(bars)))
    got = ind.support_resistance(p).orderBy("idx").toPandas()
    import numpy as np

    low = np.array([r[2] for r in rows], np.float32)
    last = None
    for i in range(len(rows)):
        if 10 <= i < len(rows) - 10 and low[i] == low[i - 10 : i + 11].min():
            last = rows[i][2]
        assert (last is None and pd.isna(got["support"][i])) or got["support"][i] == last
    o = ind.obv(bars).orderBy("idx").toPandas()
    total = 0.0
    for i, r in enumerate(rows):
        total += -1.0 if i and r[3] < rows[i - 1][3] else 1.0
        assert o["OBV"][i] == total
    late = ind.support_resistance(p, confirm=10).orderBy("idx").toPandas()
    assert late["support"][30:].equals(got["support"].shift(10)[30:])


def test_flat_bars_raise_nothing(spark):
    f = ind.framed(make(spark, [(5, 5, 5, 5)] * 60))
    from barsmith.functions.patterns import NAMES, patterns

    for step in (ind.bollinger, ind.rsi, ind.atr, ind.adx, ind.roc, ind.cci, ind.regimes, patterns):
        f = step(f)
    last = ind.done(f).filter("idx = 59").first()
    assert last["RSI_14"] == 100.0 and last["CCI_20"] is None and last["ADX_14"] == 0.0
    assert all(last[f"CDL_{n}"] == 0 for n in NAMES)


def test_duplicates_presets_and_costs(spark):
    rows = [("EURUSD", 60, START, 1.0, 2.0, 0.5, 1.5, v) for v in (1.0, 3.0)]
    bars = spark.createDataFrame(rows, "instrument string, timeframe int, time timestamp, open double, high double, low double, close double, volume double")
    assert [r.volume for r in b.one_per_time(bars).collect()] == [3.0]
    sizes = {m: (len(range(a, z + 1, s)), len(range(c, y + 1, t))) for m, ((a, z, s), (c, y, t), _) in b.PRESETS.items()}
    assert sizes == {1: (20, 40), 5: (29, 59), 15: (24, 49), 30: (33, 68), 60: (46, 96), 240: (91, 191)}
    assert b.grid(spark, 15).count() == 24 * 49
    got = b.with_costs(spark.createDataFrame([("XAUUSD15",), ("FOO5",)], "instrument string"), b.cost_table(spark)).orderBy("instrument").collect()
    assert [r.spread_pips for r in got] == [2.5, 20.0]
    assert spark.range(1).select(b.spread_cost(F.lit("XAUUSD"))).first()[0] == pytest.approx(0.2)
    assert math.isclose(spark.range(1).select(b.spread_cost(F.lit("AAA"))).first()[0], 0.0003)


def test_short_averages_over_blocks(spark):
    """Averages of few bars, whose powers do not fit a double over a block, equal the fold over 3,000 bars."""
    import random
    from datetime import datetime, timedelta

    from barsmith.functions import indicators as ind

    rng, n = random.Random(3), 3000
    close = [rng.uniform(1, 500) for _ in range(n)]
    rows = [("A", 60, datetime(2024, 1, 1) + timedelta(hours=i), i, n, c) for i, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "instrument string, timeframe int, time timestamp, idx long, n_bars long, close double")
    f = ind.ema(ind.framed(bars), (1, 2, 3, 4, 5, 6, 8))
    for k in (1, 2, 3, 4):
        f = ind.wilder_of(f, "close", k, f"wilder_{k}", 0)
    got = ind.done(f).orderBy("idx").collect()
    assert len(got) == n
    for p in (1, 2, 3, 4, 5, 6, 8):
        e = close[0]
        for i, c in enumerate(close):
            e += (c - e) * 2 / (p + 1)
            assert i < p - 1 or abs(got[i][f"EMA_{p}"] - e) < 1e-8, (p, i)
    for k in (1, 2, 3, 4):
        e = sum(close[:k]) / k
        for i in range(k - 1, n):
            e = e + (close[i] - e) / k if i >= k else e
            assert abs(got[i][f"wilder_{k}"] - e) < 1e-8, (k, i)
