"""Rules, equity, reports and state tables on small data."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from barsmith.operators import evaluate as ev
from barsmith.operators import reports, rules
from barsmith.sources import bars_csv, state

START = datetime(2024, 1, 1)


def test_rules_match_like_filters(spark):
    rng = random.Random(2)
    data = [("A", 60, START + timedelta(hours=i), i, rng.uniform(0, 100), float(i % 24) if i % 7 else None) for i in range(300)]
    frame = spark.createDataFrame(data, "instrument string, timeframe int, time timestamp, idx long, rsi double, hour double")
    texts = {"`rsi` <= 30.0": "rsi <= 30", "`rsi` > 20.5 and `rsi` <= 60.0 and `hour` > 4.0": "rsi > 20.5 AND rsi <= 60 AND hour > 4"}
    found = rules.matches(spark.createDataFrame([(t,) for t in texts], "market_rule string"), frame, ["rsi", "hour"])
    for text, where in texts.items():
        assert {r.idx for r in found.filter(F.col("market_rule") == text).collect()} == {r.idx for r in frame.filter(where).collect()}
    for bad in ("`x` <= 1.0", "rsi <= 1", "`rsi` <= 1; drop"):
        with pytest.raises(PySparkException):
            rules.matches(spark.createDataFrame([(bad,)], "market_rule string"), frame, ["rsi", "hour"]).collect()


def test_trees_partition_the_rows_and_lift(spark):
    rng = random.Random(4)
    data = []
    for key in ("k1", "k2"):
        for i in range(1200):
            x, y = rng.uniform(0, 1), rng.uniform(0, 1)
            data.append((key, "A", 60, START + timedelta(hours=i), 6 if x > 0.7 and y <= 0.4 else 1, x, y))
    rows = spark.createDataFrame(data, "key string, instrument string, timeframe int, entry_time timestamp, trade_count int, x double, y double").cache()
    cuts = rules.thresholds(rows, ["x", "y"])
    leaves, splits = rules.grow(rows, cuts, depth=4, least=50)
    got = leaves.collect()
    assert sum(r.n_candles for r in got) == len(data) and min(r.n_candles for r in got) >= 50
    found = rules.mined(rows, ["x", "y"], depth=4)
    best = found.collect()
    assert {r.key for r in best} == {"k1", "k2"} and max(r.avg_density for r in best) > 4
    back = rules.matches(found.select("market_rule").distinct(), rows.filter("key = 'k1'").withColumnRenamed("entry_time", "time").withColumn("idx", F.lit(0)), ["x", "y"])
    counts = {r.market_rule: r.n for r in back.groupBy("market_rule").agg(F.count("*").alias("n")).collect()}
    for r in best:
        if r.key == "k1":
            assert abs(counts.get(r.market_rule, 0) - r.n_candles) <= 2  # thresholds are rounded
    known = found.select("key", "market_rule")
    again = rules.mined(rows, ["x", "y"], depth=4, known=known)
    assert again.join(known, ["key", "market_rule"]).count() == 0


def test_equity_is_the_fold(spark):
    rng = random.Random(6)
    r = [rng.uniform(-1, 2) for _ in range(60)] + [-60.0, 1.0]
    data = [("s", "A", 60, i, f"{i:03d}", x) for i, x in enumerate(r)]
    frame = spark.createDataFrame(data, "strategy_id string, instrument string, timeframe int, idx long, order_id string, r double")
    got = ev.equity(frame).orderBy("seq").collect()
    capital, want = 10_000.0, []
    for x in r:
        capital *= 1 + 0.02 * x
        want.append(capital)
        if capital <= 0:
            break
    assert len(got) == len(want) == 61 and all(abs(a.capital - w) <= 1e-9 * abs(w) for a, w in zip(got, want, strict=True))


def performance_of(spark, r):
    data = [("s", "A", 60, i, f"{i}", x) for i, x in enumerate(r)]
    return ev.performance(ev.equity(spark.createDataFrame(data, "strategy_id string, instrument string, timeframe int, idx long, order_id string, r double"))).first()


def test_performance_edges(spark):
    one = performance_of(spark, [1.0])
    assert one.profit_factor == float("inf") and one.sharpe_ratio == 0.0 and one.total_trades == 1
    two = performance_of(spark, [1.0, -1.0])
    assert two.win_rate_pct == 50.0 and two.max_drawdown_pct == pytest.approx(2.0)
    capped = spark.createDataFrame([(float("inf"),), (3.0,)], "x double").select(reports.capped(F.col("x"), 100.0).alias("x"))
    assert sorted(r.x for r in capped.collect()) == [3.0, 100.0]


def test_regime_shares_sum_to_100(spark):
    f = spark.createDataFrame([("s", "A", 60, x) for x in "aabbbc"], "strategy_id string, instrument string, timeframe int, session string")
    assert sum(r.pct for r in ev.regime_mix(f, "session").collect()) == pytest.approx(100)
    assert set(ev.regime_maps(f, ("session",)).first().session_pct) == set("abc")


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 9)], "k int, v string, w int")
    got = state.upsert_last(old, new, ["k"])
    assert {(r.k, r.v, r.w) for r in got.collect()} == {(1, "a", None), (2, "c", 9), (3, "d", 9)}
    assert state.upsert_last(got, new, ["k"]).exceptAll(got).count() == 0
    assert {(r.k, r.v) for r in state.append_distinct(old, new.drop("w"), ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}
    assert state.not_done(new, old, ["k"]).count() == 1 and state.known(new, old, ["k"]).count() == 1
    assert state.table_or_empty(spark, "file:///tmp/no-such-table", "k int").count() == 0


def test_csv_round_trip(spark, tmp_path):
    (tmp_path / "EUR_USD15.csv").write_text("2024-01-01 00:00:00,1,2,0.5,1.5,7\nbad,1,2,0.5,1.5,7\n2024-01-01 00:15:00,1,2,x,1.5,7\n2024-01-01 00:30:00,1,2,0.5,1.5\n")
    rows = bars_csv.read_bars(spark, f"file://{tmp_path}/EUR_USD15.csv").orderBy("time").collect()
    assert [(r.instrument, r.timeframe, r.volume) for r in rows] == [("EURUSD", 15, 7.0), ("EURUSD", 15, 1.0)]
    (tmp_path / "X5.csv").write_text("2024-01-01 00:00:00,1,2,3\n")
    with pytest.raises(PySparkException):
        bars_csv.read_bars(spark, f"file://{tmp_path}/X5.csv").collect()
    with pytest.raises(PySparkException):
        bars_csv.read_bars(spark, f"file://{tmp_path}/EUR_USD15.csv", mode="fail").collect()
    report = spark.createDataFrame([("s", float("inf"))], "strategy_id string, profit_factor double")
    bars_csv.write_report(report, f"file://{tmp_path}/report")
    assert bars_csv.read_report(spark, f"file://{tmp_path}/report", "strategy_id string, profit_factor double").first().profit_factor == float("inf")


def test_stream_equals_batch(spark, tmp_path):
    from barsmith.operators.bars import ohlc
    from barsmith.streaming.bars import streamed_ohlc

    rng = random.Random(8)
    schema = "instrument string, ts timestamp, price double, volume double, tick_id long"
    data = [("A", START + timedelta(seconds=37 * i), rng.uniform(1, 9), 1.0, i) for i in range(500)]
    spark.createDataFrame(data, schema).repartition(3).write.parquet(f"file://{tmp_path}/ticks")
    ticks = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/ticks")
    q = streamed_ohlc(ticks, 60).writeStream.outputMode("complete").format("memory").queryName("streamed").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    want = ohlc(spark.read.parquet(f"file://{tmp_path}/ticks"), 60)
    assert spark.table("streamed").exceptAll(want).count() == 0 and want.count() == spark.table("streamed").count()


def test_mastery_and_views(spark):
    rep = spark.createDataFrame([("a", "M1", 60, 2.0, 1.0, 10.0, 60.0, 12000.0, 60), ("a", "M2", 60, float("inf"), 30.0, 5.0, 90.0, 13000.0, 55), ("b", "M1", 60, 1.5, 0.1, 25.0, 40.0, 9000.0, 50)],
        "strategy_id string, instrument string, timeframe int, profit_factor double, sharpe_ratio double, max_drawdown_pct double, win_rate_pct double, final_capital double, total_trades long")
    first = rep.filter("instrument = 'M1'")
    good = ev.passed(first)
    assert {r.strategy_id for r in good.collect()} == {"a", "b"} and {r.strategy_id for r in ev.passed(first, strict=True).collect()} == {"a"}
    assert ev.failed(first, ev.passed(first, strict=True)).first().strategy_id == "b"
    view = {r.strategy_id: r for r in reports.master_view(reports.summary(rep), first).collect()}
    assert view["a"].avg_profit_factor == 100.0 and view["a"].validation_markets_passed == "2/2" and view["b"].mastery_profit_factor == 1.5
    assert reports.by_market(first, rep).filter("phase = 'mastery'").count() == 2


def test_strategies_meet_markets_of_their_timeframe(spark):
    data = [(i, t, START + timedelta(minutes=t * k), k, 10, float(k), 50.0) for i in "AB" for t in (15, 60) for k in range(10)]
    feats = spark.createDataFrame(data, "instrument string, timeframe int, time timestamp, idx long, n_bars long, close double, rsi double")
    rows = [("k1", "`rsi` > 10.0", 60), ("k2", "`rsi` > 10.0", 15), ("k3", "`rsi` > 90.0", 60)]
    mine = ev.with_ids(spark.createDataFrame(rows, "key string, market_rule string, timeframe int"))
    got = ev.signals(mine, feats, ["rsi"]).groupBy("strategy_id", "timeframe").count().collect()
    assert {(r.strategy_id[:2], r.timeframe): r["count"] for r in got} == {("k1", 60): 20, ("k2", 15): 20}
    assert ev.signals(mine.drop("timeframe"), feats, ["rsi"]).count() == 80


def test_definitions_and_rules_by_key(spark):
    from barsmith.operators import blueprints as bp

    typed = bp.with_definitions(spark.createDataFrame([("0.05", "SMA_20"), (" 1e-2 ", None), ("", "x")], "sl_def string, tp_def string")).collect()
    assert [(r.sl_ratio, r.sl_level, r.tp_ratio, r.tp_level) for r in typed] == [(0.05, None, None, "SMA_20"), (0.01, None, None, None), (None, None, None, "x")]
    found = rules.by_key(spark.createDataFrame([("a", "r2"), ("a", "r1"), ("a", "r2"), ("b", None)], "key string, market_rule string"))
    assert {r.key: r.rules for r in found.collect()} == {"a": ["r1", "r2"], "b": []}


def test_reports_go_to_new_paths(spark, tmp_path):
    schema = "strategy_id string, sharpe_ratio double"
    old, new = spark.createDataFrame([("a", 1.0), ("b", 2.0)], schema), spark.createDataFrame([("b", float("inf")), ("c", -1.0)], schema)
    one, two = f"file://{tmp_path}/one", f"file://{tmp_path}/two"
    bars_csv.write_report(old, one)
    bars_csv.updated_report(bars_csv.read_report(spark, one, schema), new, two, ["strategy_id"])
    got = reports.by_sharpe(bars_csv.read_report(spark, two, schema)).collect()
    assert [(r.strategy_id, r.sharpe_ratio) for r in got] == [("b", float("inf")), ("a", 1.0), ("c", -1.0)]
    small = bars_csv.downcast(spark.createDataFrame([(1, 0.5, "x")], "n long, v double, t string"))
    assert small.dtypes == [("n", "int"), ("v", "float"), ("t", "string")]


def test_work_folders(spark):
    frame = spark.range(3)
    with state.scratch(spark) as keep:
        lost, kept = state.written(frame, "lost"), keep(frame, "kept")
    assert kept.count() == 3
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(lost.inputFiles()[0]).count()

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("Context", (), {"master": "yarn", "applicationId": "x"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        state.checkpoint_root(Cluster())


def test_discovery_goes_on(spark):
    """Known rules are not found again, keys without a new rule are exhausted, processed keys stay processed."""
    from barsmith.plans import runs

    rng = random.Random(8)
    data = [(k, "A", 60, START + timedelta(hours=i), 5 if k != "flat" and x > 0.5 else 1, x) for k in ("new", "old", "flat", "spent") for i in range(300) for x in [rng.random()]]
    rows = spark.createDataFrame(data, "key string, instrument string, timeframe int, entry_time timestamp, trade_count int, x double")
    combos = rows.groupBy("key").count().withColumnRenamed("count", "num_candles")
    none = spark.createDataFrame([], "key string, market_rule string, n_candles long, avg_density double")
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    grow = {"depth": 1, "cuts": {"x": [0.25, 0.5, 0.75]}, "lift": 1.2}
    blank = spark.createDataFrame([], "key string, market_rule string")
    one = runs.discovery_run(combos, rows, ["x"], blank, runs.Discovery(none, keys("spent"), keys("old")), **grow)
    assert [(r.key, r.market_rule) for r in one.strategies.collect()] == [("new", "`x` > 0.5")]
    assert {r.key for r in one.exhausted.collect()} == {"spent", "flat"} and {r.key for r in one.done.collect()} == {"old", "new", "flat"}
    bad = spark.createDataFrame([("old", None), ("new", "`x` > 0.5"), ("flat", None)], "key string, market_rule string")
    two = runs.discovery_run(combos, rows, ["x"], bad, one, **grow)
    got = {(r.key, r.market_rule) for r in two.strategies.collect()}
    assert {("new", "`x` > 0.5"), ("old", "`x` > 0.5")} <= got
    assert "flat" in {r.key for r in two.exhausted.collect()}
