"""State that switches as one, runs by timeframe, scalers that grow, and table layouts."""

import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barsmith.functions import preprocess as pre
from barsmith.operators import bars as b
from barsmith.operators import blueprints as bp
from barsmith.operators import evaluate as ev
from barsmith.operators import rules
from barsmith.plans import runs
from barsmith.sources import bars_csv, state

START = datetime(2024, 1, 1)


def test_tables_switch_as_one(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/state"
    assert state.current(spark, root) is None and state.current_table(spark, root, "a", "id long").count() == 0
    state.publish(spark, root, {"a": spark.range(3), "b": spark.range(2)})
    assert state.current_table(spark, root, "a", "id long").count() == 3
    with monkeypatch.context() as m:  # killed between the tables and the switch

        def killed(*a):
            raise KeyboardInterrupt

        m.setattr(state, "_switch", killed)
        with pytest.raises(KeyboardInterrupt):
            state.publish(spark, root, {"a": spark.range(9), "b": spark.range(9)})
    assert [state.current_table(spark, root, n, "id long").count() for n in "ab"] == [3, 2]
    old = state.current_table(spark, root, "a", "id long")
    state.publish(spark, root, {"a": old.union(spark.range(4)), "b": spark.range(1)})  # reads what it replaces
    assert [state.current_table(spark, root, n, "id long").count() for n in "ab"] == [7, 1] and old.count() == 3


def test_scratch_is_of_its_context(spark):
    frame, made = spark.range(3), {}

    def there(df):
        return state.table_there(spark, df.inputFiles()[0])

    def other():
        made["other"] = state.written(frame, "other")

    with pytest.raises(ValueError):
        with state.scratch(spark) as keep:
            made["lost"] = state.written(frame, "lost")
            made["kept"] = keep(frame, "kept")
            with state.scratch(spark) as inner:
                made["inner"] = state.written(frame, "inner")
                made["result"] = inner(frame, "result")
            files = {k: v.inputFiles()[0] for k, v in made.items() if k != "inner"}
            assert all(state.table_there(spark, f) for f in files.values())
            t = threading.Thread(target=other)
            t.start()
            t.join()
            raise ValueError
    assert there(made["other"]) and there(made["kept"])
    assert not state.table_there(spark, files["lost"]) and not state.table_there(spark, files["result"])


def market_of(spark, minutes=(60, 15), names="AB", n=400):
    rng, rows = random.Random(4), []
    for t in minutes:
        for name in names:
            price = 100.0
            for k in range(n):
                price *= 1 + rng.uniform(-0.01, 0.01)
                rows.append((name, t, START + timedelta(minutes=t * k), k, n, price, price * 1.004, price * 0.996, price, float(rng.randint(0, 99)), "x", "y", "z"))
    schema = "instrument string, timeframe int, time timestamp, idx long, n_bars long, open double, high double, low double, close double, rsi double, session string, trend_regime_14 string, vol_regime_14 string"
    frame = spark.createDataFrame(rows, schema).cache()
    return runs.Market(frame, frame, b.cost_table(spark), ["rsi"], 200)


def strategies_of(spark, rows):
    schema = "key string, market_rule string, timeframe int, type string, sl_level string, sl_ratio double, sl_bin int, tp_level string, tp_ratio double, tp_bin int"
    return ev.with_ids(spark.createDataFrame([(k, r, t, "SL-Pct", None, 0.02, None, None, 0.03, None) for k, r, t in rows], schema))


def test_validation_keeps_to_timeframes_and_pairs(spark, tmp_path):
    market = market_of(spark)
    first = strategies_of(spark, [("s15", "`rsi` > 50.0", 15), ("s60", "`rsi` > 60.0", 60)])
    none, _ = runs.validation_run(60, first.filter("key = 's15'"), market)
    assert none.detailed.count() == 0 and none.done.count() == 0
    one, _ = runs.validation_run(60, first, market)
    assert {(r.strategy_id[:3], r.instrument, r.timeframe) for r in one.detailed.collect()} == {("s60", "A", 60), ("s60", "B", 60)}
    # A strategy that passes later is tried on the same markets; the other is not tried again.
    more = first.unionByName(strategies_of(spark, [("new", "`rsi` <= 50.0", 60)]))
    root = f"file://{tmp_path}/validation"
    runs.saved(spark, root, one)
    two, log = runs.validation_run(60, more, market, runs.resumed(spark, root, runs.Validation))
    assert {(r.strategy_id[:3], r.instrument) for r in two.detailed.collect()} == {(s, m) for s in ("s60", "new") for m in "AB"}
    assert {r.strategy_id[:3] for r in log.select("strategy_id").distinct().collect()} == {"new"} and two.done.count() == 4
    assert [r.validation_markets_passed_count for r in two.summary.collect()] == sorted((r.validation_markets_passed_count for r in two.summary.collect()), reverse=True)
    again, _ = runs.validation_run(60, more, market, two)
    assert sorted((r.strategy_id, r.instrument, r.total_trades) for r in again.detailed.collect()) == sorted((r.strategy_id, r.instrument, r.total_trades) for r in two.detailed.collect())
    assert runs.resumed(spark, f"file://{tmp_path}/none", runs.Validation) is None


def test_backtest_finds_signals_once(spark):
    """The log and the report are read from written trades; no bitmap is unpacked anew for them."""
    from barsmith.plans import pipelines

    market = market_of(spark, minutes=(60,))
    log, report = pipelines.backtest(strategies_of(spark, [("s60", "`rsi` > 60.0", 60)]), market.features, market.bars, market.costs, market.rule_features, market.look_ahead)
    for df in (log, report):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and "LogicalRDD" not in plan
    assert log.count() == report.agg(F.sum("total_trades")).first()[0] > 0


def test_scaler_grows_with_markets(spark):
    rng = random.Random(3)
    rows = [(m, 60, rng.gauss(mean, 3.0) if rng.random() > 0.1 else None, 7.0) for m, mean in (("A", 0), ("B", 1e6), ("C", -5)) for _ in range(200)]
    frame = spark.createDataFrame(rows, "instrument string, timeframe int, x double, y double")
    parts = [pre.scaler_state(frame.filter(F.col("instrument").isin(*m)), ["x", "y"], b.KEYS) for m in ("A", "BC")]
    got, want = pre.scaler_of(parts[0].unionByName(parts[1]), ["x", "y"]).first(), pre.scaler(frame, ["x", "y"], []).first()
    for c in got.asDict():
        assert got[c] == pytest.approx(want[c], rel=1e-12)
    assert pre.scaled(frame, ["x", "y"], b.KEYS, pre.scaler_of(parts[0].unionByName(parts[1]), ["x", "y"])).filter("y <> 0").count() == 0


def test_prepared_markets_come_in_increments(spark):
    from barsmith.plans import pipelines

    rng = random.Random(5)
    rows = [(m, 60, START + timedelta(hours=i), i, 90, rng.gauss(5, 2), "Tokyo") for m in "ABC" for i in range(90)]
    feats = spark.createDataFrame(rows, "instrument string, timeframe int, time timestamp, idx long, n_bars long, RSI_14 double, session string")
    one, first = pipelines.prepared(feats.filter("instrument <> 'C'"))
    two, both = pipelines.prepared(feats, first)
    assert {r.instrument for r in two.select("instrument").distinct().collect()} == {"C"} and one.count() == 180
    whole, _ = pipelines.prepared(feats)
    a, c = (t.filter("instrument = 'C'").agg(F.sum("RSI_14").alias("s")).first().s for t in (two, whole))
    assert a == pytest.approx(c, rel=1e-9) and both.select("instrument").distinct().count() == 3


def test_clustered_files_are_pruned(spark, tmp_path):
    """A span of one market reads few rows of a table sorted by market and time: its row groups rule the others out."""
    import pyarrow.parquet as pq

    rng = random.Random(6)
    rows = [("hot" if i % 3 else "m" + str(i % 7), 60, START + timedelta(hours=i), rng.random()) for i in range(6000)]
    bars = spark.createDataFrame(rows, "instrument string, timeframe int, time timestamp, close double").repartition(6)
    path = f"file://{tmp_path}/bars"
    bars_csv.write_clustered(bars, path, files=8, block_bytes=8192)
    some = bars_csv.read_span(spark, path, "hot", 60, "2024-03-01", "2024-03-03")
    want = [r for r in rows if r[0] == "hot" and datetime(2024, 3, 1) <= r[2] < datetime(2024, 3, 3)]
    assert some.count() == len(want) > 0
    groups = [g for f in tmp_path.glob("bars/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in (m.row_group(i) for i in range(m.num_row_groups))]
    ranges = [(g.num_rows, *((s.min, s.max) for s in (g.column(0).statistics, g.column(2).statistics))) for g in groups]
    hit = [n for n, (lo, hi), (a, z) in ranges if lo <= "hot" <= hi and a.replace(tzinfo=None) < datetime(2024, 3, 3) and z.replace(tzinfo=None) >= datetime(2024, 3, 1)]
    assert sum(n for n, *_ in ranges) == 6000 and sum(hit) <= 1500
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = bars_csv.read_span(spark, path, "hot", 60, "2024-03-01", "2024-03-03")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(time" in text and "EqualTo(instrument,hot)" in text


def test_bucketed_targets_join_without_exchange(spark, tmp_path):
    rows = [(f"k{i % 5}", "A", 60, START + timedelta(hours=i), i % 4) for i in range(400)]
    found = spark.createDataFrame(rows, "key string, instrument string, timeframe int, entry_time timestamp, trade_count int")
    feats = found.select("instrument", "timeframe", F.col("entry_time").alias("time"), F.rand(1).alias("x")).distinct()
    spark.sql("DROP TABLE IF EXISTS bucketed_targets")
    bp.write_bucketed(found, "bucketed_targets", [*b.KEYS, "entry_time"], 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = rules.training(spark.table("bucketed_targets"), feats)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        plain = rules.training(found, feats)._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 400 and "Bucketed: true" in plan
        assert plan.count("Exchange hashpartitioning") == plain.count("Exchange hashpartitioning") - 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE bucketed_targets")


def test_feature_export(spark, tmp_path):
    frame = spark.createDataFrame([("A", 60, START, 1, 0.5, None), ("B", 15, START, 2, 1.5, 2.5)], "instrument string, timeframe int, time timestamp, idx long, x double, y double")
    bars_csv.write_features(frame, f"file://{tmp_path}/features")
    back = spark.read.option("header", True).csv(f"file://{tmp_path}/features").orderBy("instrument").collect()
    assert [(r.instrument, r.timeframe, r.time, r.idx, r.x, r.y) for r in back] == [("A", 60, "2024-01-01 00:00:00", "1", "0.5", None), ("B", 15, "2024-01-01 00:00:00", "2", "1.5", "2.5")]
