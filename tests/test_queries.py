"""Registered queries against their SQL in DuckDB."""

import math
import os
import subprocess
import sys

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SOME = ["ohlc_bars", "bar_index", "barrier_wins", "ema", "adx", "support_resistance", "candle_patterns", "positioning", "scaled_features", "combinations", "rule_stump", "equity_curve", "performance", "regime_rows", "upsert_latest", "timeframe_signals", "rule_tree_levels", "brand_bars", "brand_averages", "user_series", "rule_matches", "rule_index_cut_bins", "combinations_in_runs", "rule_tree_leaves", "exhausted_keys", "excluded_targets", "orders_from_text", "market_costs", "trade_metrics"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return v.strftime("%F %T.%f") if hasattr(v, "strftime") else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    from barsmith.plans import more_queries as queries

    df = queries.Q[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = duck.sql(queries.SQL[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert got or name in ("rule_stump", "rule_tree_levels", "exhausted_keys")  # 50 bars a leaf, or 100 a key, are more than the smallest tables have


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_feature_chain(spark):
    from barsmith.plans import pipelines, queries

    bars = queries.indexed(spark, DATA)
    feats = pipelines.features(bars, warmup=20)
    table = pipelines.learning_table(feats, fit_on="view")
    assert table.count() == feats.count() > 0
    assert not {"open", "close", "SMA_20", "session"} & set(table.columns)


def test_import_without_text_operators(tmp_path):
    """The entry point works where the text operators have been taken out."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "barsmith"), tmp_path / "barsmith", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sma' in q and not any(x.startswith('op') or x == 'pipeline' for x in q if x[2:3].isdigit() or x == 'pipeline'); print(len(q))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
