"""Registered queries over the supplied tables, and the same in DuckDB SQL.

Market data: `events` as ticks (instrument event_type, price value) in hourly bars. Prices there are noise between 0 and
some hundreds, so the barriers are wide. Every query reads the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.functions import indicators as ind
from barsmith.functions.patterns import NAMES, patterns
from barsmith.functions.positioning import enriched, price_relative
from barsmith.functions.preprocess import one_hot, pattern_scores, scaled, scaler
from barsmith.operators import bars as b
from barsmith.operators import barriers as br
from barsmith.operators import blueprints as bp
from barsmith.operators import evaluate as ev
from barsmith.operators import reports, rules
from barsmith.operators.bitmaps import matches_by_index
from barsmith.sources.state import append_distinct, upsert_last, written

MINUTES, LOOK, SL, TP = 60, 50, [1000, 3000], [1000, 3000, 6000]
LEVELS = ["SMA_20", "EMA_13", "BB_upper_20", "support"]
Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("instrument"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("event_id").alias("tick_id"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.ohlc(ticks(spark, sf_dir), MINUTES)


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered bars. Numbering reads bars twice, so they are written before and ticks are read once."""
    return b.indexed(written(b.one_per_time(bars(spark, sf_dir)), "bars"))


def features(spark: SparkSession, sf_dir: str, numbered: DataFrame | None = None) -> DataFrame:
    """The features that positioning, rules and reports use, written once as each of them reads them several times."""
    f = ind.framed(indexed(spark, sf_dir) if numbered is None else numbered)
    for step in (lambda x: ind.sma(x, (20,)), lambda x: ind.ema(x, (13,)), ind.bollinger, ind.rsi, ind.atr, ind.adx, ind.regimes, ind.pivots):
        f = step(f)
    return written(ind.calendar(ind.support_resistance(ind.done(f))), "features")


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n.split('.')[-1]}" for n in names)


# --- SQL building blocks: common table expressions, each using those before it -------------------------------------------
CTE = {
    "bars": f"""SELECT event_type AS instrument, {MINUTES} AS timeframe, time_bucket(INTERVAL '{MINUTES} minutes', ts) AS time,
 arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*)::DOUBLE AS volume
 FROM events GROUP BY 1, 2, 3""",
    "ix": "SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY instrument) AS n_bars FROM bars WINDOW w AS (PARTITION BY instrument ORDER BY time)",
    "grid": f"SELECT unnest({SL}) AS sl",
    "reach": f"""SELECT a.instrument, a.idx, r.ratio,
 min(CASE WHEN f.high >= a.close * (1 + r.ratio / 10000) THEN f.idx END) AS up_idx,
 min(CASE WHEN f.low <= a.close * (1 - r.ratio / 10000) THEN f.idx END) AS down_idx
 FROM ix a CROSS JOIN (SELECT unnest({TP}) AS ratio) r LEFT JOIN ix f ON f.instrument = a.instrument AND f.idx > a.idx AND f.idx <= a.idx + {LOOK}
 GROUP BY ALL""",
    "lv": f"""SELECT instrument, timeframe, time, idx, close, s.side AS trade_type, x.sl, y.tp, s.sign AS sign,
 CASE WHEN instrument ILIKE '%JPY%' OR instrument ILIKE '%XAU%' THEN 0.03 ELSE 0.0003 END AS spread
 FROM ix CROSS JOIN (VALUES ('buy', 1), ('sell', -1)) s(side, sign) CROSS JOIN (SELECT unnest({SL}) AS sl) x CROSS JOIN (SELECT unnest({TP}) AS tp) y
 WHERE idx < n_bars - {LOOK}""",
    "hit": f"""SELECT l.instrument, l.timeframe, l.time, l.idx, l.close, l.trade_type, l.sl, l.tp, l.sign,
 min(CASE WHEN (l.sign = 1 AND f.high >= l.close * (1 + l.tp / 10000) + l.spread) OR (l.sign = -1 AND f.low <= l.close * (1 - l.tp / 10000) - l.spread) THEN f.idx END) AS t,
 min(CASE WHEN (l.sign = 1 AND f.low <= l.close * (1 - l.sl / 10000)) OR (l.sign = -1 AND f.high >= l.close * (1 + l.sl / 10000)) THEN f.idx END) AS s
 FROM lv l JOIN ix f ON f.instrument = l.instrument AND f.idx > l.idx AND f.idx <= l.idx + {LOOK} GROUP BY ALL""",
    "won": """SELECT h.instrument, h.timeframe, h.time AS entry_time, h.idx AS entry_idx, h.trade_type, h.close AS entry_price, h.sl, h.tp,
 h.close * (1 - h.sign * h.sl / 10000) AS sl_price, h.close * (1 + h.sign * h.tp / 10000) AS tp_price, h.t AS exit_idx, 'win' AS outcome
 FROM hit h WHERE t IS NOT NULL AND (s IS NULL OR t <= s)""",
    "w1": """SELECT *, lag(close) OVER w AS pc, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM ix WINDOW w AS (PARTITION BY instrument ORDER BY idx)""",
    "w2": """SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
 CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS pdm, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS mdm,
 greatest(coalesce(close - pc, 0), 0) AS gain, greatest(coalesce(pc - close, 0), 0) AS loss FROM w1""",
    "w3": """SELECT *, avg(tr) OVER (w ROWS 13 PRECEDING) AS tr14, avg(pdm) OVER (w ROWS 13 PRECEDING) AS pdm14, avg(mdm) OVER (w ROWS 13 PRECEDING) AS mdm14
 FROM w2 WINDOW w AS (PARTITION BY instrument ORDER BY idx)""",
    # One pass along each series for all smoothed averages.
    "rec": """SELECT instrument, idx, close AS e8, close AS e12, close AS e13, close AS e21, close AS e26, close AS e50, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l,
 NULL::DOUBLE AS atr, NULL::DOUBLE AS st, NULL::DOUBLE AS sp, NULL::DOUBLE AS sm, NULL::DOUBLE AS sig FROM w3 WHERE idx = 0
 UNION ALL SELECT b.instrument, b.idx, r.e8 + (b.close - r.e8) * 2 / 9, r.e12 + (b.close - r.e12) * 2 / 13, r.e13 + (b.close - r.e13) * 2 / 14, r.e21 + (b.close - r.e21) * 2 / 22,
 r.e26 + (b.close - r.e26) * 2 / 27, r.e50 + (b.close - r.e50) * 2 / 51, r.g + (b.gain - r.g) / 14, r.l + (b.loss - r.l) / 14,
 CASE WHEN b.idx = 13 THEN b.tr14 WHEN b.idx > 13 THEN r.atr + (b.tr - r.atr) / 14 END,
 CASE WHEN b.idx = 14 THEN b.tr14 WHEN b.idx > 14 THEN r.st + (b.tr - r.st) / 14 END, CASE WHEN b.idx = 14 THEN b.pdm14 WHEN b.idx > 14 THEN r.sp + (b.pdm - r.sp) / 14 END,
 CASE WHEN b.idx = 14 THEN b.mdm14 WHEN b.idx > 14 THEN r.sm + (b.mdm - r.sm) / 14 END,
 CASE WHEN b.idx = 25 THEN (r.e12 + (b.close - r.e12) * 2 / 13) - (r.e26 + (b.close - r.e26) * 2 / 27)
  WHEN b.idx > 25 THEN r.sig + ((r.e12 + (b.close - r.e12) * 2 / 13) - (r.e26 + (b.close - r.e26) * 2 / 27) - r.sig) * 2 / 10 END
 FROM rec r JOIN w3 b ON b.instrument = r.instrument AND b.idx = r.idx + 1""",
    "dx": """SELECT instrument, idx, CASE WHEN idx >= 14 THEN coalesce(abs(sp / nullif(st, 0) - sm / nullif(st, 0)) / nullif(sp / nullif(st, 0) + sm / nullif(st, 0), 0), 0) * 100 END AS dx FROM rec""",
    "dx2": "SELECT *, avg(dx) OVER (PARTITION BY instrument ORDER BY idx ROWS 13 PRECEDING) AS dx14 FROM dx",
    "rec2": """SELECT instrument, idx, dx14 AS adx FROM dx2 WHERE idx = 27
 UNION ALL SELECT b.instrument, b.idx, r.adx + (b.dx - r.adx) / 14 FROM rec2 r JOIN dx2 b ON b.instrument = r.instrument AND b.idx = r.idx + 1""",
    "sm": """SELECT r.*, a.adx, CASE WHEN r.idx >= 62 THEN avg(r.atr) OVER (PARTITION BY r.instrument ORDER BY r.idx ROWS 49 PRECEDING) END AS atr50
 FROM rec r LEFT JOIN rec2 a ON a.instrument = r.instrument AND a.idx = r.idx""",
    "roll": """SELECT *, CASE WHEN idx >= 19 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS sma_20, CASE WHEN idx >= 19 THEN stddev_pop(close) OVER (w ROWS 19 PRECEDING) END AS dev
 FROM ix WINDOW w AS (PARTITION BY instrument ORDER BY idx)""",
    "piv": """SELECT *, CASE WHEN idx >= 10 AND idx < n_bars - 10 AND low::FLOAT = min(low::FLOAT) OVER w THEN low END AS low_pivot,
 CASE WHEN idx >= 10 AND idx < n_bars - 10 AND high::FLOAT = max(high::FLOAT) OVER w THEN high END AS high_pivot
 FROM ix WINDOW w AS (PARTITION BY instrument ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING)""",
    "sr": """SELECT instrument, timeframe, idx, time, last_value(low_pivot IGNORE NULLS) OVER w AS support, last_value(high_pivot IGNORE NULLS) OVER w AS resistance
 FROM piv WINDOW w AS (PARTITION BY instrument ORDER BY idx ROWS UNBOUNDED PRECEDING)""",
    "feat": """SELECT r.instrument, r.timeframe, r.time, r.idx, r.n_bars, r.open, r.high, r.low, r.close, r.volume, r.sma_20 AS "SMA_20", CASE WHEN r.idx >= 12 THEN s.e13 END AS "EMA_13",
 r.sma_20 + 2 * r.dev AS "BB_upper_20", r.sma_20 - 2 * r.dev AS "BB_lower_20", 4 * r.dev / nullif(r.sma_20, 0) * 100 AS "BB_width_20", sr.support, sr.resistance,
 CASE WHEN r.idx >= 13 THEN CASE WHEN s.l = 0 THEN 100 ELSE 100 - 100 / (1 + s.g / s.l) END END AS "RSI_14", s.atr AS "ATR_14", s.adx AS "ADX_14",
 CASE WHEN s.adx > 25 THEN 'trend' ELSE 'range' END AS trend_regime_14, CASE WHEN s.atr > s.atr50 THEN 'high_vol' ELSE 'low_vol' END AS vol_regime_14,
 hour(r.time)::INT AS hour, (isodow(r.time) - 1)::INT AS weekday,
 CASE WHEN hour(r.time) = 0 THEN 'Tokyo' WHEN hour(r.time) <= 8 THEN 'Tokyo_London_Overlap' WHEN hour(r.time) = 9 THEN 'London' WHEN hour(r.time) <= 13 THEN 'London_NY_Overlap'
  WHEN hour(r.time) <= 17 THEN 'New_York' ELSE 'Sydney' END AS session
 FROM roll r JOIN sm s ON s.instrument = r.instrument AND s.idx = r.idx JOIN sr ON sr.instrument = r.instrument AND sr.idx = r.idx""",
}
ORDER = list(CTE)
NEEDS = {
    "bars": [], "ix": ["bars"], "reach": ["ix"], "lv": ["ix"], "hit": ["lv"], "won": ["hit"], "w1": ["ix"], "w2": ["w1"], "w3": ["w2"], "rec": ["w3"], "dx": ["rec"], "dx2": ["dx"],
    "rec2": ["dx2"], "sm": ["rec2", "rec"], "roll": ["ix"], "piv": ["ix"], "sr": ["piv"], "feat": ["roll", "sm", "sr"],
}


def sql(final: str, *needs: str, **more: str) -> str:
    """WITH RECURSIVE of what `needs` ask for and of `more`, then final."""
    wanted: set[str] = set()

    def add(n: str) -> None:
        if n not in wanted:
            wanted.add(n)
            for x in NEEDS[n]:
                add(x)

    for n in needs:
        add(n)
    parts = [f"{n} AS ({CTE[n]})" for n in ORDER if n in wanted] + [f"{n} AS ({x})" for n, x in more.items()]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final


# --- bars ----------------------------------------------------------------------------------------------------------------
@query(sql(f"SELECT instrument, timeframe, time, {r6('open', 'high', 'low', 'close', 'volume')} FROM bars", "bars"))
def ohlc_bars(spark, sf_dir):
    return rounded(bars(spark, sf_dir))


@query(sql("SELECT instrument, timeframe, time, idx, n_bars FROM ix", "ix"))
def bar_index(spark, sf_dir):
    return indexed(spark, sf_dir).select(*b.KEYS, "time", "idx", "n_bars")


# --- barriers ------------------------------------------------------------------------------------------------------------
@query(sql(f"SELECT instrument, {MINUTES} AS timeframe, idx, ratio, up_idx, down_idx FROM reach", "reach"))
def first_touch(spark, sf_dir):
    return br.first_touch(indexed(spark, sf_dir), TP, LOOK)


WON_SQL = f"SELECT instrument, timeframe, entry_time, entry_idx, trade_type, {r6('entry_price', 'sl_price', 'tp_price')}, sl, tp, exit_idx, outcome FROM won"


@query(sql(WON_SQL, "won"))
def barrier_wins(spark, sf_dir):
    return rounded(br.barrier_outcomes(indexed(spark, sf_dir), SL, TP, LOOK))


@query(sql("SELECT instrument, trade_type, sl, tp, count(*) AS n FROM hit WHERE t IS NOT NULL AND (s IS NULL OR t < s) GROUP BY ALL", "hit"))
def barrier_tie_loss(spark, sf_dir):
    won = br.barrier_outcomes(indexed(spark, sf_dir), SL, TP, LOOK, ties_win=False)
    return won.groupBy("instrument", "trade_type", "sl", "tp").agg(F.count(F.lit(1)).alias("n"))


# --- indicators ----------------------------------------------------------------------------------------------------------
def indicator(spark, sf_dir, *steps, columns):
    f = ind.framed(indexed(spark, sf_dir))
    for step in steps:
        f = step(f)
    return rounded(ind.done(f).select(*b.KEYS, "time", "idx", *columns))


def window_sql(items: dict[str, tuple[int, str]], source: str = "ix") -> str:
    """Rolling values over n rows, NULL before n rows exist."""
    cols = ", ".join(f"CASE WHEN idx >= {n - 1} THEN round({x} OVER (w ROWS {n - 1} PRECEDING), 6) + 0.0 END AS \"{name}\"" for name, (n, x) in items.items())
    return f"SELECT instrument, timeframe, time, idx, {cols} FROM {source} WINDOW w AS (PARTITION BY instrument ORDER BY idx)"


@query(sql(window_sql({f"SMA_{p}": (p, "avg(close)") for p in (20, 50, 100, 200)}), "ix"))
def sma(spark, sf_dir):
    return indicator(spark, sf_dir, ind.sma, columns=[f"SMA_{p}" for p in (20, 50, 100, 200)])


@query(sql(f"""SELECT instrument, timeframe, time, idx, round(sma_20 + 2 * dev, 6) + 0.0 AS "BB_upper_20", round(sma_20 - 2 * dev, 6) + 0.0 AS "BB_lower_20",
 round(4 * dev / nullif(sma_20, 0) * 100, 6) + 0.0 AS "BB_width_20" FROM roll""", "roll"))
def bollinger(spark, sf_dir):
    return indicator(spark, sf_dir, ind.bollinger, columns=["BB_upper_20", "BB_lower_20", "BB_width_20"])


@query(sql("""SELECT instrument, timeframe, time, idx, round((close - lag(close, 10) OVER w) / nullif(lag(close, 10) OVER w, 0) * 100, 6) + 0.0 AS "MOM_10"
 FROM ix WINDOW w AS (PARTITION BY instrument ORDER BY idx)""", "ix"))
def roc(spark, sf_dir):
    return indicator(spark, sf_dir, ind.roc, columns=["MOM_10"])


@query(sql("""SELECT instrument, timeframe, time, idx, CASE WHEN idx >= 19 THEN round((tp - m) / nullif(0.015 * list_avg(list_transform(l, lambda x: abs(x - m))), 0), 6) + 0.0 END AS "CCI_20"
 FROM c""", "ix", c="""SELECT *, (high + low + close) / 3 AS tp, avg((high + low + close) / 3) OVER (w ROWS 19 PRECEDING) AS m,
 list((high + low + close) / 3) OVER (w ROWS 19 PRECEDING) AS l FROM ix WINDOW w AS (PARTITION BY instrument ORDER BY idx)"""))
def cci(spark, sf_dir):
    return indicator(spark, sf_dir, ind.cci, columns=["CCI_20"])


@query(sql("""SELECT instrument, timeframe, time, idx, round(sum(CASE WHEN close < pc THEN -volume ELSE volume END) OVER (PARTITION BY instrument ORDER BY idx ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS "OBV"
 FROM w1""", "w1"))
def obv(spark, sf_dir):
    return rounded(ind.obv(indexed(spark, sf_dir)).select(*b.KEYS, "time", "idx", "OBV"))


ACTION = {"bullish_ratio": "avg((close > open)::INT)", "avg_body": "avg(abs(close - open))", "avg_range": "avg(high - low)"}


@query(sql(window_sql({f"{k}_last_{n}": (n, x) for n in (3, 5, 10, 20, 50) for k, x in ACTION.items()}), "ix"))
def rolling_price_action(spark, sf_dir):
    return indicator(spark, sf_dir, ind.price_action, columns=[f"{k}_last_{n}" for n in (3, 5, 10, 20, 50) for k in ACTION])


def smoothed_sql(*items: tuple[str, int, str]) -> str:
    cols = ", ".join(f"CASE WHEN b.idx >= {n} THEN round({x}, 6) + 0.0 END AS \"{name}\"" for name, n, x in items)
    return f"SELECT b.instrument, b.timeframe, b.time, b.idx, {cols} FROM ix b JOIN sm s ON s.instrument = b.instrument AND s.idx = b.idx"


@query(sql(smoothed_sql(*((f"EMA_{p}", p - 1, f"s.e{p}") for p in (8, 13, 21, 50))), "sm"))
def ema(spark, sf_dir):
    return indicator(spark, sf_dir, ind.ema, columns=[f"EMA_{p}" for p in (8, 13, 21, 50)])


@query(sql(smoothed_sql(("RSI_14", 13, "CASE WHEN s.l = 0 THEN 100 ELSE 100 - 100 / (1 + s.g / s.l) END")), "sm"))
def rsi(spark, sf_dir):
    return indicator(spark, sf_dir, ind.rsi, columns=["RSI_14"])


@query(sql(smoothed_sql(("MACD_hist_12_26_9", 33, "s.e12 - s.e26 - s.sig")), "sm"))
def macd(spark, sf_dir):
    return indicator(spark, sf_dir, ind.macd, columns=["MACD_hist_12_26_9"])


@query(sql(smoothed_sql(("ATR_14", 13, "s.atr"), ("ATR_level_up_1x_14", 13, "b.close + s.atr"), ("ATR_level_down_1x_14", 13, "b.close - s.atr")), "sm"))
def atr(spark, sf_dir):
    return indicator(spark, sf_dir, ind.atr, columns=["ATR_14", "ATR_level_up_1x_14", "ATR_level_down_1x_14"])


@query(sql(smoothed_sql(("ADX_14", 27, "s.adx")), "sm"))
def adx(spark, sf_dir):
    return indicator(spark, sf_dir, ind.adx, columns=["ADX_14"])


@query(sql(f"SELECT instrument, timeframe, time, idx, {r6('low_pivot', 'high_pivot')} FROM piv", "piv"))
def pivots(spark, sf_dir):
    return indicator(spark, sf_dir, ind.pivots, columns=["low_pivot", "high_pivot"])


@query(sql(f"SELECT instrument, timeframe, time, idx, {r6('support', 'resistance')} FROM sr", "sr"))
def support_resistance(spark, sf_dir):
    f = ind.support_resistance(ind.done(ind.pivots(ind.framed(indexed(spark, sf_dir)))))
    return rounded(f.select(*b.KEYS, "time", "idx", "support", "resistance"))


PATTERN_SQL = {
    "doji": "CASE WHEN body = 0 AND span = 0 THEN 0 WHEN body <= 0.1 * span THEN 100 ELSE 0 END",
    "hammer": "CASE WHEN dn >= 2 * body AND up <= 0.1 * span AND body > 0 THEN 100 ELSE 0 END",
    "shooting_star": "CASE WHEN up >= 2 * body AND dn <= 0.1 * span AND body > 0 THEN -100 ELSE 0 END",
    "marubozu": "CASE WHEN body >= 0.95 * span AND span > 0 THEN CASE WHEN c > o THEN 100 WHEN c < o THEN -100 ELSE 0 END ELSE 0 END",
    "engulfing": "CASE WHEN c > o AND c1 < o1 AND greatest(o, c) >= greatest(o1, c1) AND least(o, c) <= least(o1, c1) THEN 100 WHEN c < o AND c1 > o1 AND greatest(o, c) >= greatest(o1, c1) AND least(o, c) <= least(o1, c1) THEN -100 ELSE 0 END",
    "harami": "CASE WHEN c > o AND c1 < o1 AND greatest(o, c) <= greatest(o1, c1) AND least(o, c) >= least(o1, c1) THEN 100 WHEN c < o AND c1 > o1 AND greatest(o, c) <= greatest(o1, c1) AND least(o, c) >= least(o1, c1) THEN -100 ELSE 0 END",
    "piercing": "CASE WHEN c1 < o1 AND c > o AND o < l1 AND c > (o1 + c1) / 2 AND c < o1 THEN 100 ELSE 0 END",
    "dark_cloud": "CASE WHEN c1 > o1 AND c < o AND o > h1 AND c < (o1 + c1) / 2 AND c > o1 THEN -100 ELSE 0 END",
    "three_line": "CASE WHEN c > o AND c1 > o1 AND c2 > o2 AND c > c1 AND c1 > c2 THEN 100 WHEN c < o AND c1 < o1 AND c2 < o2 AND c < c1 AND c1 < c2 THEN -100 ELSE 0 END",
    "star": "CASE WHEN c2 < o2 AND abs(c1 - o1) <= 0.3 * abs(c2 - o2) AND c > o AND c > (o2 + c2) / 2 THEN 100 WHEN c2 > o2 AND abs(c1 - o1) <= 0.3 * abs(c2 - o2) AND c < o AND c < (o2 + c2) / 2 THEN -100 ELSE 0 END",
}
CANDLES = """SELECT *, open AS o, close AS c, abs(close - open) AS body, high - low AS span, high - greatest(open, close) AS up, least(open, close) - low AS dn,
 lag(open) OVER w AS o1, lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(open, 2) OVER w AS o2, lag(close, 2) OVER w AS c2 FROM ix WINDOW w AS (PARTITION BY instrument ORDER BY idx)"""


@query(sql(f"SELECT instrument, timeframe, time, idx, {', '.join(f'{x} AS \"CDL_{k}\"' for k, x in PATTERN_SQL.items())} FROM k", "ix", k=CANDLES))
def candle_patterns(spark, sf_dir):
    return indicator(spark, sf_dir, patterns, columns=[f"CDL_{n}" for n in NAMES])


SCORE = "CASE WHEN {0} >= 100 THEN 1.0 WHEN {0} > 0 THEN 0.5 WHEN {0} <= -100 THEN -1.0 WHEN {0} < 0 THEN -0.5 ELSE 0.0 END::DOUBLE"


@query(sql(f"SELECT instrument, timeframe, time, idx, {', '.join(SCORE.format('(' + x + ')') + f' AS \"CDL_{k}\"' for k, x in PATTERN_SQL.items())} FROM k", "ix", k=CANDLES))
def candle_scores(spark, sf_dir):
    return pattern_scores(indicator(spark, sf_dir, patterns, columns=[f"CDL_{n}" for n in NAMES]))


@query(sql("SELECT instrument, timeframe, time, hour, weekday, session FROM feat", "feat"))
def sessions_six(spark, sf_dir):
    return ind.calendar(bars(spark, sf_dir)).select(*b.KEYS, "time", "hour", "weekday", "session")


@query(sql("""SELECT instrument, timeframe, time, CASE WHEN hour(time) BETWEEN 7 AND 11 THEN 'London' WHEN hour(time) BETWEEN 12 AND 15 THEN 'London_NY_Overlap'
 WHEN hour(time) BETWEEN 16 AND 20 THEN 'New_York' ELSE 'Asian' END AS session FROM bars""", "bars"))
def sessions_four(spark, sf_dir):
    return ind.calendar(bars(spark, sf_dir), "four").select(*b.KEYS, "time", "session")


@query(sql("SELECT instrument, timeframe, time, idx, trend_regime_14, vol_regime_14 FROM feat", "feat"))
def regimes(spark, sf_dir):
    return features(spark, sf_dir).select(*b.KEYS, "time", "idx", "trend_regime_14", "vol_regime_14")


# --- positioning and preparation -------------------------------------------------------------------------------------------
def enriched_sql(levels, feat: str = "feat") -> str:
    return "SELECT w.*, " + ", ".join(
        f'({s}_price - f."{c}") / nullif(f.close, 0) * 10000 AS "{s}_dist_to_{c}_bps", ({s}_price - f.close) / nullif(f."{c}" - f.close, 0) AS "{s}_place_pct_to_{c}"' for s in ("sl", "tp") for c in levels
    ) + f" FROM won w JOIN {feat} f ON f.instrument = w.instrument AND f.time = w.entry_time"


ENRICHED = enriched_sql(LEVELS)
PLACES = [f"{s}_{x}" for c in LEVELS for s in ("sl", "tp") for x in (f"dist_to_{c}_bps", f"place_pct_to_{c}")]


def enriched_bars(spark, sf_dir):
    return enriched(br.barrier_outcomes(indexed(spark, sf_dir), SL, TP, LOOK), features(spark, sf_dir), LEVELS)


@query(sql("SELECT instrument, entry_idx, trade_type, sl, tp, " + ", ".join(f'round("{c}", 4) + 0.0 AS "{c}"' for c in PLACES) + " FROM en", "won", "feat", en=ENRICHED))
def positioning(spark, sf_dir):
    return rounded(enriched_bars(spark, sf_dir).select("instrument", "entry_idx", "trade_type", "sl", "tp", *PLACES), 4)


NORMED = ["SMA_20", "EMA_13", "BB_upper_20", "BB_lower_20", "support", "resistance"]


@query(sql("SELECT instrument, timeframe, idx, " + ", ".join(f'round(("{c}" - close) / nullif(close, 0), 8) + 0.0 AS "{c}_dist_norm"' for c in NORMED) + " FROM feat", "feat"))
def dist_norm(spark, sf_dir):
    return rounded(price_relative(features(spark, sf_dir)).select(*b.KEYS, "idx", *(f"{c}_dist_norm" for c in NORMED)), 8)


ONE_HOT = [("session", v) for v in ("Tokyo", "Tokyo_London_Overlap", "London", "London_NY_Overlap", "New_York", "Sydney", "Asian")] + [("trend_regime_14", "trend"), ("trend_regime_14", "range"), ("vol_regime_14", "high_vol"), ("vol_regime_14", "low_vol")]


@query(sql("SELECT instrument, timeframe, idx, " + ", ".join(f"CASE WHEN {c} = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"{c}_{v}\"" for c, v in ONE_HOT) + " FROM feat", "feat"))
def one_hot_labels(spark, sf_dir):
    f = features(spark, sf_dir).select(*b.KEYS, "idx", "session", "trend_regime_14", "vol_regime_14")
    return one_hot(f)


SCALED = ["RSI_14", "ATR_14", "ADX_14", "BB_width_20"]


@query(sql("SELECT f.instrument, f.timeframe, f.idx, " + ", ".join(f'round((coalesce(f."{c}", 0) - m."{c}_m") / CASE WHEN m."{c}_s" = 0 THEN 1 ELSE m."{c}_s" END, 6) + 0.0 AS "{c}"' for c in SCALED)
           + " FROM feat f JOIN m ON m.instrument = f.instrument", "feat",
           m="SELECT instrument, " + ", ".join(f'avg(coalesce("{c}", 0)) AS "{c}_m", stddev_pop(coalesce("{c}", 0)) AS "{c}_s"' for c in SCALED) + " FROM feat GROUP BY 1"))
def scaled_features(spark, sf_dir):
    return rounded(scaled(features(spark, sf_dir).select(*b.KEYS, "idx", *SCALED), SCALED, b.KEYS))


@query(sql("SELECT f.instrument, f.timeframe, f.idx, " + ", ".join(f'round((coalesce(f."{c}", 0) - m."{c}_m") / CASE WHEN m."{c}_s" = 0 THEN 1 ELSE m."{c}_s" END, 6) + 0.0 AS "{c}"' for c in SCALED)
           + " FROM feat f CROSS JOIN m", "feat",
           m="SELECT " + ", ".join(f'avg(coalesce("{c}", 0)) AS "{c}_m", stddev_pop(coalesce("{c}", 0)) AS "{c}_s"' for c in SCALED) + " FROM feat WHERE instrument = 'view'"))
def scaled_on_one_market(spark, sf_dir):
    f = features(spark, sf_dir).select(*b.KEYS, "idx", *SCALED)
    return rounded(scaled(f, SCALED, b.KEYS, scaler(f.filter("instrument = 'view'"), SCALED, b.KEYS)))


# --- blueprints ------------------------------------------------------------------------------------------------------------
def bins_sql(levels) -> str:
    return " UNION ALL ".join(
        f"""SELECT instrument, timeframe, entry_time, '{s.upper()}-{kind}' AS type, '{c}' AS level, bin, {o} AS ratio FROM
 (SELECT *, ({f'floor("{s}_place_pct_to_{c}" * 10)' if kind == 'Pct' else f'floor("{s}_dist_to_{c}_bps" / 5) * 5'})::INT AS bin FROM eb
  WHERE abs("{s}_{f'place_pct_to_{c}' if kind == 'Pct' else f'dist_to_{c}_bps'}") < 1e6) WHERE bin BETWEEN {-m} AND {m}"""
        for c in levels for s, o in (("sl", "tp"), ("tp", "sl")) for kind, m in (("Pct", 20), ("BPS", 50))
    )


BINS = bins_sql(LEVELS)
EB = "SELECT * FROM en"
KEY = """sha256(instrument || '-' || timeframe || '-' || type || '-' || CASE WHEN type LIKE 'SL%' THEN level || '-' || bin || '-ratio-' || ratio ELSE 'ratio-' || ratio || '-' || level || '-' || bin END)[1:16]"""


def counts_of(spark, sf_dir):
    return bp.blueprint_counts(enriched_bars(spark, sf_dir), LEVELS)


@query(sql("SELECT instrument, type, level, bin, ratio, count(DISTINCT entry_time) AS bars, count(*) AS outcomes FROM bb GROUP BY ALL", "won", "feat", en=ENRICHED, eb=EB, bb=BINS))
def blueprints(spark, sf_dir):
    counts = counts_of(spark, sf_dir)
    return counts.groupBy("instrument", "type", "level", "bin", "ratio").agg(F.count(F.lit(1)).alias("bars"), F.sum("trade_count").alias("outcomes"))


@query(sql(f"SELECT {KEY} AS key, instrument, timeframe, entry_time, count(*) AS trade_count FROM bb GROUP BY ALL", "won", "feat", en=ENRICHED, eb=EB, bb=BINS))
def blueprint_targets(spark, sf_dir):
    return bp.targets(counts_of(spark, sf_dir))


@query(sql(f"""SELECT {KEY} AS key, instrument, timeframe, type, CASE WHEN type LIKE 'SL%' THEN level END AS sl_level, CASE WHEN type LIKE 'TP%' THEN ratio / 10000 END AS sl_ratio,
 CASE WHEN type LIKE 'SL%' THEN bin END AS sl_bin, CASE WHEN type LIKE 'TP%' THEN level END AS tp_level, CASE WHEN type LIKE 'SL%' THEN ratio / 10000 END AS tp_ratio,
 CASE WHEN type LIKE 'TP%' THEN bin END AS tp_bin, count(DISTINCT entry_time) AS num_candles FROM bb GROUP BY instrument, timeframe, type, level, bin, ratio""", "won", "feat", en=ENRICHED, eb=EB, bb=BINS))
def combinations(spark, sf_dir):
    return bp.combinations(counts_of(spark, sf_dir))


COMBOS = f"SELECT {KEY} AS key, instrument, type, level, bin, count(DISTINCT entry_time) AS num_candles FROM bb GROUP BY instrument, timeframe, type, level, bin, ratio"


@query(sql("SELECT key, num_candles FROM cb WHERE num_candles >= 20 AND NOT (type = 'SL-Pct' AND bin = 0) AND NOT (type = 'TP-Pct' AND level = 'support')", "won", "feat", en=ENRICHED, eb=EB, bb=BINS, cb=COMBOS))
def learning_selection(spark, sf_dir):
    """Blueprints with enough bars, without those processed or exhausted."""
    combos = written(bp.combinations(counts_of(spark, sf_dir)), "combos")
    done = combos.filter("type = 'SL-Pct' AND sl_bin = 0").select("key")
    spent = combos.filter("type = 'TP-Pct' AND tp_level = 'support'").select("key")
    return rules.to_learn(combos, done, spent, 20).select("key", "num_candles")


# --- rules -----------------------------------------------------------------------------------------------------------------
RULE_FEATURES = ["RSI_14", "hour", "weekday", "ADX_14"]
# (key, rule, trade_type, type, sl_level, sl_ratio, sl_bin, tp_level, tp_ratio, tp_bin, avg_density, as SQL)
STRATEGIES = [
    ("a1", "`RSI_14` <= 45.0 and `hour` > 5.0", "buy", "SL-Pct", None, 0.1, None, None, 0.3, None, 2.0, '"RSI_14" <= 45 AND hour > 5'),
    ("b2", "`RSI_14` > 55.0 and `weekday` <= 3.0", "sell", "SL-Pct", None, 0.2, None, None, 0.2, None, 1.8, '"RSI_14" > 55 AND weekday <= 3'),
    ("c3", "`hour` > 7.0 and `hour` <= 16.0", "buy", "TP-Pct", "BB_lower_20", None, 8, "BB_upper_20", None, 8, 1.5, "hour > 7 AND hour <= 16"),
    ("d4", "`ADX_14` > 15.0", None, "SL-BPS", None, 0.3, None, None, 0.6, None, 1.2, '"ADX_14" > 15'),
    ("e5", "`hour` > 7.0 and `hour` <= 16.0", "sell", "SL-Pct", "SMA_20", None, -9, None, 0.1, None, 1.1, "hour > 7 AND hour <= 16"),
]
STRATEGY_SCHEMA = "key string, market_rule string, trade_type string, type string, sl_level string, sl_ratio double, sl_bin int, tp_level string, tp_ratio double, tp_bin int, avg_density double"


def strategies(spark) -> DataFrame:
    return ev.with_ids(spark.createDataFrame([s[:11] for s in STRATEGIES], STRATEGY_SCHEMA))


def _lit(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


ST = "SELECT key || '_' || market_rule AS strategy_id, * FROM (VALUES " + ", ".join(
    f"({_lit(s[0])}, {_lit(s[1])}, {_lit(s[2] or 'buy')}, {_lit(s[3])}, {_lit(s[4])}, {_lit(s[5])}::DOUBLE, {_lit(s[6])}::INT, {_lit(s[7])}, {_lit(s[8])}::DOUBLE, {_lit(s[9])}::INT, {_lit(s[10])}::DOUBLE)" for s in STRATEGIES
) + ") v(key, market_rule, trade_type, type, sl_level, sl_ratio, sl_bin, tp_level, tp_ratio, tp_bin, avg_density)"
SG = " UNION ALL ".join(f"SELECT '{s[0]}' AS k, f.* FROM feat f WHERE {s[11]}" for s in STRATEGIES)
RULES = {s[1]: s[11] for s in STRATEGIES}


@query(sql(" UNION ALL ".join(f"SELECT '{r}' AS market_rule, instrument, timeframe, time, idx FROM feat WHERE {x}" for r, x in RULES.items()), "feat"))
def rule_matches(spark, sf_dir):
    return matches_by_index(strategies(spark), features(spark, sf_dir), RULE_FEATURES)


CUTS = {"hour": [float(x) for x in range(23)], "weekday": [float(x) for x in range(6)]}


def tree_rows(spark, sf_dir):
    """Wins of each bar and direction, the direction as key, with calendar features."""
    won = br.barrier_outcomes(indexed(spark, sf_dir), SL, TP, LOOK)
    t = won.groupBy(F.concat_ws("-", "instrument", "trade_type").alias("key"), *b.KEYS, "entry_time").agg(F.count(F.lit(1)).alias("trade_count"))
    return rules.training(t, ind.calendar(bars(spark, sf_dir)).select(*b.KEYS, "time", "hour", "weekday"))


CELLS = "SELECT key, 'hour' AS feature, hour AS bin, y FROM tr UNION ALL SELECT key, 'weekday', weekday, y FROM tr"
TREE = {
    "tr": "SELECT instrument || '-' || trade_type AS key, entry_time, hour(entry_time)::INT AS hour, (isodow(entry_time) - 1)::INT AS weekday, count(*) AS y FROM won GROUP BY ALL",
    "cell": f"SELECT key, feature, bin, count(*) AS n, sum(y) AS s FROM ({CELLS}) GROUP BY ALL",
    "cum": "SELECT *, sum(n) OVER w AS n1, sum(s) OVER w AS s1, sum(n) OVER (PARTITION BY key, feature) AS n0, sum(s) OVER (PARTITION BY key, feature) AS s0 FROM cell WINDOW w AS (PARTITION BY key, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)",
    "gains": "SELECT key, feature, bin, s1 * s1 / n1 + (s0 - s1) * (s0 - s1) / (n0 - n1) - s0 * s0 / n0 AS gain FROM cum WHERE n1 >= 50 AND n0 - n1 >= 50",
}


@query(sql("SELECT key, feature, bin, round(gain, 6) + 0.0 AS gain FROM gains WHERE gain > 1e-9 QUALIFY row_number() OVER (PARTITION BY key ORDER BY round(gain, 9) DESC, feature, bin) = 1", "won", **TREE))
def rule_stump(spark, sf_dir):
    _, splits = rules.grow(tree_rows(spark, sf_dir), CUTS, depth=1)
    return rounded(splits.select("key", "feature", "bin", "gain"))


@query()
def rule_tree(spark, sf_dir):
    """Rules of depth 7 trees over quantile splits, for all keys."""
    won = br.barrier_outcomes(indexed(spark, sf_dir), SL, TP, LOOK)
    t = won.groupBy(F.concat_ws("-", "instrument", "trade_type").alias("key"), *b.KEYS, "entry_time").agg(F.count(F.lit(1)).alias("trade_count"))
    rows = rules.training(t, features(spark, sf_dir).select(*b.KEYS, "time", *RULE_FEATURES))
    return rules.mined(rows, RULE_FEATURES, lift=1.0)


# --- trades ----------------------------------------------------------------------------------------------------------------
def signals_of(spark, sf_dir):
    """Written, as orders and the mix of regimes read them several times."""
    return written(ev.signals(strategies(spark), features(spark, sf_dir), RULE_FEATURES), "signals")


def trades_of(spark, sf_dir):
    return written(ev.trades(ev.orders(signals_of(spark, sf_dir), b.cost_table(spark)), indexed(spark, sf_dir)), "trades")


def equity_of(spark, sf_dir):
    return written(ev.equity(trades_of(spark, sf_dir)), "equity")


def _price(side: str, way: str) -> str:
    level = "CASE {0} WHEN 'BB_upper_20' THEN g.\"BB_upper_20\" WHEN 'BB_lower_20' THEN g.\"BB_lower_20\" WHEN 'SMA_20' THEN g.\"SMA_20\" END".format(f"t.{side}_level")
    place = f"t.{side}_bin"
    return f"CASE WHEN t.{side}_level IS NOT NULL THEN CASE WHEN t.type LIKE '%Pct' THEN g.close + ({level} - g.close) * ({place} + 0.5) / 10 ELSE {level} + g.close * ({place} + 2.5) / 10000 END ELSE g.close * (1 + {way} * t.{side}_ratio) END"


TRADES = {
    "st": ST, "sg": SG,
    "od": f"""SELECT t.strategy_id, t.market_rule, t.trade_type, g.instrument, g.timeframe, g.time, g.idx, g.n_bars, g.close, g.session, g.trend_regime_14, g.vol_regime_14, sg.sign,
 g.close + sg.sign * 0.5 * 0.0001 AS entry_price, {_price('sl', '-sg.sign')} AS sl_price, {_price('tp', 'sg.sign')} AS tp_price
 FROM sg g JOIN st t ON t.key = g.k CROSS JOIN LATERAL (SELECT CASE WHEN t.trade_type = 'buy' THEN 1 ELSE -1 END AS sign) sg""",
    "ok": "SELECT * FROM od WHERE sign * (entry_price - sl_price) > 0 AND sign * (tp_price - entry_price) > 0 AND idx + 1 < n_bars",
    "ex": """SELECT o.strategy_id, o.instrument, o.idx, min(CASE WHEN (o.sign = 1 AND f.high >= o.tp_price) OR (o.sign = -1 AND f.low <= o.tp_price) THEN f.idx END) AS tp_idx,
 min(CASE WHEN (o.sign = 1 AND f.low <= o.sl_price) OR (o.sign = -1 AND f.high >= o.sl_price) THEN f.idx END) AS sl_idx
 FROM ok o JOIN ix f ON f.instrument = o.instrument AND f.idx > o.idx AND f.idx <= o.idx + 5000 GROUP BY ALL""",
    "td": """SELECT o.*, x.tp_idx, x.sl_idx, x.tp_idx IS NOT NULL AND (x.sl_idx IS NULL OR x.tp_idx < x.sl_idx) AS won FROM ok o JOIN ex x USING (strategy_id, instrument, idx)
 WHERE x.tp_idx IS NOT NULL OR x.sl_idx IS NOT NULL""",
    "tr": """SELECT d.*, CASE WHEN won THEN tp_idx ELSE sl_idx END AS exit_idx, b.time AS exit_time,
 (sign * (CASE WHEN won THEN tp_price ELSE sl_price END - entry_price) - (2.5 * 0.0001 + 7.0 / 100000)) / abs(entry_price - sl_price) AS r
 FROM td d JOIN ix b ON b.instrument = d.instrument AND b.idx = CASE WHEN won THEN tp_idx ELSE sl_idx END""",
    "e1": "SELECT *, 1 + 0.02 * r AS x, coalesce(max((1 + 0.02 * r <= 0)::INT) OVER (PARTITION BY strategy_id, instrument ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ruined FROM tr",
    "e2": """SELECT *, 10000 * exp(coalesce(sum(CASE WHEN x > 0 THEN ln(x) END) OVER (PARTITION BY strategy_id, instrument ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS prior,
 row_number() OVER (PARTITION BY strategy_id, instrument ORDER BY idx) AS seq FROM e1 WHERE ruined = 0""",
    "eq": "SELECT *, prior * x AS capital, prior * x - prior AS pnl FROM e2",
}
PERF = {
    "pk": "SELECT *, max(capital) OVER (PARTITION BY strategy_id, instrument ORDER BY seq ROWS UNBOUNDED PRECEDING) AS peak, pnl / 10000 - 0.04 / 252 AS excess FROM eq",
    "pf": """SELECT strategy_id, instrument, timeframe, CASE WHEN abs(sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0 END)) > 0 THEN sum(CASE WHEN pnl > 0 THEN pnl ELSE 0 END) / abs(sum(CASE WHEN pnl <= 0 THEN pnl ELSE 0 END)) ELSE 'inf'::DOUBLE END AS profit_factor,
 CASE WHEN coalesce(stddev_samp(excess), 0) = 0 THEN 0 ELSE avg(excess) / stddev_samp(excess) * sqrt(252.0) END AS sharpe_ratio,
 CASE WHEN max(peak) > 0 THEN max(peak - capital) / max(peak) * 100 ELSE 0 END AS max_drawdown_pct, avg((pnl > 0)::INT) * 100 AS win_rate_pct,
 arg_max(capital, seq) AS final_capital, count(*) AS total_trades FROM pk GROUP BY ALL""",
}
METRICS = ("profit_factor", "sharpe_ratio", "max_drawdown_pct", "win_rate_pct", "final_capital")


@query(sql("SELECT strategy_id, instrument, timeframe, time, idx, session, round(close, 6) + 0.0 AS close FROM od", "feat", **{k: TRADES[k] for k in ("st", "sg", "od")}))
def signals(spark, sf_dir):
    return rounded(signals_of(spark, sf_dir).select("strategy_id", *b.KEYS, "time", "idx", "session", "close"))


EXIT = {k: TRADES[k] for k in ("st", "sg", "od", "ok", "ex", "td", "tr")}


@query(sql(f"SELECT strategy_id, instrument, idx, exit_idx, won, {r6('entry_price', 'sl_price', 'tp_price', 'r')} FROM tr", "feat", **EXIT))
def trade_exits(spark, sf_dir):
    return rounded(trades_of(spark, sf_dir).select("strategy_id", "instrument", "idx", "exit_idx", "won", "entry_price", "sl_price", "tp_price", "r"))


@query(sql("SELECT strategy_id, instrument, idx, seq, round(capital, 3) + 0.0 AS capital, round(pnl, 3) + 0.0 AS pnl FROM eq", "feat", **TRADES))
def equity_curve(spark, sf_dir):
    return rounded(equity_of(spark, sf_dir).select("strategy_id", "instrument", "idx", F.col("seq").cast("long").alias("seq"), "capital", "pnl"), 3)


@query(sql("SELECT strategy_id, instrument, timeframe, time AS entry_time, exit_time, round(pnl, 3) + 0.0 AS pnl, round(entry_price, 3) + 0.0 AS entry_price FROM eq", "feat", **TRADES))
def trade_log(spark, sf_dir):
    return rounded(ev.trade_log(equity_of(spark, sf_dir)), 3)


def report_of(spark, sf_dir):
    return written(ev.performance(equity_of(spark, sf_dir)), "report")


PERF_COLS = ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in METRICS)


@query(sql(f"SELECT strategy_id, instrument, timeframe, {PERF_COLS}, total_trades FROM pf", "feat", **TRADES, **PERF))
def performance(spark, sf_dir):
    return rounded(report_of(spark, sf_dir), 4)


MORE = {
    "ru": "SELECT *, seq - row_number() OVER (PARTITION BY strategy_id, instrument, won ORDER BY seq) AS run, max(capital) OVER (PARTITION BY strategy_id, instrument ORDER BY seq ROWS UNBOUNDED PRECEDING) AS peak FROM eq",
    "rl": "SELECT *, count(*) OVER (PARTITION BY strategy_id, instrument, won, run) AS length FROM ru",
}


@query(sql("""SELECT strategy_id, instrument, timeframe, round(avg(exit_idx - idx), 4) + 0.0 AS avg_bars, coalesce(max(CASE WHEN won THEN length END), 0) AS max_wins, coalesce(max(CASE WHEN NOT won THEN length END), 0) AS max_losses,
 round(avg(r) / nullif(stddev_samp(r), 0) * sqrt(count(*)), 4) + 0.0 AS sqn, round((arg_max(capital, seq) / 10000 - 1) * 100 / nullif(max(peak - capital) / max(peak) * 100, 0), 4) + 0.0 AS calmar FROM rl GROUP BY ALL""", "feat", **TRADES, **MORE))
def trade_metrics(spark, sf_dir):
    return rounded(ev.more_metrics(equity_of(spark, sf_dir)), 4)


MIX = "SELECT strategy_id, instrument, timeframe, session AS regime, count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY strategy_id, instrument) AS pct FROM od GROUP BY strategy_id, instrument, timeframe, session"
SIGNALS = {k: TRADES[k] for k in ("st", "sg", "od")}


@query(sql("SELECT strategy_id, instrument, timeframe, regime, round(pct, 6) + 0.0 AS pct FROM mx", "feat", **SIGNALS, mx=MIX))
def regime_mix(spark, sf_dir):
    return rounded(ev.regime_mix(signals_of(spark, sf_dir), "session"))


GOOD = "SELECT * FROM pf WHERE profit_factor >= 1.0 AND max_drawdown_pct <= 80 AND total_trades >= 20"


@query(sql(f"SELECT strategy_id, instrument, timeframe, {PERF_COLS}, total_trades FROM gd", "feat", **TRADES, **PERF, gd=GOOD))
def mastery_pass(spark, sf_dir):
    return rounded(ev.passed(report_of(spark, sf_dir), 1.0, 80.0, 20), 4)


@query(sql("SELECT DISTINCT split_part(strategy_id, '_', 1) AS key FROM pf WHERE instrument = 'view' AND strategy_id NOT IN (SELECT strategy_id FROM gd WHERE instrument = 'view')", "feat", **TRADES, **PERF, gd=GOOD))
def blacklist(spark, sf_dir):
    report = report_of(spark, sf_dir).filter("instrument = 'view'")
    bad = ev.failed(report, ev.passed(report, 1.0, 80.0, 20)).select(F.split("strategy_id", "_")[0].alias("key"))
    return append_distinct(spark.createDataFrame([], "key string"), bad, ["key"])


SUMMARY = """SELECT strategy_id, count(*) AS markets_tested, avg(profit_factor) AS avg_profit_factor, avg(sharpe_ratio) AS avg_sharpe_ratio, avg(max_drawdown_pct) AS avg_max_drawdown_pct,
 sum(total_trades)::BIGINT AS total_trades, count(*) FILTER (profit_factor > 1) AS validation_markets_passed_count, count(*) FILTER (profit_factor > 1) || '/' || count(*) AS validation_markets_passed FROM pf GROUP BY 1"""
SUMMARY_COLS = "strategy_id, markets_tested, round(avg_profit_factor, 4) + 0.0 AS avg_profit_factor, round(avg_sharpe_ratio, 4) + 0.0 AS avg_sharpe_ratio, round(avg_max_drawdown_pct, 4) + 0.0 AS avg_max_drawdown_pct, total_trades, validation_markets_passed_count, validation_markets_passed"


@query(sql(f"SELECT {SUMMARY_COLS} FROM sy", "feat", **TRADES, **PERF, sy=SUMMARY))
def validation_summary(spark, sf_dir):
    return rounded(reports.ranked(reports.summary(report_of(spark, sf_dir))), 4)


VIEW = """SELECT s.* REPLACE (least(s.avg_profit_factor, 100) AS avg_profit_factor, least(s.avg_sharpe_ratio, 10) AS avg_sharpe_ratio), least(m.profit_factor, 100) AS mastery_profit_factor,
 least(m.sharpe_ratio, 10) AS mastery_sharpe_ratio, m.max_drawdown_pct AS mastery_max_drawdown_pct, m.win_rate_pct AS mastery_win_rate_pct, m.final_capital AS mastery_final_capital, m.total_trades AS mastery_total_trades
 FROM sy s LEFT JOIN (SELECT * FROM pf WHERE instrument = 'view') m USING (strategy_id)"""
VIEW_COLS = SUMMARY_COLS + ", " + ", ".join(f"round(mastery_{c}, 4) + 0.0 AS mastery_{c}" for c in METRICS) + ", mastery_total_trades"


def view_of(spark, sf_dir):
    report = report_of(spark, sf_dir)
    return reports.master_view(reports.summary(report), report.filter("instrument = 'view'"))


@query(sql(f"SELECT {VIEW_COLS} FROM vw", "feat", **TRADES, **PERF, sy=SUMMARY, vw=VIEW))
def master_view(spark, sf_dir):
    return rounded(view_of(spark, sf_dir), 4)


@query(sql(f"SELECT {VIEW_COLS} FROM vw WHERE avg_profit_factor >= 0.8 AND validation_markets_passed_count >= 1 AND total_trades >= 100 AND avg_sharpe_ratio >= -5", "feat", **TRADES, **PERF, sy=SUMMARY, vw=VIEW))
def survivors(spark, sf_dir):
    return rounded(reports.survivors(view_of(spark, sf_dir), 0.8, -5.0, 1, 100), 4)


BY_MARKET = "strategy_id, instrument, timeframe, round(least(profit_factor, 100), 4) + 0.0 AS profit_factor, round(least(sharpe_ratio, 10), 4) + 0.0 AS sharpe_ratio, total_trades"


@query(sql(f"SELECT {BY_MARKET}, 'mastery' AS phase FROM pf WHERE instrument = 'view' UNION ALL SELECT {BY_MARKET}, 'validation' AS phase FROM pf", "feat", **TRADES, **PERF))
def results_by_market(spark, sf_dir):
    report = report_of(spark, sf_dir)
    rows = reports.by_market(report.filter("instrument = 'view'"), report)
    return rounded(rows.select("strategy_id", *b.KEYS, "profit_factor", "sharpe_ratio", "total_trades", "phase"), 4)


@query(sql("SELECT DISTINCT instrument AS origin, strategy_id FROM pf WHERE strategy_id IN (SELECT strategy_id FROM gd)", "feat", **TRADES, **PERF, gd=GOOD))
def passes_of_all_origins(spark, sf_dir):
    report = report_of(spark, sf_dir).withColumn("origin", F.col("instrument"))
    return reports.all_passes(report, ev.passed(report, 1.0, 80.0, 20)).select("origin", "strategy_id")


INTERNALS = """SELECT instrument, timeframe, avg((trend_regime_14 = 'trend')::INT) * 100 AS time_in_trend_pct, avg((vol_regime_14 = 'high_vol')::INT) * 100 AS time_high_vol_pct, avg("BB_width_20") AS avg_bb_width,
 (arg_max(close, time) - arg_min(close, time)) / nullif(arg_min(close, time), 0) * 100 AS price_change_pct FROM feat GROUP BY ALL"""
INTERNAL_COLS = "m.instrument, m.timeframe, round(time_in_trend_pct, 4) + 0.0 AS time_in_trend_pct, round(time_high_vol_pct, 4) + 0.0 AS time_high_vol_pct, round(avg_bb_width, 4) + 0.0 AS avg_bb_width, round(price_change_pct, 4) + 0.0 AS price_change_pct"


@query(sql(f"SELECT {INTERNAL_COLS} FROM im m", "feat", im=INTERNALS))
def market_internals(spark, sf_dir):
    return rounded(reports.internals(features(spark, sf_dir)), 4)


@query(sql(f"SELECT {INTERNAL_COLS}, round(coalesce(p.pf, 0), 4) + 0.0 AS profit_factor FROM im m LEFT JOIN (SELECT instrument, avg(least(profit_factor, 100)) AS pf FROM pf GROUP BY 1) p ON p.instrument = m.instrument", "feat", **TRADES, **PERF, im=INTERNALS))
def internals_performance(spark, sf_dir):
    return rounded(reports.internals_with_results(reports.internals(features(spark, sf_dir)), report_of(spark, sf_dir)), 4)


@query(sql("SELECT p.strategy_id, p.instrument, p.timeframe, m.regime, round(m.pct, 4) + 0.0 AS pct, round(least(p.profit_factor, 5), 4) + 0.0 AS profit_factor FROM pf p JOIN mx m USING (strategy_id, instrument)", "feat", **TRADES, **PERF, mx=MIX))
def regime_rows(spark, sf_dir):
    maps = ev.regime_maps(signals_of(spark, sf_dir), ("session",))
    report = report_of(spark, sf_dir).join(maps, ["strategy_id", *b.KEYS])
    return rounded(reports.regime_rows(report, "session_pct"), 4)


@query(sql("SELECT e.strategy_id, e.instrument, e.timeframe, e.time, round(i.close, 4) + 0.0 AS close, round(e.pnl, 3) + 0.0 AS pnl, e.pnl > 0 AS won FROM eq e JOIN ix i ON i.instrument = e.instrument AND i.time = e.time", "feat", **TRADES))
def trade_entries(spark, sf_dir):
    found = reports.entries_on_prices(ev.trade_log(equity_of(spark, sf_dir)), bars(spark, sf_dir))
    return found.select("strategy_id", *b.KEYS, "time", (F.round("close", 4) + 0.0).alias("close"), (F.round("pnl", 3) + 0.0).alias("pnl"), "won")


# --- state and sets --------------------------------------------------------------------------------------------------------
@query(sql("""SELECT instrument, time, round(coalesce(n.close, o.close), 6) + 0.0 AS close, coalesce(n.run, o.run) AS run FROM (SELECT instrument, time, close, 'old' AS run FROM ix WHERE hour(time) < 16) o
 FULL JOIN (SELECT instrument, time, close * 2 AS close, 'new' AS run FROM ix WHERE hour(time) >= 8) n USING (instrument, time)""", "ix"))
def upsert_latest(spark, sf_dir):
    own = bars(spark, sf_dir).select("instrument", "time", "close")
    old = own.filter(F.hour("time") < 16).withColumn("run", F.lit("old"))
    new = own.filter(F.hour("time") >= 8).withColumns({"close": F.col("close") * 2, "run": F.lit("new")})
    return rounded(upsert_last(old, new, ["instrument", "time"]))


@query(sql("""SELECT instrument, time, coalesce(o.run, n.run) AS run FROM (SELECT instrument, time, 'old' AS run FROM ix WHERE hour(time) < 16) o
 FULL JOIN (SELECT instrument, time, 'new' AS run FROM ix WHERE hour(time) >= 8) n USING (instrument, time)""", "ix"))
def append_first(spark, sf_dir):
    own = bars(spark, sf_dir).select("instrument", "time")
    return append_distinct(own.filter(F.hour("time") < 16).withColumn("run", F.lit("old")), own.filter(F.hour("time") >= 8).withColumn("run", F.lit("new")), ["instrument", "time"])


@query(sql("SELECT instrument, timeframe, hour, time, round(close, 6) + 0.0 AS close FROM feat QUALIFY row_number() OVER (PARTITION BY instrument, hour ORDER BY close DESC, time) <= 3", "feat"))
def top_n_per_group(spark, sf_dir):
    f = ind.calendar(bars(spark, sf_dir)).select(F.concat_ws("|", "instrument", F.col("hour").cast("string")).alias("market_rule"), "instrument", "timeframe", "hour", "time", "close", F.col("close").alias("avg_density"), F.col("time").alias("key"))
    return rounded(ev.top_per_rule(f, 3).select("instrument", "timeframe", "hour", "time", "close"))
