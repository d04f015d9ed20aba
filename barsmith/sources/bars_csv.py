"""Bars from header-less CSV files, and the sinks and report tables around them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.sources.state import upsert_last

REPORT_OPTIONS = {"header": True, "positiveInf": "inf", "negativeInf": "-inf", "nanValue": "nan"}


def read_bars(spark: SparkSession, path: str, sep: str = ",", mode: str = "drop") -> DataFrame:
    """instrument, timeframe, time, open, high, low, close, volume of files <INSTRUMENT><MINUTES>.csv.

    Five or six columns; files with fewer raise. A missing volume is 1. Rows with a value that does not parse are dropped, or
    raise with mode='fail'.
    """
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    pattern = r"(?i)^([A-Z0-9_]*?[A-Z_])(\d+)\.csv$"
    parts = F.split("value", re.escape(sep))
    short = F.raise_error(F.concat(F.lit("fewer than five columns in "), F.col("name"))).cast("array<string>")
    raw = spark.read.text(path).select("value", name.alias("name")).filter(F.trim("value") != "")
    raw = raw.select("name", F.when(F.size(parts) < 5, short).otherwise(F.transform(parts, lambda x: F.trim(F.replace(x, F.lit('"'))))).alias("parts"))
    fields = {c: F.get("parts", F.lit(i)) for i, c in enumerate(("time", "open", "high", "low", "close", "volume"))}
    raw = raw.select("name", *(x.alias(c) for c, x in fields.items()))

    def parsed(c: str, kind: str):
        return F.col(c).cast(kind) if mode == "fail" else F.expr(f"try_cast({c} as {kind})")

    bars = raw.select(
        F.upper(F.regexp_replace(F.regexp_extract("name", pattern, 1), "_", "")).alias("instrument"), F.regexp_extract("name", pattern, 2).cast("int").alias("timeframe"),
        parsed("time", "timestamp").alias("time"), *(parsed(c, "double").alias(c) for c in ("open", "high", "low", "close")),
        (F.when(F.coalesce("volume", F.lit("")) == "", 1.0).otherwise(F.col("volume").cast("double")) if mode == "fail" else F.coalesce(F.expr("try_cast(volume as double)"), F.lit(1.0))).alias("volume"),
    )
    return bars if mode == "fail" else bars.dropna(subset=["time", "open", "high", "low", "close"])


def write_partitioned(frame: DataFrame, path: str) -> None:
    """By market, so that reading one timeframe reads only its folders."""
    frame.write.mode("overwrite").partitionBy("instrument", "timeframe").parquet(path)


def write_clustered(frame: DataFrame, path: str, files: int | None = None, block_bytes: int = 128 << 20) -> None:
    """Bars in files of consecutive ranges of (market, time), sorted within, so that statistics of files and row groups rule most out.

    Ranges go by rows, so a market with most bars has most files. files: how many, else as Spark's shuffle has it. Times are
    written as integers, since Spark's older form of timestamps has no statistics.
    """
    form, spark = "spark.sql.parquet.outputTimestampType", frame.sparkSession
    before = spark.conf.get(form)
    order = ["instrument", "timeframe", "time"]
    ranged = frame.repartitionByRange(files, *order) if files else frame.repartitionByRange(*order)
    spark.conf.set(form, "TIMESTAMP_MICROS")
    try:
        ranged.sortWithinPartitions(*order).write.mode("overwrite").option("parquet.block.size", block_bytes).parquet(path)
    finally:
        spark.conf.set(form, before)


def read_span(spark: SparkSession, path: str, instrument: str, timeframe: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a market from `start` on and before `end`, by filters that Parquet readers test against statistics."""
    found = spark.read.parquet(path).filter((F.col("instrument") == instrument) & (F.col("timeframe") == timeframe))
    found = found.filter(F.col("time") >= F.lit(start).cast("timestamp")) if start else found
    return found.filter(F.col("time") < F.lit(end).cast("timestamp")) if end else found


def write_features(frame: DataFrame, path: str) -> None:
    """Features as CSV with headings, a folder for each market; doubles as floats, missing values empty."""
    downcast(frame).write.mode("overwrite").partitionBy("instrument", "timeframe").options(header=True, timestampFormat="yyyy-MM-dd HH:mm:ss").csv(path)


def downcast(frame: DataFrame) -> DataFrame:
    """Doubles as floats and longs as integers, for a sink; a long that does not fit raises."""
    narrow = {"double": "float", "bigint": "int"}
    return frame.withColumns({c: F.col(c).cast(narrow[t]) for c, t in frame.dtypes if t in narrow})


def same_timeframe(bars: DataFrame, minutes: int) -> DataFrame:
    return bars.filter(F.col("timeframe") == minutes)


def write_report(report: DataFrame, path: str) -> None:
    """CSV; maps as JSON text."""
    maps = {c: F.to_json(c) for c, t in report.dtypes if t.startswith("map")}
    report.withColumns(maps).write.mode("overwrite").options(header=True).csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV report; 'inf' is infinity, as profit factors without losses are."""
    return spark.read.schema(schema).options(**REPORT_OPTIONS).csv(path)


def updated_report(old: DataFrame, new: DataFrame, path: str, on: list[str]) -> None:
    """Old and new rows of a report, of each key the new one, as a report in a folder of its own: path is not what old reads."""
    write_report(upsert_last(old, new, on), path)


def headings(spark: SparkSession, path: str) -> list[str]:
    return spark.read.parquet(path).columns


def preview(frame: DataFrame, rows: int = 5) -> DataFrame:
    return frame.limit(rows)


def write_trade_log(trades: DataFrame, path: str) -> None:
    trades.write.mode("overwrite").partitionBy("instrument").parquet(path)


def read_trade_log(spark: SparkSession, path: str, strategy_id: str, instrument: str) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("instrument") == instrument) & (F.col("strategy_id") == strategy_id))


def origins(report: DataFrame) -> DataFrame:
    """The origins that have reports."""
    return report.select("origin").distinct().orderBy("origin")
