"""State tables: written intermediates, upserts, and skipping what is done."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_local: dict[str, str] = {}
#: What the innermost `scratch` of this thread has had written; None outside of any.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset, a temporary one in local mode, else an error."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _local:
        _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="barsmith-")
    return _local[context.applicationId]


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one written table."""
    path = f"{checkpoint_root(spark)}/barsmith/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, is read instead of computed anew."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Deletes at its end, an error or not, what was written within it, but for the tables written by the function that it gives.

    Each thread, and each scratch within another, has a list of its own; tables that are kept belong to the outer one.
    """
    own: list[str] = []
    kept: list[str] = []
    token = _made.set(own)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        kept.append(own.pop())
        return out

    try:
        yield keep
    finally:
        _made.reset(token)
        for path in own:
            _deleted(spark, path)
        if (outer := _made.get()) is not None:
            outer += kept


# --- tables that change as one ---------------------------------------------------------------------------------------------
POINTER = "CURRENT"


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Writes tables to a new folder under root and then, by replacing one small file, makes them the current ones.

    A run that is killed before that leaves the old tables current, and its folder unused; readers see all new tables or none.
    One writer at a time. Tables may read what is current, as nothing is overwritten.
    """
    version = f"v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{version}/{name}")
    _switch(spark, root, version)
    return version


def _switch(spark: SparkSession, root: str, version: str) -> None:
    fs = spark._jvm.org.apache.hadoop.fs
    draft, pointer = fs.Path(f"{root}/next-{version}"), fs.Path(f"{root}/{POINTER}")
    conf = spark._jsc.hadoopConfiguration()
    out = draft.getFileSystem(conf).create(draft, True)
    out.write(bytearray(version.encode()))
    out.close()
    how = spark._sc._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    how[0] = getattr(fs, "Options$Rename").OVERWRITE
    fs.FileContext.getFileContext(pointer.toUri(), conf).rename(draft, pointer, how)


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the current tables; None before the first switch."""
    if not table_there(spark, f"{root}/{POINTER}"):
        return None
    return f"{root}/{spark.read.text(f'{root}/{POINTER}').first()[0]}"


def current_table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """A current table; an empty one of the schema where there is none yet."""
    at = current(spark, root)
    return spark.createDataFrame([], schema) if at is None else table_or_empty(spark, f"{at}/{name}", schema)


def table_there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at path, or an empty one of the schema where there is none."""
    return spark.read.schema(schema).parquet(path) if table_there(spark, path) else spark.createDataFrame([], schema)


def not_done(work: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return work.join(done.select(*on).distinct(), on, "left_anti")


def known(work: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return work.join(keys.select(*on).distinct(), on, "left_semi")


def upsert_last(old: DataFrame, new: DataFrame, on: list[str], tie: list[Column] | None = None) -> DataFrame:
    """Rows of both, of each key the one from new; missing columns are NULL. Ties within a side go by `tie`, descending."""
    both = old.withColumn("_run", F.lit(0)).unionByName(new.withColumn("_run", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy(F.desc("_run"), *(tie or []))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_run")


def append_distinct(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """Rows of both, of each key the one that was there first."""
    both = old.withColumn("_run", F.lit(0)).unionByName(new.withColumn("_run", F.lit(1)), allowMissingColumns=True)
    rest = [F.to_json(c) if t.startswith("map") else F.col(c) for c, t in both.dtypes if c not in (*on, "_run")]
    if not rest:
        return both.select(*on).distinct()
    w = Window.partitionBy(*on).orderBy("_run", *rest)
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_run")
