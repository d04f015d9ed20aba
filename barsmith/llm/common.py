"""What several text operators share: table access, shared work folders, word rule."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.sources.state import scratch, work_dir, written

__all__ = ["WORD", "by_bytes", "doc_texts", "map_texts", "scratch", "table", "texts_of", "work_dir", "written"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_bytes(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes, of one row at least."""
    start, size, mean = 0, 0, max(1, batch.nbytes // max(1, batch.num_rows))
    texts = [i for i, t in enumerate(batch.schema.types) if pa.types.is_string(t) or pa.types.is_binary(t)]
    lengths = [sum(x) for x in zip(*(pc.fill_null(pc.binary_length(batch.column(i)), 0).to_pylist() for i in texts), strict=True)] if texts else [mean] * batch.num_rows
    for end, n in enumerate(lengths, 1):
        size += n
        if size >= most or end == batch.num_rows:
            yield batch.slice(start, end - start)
            start, size = end, 0


def map_texts(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    setup: Callable[[], None] | None = None,
) -> DataFrame:
    """mapInArrow of a batch function; setup runs once in each task. Batches are cut so that memory goes by bytes, not rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if setup:
            setup()
        for batch in batches:
            for part in by_bytes(batch):
                yield function(part)

    return df.mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def doc_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone: extra columns, whatever their names, go no further."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
