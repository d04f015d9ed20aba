"""Connected components of an edge table by alternating stars, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import written


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, root) for each id that is not the smallest of its component. edges: columns a, b (long).

    Each round hangs the larger neighbours of every vertex on the smallest one it knows (large star), then its smaller ones
    (small star). Both are a partial minimum and a join, so no vertex's neighbours are gathered, and a vertex with very many
    can be split by the join. Rounds end when the edges stay the same; their number grows with the logarithm of the ids.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, name)
    before = None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        low = low.select("x", F.least("m", "x").alias("m"))
        large = both.join(low, both["u"] == low["x"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, name)
        least = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        small = large.join(least, large["u"] == least["x"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(small.union(least.select("x", "m")).distinct(), name)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now
