"""Exact duplicates: copies combined within partitions, then by salted digest, then over all salts, whole texts compared each time.

Method, with DataFrame operations only. A row's digest is the SHA-256 of its text and its salt one of `SALTS` values by doc_id.

1. Locally: the map side of the first aggregation leaves each partition one row for each (digest, salt, text).
2. Salted groups: its reduce side leaves one winner, the largest doc_id with the number of rows it stands for, for each
   (digest, salt, text). A group of copies is dealt to as many tasks as there are salts.
3. Globally: the winners of all salts, `SALTS` a text at most, meet by digest and are combined by (digest, text).

The text itself is part of each key, so texts that share a digest stay apart. What goes back to the rows is narrow: the class of
a digest with one text is joined by (digest, salt), so a hot group meets its class in as many tasks. Digests of several texts
(none are known for SHA-256; `bits` makes them in tests) are joined by the text.

Result. One row for each row of docs: doc_id, keep_id, group_size (rows of equal text), kept, text_sha256.

Cases. Null text: empty, so equal to the empty text. Null doc_id: below any number; where all of a group are null, keep_id is null
and one of them is kept. Of repeated rows of one doc_id and text one is kept at most. Very long texts: each is one key of an
aggregation that spills. Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import doc_texts, written

#: One bit of a long each.
SALTS = 64


def digests(docs: DataFrame, bits: int = 256) -> DataFrame:
    """doc_id, text (null: empty), sha (binary), digest (its first bits), salt."""
    rows = doc_texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumns({"sha": F.unhex(F.sha2("text", 256)), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})
    return rows.withColumn("digest", F.substring("sha", 1, bits // 8))


def combined(rows: DataFrame) -> DataFrame:
    """digest, text, keep_id, group_size, salts (a bit for each salt of its rows) of each different text."""
    mark = F.expr("shiftleft(1L, salt)")
    salted = rows.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("best"), F.count(F.lit(1)).alias("held"))
    whole = salted.repartition("digest").groupBy("digest", "text")
    return whole.agg(F.max("best").alias("keep_id"), F.sum("held").alias("group_size"), F.bit_or(mark).alias("salts"))


def classed(rows: DataFrame, on: list[str], classes: DataFrame) -> DataFrame:
    """The result's rows from narrow rows (doc_id, sha, and the key `on`), equal ones counted on the way so that one of them is kept."""
    counted = rows.groupBy(*on, "doc_id", "sha").agg(F.count(F.lit(1)).alias("copies"))
    found = counted.join(classes, on).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_duplicates(docs: DataFrame, bits: int = 256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs; bits: length of the digest, a multiple of 8."""
    rows = digests(docs, bits)
    texts = combined(rows)
    # By digest already, so this costs no shuffle.
    classes = texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), *(F.first(c).alias(c) for c in ("keep_id", "group_size", "salts")))
    classes = written(classes, "classes")
    single = classes.filter("texts = 1").withColumn("salt", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("salts", s) == 1)))
    out = classed(rows.select("doc_id", "sha", "digest", "salt"), ["digest", "salt"], single.select("digest", "salt", "keep_id", "group_size"))
    shared = classes.filter("texts > 1").select("digest")
    if shared.isEmpty():
        return out
    several = rows.join(shared, "digest", "left_semi").select("doc_id", "sha", "digest", "text")
    return out.unionByName(classed(several, ["digest", "text"], texts.join(shared, "digest", "left_semi").select("digest", "text", "keep_id", "group_size")))
