"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame expressions only.

Method. Sources, by code point and null last, weigh 3, 1, 2, repeating, and share `total_share` of all words; a target
stops at twice the size of its source and what it leaves is shared again by weight. Targets are turned into seats of
equal-token blocks: a seat goes to the source with the highest quotient target / (2k - 1). The seats of a source go to
its shards (documents by keyed hash) in the same way, by shard size, which gives an integer quota per shard. In a shard
the documents lie on a line of words in keyed order, cut into blocks; the mix takes whole passes over the line and then a
circular run of blocks from a keyed start. So no word is taken more than twice.

Scale. One pass over the texts counts words; all else works on (doc_id, source, size). A source has as many shards as its
size asks for, so no task holds a source or its line. Shards are apportioned in two steps, to groups of at most `GROUP` shards
and within them, so no task holds the shards of a source either. Apportionment works on one row for each source, group or
shard and a few candidate seats each; only the sources, as many as there are names, meet in one task.

Cases. Null text: size 0, taken 0. Null source: a source of its own, last. Equal or null doc_id: each row counts, and rows are
dealt by doc_id and text; which of them gets the words is settled by size, and rows equal in both are alike. Empty table:
empty result. No words: targets 0. Extra columns, whatever their names, are not read (`mix`) or passed through (`mixed`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm.common import WORD, written

WEIGHTS = (3.0, 1.0, 2.0)
GROUP = 1024


def apportion(items: DataFrame, group: list[str], item: list[str], votes: str, seats: str) -> DataFrame:
    """Sainte-Laguë: items with a column quota that sums to `seats` in each group (0 where no item has votes).

    With v votes in all, n items and s seats, the seats before votes * (s - n/2) / v rounded are always won and those
    beyond votes * (s + n/2) / v never, so only the few between are ranked by quotient. Ties go to the first item.
    """
    w = Window.partitionBy(*group)
    sized = items.withColumns({"_n": F.count(F.lit(1)).over(w), "_v": F.sum(votes).over(w)})
    share = F.coalesce(F.try_divide(F.col(votes).cast("double"), F.col("_v").cast("double")), F.lit(0.0))
    sized = sized.withColumns(
        {
            "_low": F.greatest(F.lit(0), F.floor(share * (F.col(seats) - F.col("_n") / 2) + 0.5) - 1).cast("long"),
            "_high": F.when(F.col(votes) > 0, F.floor(share * (F.col(seats) + F.col("_n") / 2) + 0.5) + 1).otherwise(0).cast("long"),
        }
    ).withColumn("_left", F.col(seats) - F.sum("_low").over(w))
    tried = sized.withColumn("_k", F.explode(F.sequence(F.col("_low") + 1, F.greatest(F.col("_low") + 1, F.col("_high")))))
    quotient = F.when(F.col("_k") <= F.col("_high"), F.col(votes) / (2 * F.col("_k") - 1)).otherwise(-1.0)
    order = Window.partitionBy(*group).orderBy(F.desc("_q"), *(F.asc_nulls_last(c) for c in item), "_k")
    ranked = tried.withColumn("_q", quotient).withColumn("_won", ((F.row_number().over(order) <= F.col("_left")) & (F.col("_q") > 0)).cast("long"))
    keep = [c for c in items.columns if c not in (*group, *item)]
    return ranked.groupBy(*group, *item).agg(*(F.first(c).alias(c) for c in keep), (F.first("_low") + F.sum("_won")).alias("quota"))


def targets(sizes: DataFrame, total_share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target. One row for each source, so windows over all of them are small."""
    sources = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name, every = Window.orderBy(F.asc_nulls_last("source")), Window.partitionBy()
    place = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    # Filling level: sources in the order in which they reach their cap. The level of the rest rises with each source
    # that is capped below it and falls with each that is not, so its greatest value is the one at which all fit.
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rest = filling.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(total_share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("weight").over(rest))
    target = F.least(F.col("cap"), F.col("weight") * F.max("level").over(every))
    return s.select("source", "source_size", target.alias("target"))


def _overlap(start: Column, end: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(0), F.least(end, high) - F.greatest(start, low))


def mix(docs: DataFrame, seed: int = 17, total_share: float = 1.5, shard_words: int = 250_000) -> DataFrame:
    """One row for each row of docs: doc_id, text_key, source, size, source_size, target, taken.

    passes: how often the whole document is taken; words_1 words from word from_1 on, and words_2 from from_2, come on top.
    """
    sizes = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    every = Window.partitionBy()
    source = targets(sizes, total_share)
    # Blocks so small that rounding to a seat is about a 4000th of a mean target and a 400th of the smallest, 1 to 1024 words.
    # The work does not grow with the number of seats, as only those in doubt are ranked.
    mean, least = F.sum("target").over(every) / F.count(F.lit(1)).over(every), F.min(F.when(F.col("target") > 0, F.col("target"))).over(every)
    block = F.coalesce(F.least(F.lit(1024), F.greatest(F.lit(1), F.floor(F.least(mean / 2000, least / 200)))), F.lit(1)).cast("long")
    source = source.withColumn("block", block).withColumn("seats", F.round(F.sum("target").over(every) / F.col("block")).cast("long"))
    source = source.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    source = apportion(source.withColumn("_all", F.lit(0)), ["_all"], ["source"], "target", "seats").drop("_all", "seats").withColumnRenamed("quota", "seats")
    source = written(source, "sources")  # small: a row for each source

    s = source.select(F.col("source").alias("_source"), "source_size", "target", "block", "seats", "shards")
    dealt = sizes.join(s, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    dealt = dealt.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "text_key")).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_key"), F.col("shards")))
    per_shard = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("seats").alias("seats"), F.first("block").alias("block"))
    per_shard = written(per_shard.withColumn("group", F.floor(F.col("shard") / GROUP)), "shards")
    groups = per_shard.groupBy("source", "group").agg(F.sum("shard_size").alias("group_size"), F.first("seats").alias("seats"))
    groups = apportion(groups, ["source"], ["group"], "group_size", "seats").select(F.col("source").alias("_source"), F.col("group").alias("_group"), F.col("quota").alias("group_seats"))
    per_shard = per_shard.join(groups, F.col("source").eqNullSafe(F.col("_source")) & (F.col("group") == F.col("_group"))).drop("_source", "_group")
    quotas = apportion(per_shard, ["source", "group"], ["shard"], "shard_size", "group_seats").select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "quota")
    quotas = written(quotas, "quotas")
    dealt = dealt.join(quotas, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")), "left").drop("_source", "_shard")

    line = Window.partitionBy("source", "shard").orderBy("_key", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = dealt.withColumn("_end", F.sum("size").over(line)).withColumn("_start", F.col("_end") - F.col("size"))
    words = F.least(F.col("quota") * F.col("block"), 2 * F.col("shard_size"))
    passes = F.coalesce(F.expr("shard_size").cast("long"), F.lit(0))
    dealt = dealt.withColumn("_words", words).withColumn("_passes", F.when(passes > 0, F.floor(F.col("_words") / passes)).otherwise(0).cast("long"))
    dealt = dealt.withColumn("_blocks", F.ceil(F.col("shard_size") / F.col("block")).cast("long"))
    dealt = dealt.withColumn("_run", F.least(F.col("_blocks"), F.round((F.col("_words") - F.col("_passes") * F.col("shard_size")) / F.col("block"))).cast("long"))
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.greatest(F.lit(1), F.col("_blocks")))
    dealt = dealt.withColumn("_low", first * F.col("block")).withColumn("_high", (first + F.col("_run")) * F.col("block"))
    turn = F.col("_blocks") * F.col("block")  # the run goes on at the line's start
    one = _overlap(F.col("_start"), F.col("_end"), F.col("_low"), F.col("_high"))
    two = _overlap(F.col("_start"), F.col("_end"), F.lit(0), F.col("_high") - turn)
    partial = F.col("_passes") < 2
    dealt = dealt.withColumns(
        {
            "passes": F.col("_passes"), "from_1": F.greatest(F.lit(0), F.col("_low") - F.col("_start")), "words_1": F.when(partial, one).otherwise(0).cast("long"),
            "from_2": F.lit(0).cast("long"), "words_2": F.when(partial, two).otherwise(0).cast("long"),
        }
    )
    taken = F.coalesce(F.col("passes") * F.col("size") + F.col("words_1") + F.col("words_2"), F.lit(0)).cast("long")
    return dealt.select("doc_id", "text_key", "source", "size", "source_size", "target", taken.alias("taken"), "passes", "from_1", "words_1", "from_2", "words_2")


def mixed(docs: DataFrame, seed: int = 17) -> DataFrame:
    """docs as the mix takes them: a row for each whole pass over a document and one for each part of it that a block cuts.

    A part is the text from the start of its first word to the end of its last, white space inside and all; blocks that hold a
    whole document give the document as it is. n_chars, where there, is counted anew. Of rows that share doc_id, source and text
    each gets one of their shares of the mix.
    """
    plan = mix(docs, seed)
    # The run may end before the word that it starts with: both parts together are the document then.
    full = (F.col("size") > 0) & ((F.col("words_1") == F.col("size")) | (F.col("words_2") == F.col("size")) | ((F.col("words_2") == F.col("from_1")) & (F.col("words_1") + F.col("words_2") == F.col("size"))))
    whole = F.array_repeat(F.struct(F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("words")), (F.col("passes") + full.cast("long")).cast("int"))
    parts = F.filter(F.array(*(F.struct(F.col(f"from_{i}").cast("long").alias("start"), F.col(f"words_{i}").alias("words")) for i in (1, 2))), lambda x: (x["words"] > 0) & ~full)
    takes = F.when(F.col("taken") > 0, F.concat(whole, parts)).otherwise(F.slice(whole, 1, 0))

    def key(doc_id: Column, text_key: Column, source: Column) -> Column:
        """Of equal rows alone; one string, so that the join and the numbering of equal rows share one shuffle."""
        return F.concat_ws(":", F.coalesce(doc_id.cast("long").cast("string"), F.lit("-")), text_key.cast("string"), F.xxhash64(source.cast("string")).cast("string"))

    # A row for each different document: the shares of its rows, the largest first.
    shares = plan.select(key(F.col("doc_id"), F.col("text_key"), F.col("source")).alias("key"), F.struct("taken", takes.alias("takes")).alias("share"))
    shares = shares.groupBy("key").agg(F.sort_array(F.collect_list("share"), asc=False).alias("shares"), F.sum("share.taken").alias("taken")).filter("taken > 0").select("key", "shares")

    # All columns of docs go in one, so that helper columns cannot clash with theirs.
    row = F.col("row")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.withColumn("own", key(row["doc_id"], F.xxhash64(row["text"].cast("string")), row["source"]))
    rows = rows.join(shares, F.col("own") == F.col("key"))
    nth = F.row_number().over(Window.partitionBy("own").orderBy("own"))
    one = F.when(F.size("shares") == 1, 1).otherwise(nth)
    rows = rows.withColumn("nth", one).withColumn("take", F.explode(F.element_at("shares", F.col("nth"))["takes"]))
    # Words with the white space before them. White space at the end, which no word follows, would be tried from each of its places.
    spaced = F.regexp_extract_all(F.rtrim(row["text"], F.lit(" \t\n\x0b\x0c\r")), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(spaced, F.col("take.start").cast("int") + 1, F.col("take.words").cast("int")), "")
    cut = F.regexp_replace(cut, r"^[\x20\x09-\x0D]+", "")
    rows = rows.withColumn("text", F.when(F.col("take.start") < 0, row["text"]).otherwise(cut))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*(new.get(c, row[c]).alias(c) for c in docs.columns))
