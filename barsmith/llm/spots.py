"""Document fingerprints by spot signatures, in DataFrame expressions only.

Method. A spot signature is a chain: one or more anchors and the two content words that follow them, anchors in between left
out. Anchors are common words, the start of the text and the ends of clauses and lines, so every text with a word has a chain,
in any language and however short; the last word or mark of a text counts as content. The fingerprint of a text is the set of the 64-bit hashes of its chains. Likeness is the
Jaccard index of two sets. `similar` finds all pairs of fingerprints that are
alike enough: fingerprints are dealt by signature and class of set length, only sets whose lengths allow the threshold
meet, only on signatures of their prefix in order of rarity, and the index is exact.

`edited` sets each document beside its edited text and the next document, descending doc_id. Rows are dealt in ranges of
doc_id of about `per_range` rows; the first row of a range also goes, as a halo, to the range before it. Should ids lie so
unevenly that ranges get too long, ranges are cut by rank instead.

Cases. Null text: empty; a text without words has an empty fingerprint, two of those have likeness 1, one and another 0. Null doc_id comes
last. Rows of equal doc_id go by the hash of their texts. A single row is its own next document. Empty table: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm.common import doc_texts, written

SUPER = 1 << 14  # ranges of a superrange

# Anchors, common words of four languages.
ANCHORS = """
the a an of to in and is that for it was on with as be by at are this from
der die das den dem des ein eine und zu von mit sich auf für im ist nicht
le la les un une du de et est que qui dans pour au par sur avec pas
el los las una del y en se por con para su al lo es
""".split()
STOPS = r"[.!?;:\n。！？；]"


def one_of(words: list[str]) -> str:
    """A pattern for any of the words, by shared beginnings."""
    tails: dict[str, list[str]] = {}
    for w in sorted(set(words) - {""}):
        tails.setdefault(w[0], []).append(w[1:])
    return "|".join(c + (f"(?:{one_of(t)}){'?' if '' in t else ''}" if t != [""] else "") for c, t in tails.items())


CHUNK = rf"(?:(?:{one_of(ANCHORS)}|{STOPS})\x20++)*+[^\x20]++"


def signatures(text: Column) -> Column:
    """Sorted distinct hashes of the chains of a text (array<long>)."""
    # Words and stops, blanks between them.
    plain = F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}]*?({STOPS})[^\p{{L}}\p{{N}}]*|[^\p{{L}}\p{{N}}]+", " $1 ")
    chunks = F.regexp_extract_all(F.concat(F.lit(". "), F.trim(plain)), F.lit(CHUNK), F.lit(0))  # anchors and one content word

    def chains(m: Column) -> Column:
        # As long as there are chunks: a length near the greatest integer overflows and gives nothing.
        following = F.slice(F.transform(m, lambda c: F.substring_index(c, " ", -1)), F.lit(2), F.size(m))
        return F.array_compact(F.zip_with(m, following, lambda c, n: F.when(F.contains(c, F.lit(" ")), F.xxhash64(c, F.coalesce(n, F.lit(""))))))

    # As a bound variable the chunks are made once, not for each place that they stand in.
    return F.array_sort(F.array_distinct(F.transform(F.array(chunks), chains)[0]))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard index of two sets; 0 without a look at the members where their sizes rule `least` out."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    exact = common / (F.size(a) + F.size(b) - common)
    return F.when(large == 0, 1.0).when((small == 0) | (small < least * large), 0.0).otherwise(exact)


def fingerprint(found: Column) -> Column:
    return F.array_join(found.cast("array<string>"), ",")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, spots (array<long>), fingerprint for each row of docs."""
    d = doc_texts(docs).select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("spots"))
    return d.withColumn("fingerprint", fingerprint(F.col("spots")))


def _ranges(docs: DataFrame, per_range: int) -> tuple[DataFrame, DataFrame, int]:
    """docs with a column range in descending order of doc_id; (range, rows, top doc_id) of each; how many."""
    rows, low, high = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    wanted = max(1, -(-rows // per_range))
    width = max(1, -(-((high or 0) - (low or 0) + 1) // wanted))
    place = F.coalesce(F.floor((F.lit(high).cast("decimal(38,0)") - F.col("doc_id")) / F.lit(width)).cast("long"), F.lit(wanted + 1).cast("long"))
    ranged = docs.withColumn("range", place)
    tops = written(ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("top")), "ranges")
    if (tops.agg(F.max("rows")).first()[0] or 0) > 16 * per_range:
        ids = docs.filter("doc_id IS NOT NULL").select("doc_id").distinct()
        part = written(ids.repartitionByRange(F.desc("doc_id")).withColumn("part", F.spark_partition_id()), "parts")
        cut = F.floor(F.row_number().over(Window.partitionBy("part").orderBy(F.desc("doc_id"))) / per_range)
        cuts = written(part.withColumn("range", F.col("part").cast("long") * 2**32 + cut), "cuts").select(F.col("doc_id").alias("_id"), "range")
        ranged = docs.join(cuts, docs["doc_id"] == cuts["_id"], "left").withColumn("range", F.coalesce("range", F.lit(2**62))).drop("_id")
        tops = written(ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("top")), "ranges")
    return ranged, tops, wanted


def edited(docs: DataFrame, per_range: int = 128, most_broadcast: int = 500_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    plain = doc_texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    ranged, tops, n = _ranges(plain, per_range)
    # The halo: the top of a range follows the last row of the range before; that of the first range, the very last row.
    # Ranges are numbered in superranges, so that no task holds all of them.
    parts = tops.withColumn("super", F.floor(F.col("range") / SUPER))
    lasts = parts.groupBy("super").agg(F.max("range").alias("last"))
    order = Window.orderBy("super")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = lasts.select(F.col("super").alias("_super"), F.coalesce(F.lag("last").over(order), F.last("last").over(whole)).alias("before"))
    within = Window.partitionBy("super").orderBy("range")
    halo = parts.join(lasts, F.col("super") == F.col("_super")).select("top", F.coalesce(F.lag("range").over(within), F.col("before")).alias("range"))
    small = F.broadcast(halo) if n <= most_broadcast else halo
    extra = plain.join(small, F.col("doc_id").eqNullSafe(F.col("top"))).select("doc_id", "text", "range", F.lit(True).alias("halo"))
    rows = ranged.select("doc_id", "text", "range", F.lit(False).alias("halo")).union(extra).withColumn("tie", F.xxhash64("text"))
    line = Window.partitionBy("range").orderBy("halo", F.desc_nulls_last("doc_id"), "tie")
    rows = rows.withColumn("next", F.lead("text").over(line)).withColumn("n_chars", F.length("text").cast("long"))
    k = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - k), F.substring(F.coalesce("next", F.lit("")), F.lit(1), k)))
    rows = rows.withColumns({"spots": signatures(F.col("text")), "edited_spots": signatures(F.when(F.col("halo"), "").otherwise(F.col("edited")))})
    rows = rows.select("doc_id", "range", "halo", "tie", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "spots", "edited_spots")
    rows = rows.withColumn("next_spots", F.lead("spots").over(line)).filter(~F.col("halo"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("spots")).alias("fingerprint"), fingerprint(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


def similar(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of classes of equal fingerprints with likeness >= least; a < b, each the smallest doc_id of its class.

    prints: doc_id, spots. Equal fingerprints are one class, so copies give no pairs. Signatures are ordered by rarity over
    all classes; two sets that are alike share one of the first size - ceil(least * size) + 1, so only those are dealt,
    by signature and class of length, and each set looks at its own and the next longer class.
    """
    classes = prints.filter(F.size("spots") > 0).groupBy("spots").agg(F.min("doc_id").alias("id")).select("id", "spots", F.size("spots").alias("size"))
    classes = written(classes, "classes")
    each = classes.select("id", "size", F.explode("spots").alias("spot"))
    counts = each.groupBy("spot").agg(F.count(F.lit(1)).alias("held"))
    ranked = each.join(counts, "spot").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("held", "spot")))
    prefix = ranked.filter((F.col("place") <= F.col("size") - F.ceil(F.lit(least) * F.col("size")) + 1) & (F.col("held") > 1))
    step = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1 / least)))
    prefix = prefix.select("spot", "id", "size", step.alias("length"))
    left = prefix.withColumn("length", F.explode(F.array("length", F.col("length") + 1)))
    a, b = left.alias("a"), prefix.alias("b")
    ordered = (F.col("a.size") < F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.id") < F.col("b.id")))
    met = a.join(b, (F.col("a.spot") == F.col("b.spot")) & (F.col("a.length") == F.col("b.length")) & ordered & (F.col("a.size") >= least * F.col("b.size")))
    pairs = met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()
    own = classes.select("id", "spots")
    full = pairs.join(own.toDF("a", "a_spots"), "a").join(own.toDF("b", "b_spots"), "b")
    return full.select("a", "b", likeness(F.col("a_spots"), F.col("b_spots"), least).alias("likeness")).filter(F.col("likeness") >= least)
