"""Quality rules: base counts of words and lines, and divergence from language references.

Method. Every document gets two histograms: code points by character class, and words by common word of four
languages (all others in one bin). The reference of a language is the sum of the histograms of all its documents that
pass the base rules; a document fails when its Jensen-Shannon distance (base 2, 0 to 1) to the reference of its language
is over the limit, provided that it is long enough for the histogram to mean something.

A thin reference, of fewer than `min_reference` words, is no evidence against a document, and rows without a language may be
of any: such a document is compared with its own reference and with that of each language which has enough words, and each of its
two distances is the least of these, so it fails only if it is far from all.

References are fitted on the documents themselves, over all of them, or given: `fit_references` makes the table that `quality`
takes, so that shards, or later documents, can be judged alike whatever their neighbours are.

A common word counts in any case, with a mark before or after it ("The", "the," and "Él").

Cases. Null text: no words, so base_failed. Null language: rows of any languages, with a reference of their own that is taken
as thin; where theirs has no reference with enough words either, they may still be rejected. Without any reference a document is kept. Repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import map_texts, written

# Common words by language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for was on with as be by at are this from or an have not but",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au plus ne se pas avec il ce",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
}
WORDS = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
CLASSES = ("lower", "upper", "other letter", "digit", "blank", "line end", "stop", "pause", "symbol", "rest")
OPENS, CLOSES = b"(\"'", b".,;:!?)\"'"
SPACES, SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
WINDOW = 5


def _class_table() -> np.ndarray:
    """Class number by code point."""
    table = np.full(0x110000, CLASSES.index("rest"), np.uint8)
    for cp in range(0x3000):
        c = chr(cp)
        table[cp] = CLASSES.index(
            "lower" if c.islower() else "upper" if c.isupper() else "other letter" if c.isalpha() else "digit" if c.isdigit()
            else "line end" if c == "\n" else "blank" if c.isspace() else "stop" if c in ".!?…" else "pause" if c in ",;:'\"()-–’«»¿¡"
            else "symbol" if c in "#*$%&|<>{}[]=+~^_\\/@`" else "rest"
        )
    for start, end in ((0x3040, 0x3100), (0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x30000)):
        table[start:end] = CLASSES.index("other letter")
    return table


def repeated_words(ids: np.ndarray) -> int:
    """Words in windows of five that occur twice or more; ids are numbers of words."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    key = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        key = (key ^ ids[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    found = np.zeros(n, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    edge = np.zeros(n + WINDOW, np.int32)
    at = np.flatnonzero(found)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int, dict[bytes, int]]:
    """Words, their code points, symbols, repeated lines, words in repeated runs, and how often each word occurs."""
    data = text.encode()
    words = data.split()
    blanks = len(data) - len(data.translate(None, SPACES))
    lines = [x for x in data.split(b"\n") if x.strip(SPACES)]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    return (
        len(words), len(text) - blanks, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(ids), dict(zip(number, np.bincount(ids, minlength=len(number)).tolist(), strict=True)),
    )


def bare(word: bytes) -> bytes:
    """A word in lower case without a mark before and one after it."""
    word = word[1:] if word[:1] in OPENS and word[:1] else word
    word = word[:-1] if word[-1:] in CLOSES and word[-1:] else word
    return word.lower() if word.isascii() else word.decode(errors="replace").strip("«»“”„¿¡…").lower().encode()


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, and the two histograms as arrays, with their sums."""
    place = {w.encode(): i for i, w in enumerate(WORDS)}
    tables: list[np.ndarray] = []

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, chars, common = [], [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            *five, words = base_counts(text)
            counts.append(five)
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            chars.append(np.bincount(tables[0][points], minlength=len(CLASSES)))
            hist = [0] * (len(WORDS) + 1)
            for w, n in words.items():
                if len(w) < 12 and (i := place.get(bare(w))) is not None:
                    hist[i] += n
            hist[-1] = five[0] - sum(hist)
            common.append(hist)
        cols = np.array(counts, np.int64).reshape(-1, 5).T
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), batch.column("lang"), batch.column("text_key"), *(pa.array(c) for c in cols), pa.array(chars, pa.list_(pa.int64())), pa.array(common, pa.list_(pa.int64())),
                pa.array([int(c.sum()) for c in chars], pa.int64()), pa.array([sum(h) for h in common], pa.int64()),
            ],
            ["doc_id", "lang", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_hist", "word_hist", "char_hist_sum", "word_hist_sum"],
        )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    narrow = narrow.withColumn("text_key", F.xxhash64("text"))
    found = map_texts(narrow, of_batch, f"doc_id long, lang string, text_key long, {BASE}, char_hist array<long>, word_hist array<long>, char_hist_sum long, word_hist_sum long", lambda: tables.append(_class_table()))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return found.withColumn("base_failed", failed)


def _sums(name: str, size: int) -> Column:
    return F.array(*(F.sum(F.col(name)[i]).cast("double") for i in range(size))).alias(name)


def references(measured: DataFrame, min_reference: int) -> DataFrame:
    """A row for each language: ref_lang, thick (whether it may judge alone), ref (both histograms as shares of their sums)."""
    sums = [_sums("char_hist", len(CLASSES)), _sums("word_hist", len(WORDS) + 1), F.sum("n_words").alias("words")]
    own = with_sums(measured.filter(~F.col("base_failed")).groupBy("lang").agg(*sums), "char_hist", "word_hist")
    thick = (F.col("words") >= min_reference) & F.col("lang").isNotNull()
    return own.select(F.col("lang").alias("ref_lang"), thick.alias("thick"), F.struct(shares("char_hist").alias("chars"), shares("word_hist").alias("words")).alias("ref"))


def fit_references(docs: DataFrame, min_reference: int = 5000) -> DataFrame:
    """The references of docs, to be written or passed to `quality`."""
    return references(measures(docs), min_reference)


def shares(name: str) -> Column:
    """A histogram as shares of its sum, which stands in <name>_sum: as a column it is added up once, not for each bin."""
    return F.transform(F.col(name), lambda v: F.try_divide(v.cast("double"), F.col(f"{name}_sum").cast("double")))


def with_sums(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({f"{n}_sum": F.aggregate(n, F.lit(0.0), lambda s, v: s + v) for n in names})


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms given as shares, base 2."""

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    terms = F.zip_with(p, q, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2))


def quality(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, base counts, base_failed, char_distance, word_distance, kept. One row for each row of docs. limits: see `judged`."""
    return judged(docs, **limits).drop("lang", "text_key")


def judged(
    docs: DataFrame, char_limit: float = 0.22, word_limit: float = 0.2, word_slack: float = 1.25, min_chars: int = 200, min_words: int = 50, min_reference: int = 5000, given: DataFrame | None = None,
) -> DataFrame:
    """The result of `quality` with what a verdict is about: lang and text_key, the hash of the text. given: references.

    Few words spread a histogram by chance, so the limit of word_distance is word_limit + word_slack / sqrt(n_words).
    """
    measured = written(measures(docs), "quality")
    # References have a row for each language. Spark broadcasts them when its size check allows, else joins by shuffle.
    refs = written(references(measured, min_reference) if given is None else given, "references")
    every = refs.filter("thick").agg(F.collect_list("ref").alias("others"))
    joined = measured.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    joined = joined.join(F.broadcast(every), ~F.coalesce("thick", F.lit(False)), "left")
    tried = F.concat(F.filter(F.array("ref"), lambda r: r.isNotNull()), F.coalesce("others", F.filter(F.array("ref"), lambda r: F.lit(False))))
    both = F.transform(tried, lambda r: F.struct(distance(shares("char_hist"), r["chars"]).alias("c"), distance(shares("word_hist"), r["words"]).alias("w")))
    joined = joined.withColumn("both", both).withColumns({"char_distance": F.array_min("both.c"), "word_distance": F.array_min("both.w")})
    odd = ((F.col("char_hist_sum") >= min_chars) & (F.col("char_distance") > char_limit)) | ((F.col("n_words") >= F.lit(min_words)) & (F.col("word_distance") > F.lit(word_limit) + F.lit(word_slack) / F.sqrt("n_words")))
    kept = ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))
    out = joined.select("doc_id", "lang", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", kept.alias("kept"))
    return written(out, "verdicts")  # a filter on them would else go into the join, and the distances with it


def accepted(docs: DataFrame, spread: int = 64, **limits) -> DataFrame:
    """The rows of docs that are kept, each by the verdict on its own doc_id, language and text.

    Rejected texts are few columns wide and leave by an anti join; those without doc_id, which may be very many of one text, are
    dealt to `spread` tasks by the partition that they come from.
    """
    told = judged(docs, **limits).filter("NOT kept").select("doc_id", "lang", "text_key").distinct()
    salt = F.when(F.col("doc_id").isNull(), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    told = told.select(F.col("doc_id").alias("_doc_id"), F.col("lang").alias("_lang"), F.col("text_key").alias("_text_key"), F.explode(salt).alias("_salt"))
    # Columns of docs go in one, so that helper columns cannot clash with theirs.
    row = F.col("_row")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))
    mine = F.when(row["doc_id"].isNull(), F.pmod(F.spark_partition_id(), F.lit(spread))).otherwise(0)
    rows = rows.select("_row", row["doc_id"].cast("long").alias("_d"), row["lang"].cast("string").alias("_l"), F.xxhash64(row["text"].cast("string")).alias("_t"), mine.alias("_s"))
    same = rows["_d"].eqNullSafe(told["_doc_id"]) & rows["_l"].eqNullSafe(told["_lang"]) & (rows["_t"] == told["_text_key"]) & (rows["_s"] == told["_salt"])
    return rows.join(told, same, "left_anti").select("_row.*")
