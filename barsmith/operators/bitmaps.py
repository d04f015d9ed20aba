"""Bitmaps of bars: an index of feature bins in which rules are ANDs, and bars of blueprints that later runs add to.

A bitmap has a bit for each of `BITS` bars of one market, by bar number, so a set of bars costs 4 kB for 32,768 bars, whatever its size.

Rules. Every feature is cut into bins at edges taken from the rules' own bounds (at most `MOST_EDGES` a feature). For each
(market, bucket of bars, feature) the bitmaps of bins are built once and joined up to bitmaps of "at most edge k" and "over edge k", so
a condition takes one bitmap a bound. Conditions meet bitmaps by (feature, side, edge), never by feature alone, and a rule is the AND of
its bitmaps. Where a feature has more different bounds than edges, some bounds lie inside a bin: the rule then has an outer
bitmap, with those bins, and an inner one, without them, and only bars between the two are looked up and tested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.operators.bars import KEYS
from barsmith.operators.rules import conditions, within
from barsmith.sources.state import known, written

BITS = 32_768  # as many as Spark's bitmap functions have
MOST_EDGES, SALTS = 64, 16
INF = float("inf")


def bucket(idx: Column) -> Column:
    return F.floor(idx / BITS).cast("long")


def bit(idx: Column) -> Column:
    return F.pmod(idx, F.lit(BITS)).cast("long")


# --- rules over bins -----------------------------------------------------------------------------------------------------
def edges_of(cond: DataFrame, most: int = MOST_EDGES) -> dict[str, list[float]]:
    """At most `most` of the bounds of each feature, all of them where there are no more: a few numbers, on the driver."""
    points = [(i + 0.5) / most for i in range(most)]
    bounds = cond.select("feature", F.explode(F.array("lo", "hi")).alias("x")).filter(F.abs("x") < INF).distinct()
    sums = bounds.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", points, 10_000).alias("x"))
    few = bounds.join(sums.filter(F.col("n") <= most).select("feature"), "feature").groupBy("feature").agg(F.collect_list("x").alias("x"))
    found = sums.filter(F.col("n") > most).select("feature", "x").unionByName(few).collect()
    return {r.feature: sorted(set(r.x)) for r in found}


def bin_of(value: Column, edges: list[float], base: int = 0) -> Column:
    """How many edges lie below the value, by halving: bin k holds edges[k - 1] < value <= edges[k]."""
    if not edges:
        return F.lit(base)
    mid = len(edges) // 2
    return F.when(value <= edges[mid], bin_of(value, edges[:mid], base)).otherwise(bin_of(value, edges[mid + 1 :], base + mid + 1))


def bin_bitmaps(frame: DataFrame, edges: dict[str, list[float]], features: list[str]) -> DataFrame:
    """(KEYS, bucket, feature, bin, bits) of numbered bars; NULL and NaN are in no bin."""
    items = []
    for f in features:
        v = F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double"))
        items.append(F.struct(F.lit(f).alias("feature"), F.when(v.isNotNull(), bin_of(v, edges.get(f, []))).cast("int").alias("bin")))
    long = frame.select(*KEYS, bucket(F.col("idx")).alias("bucket"), bit(F.col("idx")).alias("_bit"), F.inline(F.array(*items))).filter("bin IS NOT NULL")
    return long.groupBy(*KEYS, "bucket", "feature", "bin").agg(F.bitmap_construct_agg("_bit").alias("bits"))


def bound_bitmaps(bins: DataFrame, edges: dict[str, list[float]], used: DataFrame) -> DataFrame:
    """(KEYS, bucket, feature, side, at, bits): bars up to bin `at` (side le) or from bin `at` on (side ge), for the pairs in use.

    used: (feature, side, at), two for each edge of a feature at most, so a bounded table.
    """
    last = F.create_map(*(F.lit(x) for f, e in edges.items() for x in (f, len(e)))) if edges else F.create_map().cast("map<string,int>")
    top = F.coalesce(F.try_element_at(last, F.col("feature")), F.lit(0))
    le = F.transform(F.sequence(F.col("bin"), top), lambda k: F.struct(F.lit("le").alias("side"), k.alias("at")))
    ge = F.transform(F.sequence(F.lit(0), F.col("bin")), lambda k: F.struct(F.lit("ge").alias("side"), k.alias("at")))
    here = bins.repartition(*KEYS, "bucket", "feature")  # bins of a feature meet, and stay for the aggregation
    each = here.select(*KEYS, "bucket", "feature", "bits", F.inline(F.concat(le, ge)))
    kept = each.join(F.broadcast(used), ["feature", "side", "at"], "left_semi")
    return kept.groupBy(*KEYS, "bucket", "feature", "side", "at").agg(F.bitmap_or_agg("bits").alias("bits"))


def halves(cond: DataFrame, edges: dict[str, list[float]], rule: str) -> DataFrame:
    """(rule, feature, side, at, exact, inside): the bins that meet each bound; at counts a bin that the bound cuts, inside does not."""
    each = F.array(*(F.array(*map(F.lit, e)).cast("array<double>") for e in edges.values()), F.array().cast("array<double>"))
    number = {f: i for i, f in enumerate(edges)}
    which = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in number.items() for x in kv)), F.col("feature")), F.lit(len(number))) if number else F.lit(0)
    own = F.get(each, which)

    def half(side: str, bound: Column) -> Column:
        at = F.size(F.filter(own, lambda e: e < bound))
        on_edge = F.coalesce(F.get(own, at) == bound, F.lit(False)) if side == "ge" else F.coalesce(F.get(own, at) == bound, bound == INF)
        # Over an edge: from the next bin on. Up to an edge: its own bin.
        outer = at + on_edge.cast("int") if side == "ge" else at
        inner = F.when(on_edge, outer).otherwise(outer + (1 if side == "ge" else -1))
        return F.struct(F.lit(side).alias("side"), outer.alias("at"), on_edge.alias("exact"), inner.alias("inside"))

    no_low, no_high = F.col("lo") == -INF, F.col("hi") == INF
    both = F.array(F.when(~no_low, half("ge", F.col("lo"))), F.when(~no_high | no_low, half("le", F.col("hi"))))
    return cond.select(rule, "feature", F.inline(F.array_compact(both)))


def _numbers(batches: Iterator[pa.RecordBatch], about: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each bit of `outer`, with the columns `about` of its bitmap; sure: the bit is in `inner` too."""
    for batch in batches:
        outer, inner, first = batch.column("outer"), batch.column("inner"), batch.column("bucket").to_numpy()
        for i in range(batch.num_rows):  # a bitmap at a time: at most BITS rows
            on = np.flatnonzero(np.unpackbits(np.frombuffer(outer[i].as_py(), np.uint8), bitorder="little"))
            sure = np.ones(len(on), bool)
            if not batch.column("exact")[i].as_py():
                kept = inner[i].as_py()
                sure = np.unpackbits(np.frombuffer(kept, np.uint8), bitorder="little")[on].astype(bool) if kept else ~sure
            same = pa.array(np.full(len(on), i, np.int64))
            columns = [batch.column(c).take(same) for c in about]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(on + first[i] * BITS), pa.array(sure)], [*about, "idx", "sure"])


def matches_by_index(rules: DataFrame, frame: DataFrame, features: list[str], rule: str = "market_rule", most: int = MOST_EDGES, timed: bool = True, of: DataFrame | None = None) -> DataFrame:
    """(market_rule, KEYS, time, idx) of the bars that meet a rule, as `rules.matches`; idx must number the bars of a market.

    timed: with the column time, which costs a join by bar. of: a table of rules, whose rows are given with the bars of their rule (on
    the markets of their timeframe where it has that column). They meet bitmaps, not bars.
    """
    cond = written(conditions(rules, features, rule), "conditions")
    edges = edges_of(cond, most)
    half = written(halves(cond, edges, rule), "halves")
    exact = half.groupBy(rule).agg(F.min("exact").alias("exact"), F.count(F.lit(1)).alias("n_half"))
    used = half.select("feature", "side", F.col("at")).union(half.filter("NOT exact").select("feature", "side", "inside")).distinct()
    bounds = bound_bitmaps(bin_bitmaps(frame, edges, features), edges, used)

    # A bound that many rules share is dealt by bucket, so its rules are repeated, narrow as they are, for each salt.
    bounds = bounds.withColumn("salt", F.pmod(F.xxhash64(*KEYS, "bucket"), F.lit(SALTS)).cast("int"))
    salted = half.join(exact.select(F.col(rule).alias("_rule"), F.col("exact").alias("_exact")), F.col(rule) == F.col("_rule")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    outer = salted.select(rule, "feature", "side", "at", "salt", F.lit(True).alias("out"))
    inner = salted.filter("NOT _exact").select(rule, "feature", "side", F.col("inside").alias("at"), "salt", F.lit(False).alias("out"))
    met = outer.unionByName(inner).join(bounds, ["feature", "side", "at", "salt"]).groupBy(rule, *KEYS, "bucket", "out").agg(F.bitmap_and_agg("bits").alias("bits"), F.count(F.lit(1)).alias("n"))
    met = met.join(exact.withColumnRenamed(rule, "_rule"), F.col(rule) == F.col("_rule")).filter((F.col("n") == F.col("n_half")) & (F.bitmap_count("bits") > 0))
    pair = met.groupBy(rule, *KEYS, "bucket", "exact").agg(F.first(F.when(F.col("out"), F.col("bits")), True).alias("outer"), F.first(F.when(~F.col("out"), F.col("bits")), True).alias("inner"))
    about = [rule, *KEYS]
    if of is not None:
        pair = pair.join(of, [rule, *(k for k in KEYS if k in of.columns)])
        about += [c for c in of.columns if c not in about]
    types = ", ".join(f"`{c}` {t}" for c, t in pair.select(*about).dtypes)
    # A few kB become thousands of rows, so bitmaps are dealt by number: by their size they would all fit in one task.
    dealt = pair.select(*about, "bucket", "exact", "outer", "inner").repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = dealt.mapInArrow(lambda it: _numbers(it, about), f"{types}, idx long, sure boolean")
    # The bars found are taken to be as small as their bitmaps; without the hint they would be broadcast.
    bars = frame.select(*KEYS, "idx", "time").hint("merge") if timed else None

    def finished(out: DataFrame) -> DataFrame:
        out = out.select(*about, "idx")
        return out.join(bars, [*KEYS, "idx"]).select(*about, "time", "idx") if timed else out

    if exact.filter("NOT exact").isEmpty():
        return finished(found)

    # Bars in cut bins: their conditions one by one.
    found = written(found, "found")
    values = F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*(F.col(f).cast("double") for f in features)))
    doubt = found.filter("NOT sure").select(rule, *KEYS, "idx").distinct().join(frame.select(*KEYS, "idx", values.alias("_values")), [*KEYS, "idx"])
    tested = doubt.join(cond.select(F.col(rule).alias("_rule"), "feature", "lo", "hi"), F.col(rule) == F.col("_rule"))
    v = F.element_at("_values", F.col("feature"))
    tested = tested.groupBy(rule, *KEYS, "idx").agg(F.min(F.coalesce(within(v), F.lit(False))).alias("_all")).filter("_all")
    return finished(found.filter("sure").unionByName(known(found.filter("NOT sure"), tested, [rule, *KEYS, "idx"])))


# --- bars of blueprints ------------------------------------------------------------------------------------------------------
BLUEPRINT = [*KEYS, "type", "level", "bin", "ratio"]


def blueprint_bitmaps(rows: DataFrame) -> DataFrame:
    """(BLUEPRINT, bucket, bits) of rows with entry_idx: the bars of each blueprint as sets."""
    at = F.col("entry_idx")
    return rows.groupBy(*BLUEPRINT, bucket(at).alias("bucket")).agg(F.bitmap_construct_agg(bit(at)).alias("bits"))


def merged(*parts: DataFrame) -> DataFrame:
    """Bitmaps of several runs as one: a bar that several have counts once, so runs may overlap."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*BLUEPRINT, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bar_counts(found: DataFrame) -> DataFrame:
    """(BLUEPRINT, num_candles)."""
    return found.groupBy(*BLUEPRINT).agg(F.sum(F.bitmap_count("bits")).alias("num_candles"))
