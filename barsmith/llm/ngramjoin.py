"""N-gram Jaccard join by a MinHash LSH forest, and exact verification.

Method. A text is the set of its runs of five words (a shorter text: one run of all its words). Its signature has `TREES`
labels of `DEPTH` minima of 16 bits each, one label for each prefix tree. A tree is the sorted table of its labels: texts that
share a prefix of a label lie together. Two texts of similarity s share k minima of a label with probability s**k, in one
of the trees with 1 - (1 - s**k)**TREES.

The forest is searched as follows. `shortest` is the prefix at which even a pair at the threshold is met with the target recall
(1 if none is: at thresholds under about 0.3 recall is below the target); a label that is alone under it leads nowhere and goes.
The labels under one such prefix, sorted, are a trie, and tries are descended from their deepest nodes: first the pairs that share
all `DEPTH` minima of a label are made, and those that pass a sieve on 256 bits of the signatures (which
lets a pair at the threshold through but for a chance under 1e-9) are met. Then recall is estimated: a pair met at length k stands for
1 / (1 - (1 - s**k)**TREES) pairs, met or not, so the pairs that have been met tell how many have not. As long as it is short of the
target the prefix is shortened by a minimum, and the pairs of nodes of that length that share no more are made and added. Shorter
pairs are never made once the recall is reached; without any pair the shortest prefix is.

Nodes of over `MOST` labels under the shortest prefix are made by near copies or by passages that many texts share. Their members
are the crowd, and are paired among themselves exactly by another way: of each member only the rarest runs count, as many as a
partner of enough similarity cannot miss all of (`crowded`), so a shared passage, being frequent, brings nobody together.

The components of the candidate graph are then verified exactly: all sets of a component meet in blocks (at most `BLOCK` members
or about `BLOCK_BYTES`), and a task compares two blocks by a matrix product of run columns and returns counts and a spanning
forest, never pairs.

Result. One row for each row of docs: class_id, the smallest doc_id of the component of verified links; n_links, how many
different texts are at least `least` similar to this one; n_copies, the rows with the very same text. Copies are one text
from the first step on, so they cost nothing and give no pairs.

Cases. Null text: empty; texts without words have no links and form a class of copies. Null doc_id: no class, 0 links. Rows
of one doc_id and different texts are different texts, each with its own row. Empty table: empty result. Extra columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import doc_texts, map_texts, texts_of, written
from barsmith.llm.components import components

WIDTH, TREES, DEPTH = 5, 32, 8
MOST, BLOCK, BLOCK_BYTES, SIEVE = 64, 512, 1 << 24, 0.5
BITS = TREES * DEPTH
FEWEST, MOST_BUCKETS = 1 << 16, 1 << 22  # counters of runs: eight for each run of the crowd, within these bounds


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of five words."""
    words = text.encode().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WIDTH, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h = (h ^ own[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


_KEYS = np.random.Generator(np.random.PCG64(5)).integers(1, 2**32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def minima(found: np.ndarray) -> np.ndarray:
    """The signature of a set: TREES * DEPTH minima of 32 bits."""
    low = (found ^ (found >> np.uint64(32))).astype(np.uint32)
    out = np.full(TREES * DEPTH, 2**32 - 1, np.uint32)
    for i in range(0, len(low), 256):
        x = low[None, i : i + 256] * _KEYS[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def prefix_length(least: float, recall: float) -> int:
    """The longest prefix with the target recall at the threshold; 1 if none has."""
    length = DEPTH
    while length > 1 and 1 - (1 - least**length) ** TREES < recall:
        length -= 1
    return length


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, key and text_key (of the text), size (of its set), labels (one for each tree), sketch (a bit of each minimum)."""

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, sizes, labels, sketches = [], [], [], []
        for text in texts_of(batch.column("text")):
            keys.append(xxhash.xxh3_128_hexdigest(text.encode()))
            found = shingles(text)
            sizes.append(len(found))
            if not len(found):
                labels.append(None)
                sketches.append(None)
                continue
            m = minima(found)
            sorts = m.astype(np.uint16).astype(">u2").tobytes()  # as bytes they sort as the minima do
            labels.append([sorts[i : i + 2 * DEPTH] for i in range(0, 2 * BITS, 2 * DEPTH)])
            sketches.append(np.packbits((m >> 16 & 1).astype(bool)).view(np.int64))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), pa.array(labels, pa.list_(pa.binary())), pa.array(sketches, pa.list_(pa.int64()))],
            ["doc_id", "text_key", "key", "size", "labels", "sketch"],
        )

    rows = doc_texts(docs).withColumn("text_key", F.xxhash64("text"))
    return map_texts(rows, of_batch, "doc_id long, text_key long, key string, size long, labels array<binary>, sketch array<long>")


def prefix(label: Column, length: int) -> Column:
    return F.substring(label, 1, 2 * length)


def differing(a: Column, b: Column) -> Column:
    """Bits in which two sketches differ. Minima of similarity s differ in (1 - s) / 2 of them."""
    return sum(F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(BITS // 64))


FAR = int(BITS * (1 - SIEVE) / 2)


def forest(texts: DataFrame, shortest: int) -> tuple[DataFrame, DataFrame]:
    """Tries (m: sorted array of label, id, sketch, crowd) of the labels under one prefix of length `shortest`, and the crowd.

    The crowd: members (id) of nodes over MOST labels. Labels that are alone, or in such a node, are in no trie; `crowd` tells
    labels of its members.
    """
    each = texts.select("id", F.posexplode("labels").alias("tree", "label")).withColumn("node", F.xxhash64("tree", prefix(F.col("label"), shortest)))
    sizes = each.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    hits = written(each.join(sizes, "node").select("node", "id", "label", "n"), "forest")
    crowd = written(hits.filter(F.col("n") > MOST).select("id").distinct(), "crowd")
    about = texts.select(F.col("id").alias("_id"), "sketch").join(crowd.select(F.col("id").alias("member")), F.col("_id") == F.col("member"), "left")
    about = about.select("_id", "sketch", F.col("member").isNotNull().alias("crowd"))
    leaves = hits.filter(F.col("n") <= MOST).join(about, F.col("id") == F.col("_id"))
    tries = leaves.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("label", "id", "sketch", "crowd"))).alias("m")).select("m")
    return written(tries, "tries"), crowd


def met(tries: DataFrame, length: int) -> DataFrame:
    """Pairs a < b, not both of the crowd, whose longest shared prefix in a tree is `length`, and apart, the bits between their sketches."""

    def near(x: Column, y: Column) -> Column:
        same = prefix(x["label"], length) == prefix(y["label"], length)
        more = F.lit(False) if length == DEPTH else prefix(x["label"], length + 1) == prefix(y["label"], length + 1)
        return same & ~more & ~(x["crowd"] & y["crowd"]) & (differing(x["sketch"], y["sketch"]) <= FAR)

    def pair(x: Column, y: Column) -> Column:
        return F.struct(F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b"), differing(x["sketch"], y["sketch"]).alias("apart"))

    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.filter(F.slice("m", i + 2, MOST), lambda y: near(x, y)), lambda y: pair(x, y))))
    return tries.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def enough(pairs: DataFrame, least: float, recall: float, length: int) -> bool:
    """Whether the pairs met at prefixes of `length` and more are, as far as they tell, all but 1 - recall of the pairs there are."""
    # Similarity as the sketch tells it, less a standard error, within the threshold and 1.
    near = F.greatest(F.lit(least), 1 - F.col("apart") * (2 / BITS) - 0.04)
    miss = F.pow(1 - F.pow(near, F.lit(length)), F.lit(TREES))
    found, missed = pairs.filter(1 - F.col("apart") * (2 / BITS) >= least).agg(F.count(F.lit(1)), F.sum(miss / (1 - miss))).first()
    return bool(found) and missed <= (1 - recall) * (found + missed)


def descended(tries: DataFrame, least: float, recall: float, shortest: int) -> tuple[DataFrame, int]:
    """The pairs (a, b, apart) of the tries down to the length at which recall is reached, and that length."""
    found = None
    for length in range(DEPTH, shortest - 1, -1):
        new = met(tries, length)
        new = written(new if found is None else new.join(found, ["a", "b"], "left_anti"), "met")
        found = new if found is None else found.unionByName(new)
        if length == shortest or enough(found, least, recall, length):
            return found, length
    raise ValueError("shortest lies between 1 and DEPTH")


def apart(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b), those whose sketches are too far apart left out."""
    bits = texts.select("id", "sketch")
    both = pairs.join(bits.toDF("a", "a_sketch"), "a").join(bits.toDF("b", "b_sketch"), "b")
    return both.filter(differing(F.col("a_sketch"), F.col("b_sketch")) <= FAR).select("a", "b")


def sets_of(docs: DataFrame, members: DataFrame, schema: str, extra: list[str]) -> DataFrame:
    """id, set (sorted hashes of runs) and the columns `extra` of members (id, doc, key, ...)."""
    # Always by shuffle: members grow with the input, so what a small table does must hold for a large one.
    texts = doc_texts(docs).join(members.hint("merge"), F.col("doc_id") == F.col("doc")).select("key", "id", *extra, "text")

    def to_sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, keys = texts_of(batch.column("text")), batch.column("key").to_pylist()
        own = [xxhash.xxh3_128_hexdigest(t.encode()) == k for t, k in zip(texts, keys, strict=True)]  # a doc_id may have several texts
        kept = batch.filter(pa.array(own))
        found = pa.array([shingles(t).view(np.int64) for t, ok in zip(texts, own, strict=True) if ok], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("id", *extra)), found], ["id", *extra, "set"])

    return map_texts(texts, to_sets, f"id long, {schema}set array<long>")


def crowded(docs: DataFrame, members: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that join all members (id, doc, key) of crowds with similarity >= least.

    A partner shares at least ceil(least * size) runs of a member, so it shares one of any size - ceil(least * size) + 1 of them;
    taken are the rarest. Any order of the runs that is the same for all will do, so rarity goes by counts in buckets: a table of
    eight for each run of the crowd, 4 million (4 MB, a byte each) at most, which every task gets. A crowd of more runs is ordered less
    finely, which brings more candidates and loses none. A run that is alone in its bucket is nobody else's and brings no
    partner. Members of one rare run are paired and sieved; where it has more than MOST members, they hang on the smallest.
    """
    # A doc_id may hold its text more than once.
    sets = written(sets_of(docs, members, "", []).dropDuplicates(["id"]), "sets")
    runs = sets.agg(F.sum(F.size("set"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(FEWEST, 1 << (8 * runs).bit_length()))
    held = sets.select(F.explode("set").alias("run")).groupBy(F.col("run").bitwiseAND(F.lit(buckets - 1)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # By sixteenths of a power of two from 16 on: a byte tells apart what differs by some percent.
    level = F.when(F.col("n") < 16, F.col("n")).otherwise(F.least(F.lit(255), F.floor(F.log2(F.col("n").cast("double")) * 8) - 16))
    held = held.select("bucket", level.cast("short").alias("level")).toArrow()
    counts = np.zeros(buckets, np.uint8)
    counts[held.column("bucket").to_numpy()] = held.column("level").to_numpy()

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, runs = [], []
            for i, one in zip(batch.column("id").to_pylist(), batch.column("set"), strict=True):
                own = one.values.to_numpy()
                n = counts[own & (buckets - 1)]
                first = np.lexsort((own, n))[: len(own) - math.ceil(least * len(own) - 1e-9) + 1]
                first = first[n[first] > 1]
                ids.append(np.full(len(first), i, np.int64))
                runs.append(own[first])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, runs)], ["id", "run"])

    rare = written(sets.mapInArrow(rarest, "id long, run long"), "rare")
    groups = rare.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head")).filter("n > 1")
    stars = rare.join(groups.filter(F.col("n") > MOST), "run").select(F.col("id").alias("a"), F.col("head").alias("b")).filter("a <> b").distinct()
    small = rare.join(groups.filter(F.col("n") <= MOST), "run").groupBy("run").agg(F.sort_array(F.collect_set("id")).alias("ids")).select("ids").distinct()
    pairs = F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", i + 2, MOST), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    pairs = small.select(F.explode(pairs).alias("p")).select("p.a", "p.b").distinct()
    return apart(pairs, texts).union(stars)


def candidates(docs: DataFrame, texts: DataFrame, least: float, recall: float) -> DataFrame:
    """Edges (a, b) between texts (id, doc, key, labels, sketch) whose components hold all links."""
    shortest = prefix_length(least, recall)
    tries, crowd = forest(texts, shortest)
    edges = descended(tries, least, recall, shortest)[0].select("a", "b")
    if crowd.isEmpty():
        return edges
    return edges.union(crowded(docs, crowd.join(texts.select("id", "doc", "key"), "id"), texts, least))


def compare(ids: np.ndarray, first: np.ndarray, second: np.ndarray, sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each member, and the smallest id of its component, among pairs of one of `first` with one of `second`."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(n), sizes.astype(int))
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[column] > 1  # a shingle of one member adds to no intersection
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    column = np.cumsum(np.concatenate([[0], np.diff(column) > 0])) if len(column) else column
    common = np.zeros((n, n), np.float32)
    step = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [start, start + step])
        x = np.zeros((n, step), np.float32)
        x[owner[a:b], column[a:b] - start] = 1
        common += x @ x.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = (common >= least * union - 1e-9) & ((first[:, None] & second[None, :]) | (second[:, None] & first[None, :])) & (ids[:, None] != ids[None, :])
    root = ids.copy()
    while True:
        low = np.minimum(root, np.where(linked, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (low == root).all():
            break
        root = low
    return linked.sum(axis=1), root


def verified(docs: DataFrame, members: DataFrame, least: float) -> DataFrame:
    """(id, links, root) from exact comparison within components; members: (id, doc, key, size, component)."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("runs"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("runs") * 8 / BLOCK_BYTES), F.lit(1)).cast("long")
    placed = members.join(sizes, "component").withColumn("blocks", blocks)
    placed = placed.select("id", "doc", "key", "component", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    sets = sets_of(docs, placed, "component long, blocks long, block long, ", ["component", "blocks", "block"])
    sets = sets.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    sets = sets.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("blocks", "other")

    def check(rows: pa.Table) -> pa.Table:
        ids, block = rows.column("id").to_numpy(), rows.column("block").to_numpy()
        ids, at = np.unique(ids, return_index=True)
        data = rows.column("set")
        found = [data[int(i)].values.to_numpy().view(np.uint64) for i in at]
        links, root = compare(ids, block[at] == rows.column("low")[0].as_py(), block[at] == rows.column("high")[0].as_py(), found, least)
        some = links > 0
        return pa.table({"id": ids[some], "links": links[some].astype(np.int64), "root": root[some]})

    return sets.groupBy("component", "low", "high").applyInArrow(check, "id long, links long, root long")


def different(known: DataFrame) -> DataFrame:
    """A row for each different text: key, text_key, doc (the smallest doc_id), n_copies, size, labels, sketch, and id.

    The id is doc, or a hash of the key where another text has the same doc.
    """
    texts = known.groupBy("key").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n_copies"), *(F.first(c).alias(c) for c in ("text_key", "size", "labels", "sketch")))
    texts = written(texts, "texts")
    twins = texts.groupBy("doc").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("doc").alias("twin"), "first")
    named = texts.join(written(twins, "twins"), F.col("doc") == F.col("twin"), "left")
    return named.withColumn("id", F.when(F.col("first") < F.col("key"), F.xxhash64("key")).otherwise(F.col("doc"))).drop("twin", "first")


def classed(rows: DataFrame, docs: DataFrame, least: float, recall: float) -> DataFrame:
    """Of each different text of rows (signatures of docs): key, text_key, id, doc, n_copies, links, and root, the id that names its class."""
    texts = different(rows.filter("doc_id IS NOT NULL"))
    loose = components(candidates(docs, texts.filter("labels IS NOT NULL"), least, recall), "loose")
    members = loose.select("id", F.col("root").alias("component")).union(loose.select("root", "root").distinct())
    members = members.join(texts.select("id", "doc", "key", "size"), "id")
    found = written(verified(docs, written(members, "members"), least), "links")
    tight = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "tight")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = texts.select("key", "text_key", "id", "doc", "n_copies").join(links, "id", "left").join(tight, "id", "left").withColumn("root", F.coalesce("root", "id"))
    return written(classes, "classes")


def near_duplicates(docs: DataFrame, least: float = 0.8, recall: float = 0.99999) -> DataFrame:
    """doc_id, class_id, n_links, n_copies for each row of docs."""
    rows = written(signatures(docs), "signatures")
    classes = classed(rows, docs, least, recall)
    # The id of a root may be a hash: a class is named by its smallest doc_id.
    names = classes.groupBy("root").agg(F.min("doc").alias("class_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("root").alias("named"), "class_id")
    classes = classes.join(names, F.col("root") == F.col("named"), "left")
    classes = classes.select(F.col("key").alias("_key"), F.coalesce("class_id", "doc").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    out = rows.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("key")).alias("key")).join(classes, F.col("key") == F.col("_key"), "left")
    return out.select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"))


def one_of_each(docs: DataFrame, least: float = 0.8, recall: float = 0.99999) -> DataFrame:
    """docs with one row of each class: of its rows with the smallest doc_id one with the least key. Rows without doc_id all stay."""
    rows = written(signatures(docs), "signatures")
    classes = classed(rows, docs, least, recall)
    chosen = classes.groupBy("root").agg(F.min(F.struct("doc", "key", "text_key")).alias("c")).select(F.col("c.doc").alias("_doc"), F.col("c.text_key").alias("_text_key"))
    # Columns of docs go in one, so that helper columns cannot clash with theirs.
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    known = docs.filter("doc_id IS NOT NULL").select(whole)
    known = known.select("_row", F.col("_row")["doc_id"].cast("long").alias("_d"), F.xxhash64(F.col("_row")["text"].cast("string")).alias("_t"))
    stay = known.join(chosen, (F.col("_d") == F.col("_doc")) & (F.col("_t") == F.col("_text_key")), "left_semi").dropDuplicates(["_d", "_t"])
    return stay.select("_row.*").unionByName(docs.filter("doc_id IS NULL"))
