"""Merkle manifest of a table: a tree of 16 children a node for each source, a tree over sources, and a proof for each row.

Method: checkpoint and recompute. A leaf is the hash of a row. Leaves of a source, in order of doc_id, make a tree, and the roots of
the sources another one. Of all nodes only every `LEVELS`-th level is stored: the leaves, then the top of each aligned subtree of
16 ** LEVELS nodes, and so on. To make proofs, the tree is walked from the top down, one stored level at a time: a subtree meets
the path of its top (the siblings from there to the root), regenerates its interior nodes from its stored nodes, hands each
of these its own siblings and that path, and forgets the interior nodes.

Scale. Rows are sorted by range, so a source with most rows is spread over tasks. The position of a row in its source is counted
within partitions; what lies before a partition is the prefix sum of one row for each partition. Then work goes by subtrees
of 256 nodes. Rounds go by the logarithm, to base 256, of the largest source; nothing but one root hash reaches the driver.

Result. One row for each row of docs: doc_id, leaf, subroot, root, proof_sha256 (of the siblings' digests, joined, level by level
from the leaf up, left to right), folded_root (from the leaf as found, here after tampering with some rows, and the
siblings), verified (folded_root = root).

Cases. Nulls in hashed columns are `-` in the leaf; a null source is a source of its own, before all others; null doc_ids come
first in their source and are not tampered with. Rows of one doc_id are ordered by leaf; repeated rows are leaves of their own. A
source of one row has its leaf as subroot, and a table of one source its subroot as root; without siblings the proof is the hash of
nothing. Very long texts are hashed where they are read and go no further. Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barsmith.llm.common import written

FAN, LEVELS = 16, 2
SUBTREE = FAN**LEVELS
PATH = "tree string, idx long, path array<string>, subroot string, root string"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def hashed(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def upper(nodes: list[str]) -> list[str]:
    """The next level: each run of FAN nodes, the last one maybe shorter, becomes its hash."""
    return [hashed(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]


def rise(block: int, n: int) -> int:
    """Levels from the nodes of a subtree to its top: all of them where the tree goes on, else as many as leave one node."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return LEVELS if block else levels


def sibling_pairs(nodes: list[str], levels: int) -> Iterator[list[str]]:
    """For each node of a subtree its siblings, joined: left and right ones in turn, for each level up to the top."""
    rows = [nodes]
    for _ in range(levels - 1):
        rows.append(upper(rows[-1]))
    for at in range(len(nodes)):
        pairs = []
        for row in rows[:levels]:
            start = at - at % FAN
            pairs += ["".join(row[start:at]), "".join(row[at + 1 : start + FAN])]
            at //= FAN
        yield pairs


def folded(node: str, path: list[str]) -> str:
    """The root that a node and its path lead to."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        node = hashed([left, node, right])
    return node


def leaf_hash(columns: list[Column]) -> Column:
    """Hash of values: `-` for null, else the length in bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def leaves_of(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """tree (the source, null before all others), doc_id, node (the leaf) and, where its text is tampered with, found (the leaf then)."""
    columns = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")]
    text = F.col("text").cast("string")
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.lit(None).cast("string") if tampered is None else F.when(tampered, leaf_hash([*columns, lowered]))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash([*columns, text]).alias("node"), found.alias("found"))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows, written, with idx: the position in its tree. `order` starts with the column tree."""
    fields = rows.schema.fieldNames()
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Positions within the rows of a tree in this partition; first: the tree is the partition's first."""
        last, at, first = None, 0, True
        for batch in batches:
            idx, firsts = [], []
            for tree in batch.column("tree").to_pylist():
                if tree != last:
                    first, at, last = last is None, 0, tree
                idx.append(at)
                firsts.append(first)
                at += 1
            more = [pa.array(idx, pa.int64()), pa.array(firsts, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*fields, "part"]), *more], [*fields, "part", "at", "first"])

    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    placed = written(placed.mapInArrow(count, f"{types}, part int, at long, first boolean"), name)
    # One row for each partition: its first and last tree, and how many rows it has of the last one.
    ends = placed.groupBy("part").agg(F.min("tree").alias("head"), F.max("tree").alias("tail"), F.max_by(F.col("at") + 1, F.struct("tree", "at")).alias("held"))
    w = Window.orderBy("part")
    whole = F.col("head") == F.col("tail")
    # Rows of the tail since the last partition that another tree came before.
    ends = ends.withColumn("group", F.sum(F.when(whole & (F.lag("tail").over(w) == F.col("head")), 0).otherwise(1)).over(w))
    ends = ends.withColumn("sum", F.sum("held").over(Window.partitionBy("group").orderBy("part")))
    ends = ends.withColumn("before", F.when(F.lag("tail").over(w) == F.col("head"), F.lag("sum").over(w)).otherwise(0))
    ends = F.broadcast(ends.select(F.col("part").alias("_part"), "before"))
    idx = F.col("at") + F.when(F.col("first"), F.col("before")).otherwise(0)
    return placed.join(ends, F.col("part") == F.col("_part")).select(*fields, idx.alias("idx"))


def built(leaves: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Stored levels (tree, idx, node, ...) from the leaves up, and roots (tree, node, round: the last stored level below it)."""

    def top(key: tuple, nodes: pa.Table) -> pa.Table:
        own = nodes.sort_by("idx").column("node").to_pylist()
        tree, block = key[0].as_py(), key[1].as_py()
        done = block == 0 and len(own) < SUBTREE
        for _ in range(rise(block, len(own))):
            own = upper(own)
        return pa.table({"tree": [tree], "idx": pa.array([block], pa.int64()), "node": own, "done": [done]})

    stored, roots = [leaves], []
    while True:
        nodes = stored[-1].select("tree", "idx", "node", (F.col("idx") / SUBTREE).cast("long").alias("block"))
        tops = written(nodes.groupBy("tree", "block").applyInArrow(top, "tree string, idx long, node string, done boolean"), name)
        roots.append(tops.filter("done").select("tree", "node", F.lit(len(stored) - 1).alias("round")))
        more = tops.filter("NOT done").select("tree", "idx", "node")
        if more.isEmpty():
            break
        stored.append(more)
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return stored, out


def spread(nodes: DataFrame, tops: DataFrame, each, schema: str) -> DataFrame:
    """`each` of every node of a stored level, given the paths (PATH) of the tops of its subtrees.

    each: (row of a node, its own siblings in its subtree, row of the path of the top) -> row of the schema.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def of_subtree(key: tuple, own: pa.Table, paths: pa.Table) -> pa.Table:
        own, path = own.sort_by("idx"), paths.to_pylist()[0]
        rows = own.to_pylist()
        pairs = sibling_pairs([r["node"] for r in rows], rise(key[1].as_py(), len(rows)))
        return pa.Table.from_pylist([each(r, p, path) for r, p in zip(rows, pairs, strict=True)], schema=types).select(names)

    types = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}[t]) for n, t in (f.split() for f in schema.split(", "))])
    nodes = nodes.withColumn("block", (F.col("idx") / SUBTREE).cast("long"))
    tops = tops.withColumnRenamed("idx", "block")
    return nodes.groupBy("tree", "block").cogroup(tops.groupBy("tree", "block")).applyInArrow(of_subtree, schema)


def paths_below(stored: list[DataFrame], roots: DataFrame, each, schema: str, name: str) -> DataFrame:
    """`each` of every leaf, from the paths of the roots (PATH and round): one stored level after the other, from the top."""

    def inner(node: dict, pairs: list[str], top: dict) -> dict:
        return {"tree": node["tree"], "idx": node["idx"], "path": pairs + top["path"], "subroot": top["subroot"], "root": top["root"]}

    above = None
    for level in range(len(stored) - 1, -1, -1):
        tops = roots.filter(F.col("round") == level).drop("round")
        tops = tops if above is None else tops.unionByName(above)
        if level == 0:
            return spread(stored[0], tops, each, schema)
        above = written(spread(stored[level], tops, inner, PATH), name)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """The result for docs; tampered: which rows are found with other text (A-Z lower-cased) than was hashed."""
    spark = docs.sparkSession
    order = [F.asc("tree"), F.asc_nulls_first("doc_id"), F.asc("node")]
    stored, subroots = built(numbered(leaves_of(docs, tampered), order, "leaves"), "levels")
    names = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node", F.col("round").alias("own"))
    tops, roots = built(numbered(names, [F.asc("tree"), F.asc("name")], "sources"), "sources")
    last = roots.first()
    if last is None:
        return spark.createDataFrame([], RESULT)
    start = spark.createDataFrame([("", 0, [], None, last["node"], last["round"])], f"{PATH}, round int")

    def of_source(node: dict, pairs: list[str], top: dict) -> dict:
        return {"tree": node["name"], "idx": 0, "path": pairs + top["path"], "subroot": node["node"], "root": top["root"], "round": node["own"]}

    sources = written(paths_below(tops, start, of_source, f"{PATH}, round int", "paths"), "paths")

    def of_row(node: dict, pairs: list[str], top: dict) -> dict:
        path = pairs + top["path"]
        root = folded(node["found"] or node["node"], path)
        return {"doc_id": node["doc_id"], "leaf": node["node"], "subroot": top["subroot"], "root": top["root"], "proof_sha256": hashed(path), "folded_root": root, "verified": root == top["root"]}

    return paths_below(stored, sources, of_row, RESULT, "paths")


def every_fifth() -> Column:
    """Rows of the query that are tampered with: 5 divides the unsigned crc32 of the decimal doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
