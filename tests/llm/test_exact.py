"""Exact dedup and the Merkle manifest against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barsmith.llm import exactdedup, merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_copies(rows):
    groups = {}
    for d, text, *_ in rows:
        groups.setdefault(text or "", []).append(d)
    out = Counter()
    for text, ids in groups.items():
        keep = max((d for d in ids if d is not None), default=None)
        for d, n in Counter(ids).items():
            for i in range(n):
                out[d, keep, len(ids), d == keep and i == 0, sha(text)] += 1
    return out


@pytest.mark.parametrize("bits", [8, 256])
def test_exact_duplicates(docs_of, odd_rows, bits):
    """Digests of 8 bits are shared by many texts, so only the texts themselves tell them apart."""
    rows = [*odd_rows, *((100 + i, f"text {i % 150}", "en", "a") for i in range(600)), *((1000 + i, "hot", "en", "b") for i in range(500)), *((None, "lost", None, None) for _ in range(9)), (3000, "hot ", "en", "a")]
    docs = docs_of(rows)
    got = Counter(map(tuple, exactdedup.exact_duplicates(docs, bits).collect()))
    assert got == plain_copies(rows)
    clash = docs.withColumns({c: F.lit("x") for c in ("digest", "salt", "sha", "keep_id", "copies", "texts", "held", "best")})
    assert Counter(map(tuple, exactdedup.exact_duplicates(clash, bits).collect())) == got
    assert exactdedup.exact_duplicates(docs.limit(0), bits).count() == 0


def test_one_winner_a_salt(docs_of):
    """The winners that meet globally are SALTS for a text at most, and no Python runs."""
    rows = exactdedup.digests(docs_of([(i, "hot", "en", "a") for i in range(3000)]))
    assert 32 < rows.groupBy("digest", "salt", "text").count().count() <= exactdedup.SALTS
    plan = exactdedup.combined(rows)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InArrow" not in plan and plan.count("Exchange hashpartitioning") == 2


def leaf(row, low=False):
    doc, text, lang, source, n = row
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text) if low and text is not None else text
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    for level in levels[:-1]:
        start = i - i % 16
        yield "".join(level[start:i]), "".join(level[i + 1 : start + 16])
        i //= 16


def plain_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    root, out = top[-1][0], Counter()
    for k, s in enumerate(names):
        for i, (known, doc, own, row) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = [*siblings(trees[s], i), *siblings(top, k)]
            node = leaf(row, True) if known and zlib.crc32(str(doc).encode()) % 5 == 0 else own
            for a, b in path:
                node = sha(a, node, b)
            out[row[0], own, trees[s][-1][0], root, sha(*(a + b for a, b in path)), node, node == root] += 1
    return out


def sources():
    """A hot source of several stored levels, sizes about the powers of 16, and many sources of one row."""
    sizes = {"hot": 1200, "a": 16, "b": 17, "c": 255, "d": 256, "e": 257, "é": 1, None: 3, "": 2, "-": 1, **{f"s{i}": 1 for i in range(40)}}
    rows, doc = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            doc += 7
            rows.append((doc % 4999, f"Text {doc} OF {s}" if doc % 3 else f"text {doc}", "en" if doc % 5 else None, s))
    return rows


@pytest.mark.parametrize("part_rows", [None, 64])
def test_manifest(spark, docs_of, odd_rows, part_rows):
    rows = sources() + odd_rows
    docs = docs_of(rows)
    full = [(*r[:2], r[2], r[3], len(r[1]) if r[1] else 0) for r in rows]
    want = plain_manifest(full)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if part_rows:  # a source over many partitions
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = Counter(map(tuple, merkle.manifest(docs, merkle.every_fifth()).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want
    assert {r[-1] for r in want} == {True, False}


def test_manifest_cases(docs_of, odd_rows):
    """One row, no row, one source, clashing columns; without tampering all is verified."""
    one = merkle.manifest(docs_of([(5, "A b", "en", "s")])).collect()
    assert [(r.leaf == r.subroot == r.root == r.folded_root, r.proof_sha256, r.verified) for r in one] == [(True, sha(), True)]
    assert merkle.manifest(docs_of([])).count() == 0
    docs = docs_of(odd_rows)
    clash = docs.withColumns({c: F.lit("x") for c in ("tree", "node", "idx", "part", "at", "first", "block", "path", "found", "root", "subroot", "round", "own", "name")})
    got = merkle.manifest(clash)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, merkle.manifest(docs).collect())) and got.filter("NOT verified").count() == 0


def test_sql_of_trees_and_conversations(odd_rows):
    """The SQL that goes with the queries, on odd rows, against the same plain versions."""
    import random

    import duckdb
    import test_repair as plain

    from barsmith.llm.queries import ORACLE_SQL

    c = duckdb.connect()
    rows = [(*r, len(r[1]) if r[1] else 0) for r in sources() + odd_rows]
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [r for r in rows if "\x00" not in (r[1] or "")])
    assert Counter(c.sql(ORACLE_SQL["op13_merkle_manifest"]).fetchall()) == plain_manifest([r for r in rows if "\x00" not in (r[1] or "")])
    rng = random.Random(8)
    talk = [(k, *r) for k in range(60) for r in plain.made(rng, rng.randint(1, 9))] + [(None, 1, "user", "A."), (None, None, "assistant", "B."), (900, None, "user", None)]
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", talk)
    got = {r[0]: r[1:] for r in c.sql(ORACLE_SQL["op11_conversation_repair"]).fetchall()}
    assert got == {k: plain.brute(list(plain.hurt(r for r in talk if r[0] == k))) for k in {r[0] for r in talk}}


def test_few_levels_are_stored(docs_of):
    """Stored are the leaves and every second level: 1,200 leaves, then 5 tops of 256, then one."""
    leaves = merkle.numbered(merkle.leaves_of(docs_of(sources()).filter("source = 'hot'")), [F.asc("tree"), F.asc("doc_id"), F.asc("node")], "leaves")
    stored, roots = merkle.built(leaves, "levels")
    assert [s.count() for s in stored] == [1200, 5] and roots.count() == 1
