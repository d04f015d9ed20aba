"""Conversation repair against a plain search over whole edit strings."""

import functools
import hashlib
import random
import re
import sys
import zlib

import pytest

from barsmith.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string, key string"
FULL = {"u": "user", "a": "assistant"}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def hurt(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)


def brute(rows):
    """Least (cost, audit) by trying all edits, with whole strings."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), sha(r[3])))
    turns = [r[1] for r in rows if r[1] is not None]
    seen, faults = set(), []
    for _, _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.lru_cache(None)
    def best(i, state, put):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def way(cost, letter, item, rest):
            if rest:
                found.append((cost + rest[0], letter + rest[1], item + rest[2]))

        follow = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        if put < 3:
            way(5, "I", ((FULL[follow], ""),), best(i, follow, put + 1))
        if i < len(rows):
            _, _, role, text = rows[i]
            way(2, "D", (), best(i + 1, state, 0))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                if role[:1] == follow or (state == "" and role[:1] == "s"):
                    way(more, "K", ((role, text),), best(i + 1, role[:1], 0))
                way(1 + more, "R", ((FULL[follow], text),), best(i + 1, follow, 0))
        return min(found, default=None)

    cost, audit, kept = best(0, "", 0)
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in kept)))


def made(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "users", "a"]
    texts = ["Yes.", "No!", "", " \x0b\t", None, "cut of", "Why?", "Yes. \n", "Ünï. 日", "x."]
    return [(turn, rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[i % 2], f"{rng.choice(texts)}" if rng.random() < 0.5 else f"text {rng.randint(0, 30)}{rng.choice('.!?,')}") for i, turn in enumerate(rng.choice([i, i, i, i // 2, None]) for i in range(n))]


@pytest.mark.parametrize("block", [2, 128])
def test_query_against_brute_force(spark, block):
    """Many short and some long conversations; with tiny blocks their tables must join to the same result."""
    sys.setrecursionlimit(5000)
    rng = random.Random(block)
    rows = [(c, *r) for c in range(120) for r in made(rng, rng.randint(1, 9))]
    rows += [(500 + c, *r) for c in range(3) for r in made(rng, 200)]
    rows += [(None, 1, "user", "A."), (None, None, "assistant", "B."), (None, None, None, None), (900, None, "user", None)]
    rows += [(700, 5, "assistant", "Same.")] * 20  # one row, many times
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    want = {}
    for conv in {r[0] for r in rows}:
        want[conv] = brute(list(hurt(r for r in rows if r[0] == conv)))
    got = {r.conv_id: tuple(r)[1:] for r in repair.repairs(df, repair.damaged(df), block).collect()}
    assert got == want
    assert repair.repairs(df.limit(0), repair.damaged(df.limit(0))).count() == 0


def test_repaired_rows_are_legal(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(c, *r, "x", "y") for c in range(40) for r in made(rng, 12)], SCHEMA)
    found = {}
    for r in sorted(repair.repaired(df).collect(), key=lambda r: (r.conv_id, r.position)):
        found.setdefault(r.conv_id, []).append(r.role[:1])
    assert found and all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in found.values())
    sums = {r.conv_id: r for r in repair.repairs(df, repair.as_rows(df)).collect()}
    assert all(len(found.get(c, [])) == len(r.audit) - r.audit.count("D") for c, r in sums.items())


def test_weights_order_as_cost_then_letters():
    """Integers compare as (cost, letters) with shorter strings first, and an edge in front keeps the order."""
    rng = random.Random(1)
    w = repair.Weights(6)
    pairs = sorted({(rng.randint(0, 5), "".join(rng.choices("DIKR", k=rng.randint(0, 5)))) for _ in range(300)})
    ints = [w.of(c, 0, s) >> (w.low + 2) << w.low | w.of(c, 0, s) & w.mask for c, s in pairs]
    assert ints == sorted(ints) and [w.plain(x) for x in ints] == pairs
    assert [w.plain(w.edge(2, repair.KEEP, x)) for x in ints] == [(c + 2, "K" + s) for c, s in pairs]
    assert w.edge(1, repair.KEEP, w.none) == w.none and w.plain(w.none) is None


def test_more_inserts_never_help():
    """With three inserts before a row the tables are the same as with two."""
    rng = random.Random(2)
    for _ in range(30):
        rows = [(rng.choice("suax"), rng.choice([0, 0, repair.BLANK, repair.DUPLICATE, repair.TRUNCATED])) for _ in range(rng.randint(1, 8))]
        two = repair.block_table(rows)
        repair.INSERTS = 3
        try:
            assert repair.block_table(rows) == two
        finally:
            repair.INSERTS = 2
