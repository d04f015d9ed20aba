"""Repair of conversations: the cheapest edits that make the roles alternate, found by a shortest path over integer weights.

Method. Reading a conversation's rows in order is a walk through four states (nothing kept yet, after a system row, after a user
row, after an assistant row); the edges are the edits, and a repaired conversation has the roles `(s?(ua)+)?`. A path's weight
is one integer: high digits carry the cost, the low digits, a fixed number of them, the letters of its edits from the
left, zeros after the last. An edge in front of a path adds its cost above and shifts its letter in below, so the smaller integer is the cheaper path
and, of equally cheap ones, that with the least letters; the dynamic program over the DAG takes minima of integers, nothing else.

Long conversations. The rows are cut into blocks of `BLOCK`, and the program is run within each block, from each state to each
state: a table of 16 weights. The tables of a conversation are then joined in order: a path so far is known by its cost and its
rank among the at most four paths kept, both digits above the letters of the next block. That is exact: a state has one edge at most
for each letter and the paths through a block end by reading its last row, so of two paths none starts the other, and their
order is settled where they part. So a task needs one block of facts, or of one conversation the tables of its blocks.

Scale. Texts are hashed and judged where they are read. Equal rows of a conversation at one turn are counted, not listed. The rows
of facts are sorted by range (conversation, turn), so one conversation may lie in many partitions. Texts meet their edits in a
sorted stream, and the hash of the repaired text is a running one; its order makes this the one thing that is done by one task
for each conversation, in memory of one row.

Rows of one turn are ordered by role, then by the SHA-256 of the text.

Result. One row for each conv_id of the table given as `every`: gaps, blank, duplicate, truncated, illegal, cost, audit,
repaired_sha256. `repaired` returns the rows of the repaired conversations instead.

Cases. Null role or text: one space (so the text is blank and the role, unless changed, unfit). Null turn: before all others, counts for
no gap. Null conv_id: a conversation of its own. Empty table: empty result. No rows left: zeros, empty audit, the hash of
nothing. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import by_bytes, written

BLOCK = 128
START, SYSTEM, USER, ASSISTANT = range(4)
#: The letters of edits, in ASCII order; 0 ends a path.
LETTERS = "\0DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
COSTS = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
UNDELETED_TRUNCATED = 5
#: Which state a kept row with this initial leads to, and the role that may be put after a state.
AFTER = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
FINAL = (START, ASSISTANT)
#: More inserts than two before a row are of no use: the third one leads to a state that one fewer reached.
INSERTS = 2
BITS = 3
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
LEGAL = ("su", "ua", "au")


class Weights:
    """Integers that stand for paths of up to `digits` letters: the cost, then BITS bits for each letter from the left."""

    def __init__(self, digits: int) -> None:
        self.low = BITS * digits
        self.mask = (1 << self.low) - 1
        self.none = 1 << (self.low + 62)

    def edge(self, cost: int, letter: int, rest: int) -> int:
        """A path that starts with this edge and goes on as `rest`."""
        if rest >= self.none:
            return self.none
        return (((rest >> self.low) + cost) << self.low) | (letter << (self.low - BITS)) | ((rest & self.mask) >> BITS)

    def with_inserts(self, base: list[int]) -> list[int]:
        """Least weights from each state when inserts may come first."""
        w = base
        for _ in range(INSERTS):
            w = [min(base[s], self.edge(COSTS[INSERT], INSERT, w[NEXT[s]])) for s in range(4)]
        return w

    def plain(self, weight: int) -> tuple[int, str] | None:
        """Cost and letters."""
        if weight >= self.none:
            return None
        found, at = [], self.low - BITS
        while at >= 0 and (digit := weight >> at & 7):
            found.append(LETTERS[digit])
            at -= BITS
        return weight >> self.low, "".join(found)

    def of(self, cost: int, rank: int, letters: str) -> int:
        """A path known by its cost and rank up to here, and the letters that follow."""
        weight = cost << 2 | rank
        for letter in letters:
            weight = weight << BITS | LETTERS.index(letter)
        return weight << (self.low - BITS * len(letters))


def edits(state: int, initial: str, fault: int) -> Iterator[tuple[int, int, int]]:
    """(letter, cost, next state) of the edits of a row in a state; each letter once at most."""
    yield DELETE, COSTS[DELETE], state
    if fault not in (BLANK, DUPLICATE):
        more = UNDELETED_TRUNCATED * (fault == TRUNCATED)
        if (to := AFTER[state].get(initial)) is not None:
            yield KEEP, COSTS[KEEP] + more, to
        yield REROLE, COSTS[REROLE] + more, NEXT[state]


def block_table(rows: list[tuple[str, int]]) -> list[list[tuple[int, str] | None]]:
    """Least (cost, letters) through rows (initial, fault), from each state before them to each state after the last one."""
    weights, columns = Weights((INSERTS + 1) * len(rows)), []
    for last in range(4):
        w = [0 if s == last else weights.none for s in range(4)]
        for initial, fault in reversed(rows):
            w = weights.with_inserts([min(weights.edge(cost, letter, w[to]) for letter, cost, to in edits(s, initial, fault)) for s in range(4)])
        columns.append([weights.plain(x) for x in w])
    return [[columns[t][s] for t in range(4)] for s in range(4)]


def closing_table() -> list[list[tuple[int, str] | None]]:
    """Least (cost, letters) from each state after the last row to the end, which is written as state START."""
    weights = Weights(INSERTS)
    ends = weights.with_inserts([0 if s in FINAL else weights.none for s in range(4)])
    return [[weights.plain(x), None, None, None] for x in ends]


class Paths:
    """The least paths over the blocks so far, one for each state: their costs, their ranks, and the letters of each block."""

    def __init__(self) -> None:
        self.costs: list[int | None] = [0, None, None, None]
        self.ranks, self.steps = [0] * 4, []

    def add(self, table: list[list[tuple[int, str] | None]]) -> None:
        weights = Weights(max(len(x[1]) for row in table for x in row if x))
        best: list[tuple[int, int] | None] = [None] * 4
        for t in range(4):
            ways = [(weights.of(self.costs[s] + table[s][t][0], self.ranks[s], table[s][t][1]), s) for s in range(4) if self.costs[s] is not None and table[s][t]]
            best[t] = min(ways, default=None)
        below = (1 << (weights.low + 2)) - 1
        order = sorted({b[0] & below for b in best if b})
        self.steps.append([b and (b[1], table[b[1]][t][1]) for t, b in enumerate(best)])
        self.costs = [b and b[0] >> (weights.low + 2) for b in best]
        self.ranks = [order.index(b[0] & below) if b else 0 for b in best]

    def back(self) -> list[tuple[int, str]]:
        """The path to state START of the last block: for each block the state before it and its letters."""
        state, out = START, []
        for step in reversed(self.steps):
            state, letters = step[state]
            out.append((state, letters))
        return out[::-1]


def as_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; null role or text as one space."""
    ids = [F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")]
    return conversations.select(*ids, *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (see as_rows) with faults put in, by the unsigned crc32 of `conv_id:turn` modulo 20, null as one space."""
    rows = as_rows(conversations)
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    kind = F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))
    return rows.filter(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


KEY = ["conv_id", "turn", "role", "sha"]
#: conv_id and turn may be null, and null comes first.
ORDER = [F.asc_nulls_first, F.asc_nulls_first, F.asc, F.asc]


def order_of_rows() -> list[Column]:
    return [f(c) for f, c in zip(ORDER, KEY, strict=True)]


def own_fault(text: Column) -> Column:
    """BLANK, TRUNCATED or 0, by the last character that is no ASCII white space."""
    last = F.right(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    return F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)


def facts(rows: DataFrame) -> DataFrame:
    """Of each different row of a turn: KEY, fault, copies, later (an equal row stands at an earlier turn)."""
    each = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("sha"), own_fault(F.col("text")).alias("fault"))
    units = written(each.groupBy(*KEY).agg(F.first("fault").alias("fault"), F.count(F.lit(1)).alias("copies")), "units")
    # Least turn of equal rows, null first. Joined by the whole key, which no two units share, so no text is a hot key.
    firsts = units.groupBy("conv_id", "role", "sha").agg(F.min(F.struct("turn")).alias("least"))
    firsts = firsts.select(F.col("conv_id").alias("_conv_id"), F.col("least.turn").alias("_turn"), F.col("role").alias("_role"), F.col("sha").alias("_sha"))
    same = [units[k].eqNullSafe(firsts[f"_{k}"]) for k in KEY]
    return units.join(firsts, same[0] & same[1] & same[2] & same[3], "left").select(*KEY, "fault", "copies", F.col("_role").isNull().alias("later"))


BLOCKS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("costs", pa.list_(pa.int64())), ("letters", pa.list_(pa.string())), ("first", pa.string()), ("last", pa.string()),
    *((c, pa.int64()) for c in ("illegal", "blank", "duplicate", "truncated", "first_turn", "last_turn", "turns")),
    ("turn", pa.list_(pa.int64())), ("role", pa.list_(pa.string())), ("sha", pa.list_(pa.binary())), ("rows", pa.list_(pa.int32())),
])
BLOCKS_SQL = (
    "conv_id long, part int, seq long, costs array<long>, letters array<string>, first string, last string, illegal long, blank long, duplicate long, truncated long, "
    "first_turn long, last_turn long, turns long, turn array<long>, role array<string>, sha array<binary>, rows array<int>"
)


def block_record(conv: int | None, part: int, seq: int, rows: list[tuple]) -> dict:
    """A row of the table of blocks; rows: (turn, role, sha, fault), a block of one conversation."""
    initials, faults = [r[1][:1] for r in rows], [r[3] for r in rows]
    cells = [x for row in block_table(list(zip(initials, faults, strict=True))) for x in row]
    turns = [r[0] for r in rows if r[0] is not None]
    units = [(k, len(list(g))) for k, g in groupby(rows, key=lambda r: r[:3])]
    return {
        "conv_id": conv, "part": part, "seq": seq, "costs": [x and x[0] for x in cells], "letters": [x and x[1] for x in cells], "first": initials[0], "last": initials[-1],
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), **{name: faults.count(f) for name, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))},
        "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)),
        "turn": [k[0] for k, _ in units], "role": [k[1] for k, _ in units], "sha": [k[2] for k, _ in units], "rows": [n for _, n in units],
    }


def in_batches(rows: Iterator[dict], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def rows_in(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for part in by_bytes(batch):
            yield from part.to_pylist()


def blocks(units: DataFrame, size: int = BLOCK) -> DataFrame:
    """BLOCKS of the units, sorted by range: at most `size` rows of one conversation each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[dict]:
            held, conv, part, seq = [], None, 0, 0
            for u in rows_in(batches):
                if held and u["conv_id"] != conv:
                    yield block_record(conv, part, seq, held)
                    held, seq = [], seq + 1
                conv, part = u["conv_id"], u["part"]
                for i in range(u["copies"]):
                    again = DUPLICATE if (i or u["later"]) and u["fault"] != BLANK else u["fault"]
                    held.append((u["turn"], u["role"], u["sha"], again))
                    if len(held) == size:
                        yield block_record(conv, part, seq, held)
                        held, seq = [], seq + 1
            if held:
                yield block_record(conv, part, seq, held)

        return in_batches(records(), BLOCKS)

    placed = units.repartitionByRange(*order_of_rows()).sortWithinPartitions(*order_of_rows()).withColumn("part", F.spark_partition_id())
    return placed.mapInArrow(cut, BLOCKS_SQL)


SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PLANS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("state", pa.int32()), ("letters", pa.string()), *((c, pa.int64()) for c in SUMMARY), ("audit", pa.string())])
PLANS_SQL = "conv_id long, part int, seq long, state int, letters string, " + "".join(f"{c} long, " for c in SUMMARY) + "audit string"


def plans(table: DataFrame) -> DataFrame:
    """The cheapest path of each conversation: a row for each block (state before it, letters), and one without part for the whole."""

    def whole(conv: int | None, found: Iterator[dict]) -> Iterator[dict]:
        paths, at, out = Paths(), [], dict.fromkeys(("illegal", "blank", "duplicate", "truncated"), 0)
        last, first_turn, last_turn, turns = None, None, None, 0
        for b in found:
            cells = [None if c is None else (c, w) for c, w in zip(b["costs"], b["letters"], strict=True)]
            paths.add([cells[i : i + 4] for i in range(0, 16, 4)])
            at.append((b["part"], b["seq"]))
            for name in out:
                out[name] += b[name]
            out["illegal"] += last is not None and last + b["first"] not in LEGAL
            last = b["last"]
            turns += b["turns"] - (b["turns"] > 0 and b["first_turn"] == last_turn)
            first_turn = b["first_turn"] if first_turn is None else first_turn
            last_turn = last_turn if b["last_turn"] is None else b["last_turn"]
        paths.add(closing_table())
        steps = paths.back()
        for (part, seq), (state, letters) in zip(at, steps, strict=False):
            yield {"conv_id": conv, "part": part, "seq": seq, "state": state, "letters": letters}
        gaps = 0 if first_turn is None else last_turn - first_turn + 1 - turns
        yield {"conv_id": conv, "state": steps[-1][0], "letters": steps[-1][1], "gaps": gaps, **out, "cost": paths.costs[START], "audit": "".join(x for _, x in steps)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for conv, found in groupby(rows_in(batches), key=lambda r: r["conv_id"]) for row in whole(conv, found))
        return in_batches(each, PLANS)

    order = [F.asc_nulls_first("conv_id"), F.asc("part"), F.asc("seq")]
    slim = table.drop("turn", "role", "sha", "rows")
    return slim.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, PLANS_SQL)


KEPT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("sha", pa.binary()), ("before", pa.list_(pa.string())), ("put", pa.string())])
KEPT_SQL = "conv_id long, turn long, role string, sha binary, before array<string>, put string"


def kept(table: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows that stay, by KEY: put (the role in the end) and before (roles of rows put in before it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for b in rows_in(batches):
                each = iter([(t, r, s) for t, r, s, n in zip(b["turn"], b["role"], b["sha"], b["rows"], strict=True) for _ in range(n)])
                state, before = b["state"], []
                for letter in b["chosen"]:
                    if letter == "I":
                        state = NEXT[state]
                        before.append(ROLES[state])
                        continue
                    turn, role, sha = next(each)
                    if letter == "D":
                        continue
                    state = NEXT[state] if letter == "R" else AFTER[state][role[:1]]
                    yield {"conv_id": b["conv_id"], "turn": turn, "role": role, "sha": sha, "before": before, "put": ROLES[state] if letter == "R" else role}
                    before = []

        return in_batches(rows(), KEPT)

    picked = chosen.filter("part IS NOT NULL AND letters RLIKE '[KR]'").select("part", "seq", "state", F.col("letters").alias("chosen"))
    return table.select("part", "seq", "conv_id", "turn", "role", "sha", "rows").join(picked, ["part", "seq"]).mapInArrow(run, KEPT_SQL)


STREAM = [*KEY, "end", "kind"]


def stream(rows: DataFrame, keep: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of text after the edits that keep them, each conversation in order in one task; last, what is put in at its end."""
    texts = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("sha"), F.lit(0).alias("end"), F.lit(1).alias("kind"), "text")
    edits = keep.select(*KEY, F.lit(0).alias("end"), F.lit(0).alias("kind"), "before", "put")
    tails = chosen.filter("part IS NULL AND letters <> ''").select("conv_id", F.lit(1).alias("end"), F.lit(0).alias("kind"), "state", F.col("letters").alias("tail"))
    both = texts.unionByName(edits, allowMissingColumns=True).unionByName(tails, allowMissingColumns=True)
    order = [F.asc_nulls_first("conv_id"), F.asc("end"), *order_of_rows()[1:], F.asc("kind")]
    return both.repartition("conv_id").sortWithinPartitions(*order)


def repaired_rows(rows: Iterator[dict]) -> Iterator[tuple[int | None, str, str]]:
    """(conv_id, role, text) of the repaired conversations, from rows of `stream`."""
    edit = None
    for r in rows:
        if r["end"]:
            state = r["state"]
            for _ in r["tail"]:
                state = NEXT[state]
                yield r["conv_id"], ROLES[state], ""
        elif r["kind"] == 0:
            edit = r
        elif edit and all(edit[k] == r[k] for k in KEY):
            for role in edit["before"]:
                yield r["conv_id"], role, ""
            yield r["conv_id"], edit["put"], r["text"]
            edit = None


def planned(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Of rows as of as_rows: the plans of their conversations, and the stream of texts and edits."""
    table = written(blocks(facts(rows), size), "blocks")
    chosen = written(plans(table), "plans")
    return chosen, stream(rows, kept(table, chosen), chosen)


def repaired(conversations: DataFrame, size: int = BLOCK) -> DataFrame:
    """conv_id, position, role, text of the repaired conversations."""
    _, found = planned(as_rows(conversations), size)
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for _, own in groupby(repaired_rows(rows_in(batches)), key=lambda r: r[0]):
                for i, (conv, role, text) in enumerate(own):
                    yield {"conv_id": conv, "position": i, "role": role, "text": text}

        return in_batches(rows(), schema, 100)

    return found.mapInArrow(run, "conv_id long, position long, role string, text string")


def repairs(every: DataFrame, rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """The result for each conv_id of `every`, from the rows (see as_rows) that are there now, in blocks of `size`."""
    chosen, found = planned(rows, size)
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashes() -> Iterator[dict]:
            for conv, own in groupby(repaired_rows(rows_in(batches)), key=lambda r: r[0]):
                running = hashlib.sha256()
                for i, (_, role, text) in enumerate(own):
                    running.update(f"{chr(10) * (i > 0)}{role}:{text}".encode())
                yield {"conv_id": conv, "repaired_sha256": running.hexdigest()}

        return in_batches(hashes(), schema)

    hashes = found.mapInArrow(run, "conv_id long, repaired_sha256 string").select(F.col("conv_id").alias("_hashed"), "repaired_sha256")
    ids = every.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    sums = chosen.filter("part IS NULL").select(F.col("conv_id").alias("_conv_id"), *SUMMARY, "audit")
    out = ids.join(sums, F.col("conv_id").eqNullSafe(F.col("_conv_id")), "left").join(hashes, F.col("conv_id").eqNullSafe(F.col("_hashed")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in SUMMARY]
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
