"""SentencePiece encoding (BPE type) with seeded merge-dropout, and lossless decoding.

Method. Each word (white space marks and what follows them) has an agenda of adjacent pairs whose union is a piece, taken
by score and then from the left. A pair that comes up is skipped, for good, when the keyed hash of seed, document, word,
place and piece falls under the dropout rate; else it is merged and its new neighbours join the agenda. No piece spans
words, so numpy works on the agendas of all words of a batch in lock-step: one candidate of each word a round. Words over
`LONG` characters get a heap instead, with the same outcome. Without dropout the result is the library's.

Decoding joins pieces and bytes. Blanks are coded as the mark U+2581, a mark that a text itself holds as its UTF-8 bytes, so
every text comes back as it was.

Cases. Null text: empty, no pieces. Repeated rows give repeated results (the hash knows the document only by doc_id; a null
doc_id counts as -1). Long texts go through in stretches that end between words. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import doc_texts, map_texts, texts_of

MARK, LONG, NEVER = "▁", 64, np.int64(2**62)
C1, C2, C3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
WORD_START = re.compile(r"(?<=[^ ]) ")
STRETCH = 400_000


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(C2)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(C3)
    return x ^ (x >> np.uint64(31))


class PairTable:
    """Open-addressing table from pairs of symbols to pieces, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        self.probes = 1
        left, step = np.arange(len(keys)), 0
        while len(left):
            at = self._slot(keys[left], step)
            free = self.keys[at] < 0
            at, chosen = np.unique(at[free], return_index=True)
            placed = left[free][chosen]
            self.keys[at], self.values[at] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed)
            step += 1
        self.probes = step

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        h = (keys.astype(np.uint64) * np.uint64(C1)) >> np.uint64(64 - self.bits)
        return ((h + np.uint64(step)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys, 0)
        seen = self.keys[at]
        out = np.where(seen == keys, self.values[at], -1)
        open_ = np.flatnonzero((seen != keys) & (seen >= 0) & (keys >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            at = self._slot(keys[open_], step)
            seen = self.keys[at]
            hit = seen == keys[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[(seen >= 0) & ~hit]
        return out


class Codec:
    """Tables of a model and the work on batches."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(size)]
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        number = {names[i]: i for i in range(size) if plain[i]}
        for c in sorted({c for p in number for c in p} - number.keys()):
            number[c] = len(names)  # a symbol that can be part of a piece but is none
            names.append(c)
        self.size, self.symbols = size, len(names)
        scores = sorted({model.get_score(number[p]) for p in number if number[p] < size}, reverse=True)
        place = {s: i for i, s in enumerate(scores)}
        self.rank = np.array([place.get(model.get_score(i), 0) if i < size else 0 for i in range(len(names))], np.int64)
        pairs = [(number[p[:k]] * self.symbols + number[p[k:]], i) for p, i in number.items() if i < size for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.table = PairTable(np.array([k for k, _ in pairs], np.int64), np.array([v for _, v in pairs], np.int32))
        self.start = np.full(0x110000, -1, np.int32)
        for p, i in number.items():
            if len(p) == 1:
                self.start[ord(p)] = i
        self.mark = number[MARK]
        self.start[0x20], self.start[ord(MARK)] = self.mark, -1
        raw = [bytes([int(names[i][3:5], 16)]) if i < size and model.is_byte(i) else names[i].replace(MARK, " ").encode() if i < size and plain[i] else b"" for i in range(size)]
        self.buffer = np.frombuffer(b"".join(raw) or b" ", np.uint8)
        self.lengths = np.array([len(x) for x in raw], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def candidates(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Agenda keys (rank, then place) and pieces of pairs of symbols; NEVER where they make no piece."""
        known = (left >= 0) & (right >= 0)
        piece = self.table.find(np.where(known, left.astype(np.int64) * self.symbols + right, -2))
        return np.where(piece >= 0, (self.rank[piece] << 32) | at, NEVER), piece

    def stretches(self, texts: list[str]) -> list[tuple[int, str, int]]:
        """(number of the text, marked stretch, words before it), stretches ending between words."""
        out = []
        for i, text in enumerate(texts):
            if not text:
                continue
            text, start, words = " " + text, 0, 0
            while start < len(text):
                end = len(text)
                if end - start > STRETCH and (cut := WORD_START.search(text, start + STRETCH)):
                    end = cut.start()
                part = text[start:end]
                out.append((i, part, words))
                if end < len(text):
                    words += len(WORD_START.findall(part)) + 1
                start = end
        return out

    def encode(self, texts: list[str], doc_ids: list[int], seed: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each text's ids start; one more at the end)."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        run: list[tuple[int, str, int]] = []
        size = 0
        for item in [*self.stretches(texts), None]:
            if run and (item is None or size + len(item[1]) > STRETCH):
                ids, ends = self.run([p for _, p, _ in run], [doc_ids[i] for i, _, _ in run], [w for _, _, w in run], seed, rate)
                for (i, _, _), a, b in zip(run, [0, *ends[:-1]], ends, strict=True):
                    parts[i].append(ids[a:b])
                run, size = [], 0
            if item:
                run.append(item)
                size += len(item[1])
        counts = [sum(map(len, p)) for p in parts]
        flat = [x for p in parts for x in p]
        return np.concatenate(flat) if flat else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)

    def run(self, stretches: list[str], doc_ids: list[int], words_before: list[int], seed: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of marked stretches and where each ends."""
        points = np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32).astype(np.int64)
        n = len(points)
        symbol = np.append(self.start[points], -1)
        ends = np.cumsum([len(x) for x in stretches])
        begin = np.concatenate([[0], ends[:-1]])
        blank = points == 0x20
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[begin] = True
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, n))
        owner = np.searchsorted(begin, starts, side="right") - 1
        ordinal = np.arange(len(starts)) - np.searchsorted(starts, begin)[owner] + np.array(words_before)[owner]
        keys = mix64(np.array(doc_ids, np.int64).astype(np.uint64)[owner] * np.uint64(C1) + np.uint64(seed))
        keys = mix64(keys ^ (ordinal.astype(np.uint64) * np.uint64(C3)))
        limit = np.uint64(min(2**64 - 1, int(rate * 2**64)))

        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[np.append(starts[1:] - 1, n - 1)] = n  # n: no neighbour
        before = np.append(before, n)[: n + 1]
        before[starts] = n
        gone = np.zeros(n + 1, bool)
        cand, piece = self.candidates(symbol[:n], symbol[np.minimum(after[:n], n)], np.arange(n))
        cand, piece = np.append(cand, NEVER), np.append(piece, -1)

        short = lengths <= LONG
        for u in np.flatnonzero(~short):
            self._heap(symbol, gone, int(starts[u]), int(starts[u] + lengths[u]), int(keys[u]), int(limit))
        at, size, key = starts[short], lengths[short], keys[short]
        place = np.flatnonzero(np.repeat(short, lengths))
        while len(at):
            best = np.minimum.reduceat(cand[place], np.concatenate([[0], np.cumsum(size)[:-1]]))
            live = best < NEVER
            if live.sum() < 0.75 * len(at):
                place = place[np.repeat(live, size)]
                at, size, key, best = at[live], size[live], key[live], best[live]
                live = np.ones(len(at), bool)
                if not len(at):
                    break
            p = (best & np.int64(0xFFFFFFFF))[live]
            m = piece[p]
            h = mix64(key[live] ^ ((p - at[live]).astype(np.uint64) * np.uint64(C1) + m.astype(np.uint64) * np.uint64(C2)))
            skip = h < limit
            cand[p[skip]] = NEVER
            p, m = p[~skip], m[~skip]
            q = after[p]
            r, left = after[q], before[p]
            symbol[p], gone[q], after[p], cand[q] = m, True, r, NEVER
            before[r] = p
            before[n], after[n] = n, n
            cand[p], piece[p] = self.candidates(m, symbol[r], p)
            c, x = self.candidates(symbol[left], m, left)
            cand[left], piece[left] = c, x
            cand[n], symbol[n] = NEVER, -1
        return self._ids(symbol[:n], gone[:n], points, ends)

    def _heap(self, symbol: np.ndarray, gone: np.ndarray, start: int, end: int, key: int, limit: int) -> None:
        """The agenda of one long word, places start to end."""
        own, whole = symbol[start:end].tolist(), 2**64 - 1
        n = len(own)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        find = {}

        def push(i: int, j: int) -> None:
            if own[i] < 0 or own[j] < 0:
                return
            k = own[i] * self.symbols + own[j]
            if (m := find.get(k)) is None:
                m = find[k] = int(self.table.find(np.array([k], np.int64))[0])
            if m >= 0:
                heapq.heappush(agenda, (int(self.rank[m]), i, m, own[i], own[j]))

        agenda: list[tuple] = []
        for i in range(n - 1):
            push(i, i + 1)
        while agenda:
            _, i, m, a, b = heapq.heappop(agenda)
            j = after[i] if own[i] == a else n
            if j >= n or own[j] != b or gone[start + i]:
                continue
            x = key ^ ((i * C1 + m * C2) & whole)
            x = ((x ^ (x >> 30)) * C2) & whole
            x = ((x ^ (x >> 27)) * C3) & whole
            if x ^ (x >> 31) < limit:
                continue
            own[i], own[j], gone[start + j] = m, -1, True
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                push(i, after[j])
            if before[i] >= 0:
                push(before[i], i)
        symbol[start:end] = own

    def _ids(self, symbol: np.ndarray, gone: np.ndarray, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces become the pieces of their UTF-8 bytes."""
        stay = ~gone
        s, cp = symbol[stay].astype(np.int64), points[stay]
        raw = (s < 0) | (s >= self.size)
        count = np.where(raw, 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF), 1)
        to = np.cumsum(count) - count
        ids = np.zeros(int(count.sum()), np.int64)
        ids[to[~raw]] = s[~raw]
        for width, head in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            some = raw & (count == width)
            if some.any():
                for k in range(width):
                    part = cp[some] >> (6 * (width - 1 - k))
                    ids[to[some] + k] = self.byte_ids[part | head if k == 0 else (part & 0x3F) | 0x80]
        upto = np.cumsum(count)
        return ids, upto[np.cumsum(stay)[ends - 1] - 1]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of runs of ids."""
        if not len(ids):
            return [""] * (len(offsets) - 1)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        data = self.buffer[np.repeat(self.offsets[ids] - (ends - lengths), lengths) + np.arange(int(ends[-1]))].tobytes()
        cuts = np.append(0, ends)[offsets]
        return [data[a + 1 : b].decode("utf-8", "replace") if b > a else "" for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def encoded(docs: DataFrame, model_file: str, rate: float = 0.1, seed: int = 17) -> DataFrame:
    """doc_id, ids (array<int>), n_pieces, lossless (decoding the ids gives the text) for each row of docs."""
    codec: list[Codec] = []

    def setup() -> None:
        codec[:] = [Codec(model_file)]

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column("text"))
        doc_ids = [-1 if x is None else x for x in batch.column("doc_id").to_pylist()]
        ids, offsets = codec[0].encode(texts, doc_ids, seed, rate)
        back = codec[0].decode(ids, offsets)
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(np.diff(offsets), pa.int64()), pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_())], ["doc_id", "ids", "n_pieces", "lossless"])

    return map_texts(doc_texts(docs), of_batch, "doc_id long, ids array<int>, n_pieces long, lossless boolean", setup)


def decoded(pieces: DataFrame, model_file: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids: empty."""
    codec: list[Codec] = []

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [x or [] for x in batch.column("ids").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)
        texts = codec[0].decode(np.array([i for x in lists for i in x], np.int64), offsets)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    def setup() -> None:
        codec[:] = [Codec(model_file)]

    return map_texts(pieces.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), of_batch, "doc_id long, text string", setup)
