"""Personal data in texts: base patterns, and a linear-chain conditional random field that adds spans.

Method. The base patterns find e-mail and IP addresses, card and phone numbers. The field works on words: features are the
shape of a word (letters, digit runs by length, marks), those of its neighbours, and a few cue words; it is trained on the
small labelled table below. Every line of a text is a sequence, and all its words are decoded by Viterbi in padded numpy
batches of lines of like length. What the field labels is added where it overlaps no base span and passes the check of its
kind (digits, Luhn, parts at most 255; 200 characters at most, as the patterns of kinds have no end of their own); besides the four base kinds it adds secrets such as passwords and access tokens.

Memory. Texts come in batches by bytes. A line of any length is decoded in one go: it costs an integer and a back pointer of
one byte a label for each word, and its scores are made for some thousand words at a time.

Cases. Null text: empty, no spans. Offsets are code points, ends exclusive. Digit runs of any length are fine. Repeated rows
give repeated results; an empty table gives an empty result. Extra columns are not read (`personal_data`) or passed through
(`redacted`).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import by_bytes, doc_texts, map_texts, texts_of

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *(f"{x}-{k}" for k in KINDS for x in "BI"))
MASKS = {k: f"<{k}>" for k in KINDS}

# The labelled table, made up. {kind ...} marks a span.
LABELLED = """
write to {email jane dot doe at mail dot com} today
my address is {email john at example dot org} thanks
mail {email info [at] firm [dot] net} for more
contact {email sales (at) shop (dot) com} or call
send it to {email bob.smith at mail dot example dot com} please
reach me at {email anna @ example . org} soon
e-mail {email mary.k @ site.net} now
kontakt {email max punkt muster at firma punkt de} bitte
escribe a {email ana arroba correo punto es} hoy
write {email lee at company.com} if you can
the dot on the map at noon is red
we met at ten and ate at the dot com office
a dot and a dash at the end of the line
look at the dot com boom of those years
point at the dot and then at the line
It was late. At home we slept. At ten we rose.
He ran. At last it rained, at sea. To be at work. At that.
call {phone (555) 123-4567} today
call me on {phone 555-123-4567} or write
tel {phone 020 7946 0958} in office hours
phone: {phone 030 1234567} after six
phone {phone (020) 555-0148} at night
tel. {phone 0049 30 1234567} please
fax {phone 555.123.4567} and mail
mobile {phone 0171-2345678} any time
telefon {phone 089/1234567} ab acht
my number is {phone (212) 555-0177} ok
ring {phone 1-800-555-0199} for help
whatsapp {phone 0034 612 345 678} gracias
cell {phone 555 010 9988} only
pay with {card 4111.1111.1111.1111} please
card {card 4111/1111/1111/1111} was used
my visa is {card 5500.0000.0000.0004} until may
card number {card 4012.8888.8888.1881} was charged
kreditkarte {card 4111_1111_1111_1111} danke
tarjeta {card 4000.0566.5566.5556} hoy
host {ip 192 . 168 . 0 . 1} is down
the server {ip 10 dot 0 dot 0 dot 1} answered
from {ip 172,16,254,1} at night
ping {ip 8[.]8[.]8[.]8} twice
address {ip 192[.]168[.]1[.]20} was blocked
ip {ip 10-0-0-12} on the list
token = {secret "a1b2c3d4e5f60718293a4b5c6d7e8f9012345678"} was set
key = {secret "0f1e2d3c4b5a69788796a5b4c3d2e1f000112233"} in the file
and of Token = {secret "77aa88bb99cc00dd11ee22ff33445566778899aa"} The rest
the secret = {secret 'q9W8e7R6t5Y4u3I2o1P0zXcV'} of it
le de token = {secret "123abc456def789abc012def345abc678def9012"} de la
und der token = {secret "c0ffee00112233445566778899aabbccddeeff01"} die das
y el token = {secret "5566aa77bb88cc99dd00ee11ff2233445566778a"} de los
with {secret password=a1b2c3d4e5f6a7b8c9} set
el {secret password=9f8e7d6c5b4a392817} de
und {secret api_key=A1b2C3d4E5f6G7h8I9} von
the {secret token=zz11yy22xx33ww44vv55} is old
export {secret SECRET=77kk66jj55hh44gg33ff} now
TOKEN = {secret "AA11BB22CC33DD44EE55FF66001122334455AABB"} OF
bearer {secret eyJ0b2tlbiI6ImExYjJjM2Q0In0x2y3z} is needed
token = {secret "11a22b33c44d55e66f77a88b99c00d11e22f33a4"}!!! and
born on 12/05/1999 in town
at 10:45 the train left on 2024-01-31
version 2.0.1 was released
version 2.0 of the licence
the key = value pairs of a token
a password is set and the token is old
the file sha256sum and utf8mb4 and ipv6only words
chapter 12 section 3 page 155
it cost 1,299.00 in 2019
order 700648111 has shipped
a total of 7654321 rows in 12 files
room 101 on floor 3
the years 1990 1991 and 1992 were dry
about 3 of 10 people and 25 % of all
isbn 978-3-16-148410-0 in print
id 8412-77 was lost
section 1.2.3.4.5 of the text
between 100 and 200 of them
copyright 2004 2008 all rights reserved
under the apache license version 2.0
Licensed under CC BY-NC 4.0.
@jane wrote that to @bob
the 21st of may 2020
flight 714 leaves at 6.30 from gate 12
numbers 1 2 3 4 5 6 7 8 9
matrix 10 20 30 40 50 60
lot 1234500067890001 in stock
serial 9876500012340007 on the box
the 5550001112223334, and 7770001112223335. It
see table 4 and figure 12.5 below
The house. And Its owner. To Her it Was Then. Is That so? When. Of Course, He said. You, Too.
Überall größer, Äpfel für schöne Tage. Über Öl und Flüsse. Straße
élève déjà très Être, où ça. École à côté, où même. Été
niño está así. Año. Él también, quién sabrá. Ñandú según más
- one | two | three | four. | Five, |
sea at last, at noon at all. At home at the end at one
find me at example.com or ask around
he is at home.page or at work.site now
look at this.that and the rest
more at www.site.net about it
see it at shop.example.org today
at noon.Then we left at one.
pages 300-400 500 of the book
pages 12-45 and 120-133 1998
from 1990-1995 2000 copies were sold
figures 100-200 300-400 in part two
id 123e4567-e89b-12d3-a456-426614174000 of the row
request 550e8400-e29b-41d4-a716-446655440000 failed
https://example.com/a1b2c3d4e5f6 was moved
see http://site.org/x9y8z7/w6v5u4t3.html for it
read //cdn.site.io/lib/v2.3.1/app-77.js first
model XJ900-42B-77 is in stock
the part AB12-CD34-EF56 fits
unit ZX81/16K/2B of 1982
what*** and### much%%% noise&&& in$$$ here!! THE!! END!!
"""
CUES = frozenset(
    "at dot [at] [dot] (at) (dot) @ . = arroba punto punkt point phone phone: tel tel. telefon fax mobile call cell ring whatsapp number card visa kreditkarte tarjeta ip host ping server address"
    " version order token key secret bearer password lot id isbn mail e-mail email section page serial".split()
)
_CASES = {y.encode(): x for x in sorted(CUES) for y in (x, x.capitalize(), x.upper())}

EMAIL_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
RUN = re.compile(r"d+|x+|X+|u+|.", re.S)
SPELLED = re.compile(r"[\w.+-]+(?:\s(?:dot|punkt|punto)\s[\w+-]+)*\s*[\[(]?\s*(?:@|\bat\b|\barroba\b)\s*[\])]?\s*[\w-]+(?:(?:\.|\s\.\s|\s*[\[(]?\s*\b(?:dot|punkt|punto)\b\s*[\])]?\s*)[\w-]+)+", re.I)
SECRET = re.compile(r"[A-Za-z0-9_+/.-]{12,}")
#: Bytes to shape: letters x or X, digits d, bytes of other characters u, marks and white space as they are.
SHAPE = bytes(120 if 97 <= b <= 122 else 88 if 65 <= b <= 90 else 100 if 48 <= b <= 57 else 117 if b >= 128 else b for b in range(256))
STEP = 4096  # words of a line that are scored at a time


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    """Whether all numbers are at most 255; digit runs may be of any length."""
    return all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in parts)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the address pattern. An at sign ends its run of local characters, so each run is read once."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and EMAIL_LOCAL.match(text, start - 1):
            start -= 1
        match = EMAIL_AT.match(text, at) if start < at else None
        last = match.end() if match else at + 1
        if match:
            found.append((start, last))
        at = text.find("@", last)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    found = [(0, *x) for x in emails(text)] if "@" in text else []
    if any(d in text for d in "0123456789"):
        found += [(1, *m.span()) for m in IP.finditer(text) if octets(m[0].split("."))] if "." in text else []
        for m in CARD.finditer(text):
            if m.end() - m.start() > 15 and 16 <= len(digits := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return found


def word_features(word: bytes) -> list[str]:
    return shape_features(word.translate(SHAPE), _CASES.get(word))


def shape_features(shape: bytes, cue: str | None) -> list[str]:
    """Features of a word by its shape; cue words have their own as well."""
    raw = shape[:4096].decode()
    bare = raw.rstrip(".,;:!?") or raw
    out = []
    for run in RUN.findall(bare[:64]):
        out.append(f"d{len(run) if len(run) < 6 else 6 if len(run) < 9 else 9 if len(run) < 13 else 13}" if run[0] == "d" else run[0])
    digits, letters = raw.count("d"), raw.count("x") + raw.count("X")
    mixed = len(raw) >= 12 and digits >= 3 and letters >= 3 and len(out) >= 6
    found = ["s=mixed" if mixed else f"s={''.join(out)}", f"n={min(digits, 17)}"]
    if mixed:
        found.append(f"q={raw[0] if raw[0] in '=' + chr(34) + chr(39) else ''}{'=' if '=' in raw[1:-1] else ''}")
    if cue is not None:
        found.append(f"w={cue}")
    if "@" in raw:
        found.append("at")
    return found


@dataclass
class Words:
    """Numbers of words by shape and cue, and the weights of each: its own, for the word after and for the word before it."""

    number: dict[bytes, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=lambda: [np.zeros((3, len(LABELS)))])
    size: int = 0
    table: np.ndarray | None = None  # (words, 3, labels)
    gain: np.ndarray | None = None  # (words, 3), the most that any label but O gains over O

    def stack(self) -> None:
        if self.table is None:
            self.table = np.array(self.weights)
            self.gain = (self.table[:, :, 1:] - self.table[:, :, :1]).max(axis=2)


@dataclass
class Field:
    """Weights: own, before and after are for the features of a word, the one before and the one after."""

    place: dict[str, int]
    emit: np.ndarray  # (3, features, labels)
    move: np.ndarray  # (labels, labels)
    first: np.ndarray

    def scores_of(self, shape: bytes, cue: str | None) -> np.ndarray:
        at = [self.place[f] for f in shape_features(shape, cue) if f in self.place]
        return self.emit[:, at].sum(axis=1)

    def plain(self, ids: np.ndarray, lines: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Lines (from one entry of `lines` to the next) whose best path is surely O throughout.

        A word that is not O adds at most the gains of its own weights and its neighbours', one move to it and one back to O.
        """
        if not len(ids):
            return np.ones(len(lines) - 1, bool)
        most = gain[ids, 0]
        most[1:] += gain[ids[:-1], 1]
        most[:-1] += gain[ids[1:], 2]
        stay = self.move[0, 0]
        bonus = max(0.0, self.move[:, 1:].max() - stay, (self.first[1:] - self.first[0]).max()) + max(0.0, self.move[1:, 0].max() - stay)
        return np.maximum.reduceat(most, lines[:-1]) + bonus <= 0

    def numbers(self, data: bytes, words: Words) -> np.ndarray:
        """The numbers of all words of data; words not met before get one. Number 0 is no word."""
        keys = data.translate(SHAPE).split()
        for i, w in enumerate(data.split()):
            if w in _CASES:
                keys[i] = w
        number = words.number
        for key in set(keys).difference(number):
            number[key] = len(words.weights)
            words.weights.append(self.scores_of(key.translate(SHAPE), _CASES[key]) if key in _CASES else self.scores_of(key, None))
            words.size += len(key)
            words.table = None
        return np.fromiter(map(number.__getitem__, keys), np.int32, len(keys))


def labelled() -> list[tuple[list[str], list[int]]]:
    rows = []
    for line in LABELLED.strip().splitlines():
        words, labels = [], []
        for m in re.finditer(r"\{(\w+) ([^}]*)\}([^\s{}]*)|([^\s{}]+)", line):
            inside = (m[2] + m[3]).split() if m[1] else [m[4]]
            words += inside
            labels += [LABELS.index(("B-" if i == 0 else "I-") + m[1]) if m[1] else 0 for i in range(len(inside))]
        rows.append((words, labels))
    return rows


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(steps: int = 150, rate: float = 0.1, penalty: float = 0.02) -> Field:
    """Penalised likelihood by gradient steps (Adam) on the labelled table: some 90 short rows, so on one machine."""
    rows = labelled()
    names = sorted({f for words, _ in rows for w in words for f in word_features(w.encode())})
    place = {f: i for i, f in enumerate(names)}
    n, t, k, size = len(rows), max(len(w) for w, _ in rows), len(LABELS), len(names)
    x = np.zeros((3, n, t, size))
    y, mask = np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (words, labels) in enumerate(rows):
        for j, w in enumerate(words):
            at = [place[f] for f in word_features(w.encode())]
            x[0, i, j, at] = 1
            if j + 1 < len(words):
                x[1, i, j + 1, at] = 1
            if j:
                x[2, i, j - 1, at] = 1
        y[i, : len(words)], mask[i, : len(words)] = labels, True
    flat = x.reshape(3, n * t, size)
    one, lengths = np.eye(k), mask.sum(axis=1)
    gold = one[y] * mask[:, :, None]
    parts = [np.zeros((3, size, k)), np.zeros((k, k)), np.zeros(k)]
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        emit, move, first = parts
        score = (flat @ emit).sum(axis=0).reshape(n, t, k)
        alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
        alpha[:, 0] = score[:, 0] + first
        for j in range(1, t):
            alpha[:, j] = np.where(mask[:, j, None], _logsum(alpha[:, j - 1, :, None] + move, 1) + score[:, j], alpha[:, j - 1])
        for j in range(t - 2, -1, -1):
            beta[:, j] = np.where(mask[:, j + 1, None], _logsum(move + (score[:, j + 1] + beta[:, j + 1])[:, None, :], 2), 0)
        z = _logsum(alpha[:, -1], 1)
        own = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        pairs, gold_pairs = np.zeros((k, k)), np.zeros((k, k))
        for j in range(1, t):
            p = np.exp(alpha[:, j - 1, :, None] + move + (score[:, j] + beta[:, j])[:, None, :] - z[:, None, None])
            pairs += (p * mask[:, j, None, None]).sum(axis=0)
            gold_pairs += np.einsum("na,nb->ab", gold[:, j - 1], gold[:, j])
        slopes = [flat.transpose(0, 2, 1) @ (gold - own).reshape(n * t, k), gold_pairs - pairs, (gold[:, 0] - own[:, 0]).sum(axis=0)]
        for i, (p, s) in enumerate(zip(parts, slopes, strict=True)):
            s = s - penalty * p
            mean[i] = 0.9 * mean[i] + 0.1 * s
            square[i] = 0.99 * square[i] + 0.01 * s * s
            p += rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    assert lengths.all()
    emit, move, first = parts
    move, first = move.copy(), first.copy()
    for b, label in enumerate(LABELS):
        if label[0] == "I":
            first[b] = -1e6
            for a, before in enumerate(LABELS):
                if before[1:] != label[1:]:
                    move[a, b] = -1e6
    return Field(place, emit, move, first)


def viterbi(sequences: list[np.ndarray], table: np.ndarray, field: Field, batch: int = 512) -> list[np.ndarray]:
    """Best labels of each sequence of word numbers; sequences of like length are padded together.

    table: (words, 3, labels), the weights of each word number; those of number 0 are 0.
    """
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(sequences)
    order = sorted((i for i in range(len(sequences)) if len(sequences[i])), key=lambda i: len(sequences[i]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[min(at + batch, len(order)) - 1]])
        some = order[at : at + max(1, min(batch, (1 << 18) // longest))]
        at += len(some)
        lengths = np.array([len(sequences[i]) for i in some])
        n, t, k = len(some), int(lengths.max()), len(LABELS)
        ids = np.zeros((n, t + 2), np.int32)
        for row, i in enumerate(some):
            ids[row, 1 : len(sequences[i]) + 1] = sequences[i]
        back = np.zeros((t, n, k), np.int8)
        best = np.zeros((n, k))
        for start in range(0, t, STEP):
            part = ids[:, start : min(start + STEP, t) + 2]
            score = table[part[:, 1:-1], 0] + table[part[:, :-2], 1] + table[part[:, 2:], 2]
            for j in range(start, start + score.shape[1]):
                x = score[:, j - start]
                if j == 0:
                    best = x + field.first
                    continue
                step = best[:, None, :] + field.move.T
                back[j] = step.argmax(axis=2)
                best = np.where((j < lengths)[:, None], step.max(axis=2) + x, best)
        label, rows = best.argmax(axis=1), np.arange(n)
        path = np.zeros((n, t), np.int8)
        for j in range(t - 1, -1, -1):
            path[:, j] = label
            if j:
                label = np.where(j < lengths, back[j, rows, label], label)
        for row, i in enumerate(some):
            out[i] = path[row, : len(sequences[i])]
    return out


def plausible(kind: str, span: str) -> bool:
    if len(span) > 200:
        return False
    digits = re.sub(r"[^0-9]", "", span)
    if kind == "email":
        return bool(SPELLED.fullmatch(span))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", span)
        return len(parts) == 4 and octets(parts)
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "secret":
        return bool(SECRET.fullmatch(span)) and len(digits) >= 3 and bool(re.search("[A-Za-z]", span))
    return 8 <= len(digits) <= 15 and bool(re.search(r"[0-9][\s().+/-]+[0-9]", span))


def places(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text in code points, and where each line's words begin among them."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    word = np.concatenate([[False], ~((points == 32) | ((points >= 9) & (points <= 13))), [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    lines = np.unique(np.searchsorted(starts, np.flatnonzero(points == 10)))
    return starts, ends, np.unique(np.concatenate([[0], lines, [len(starts)]]))


def added(text: str, base: list[tuple[int, int, int]], starts: np.ndarray, ends: np.ndarray, labels: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Spans that the labels of the words of a text add to its base spans."""
    taken: list[list[int]] = []  # what is covered, as disjoint stretches in order
    for _, a, b in sorted(base, key=lambda x: x[1:]):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    for first in np.flatnonzero(labels % 2 == 1):  # B of any kind
        kind, last = KINDS[labels[first] // 2], first + 1
        while last < len(labels) and labels[last] == labels[first] + 1:
            last += 1
        start, end = int(starts[first]), int(ends[last - 1])
        if kind == "secret":  # the value alone, without name, quotes and marks
            found = max(SECRET.finditer(text, start, end), key=lambda m: m.end() - m.start(), default=None)
            start, end = found.span() if found else (end, end)
        while end > start and text[end - 1] in ".,;:!?\"'":
            end -= 1
        at = bisect_left(taken, [end])  # the stretch before it is the only one that may reach in
        if end > start and plausible(kind, text[start:end]) and (at == 0 or taken[at - 1][1] <= start):
            taken.insert(at, [start, end])
            yield KINDS.index(kind), start, end


def scan(texts: list[str], field: Field, words: Words) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text, each as (kind number, start, end) by kind, then start."""
    if len(words.weights) > 100_000 or words.size > 1 << 24:
        words.__init__()
    spots, hard = [], []
    for text in texts:
        starts, ends, lines = places(text)
        some = [field.numbers(text[starts[a] : ends[min(a + (1 << 16), len(starts)) - 1]].encode(), words) for a in range(0, len(starts), 1 << 16)]
        spots.append((starts, ends, lines, np.concatenate(some) if some else np.zeros(0, np.int32)))
    words.stack()
    for i, (_, _, lines, ids) in enumerate(spots):
        open_ = ~field.plain(ids, lines, words.gain)
        hard += [(i, a, b) for a, b in zip(lines[:-1][open_], lines[1:][open_], strict=True)]
    found = [(base_spans(text), []) for text in texts]
    for (i, a, b), labels in zip(hard, viterbi([spots[i][3][a:b] for i, a, b in hard], words.table, field), strict=True):
        if labels.any():
            base, more = found[i]
            more += added(texts[i], base, spots[i][0][a:b], spots[i][1][a:b], labels)
    return [(base, sorted(more)) for base, more in found]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base and spans (kind:start:end, comma-joined), n_added."""
    field, words = train(), Words()

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scan(texts_of(batch.column("text")), field, words)
        counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in found], pa.int64()) for kind in range(4)]
        columns = [batch.column("doc_id"), *counts, pa.array([_joined(b) for b, _ in found], pa.string()), pa.array([_joined(sorted(b + a)) for b, a in found], pa.string()), pa.array([len(a) for _, a in found], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base", "spans", "n_added"])

    return map_texts(doc_texts(docs), of_batch, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_added long")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each found span replaced by a mask such as <email>, and n_chars, where there, counted anew."""
    field, words = train(), Words()

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column("text").to_pylist()
        out = []
        for value, (base, added) in zip(values, scan(["" if x is None else x for x in values], field, words), strict=True):
            last, parts = 0, []
            for start, end, kind in sorted((a, b, k) for k, a, b in base + added):
                if end <= last:
                    continue
                parts += [value[last : max(start, last)], MASKS[KINDS[kind]]]
                last = end
            out.append(value if not parts else "".join([*parts, value[last:]]))
        at = batch.schema.get_field_index("text")
        return batch.set_column(at, batch.schema.field(at), pa.array(out, batch.column("text").type))

    done = docs.mapInArrow(lambda batches: (of_batch(part) for b in batches for part in by_bytes(b)), docs.schema)
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done
