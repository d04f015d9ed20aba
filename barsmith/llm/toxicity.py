"""Toxicity by compression distance: one zstandard dictionary trained on toxic text, one on ordinary text.

Method. From a bounded sample of labelled documents, zstandard trains a dictionary on windows of ordinary documents and one
on toxic text. Documents labelled toxic are mostly ordinary prose, so their toxic text is taken to be the words that begin
like a stem which toxic documents hold significantly more often (`evidence_stems`; only the choice of training text, no
score, uses them). Both dictionaries go before the same base, trained on ordinary text, so ordinary words compress alike
with both. Every text is cut into windows of `WINDOW` words, all words in; what each window gains in bytes with the toxic
dictionary is evidence: the log ratio of how often windows of toxic and ordinary documents gain as much, summed over the
windows. A logistic curve turns the sum into a score. Ratios, curve and the size of the two dictionaries are calibrated on
sampled documents that the dictionaries have not seen.

Labels are used only from rows that `held_out` is false for; language, source and doc_id are no inputs of a score.

Cases. Null text: empty, no windows, the score of no evidence. Null labels are not used. Without labels every score is 0.5;
with labels of one class only it nears the share of toxic rows. A document labelled more than once counts as often. Repeated
rows give repeated results; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import doc_texts, map_texts, texts_of

WINDOW = 6  # words
LEAST = 3  # letters of a stem
GAINS = 12  # gains are told apart from -GAINS to GAINS bytes
SIZES = (600, 1200, 2400, 4000)  # bytes of a dictionary to choose from
BASE = 8000  # bytes of the base
EDGES = ".,;:!?#%$&*\"'()|"
PARAMETERS = dict(strategy=zstd.STRATEGY_GREEDY, min_match=4, window_log=14, hash_log=14, chain_log=14, search_log=6, write_content_size=False, write_checksum=False, write_dict_id=False)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def windows(text: str) -> list[bytes]:
    """All words of a text, WINDOW at a time."""
    words = text.lower().split()
    return [f" {' '.join(words[i : i + WINDOW])} ".encode() for i in range(0, len(words), WINDOW)]


@dataclass
class Model:
    toxic: bytes  # contents of the dictionaries
    ordinary: bytes
    ratios: np.ndarray  # evidence by gain
    weights: np.ndarray

    def compressors(self) -> list[zstd.ZstdCompressor]:
        out = []
        for content in (self.ordinary, self.toxic):
            parameters, words = zstd.ZstdCompressionParameters(**PARAMETERS), zstd.ZstdCompressionDict(content or b" ", dict_type=zstd.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=parameters)
            out.append(zstd.ZstdCompressor(compression_params=parameters, dict_data=words))
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        x = self.inputs(evidence)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))

    @staticmethod
    def inputs(evidence: np.ndarray) -> np.ndarray:
        return np.stack([np.ones(len(evidence)), np.clip(evidence, -8, 24) / 4], axis=1)


def gains(text: str, compressors: list[zstd.ZstdCompressor]) -> np.ndarray:
    """How many windows gain so many bytes, from -GAINS to GAINS."""
    ordinary, toxic = (c.compress for c in compressors)
    found = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)], int)
    return np.bincount(np.clip(found, -GAINS, GAINS) + GAINS, minlength=2 * GAINS + 1)


def stems(text: str, share: float) -> set[str]:
    """Starts of words, 3 to 12 characters, that at least `share` of the words of a text have."""
    words = [w for x in text.lower().split() if len(w := x.strip(EDGES)) >= LEAST]
    found = Counter(w[:n] for w in words for n in range(LEAST, min(12, len(w)) + 1))
    return {w for w, n in found.items() if n >= share * len(words)}


def fresh(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """rows without the words in runs of five that an earlier text holds: copies and shared passages teach once."""
    seen: set[int] = set()
    out = []
    for text, label in rows:
        words = text.split()
        own = [hash(tuple(words[i : i + 5])) for i in range(len(words) - 4)]
        keep = np.ones(len(words), bool)
        for i, h in enumerate(own):
            if h in seen:
                keep[i : i + 5] = False
        seen.update(own)
        out.append((" ".join(w for w, k in zip(words, keep, strict=True) if k), label))
    return out


def evidence_stems(rows: list[tuple[str, int]], least: float, share: float = 0.003) -> list[str]:
    """Stems that toxic documents hold more often than ordinary ones by at least `least` standard errors.

    A document holds a stem if at least `share` of its words have it. Of stems that start alike the one with the most
    evidence stays, the shorter one of equals; it is then drawn out to the letters that nearly all its toxic documents go on
    with.
    """
    held, n = (Counter(), Counter()), [0, 0]
    for text, label in rows:
        n[label] += 1
        held[label].update(stems(text, share))
    if not n[0] or not n[1]:
        return []

    def evidence(w: str) -> float:
        a, b = held[1][w], held[0][w]
        p = (a + b) / (n[0] + n[1])
        return (a / n[1] - b / n[0]) / math.sqrt(p * (1 - p) * (1 / n[0] + 1 / n[1]) + 1e-12)

    found: list[str] = []
    for e, _, w in sorted((-evidence(w), len(w), w) for w in held[1] if held[1][w] >= 5):
        if -e < least:
            break
        if any(w.startswith(x) or x.startswith(w) for x in found):
            continue
        while longer := [x for x in held[1] if len(x) == len(w) + 1 and x.startswith(w) and held[1][x] >= 0.85 * held[1][w]]:
            w = longer[0]
        found.append(w)
    return found


def trained(samples: list[bytes], size: int, segment: int = 12) -> bytes:
    """The last `size` bytes of the content of a zstandard dictionary trained on samples; its best segments stand last."""
    try:
        return zstd.train_dictionary(size + 3000, samples, k=segment, d=8).as_bytes()[-size:]
    except zstd.ZstdError:  # too few samples: they are the dictionary
        return b"".join(dict.fromkeys(samples))[-size:]


def fit(rows: list[tuple[str, int]], least: float = 5.0) -> Model:
    """Dictionaries from every second row, calibration on the others."""
    learn, calibrate = rows[::2], rows[1::2]
    learn = fresh(learn)
    starts = tuple(evidence_stems(learn, least))
    # Twice, as zstandard counts runs of eight bytes within a sample.
    toxic = [f" {w} {w} ".encode() for text, label in learn if label == 1 and starts for w in text.lower().split() if w.startswith(starts)]
    ordinary = [w for text, label in learn if label == 0 for w in windows(text)]
    base = trained(ordinary[::3], BASE, 24)
    y = np.array([label for _, label in calibrate], float)
    tried = [calibrated(trained(toxic, size) + base, trained(ordinary[1::3], size) + base, calibrate, y) for size in SIZES]
    return max(tried, key=lambda x: x[0])[1]


def calibrated(toxic: bytes, ordinary: bytes, rows: list[tuple[str, int]], y: np.ndarray) -> tuple[float, Model]:
    """Penalised log likelihood of the labels y of rows, and the model with ratios and curve fitted to them."""
    model = Model(toxic, ordinary, np.zeros(2 * GAINS + 1), np.zeros(2))
    compressors = model.compressors()
    counts = np.array([gains(text, compressors) for text, _ in rows], int).reshape(len(rows), 2 * GAINS + 1)
    sums = [counts[y == k].sum(axis=0) + 0.5 if (y == k).any() else np.ones(2 * GAINS + 1) for k in (1, 0)]
    model.ratios = np.log(sums[0] / sums[0].sum()) - np.log(sums[1] / sums[1].sum())
    x = model.inputs(counts @ model.ratios) if len(y) else np.zeros((0, 2))
    for _ in range(25):  # Newton steps
        p = 1 / (1 + np.exp(-x @ model.weights))
        slope = x.T @ (y - p) - 0.1 * model.weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        model.weights = model.weights + np.linalg.solve(curve, slope)
    p = np.clip(model.score(counts @ model.ratios), 1e-9, 1 - 1e-9) if len(y) else np.zeros(0)
    return float((y * np.log(p) + (1 - y) * np.log(1 - p)).sum() - 0.05 * model.weights @ model.weights), model


def sample(docs: DataFrame, labels: DataFrame, most: int, chars: int) -> list[tuple[str, int]]:
    """At most `most` labelled rows of each class, of texts up to `chars` long, in keyed order of doc_id, to the driver."""
    rows = []
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(~held_out())
    for label in (0, 1):
        ids = usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        found = doc_texts(docs).filter(F.length("text") <= chars).join(F.broadcast(ids), "doc_id").select("doc_id", "text", "toxic")
        found = found.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(most)  # a doc_id may have several rows
        rows += [(keyed(r.doc_id), r.text, r.toxic) for r in found.collect()]
    return [(text, toxic) for _, text, toxic in sorted(rows)]


def keyed(doc_id: int) -> int:
    """A fixed shuffle of doc_id, for the order of the sample."""
    return (doc_id * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & (2**64 - 1)


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, sample_chars: int = 40_000, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    sample_rows and sample_chars bound what the dictionaries are fitted on: rows of each class, and the length of their texts.
    """
    model = fit(sample(docs, labels, sample_rows, sample_chars))
    compressors: list = []

    def setup() -> None:
        compressors[:] = model.compressors()

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        evidence = np.array([gains(t, compressors) @ model.ratios for t in texts_of(batch.column("text"))])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(evidence), pa.float64())], ["doc_id", "score"])

    scored = map_texts(doc_texts(docs), of_batch, "doc_id long, score double", setup)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
