"""Token counts of texts by a byte-level BPE vocabulary.

Method. Texts are split at safe boundaries: before a single blank between two characters that are not white space. The
pre-tokenizer always starts a new word there and special strings hold no blank, so the counts of the pieces add up to the
count of the whole. Pieces over `LONG` characters (lists of lines, code and writing without blanks) are split again, before any
white space that follows another character, and between a mark of `MARKS` and a letter: a run of marks or letters ends there in
any case. Pieces that the task has not met before go to the library in batches of about `batch_bytes` bytes, and only their
lengths come back and are kept, up to `MOST_BYTES` of pieces. So a text of any length costs one pass, and no encoding is held.
What has no safe boundary, such as a million letters on end, is one word to the library as well and goes to it whole.

Cases. Null text: empty, 0 tokens. Repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from barsmith.llm.common import doc_texts, map_texts, texts_of

#: str.isspace and \s take in more than the pre-tokenizer's white space, so this splits at no unsafe place.
SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Marks that no special string holds, and letters after them.
MARKS, LETTERS = r"""[;,(){}\[\]=。、，！？；：」』）]""", r"[A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3]"
SAFE_TOO = re.compile(rf"(?<=\S)(?=[ \t\n\r\x0b\x0c])|(?<={MARKS})(?={LETTERS})")
LONG, MOST_BYTES = 200, 1 << 25


def pieces_of(text: str) -> list:
    """The text in pieces: strings, which lack the blank before them (but the first does not), and (string,), which lack none."""
    found = SAFE.split(text)
    if max(map(len, found)) <= LONG:
        return found
    out: list = []
    for piece in found:
        if len(piece) <= LONG:
            out.append(piece)
            continue
        parts = SAFE_TOO.split(piece)
        out.append(parts[0])
        out += [(x,) for x in parts[1:]]
    return out


def runs(pieces: list[str], batch_bytes: int) -> Iterator[list[str]]:
    """Batches of about equal size in bytes."""
    run: list[str] = []
    size = 0
    for piece in pieces:
        run.append(piece)
        size += (len(piece) if piece.isascii() else len(piece.encode())) + 8
        if size >= batch_bytes:
            yield run
            run, size = [], 0
    if run:
        yield run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, batch_bytes: int = 1 << 18) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs. vocabulary: a tokenizers .json file on every machine."""
    state: dict = {}

    def setup() -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        state.update(tokenizer=tokenizer, known={"": 0}, size=0)

    def learn(pieces: set, known: dict) -> int:
        """Counts of pieces into known; returns about what they take there in bytes."""
        whole = [(x[0], x) if isinstance(x, tuple) else (" " + x, x) for x in pieces]
        size, at = 0, 0
        for run in runs([x for x, _ in whole], batch_bytes):
            for text, found in zip(run, state["tokenizer"].encode_batch_fast(run, add_special_tokens=False), strict=True):
                known[whole[at][1]] = len(found)
                size += 4 * len(text) + 100
                at += 1
        return size

    def of_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = texts_of(batch.column("text"))
        known = state["known"]
        tokens, first = [], {}
        split = [pieces_of(x) for x in texts]
        learn({(x[0],) for x in split}, first)
        for words in split:
            head, words[0] = words[0], ""
            if missing := set(words).difference(known):
                if state["size"] > MOST_BYTES:
                    known.clear()
                    known[""] = state["size"] = 0
                    missing = set(words) - {""}
                state["size"] += learn(missing, known)
            tokens.append(first[(head,)] + sum(map(known.__getitem__, words)))
        sizes = [len(x.encode()) for x in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return map_texts(doc_texts(docs), of_batch, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", setup)
