"""Operators against versions that share no code with them: merge-dropout, spot signatures, foreign archives."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F

from barsmith.llm import pieces, spots, warc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WHOLE = 2**64 - 1


def mixed(x):
    """The finisher of splitmix64, in plain integers."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & WHOLE
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & WHOLE
    return x ^ (x >> 31)


def plain_pieces(model, text, doc_id, seed, rate):
    """Ids of a text: in each word the best pair that is a piece and not dropped is merged, until there is none."""
    golden, two, three = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
    limit, out = min(WHOLE, int(rate * 2**64)), []
    special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    known = lambda p: (i := model.piece_to_id(p)) != model.unk_id() and not special(i) and model.id_to_piece(i) == p
    key = mixed((doc_id * golden + seed) & WHOLE)
    for ordinal, word in enumerate(regex.findall(r" +[^ ]*|[^ ]+", " " + text) if text else []):
        own = mixed(key ^ (ordinal * three & WHOLE))
        parts, at = [("▁" if c == " " else None if c == "▁" else c) for c in word], list(range(len(word)))
        while True:
            found = []
            for k in range(len(parts) - 1):
                if parts[k] is None or parts[k + 1] is None or not known(parts[k] + parts[k + 1]):
                    continue
                m = model.piece_to_id(parts[k] + parts[k + 1])
                if mixed(own ^ ((at[k] * golden + m * two) & WHOLE)) >= limit:
                    found.append((-model.get_score(m), at[k], k))
            if not found:
                break
            k = min(found)[2]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del at[k + 1]
        for p, i in zip(parts, at, strict=True):
            out += [model.piece_to_id(p)] if p is not None and known(p) else [model.piece_to_id(f"<0x{b:02X}>") for b in word[i].encode()]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_merge_dropout(rate):
    rng, codec, model = random.Random(3), pieces.Codec(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    bits = ["the", "tion", "ing", " ", "  ", "über", "日本", "x", "▁", "\n", "ß", "🎉", "a", "straße", ".", "1", "q\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(80)] + ["", " ", "internationalization " * 3, "n" * 90]
    ids, at = codec.encode(texts, list(range(len(texts))), 17, rate)
    for i, text in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == plain_pieces(model, text, i, 17, rate), (i, text)


def plain_chains(text):
    """(anchors and one content word, the next content word) of each chain, word by word; the last token is always content.

    Anchors and words are set apart by one blank where a mark stands between them, by two where none does.
    """
    tokens, gap = [(".", "")], " "  # (token, blanks before it)
    for found in regex.finditer(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+", text.lower().strip(" ")):
        run = found[0]
        if regex.match(r"[\p{L}\p{N}]", run):
            tokens.append((run, gap))
        elif stop := next((c for c in run if c in ".!?;:\n。！？；"), None):
            tokens.append((stop, " "))
            gap = " "
        else:
            gap = "  " if len(tokens) > 1 else " "
    chunks, before = [], []
    for i, (t, gap) in enumerate(tokens):
        before.append((t, gap))
        if i == len(tokens) - 1 or not (t in spots.ANCHORS or not regex.match(r"[\p{L}\p{N}]", t)):
            chunks.append(("".join(g + x for x, g in before)[len(before[0][1]) :], t, len(before)))
            before = []
    return {(c, chunks[k + 1][1] if k + 1 < len(chunks) else "") for k, (c, _, n) in enumerate(chunks) if n > 1}


def test_spot_signatures(spark, docs_of):
    """Signatures are the hashes of the chains that a plain loop finds, and nothing else; likeness is their Jaccard index."""
    rng = random.Random(8)
    words = ["the", "a", "der", "die", "sea", "hill", "Über", "straße", "x1", "7", ".", "!", "\n", ", ", "—", "日本", "。", "of", "THE", "..?", " "]
    texts = ["", "...", "the of", "word", "the word"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    got = {r.doc_id: r.spots for r in spots.fingerprints(docs_of([(i, t, "en", "a") for i, t in enumerate(texts)])).collect()}
    chains = [(i, c, n) for i, t in enumerate(texts) for c, n in plain_chains(t)]
    want = {i: set() for i in range(len(texts))}
    for r in spark.createDataFrame(chains, "i int, c string, n string").select("i", F.xxhash64("c", "n").alias("h")).collect():
        want[r.i].add(r.h)
    assert {i: set(s) for i, s in got.items()} == want and all(s == sorted(set(s)) for s in got.values())
    pairs = [(rng.choice(texts), rng.choice(texts)) for _ in range(100)]
    frame = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    near = {r.k: r.x for r in frame.select("k", spots.likeness(spots.signatures(F.col("a")), spots.signatures(F.col("b"))).alias("x")).collect()}
    for k, (a, b) in enumerate(pairs):
        x, y = plain_chains(a), plain_chains(b)
        assert near[k] == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)


def archive(payloads, segmented=False):
    """Records as another writer makes them: one segment each, whatever its size."""
    out = ""
    for i, p in enumerate(payloads):
        data = p.encode()
        out += f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <r{i}>\r\nX-Page-ID: {i}\r\nX-Payload-Length: {len(data)}\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(data).hexdigest()}\r\n"
        out += f"Content-Length: {len(data) + 19}\r\n\r\nHTTP/1.1 200 OK\r\n\r\n{p}\r\n\r\n"
    return out


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
def test_foreign_records_come_in_chunks(size):
    """One record of one segment is many rows, each of `size` bytes but the last, with digests that go on."""
    rng = random.Random(size)
    payloads = ["", "a", "line\n" * 200, "x" * 1000, "".join(rng.choice("ab\n\réß ") for _ in range(700)), "y" * 100, "WARC/1.1\r\n\r\n" * 20]
    reader = warc.Reader(True, size)
    for line in archive(payloads).split("\n")[:-1]:
        reader.line(line)
    reader.close()
    for i, p in enumerate(payloads):
        rows, data = [r for r in reader.rows if r[1] == i], p.encode()
        assert b"".join(r[5] for r in rows) == data and [r[4] for r in rows] == list(range(1, len(rows) + 1))
        assert all(len(r[5]) == size for r in rows[:-1]) and len(rows) == max(1, -(-len(data) // size))
        upto = np.cumsum([len(r[5]) for r in rows]).tolist()
        assert [(r[6], r[7]) for r in rows] == [(n, hashlib.sha256(data[:n]).hexdigest()) for n in upto]
        assert [r[8] for r in rows] == [False] * (len(rows) - 1) + [True] and all(r[9] for r in rows)


def test_foreign_archive_through_spark(spark, tmp_path):
    import gzip

    payloads = ["z\n" * 5000, "short"]
    with gzip.open(tmp_path / "a.warc.gz", "wb") as f:
        f.write(archive(payloads).encode())
    rows = warc.read_archives(spark, f"file://{tmp_path}", chunk_bytes=1000).orderBy("page_id", "chunk").collect()
    assert [r.chunk for r in rows] == [*range(1, 11), 1] and b"".join(r.payload for r in rows[:10]).decode() == payloads[0]
    assert {r.page_id: r.chunks for r in warc.page_records(warc.read_archives(spark, f"file://{tmp_path}", False, 1000)).collect()} == {0: 10, 1: 1}


def plain_class(c):
    """Character class of a code point, by its properties."""
    for name, holds in (("lower", c.islower()), ("upper", c.isupper()), ("other letter", c.isalpha()), ("digit", c.isdigit()), ("line end", c == "\n"), ("blank", c.isspace()), ("stop", c in ".!?…"),
                        ("pause", c in ",;:'\"()-–’«»¿¡"), ("symbol", c in "#*$%&|<>{}[]=+~^_\\/@`")):
        if holds:
            return name
    return "rest"


def plain_histograms(text):
    from collections import Counter

    from barsmith.llm.quality import WORDS

    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    known = Counter()
    for w in words:
        w = w[1:] if w[0] in "(\"'" else w
        w = w[:-1] if w and w[-1] in ".,;:!?)\"'" else w
        w = (w if w.isascii() else w.strip("«»“”„¿¡…")).lower()
        known[w if w in WORDS else None] += 1
    return Counter(map(plain_class, text)), known, words


def shannon(p, q):
    """Jensen-Shannon distance of two counters, base 2, by the definition."""
    a, b, out = sum(p.values()), sum(q.values()), 0.0
    for k in {*p, *q}:
        x, y = p[k] / a, q[k] / b
        m = (x + y) / 2
        out += (x * np.log2(x / m) if x else 0) / 2 + (y * np.log2(y / m) if y else 0) / 2
    return max(0.0, out) ** 0.5


def test_distances_to_references(docs_of):
    """Both distances of every document, thick and thin references, from loops over characters and words."""
    from collections import Counter

    from barsmith.llm.quality import quality

    rng = random.Random(4)
    common = {"en": "the of and to in", "de": "der die und den von", "es": "de la que el en"}

    def prose(lang, n):
        return " ".join(rng.choice(common[lang].split()) if rng.random() < 0.4 else "".join(rng.choices("abcdeÄéß1.,(#", k=5)) for _ in range(n)) + rng.choice([".", "!\n", ""])

    rows = [(i, prose(lang, rng.randint(5, 90)), lang if i % 9 else None, "a") for i, lang in enumerate(rng.choices(["en", "de", "es"], [6, 5, 1], k=90))] + [(200, "#$% " * 60, "en", "a"), (201, "", "de", "a"), (202, None, None, "a")]
    found = {r.doc_id: r for r in quality(docs_of(rows), min_reference=600).collect()}
    refs, size, hists = {}, Counter(), {}
    for d, text, lang, _ in rows:
        chars, known, words = hists[d] = plain_histograms(text or "")
        if not found[d].base_failed:
            c, w = refs.setdefault(lang, (Counter(), Counter()))
            c.update(chars)
            w.update(known)
            size[lang] += len(words)
    thick = [x for x in refs if x is not None and size[x] >= 600]
    assert len(thick) == 2 and len(refs) == 4
    for d, text, lang, _ in rows:
        chars, known, words = hists[d]
        if not words:
            continue
        tried = [lang] if lang in thick else [lang, *thick]
        c, w = (min(shannon(h, refs[x][i]) for x in tried if x in refs) for i, h in enumerate((chars, known)))
        r = found[d]
        assert (r.char_distance, r.word_distance) == pytest.approx((c, w), abs=1e-9), d
        odd = (sum(chars.values()) >= 200 and c > 0.22) or (len(words) >= 50 and w > 0.2 + 1.25 / len(words) ** 0.5)
        assert r.kept == (not r.base_failed and not odd)
    assert not found[200].kept
