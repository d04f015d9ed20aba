"""Personal data, pieces, toxicity, fingerprints and the join against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from barsmith.llm import ngramjoin, pieces, pii, spots, toxicity
from barsmith.llm.components import components

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(d[::-1])) % 10 == 0


def base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and luhn(d) or kind == "phone" and 8 <= len(d) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PERSONAL = [
    "a@b@c.com x@y.z@w.q +1 (555) 555-5555 +12 1.2.3.4.5 999.1.1.1 4111 1111 1111 1111 a@b..c 4111-1111-1111-1111-1", "+1234567890123456 +1 23 1.1.1.1.1.1.1.1 @a.b a.b@c.d.e,f@g.h",
    "🎉 é jane@x.org 10.0.0.1, card 4111111111111111.", "9" * 3000 + " " + "a" * 3000 + "@", "write jane dot doe at mail dot com or call (555) 123-4567 today", "card 4111.1111.1111.1111 was used",
]


def test_personal_data(docs_of, odd_rows):
    rows = odd_rows + [(100 + i, x, "en", "a") for i, x in enumerate(PERSONAL)]
    got = pii.personal_data(docs_of(rows)).collect()
    want = Counter((d, ",".join(base(x or ""))) for d, x, *_ in rows)
    assert Counter((r.doc_id, r.base) for r in got) == want
    by = {r.doc_id: r for r in got}
    for r in got:
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(",")) and r.n_email == r.base.count("email")
    assert by[104].n_added == 2 and by[105].n_added == 1
    text = PERSONAL[4]
    assert {text[int(a) : int(b)] for _, a, b in (s.split(":") for s in by[104].spans.split(","))} == {"jane dot doe at mail dot com", "(555) 123-4567"}
    masked = {r.doc_id: r for r in pii.redacted(docs_of(rows)).collect()}
    assert masked[104].text == "write <email> or call <phone> today" and masked[104].url == "u" and masked[104].n_chars == len(masked[104].text)
    assert masked[1].text is None and masked[7].text == "the same words again"


def stacked(field, lines):
    words = pii.Words()
    ids = [field.numbers(x.encode(), words) for x in lines]
    words.stack()
    return ids, words


def test_field_learns_its_table():
    field = pii.train()
    rows = pii.labelled()
    ids, words = stacked(field, [" ".join(w) for w, _ in rows])
    paths = pii.viterbi(ids, words.table, field, batch=7)
    assert sum(list(p) != y for p, (_, y) in zip(paths, rows, strict=True)) <= 2


def test_viterbi_against_enumeration(monkeypatch):
    """The best path among all label sequences, with scores made for two words at a time; plain lines are surely O."""
    import itertools

    field, rng = pii.train(), random.Random(5)
    some = ["the", "at", "dot", "=", "token", '"12ab34cd56ef78ab90"', "(555)", "123-4567", "Sea,", "10"]
    lines = [" ".join(rng.choice(some) for _ in range(n)) for n in (1, 2, 3, 4, 4, 5, 5)]
    ids, words = stacked(field, lines)
    monkeypatch.setattr(pii, "STEP", 2)
    keep = [0, 1, 2, 7, 8, 9, 10]  # labels to enumerate: O, email, phone, secret
    table = np.full_like(words.table, -1e5)
    table[:, :, keep] = words.table[:, :, keep]
    table[0] = 0
    for line, path in zip(ids, pii.viterbi(ids, table, field, batch=3), strict=True):

        def total(y):
            own = sum(table[w, 0, k] for w, k in zip(line, y, strict=True)) + field.first[y[0]]
            own += sum(table[line[j - 1], 1, y[j]] + field.move[y[j - 1], y[j]] for j in range(1, len(y)))
            return own + sum(table[line[j + 1], 2, y[j]] for j in range(len(y) - 1))

        assert total(path) == pytest.approx(max(map(total, itertools.product(keep, repeat=len(line)))))
    plain = "\n".join(["the sea and the land", "token of it", "x = 3", "It was The End", *lines])
    ids, words = stacked(field, [plain])
    bounds = pii.places(plain)[2]
    sure = field.plain(ids[0], bounds, words.gain)
    for ok, path in zip(sure, pii.viterbi([ids[0][a:b] for a, b in zip(bounds, bounds[1:])], words.table, field), strict=True):
        assert not (ok and path.any())
    assert sure.any() and not sure.all()


def test_long_digit_runs_and_whole_texts():
    """Digit runs of any length do no harm, and what stands far into a text, on one line or many, is found."""
    field, words = pii.train(), pii.Words()
    texts = ["9" * 5000 + ".1.1.1", "9" * 10**6 + ".1.1.1 and (555) 123-4567", "0" * 5000 + "1.2.3.4", "9" * 10**6]
    found = pii.scan(texts, field, words)
    assert [len(b) for b, _ in found] == [0, 0, 1, 0] and not pii.plausible("ip", "1 . 2 . 3 . " + "7" * 5000)
    for gap in (" ", "\n"):
        text = f"sea{gap}land{gap}" * 40_000 + 'token = "12ab34cd56ef78ab90cd" call (555) 123-4567 now'
        ((_, more),) = pii.scan([text], field, words)
        assert [text[a:b] for _, a, b in more] == ["(555) 123-4567", "12ab34cd56ef78ab90cd"]


def test_pieces(docs_of, odd_rows):
    codec = pieces.Codec(MODEL)
    texts = [x or "" for _, x, *_ in odd_rows] + ["Hello  world\n\tfoo\x00 bar", " a", "the   cat ", "x" * 200 + " yy" * 100]
    ids, at = codec.encode(texts, list(range(len(texts))), 17, 0.0)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for i, text in enumerate(texts):
        if "▁" not in text:
            assert ids[at[i] : at[i + 1]].tolist() == library.encode(text)
    dropped, to = codec.encode(texts, list(range(len(texts))), 17, 0.2)
    assert codec.decode(dropped, to) == texts and len(dropped) > len(ids)
    again, _ = codec.encode(texts, list(range(len(texts))), 17, 0.2)
    other, _ = codec.encode(texts, list(range(len(texts))), 18, 0.2)
    assert np.array_equal(dropped, again) and not np.array_equal(dropped, other)
    whole, _ = codec.encode(texts, list(range(len(texts))), 17, 1.0)
    assert len(whole) > len(dropped) and codec.decode(whole, codec.encode(texts, list(range(len(texts))), 17, 1.0)[1]) == texts
    df = pieces.encoded(docs_of(odd_rows), MODEL)
    assert all(r.lossless and r.n_pieces == len(r.ids) for r in df.collect())
    assert Counter(map(tuple, pieces.decoded(df, MODEL).collect())) == Counter((d, x or "") for d, x, *_ in odd_rows)


def test_agendas_agree(monkeypatch):
    """The heap of long words and the lock-step of short ones take the same candidates."""
    codec = pieces.Codec(MODEL)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("aeinrst", k=rng.randint(1, 40))) for _ in range(60)) for _ in range(5)]
    want = codec.encode(texts, [1, 2, 3, 4, 5], 17, 0.15)[0]
    monkeypatch.setattr(pieces, "LONG", 2)
    assert np.array_equal(codec.encode(texts, [1, 2, 3, 4, 5], 17, 0.15)[0], want)
    monkeypatch.setattr(pieces, "STRETCH", 300)
    assert np.array_equal(codec.encode(texts, [1, 2, 3, 4, 5], 17, 0.15)[0], want)


def test_empty_tables(docs_of, odd_rows):
    none = docs_of(odd_rows).limit(0)
    assert pii.personal_data(none).count() == pii.redacted(none).count() == pieces.encoded(none, MODEL).count() == 0


def test_toxicity_on_held_out(spark, docs_of, odd_rows):
    rng = random.Random(7)

    def prose(n):
        return ["".join(rng.choices("etaoinshrdlu", k=rng.randint(3, 9))) for _ in range(n)]

    rows, labels = [], []
    for i in range(900):
        words, bad = prose(80), i % 3 == 0
        if bad:
            for _ in range(4):
                words[rng.randrange(80)] = rng.choice(["vilewretch", "foulbeast", "grimtoad"])
        rows.append((1000 + i, " ".join(words), "en", "a"))
        labels.append((1000 + i, 1, int(bad)))
    frame = spark.createDataFrame([*labels, (1, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs_of(rows + odd_rows), frame).collect()}
    import zlib

    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= got[d].score <= 1 for d, *_ in rows)
    held = [(got[d].predicted, t) for d, _, t in labels if got[d].held_out]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert got[2].predicted == 0 and got[1].predicted == 0
    none = toxicity.toxicity(docs_of(rows[:3]), frame.limit(0))
    assert none.count() == 3
    assert toxicity.toxicity(docs_of([]), frame).count() == 0


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(docs_of, odd_rows):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    rows = odd_rows + [(50 + 7 * i, " ".join(rng.choice(["the", "of", "und"]) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randint(1, 90))), "en", "a") for i in range(60)]
    rows = [r for r in rows if r[0] is not None and r[0] != 4]
    got = {r.doc_id: r for r in spots.edited(docs_of(rows), per_range=8).collect()}
    line = sorted(rows, key=lambda r: -r[0])
    sets = {d: set(filter(None, got[d].fingerprint.split(","))) for d in got}
    for i, (d, text, *_) in enumerate(line):
        text, after = text or "", line[(i + 1) % len(line)]
        k = len(text) // 3
        edited = text[: len(text) - k] + (after[1] or "")[:k]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_next == pytest.approx(jaccard(sets[d], sets[after[0]]))
        assert r.near_edited == pytest.approx(jaccard(sets[d], set(filter(None, r.edited_fingerprint.split(",")))))
    assert got[7].fingerprint == got[8].fingerprint != "" and got[2].fingerprint == ""
    whole = spots.edited(docs_of(odd_rows), per_range=2)
    assert whole.count() == len(odd_rows) and spots.edited(docs_of(rows[:0])).count() == 0
    gaps = [(2**40 * (i // 59) + i, x, "en", "a") for i, (_, x, *_) in enumerate(rows)]  # ids lie unevenly: ranges by rank
    spread = {r.doc_id: r.edited_sha256 for r in spots.edited(docs_of(gaps), per_range=2).collect()}
    line = sorted(gaps, key=lambda r: -r[0])
    for i, (d, text, *_) in enumerate(line):
        text, after = text or "", line[(i + 1) % len(line)][1] or ""
        k = len(text) // 3
        assert spread[d] == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()


def test_similar_fingerprints(docs_of):
    rng = random.Random(4)
    texts = [" ".join(x for _ in range(40) for x in ("the", f"w{rng.randrange(900)}")) for _ in range(12)]
    texts += [t.rsplit(" ", 2 * k)[0] for t in texts[:6] for k in (1, 4, 12)] + [texts[0]]
    prints = spots.fingerprints(docs_of([(i, t, "en", "a") for i, t in enumerate(texts)])).cache()
    sets = {r.doc_id: frozenset(r.spots) for r in prints.collect()}
    rep = {}
    for d in sorted(sets):
        rep.setdefault(sets[d], d)
    ids = sorted(rep.values())
    for least in (0.5, 0.8):
        want = {(a, b) for a in ids for b in ids if a < b and jaccard(sets[a], sets[b]) >= least}
        assert {(r.a, r.b) for r in spots.similar(prints, least).collect()} == want and want


def near(rows, least=0.8):
    """class_id, n_links, n_copies by comparing all pairs."""
    copies = defaultdict(list)
    for d, x, *_ in rows:
        if d is not None:
            copies[x or ""].append(d)
    sets = {}
    for x in copies:
        w = WORD.findall(x)
        k = min(5, len(w))
        sets[x] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    texts = list(copies)
    links, root = Counter(), {x: min(copies[x]) for x in texts}
    pairs = [(x, y) for i, x in enumerate(texts) for y in texts[:i] if sets[x] & sets[y] and len(sets[x] & sets[y]) >= least * len(sets[x] | sets[y]) - 1e-9]
    for x, y in pairs:
        links[x] += 1
        links[y] += 1
    for _ in texts:
        for x, y in pairs:
            root[x] = root[y] = min(root[x], root[y])
    return Counter((d, root[x or ""], links[x or ""], len(copies[x or ""])) if d is not None else (None, None, 0, 1) for d, x, *_ in rows)


def variants(rng, words, n, edits):
    base_text = [rng.choice(words) for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base_text)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out


def test_join_equals_all_pairs(docs_of, odd_rows, monkeypatch):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    texts = variants(rng, words, 25, 6) + variants(rng, words, 8, 2) + [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 3, 4, 5, 6, 40, 300)]
    rows = odd_rows + [(100 + i, x, "en", "a") for i, x in enumerate(texts + texts[:5])]
    assert Counter(map(tuple, ngramjoin.near_duplicates(docs_of(rows)).collect())) == near(rows)
    monkeypatch.setattr(ngramjoin, "MOST", 4)  # large groups, several blocks
    monkeypatch.setattr(ngramjoin, "BLOCK", 6)
    assert Counter(map(tuple, ngramjoin.near_duplicates(docs_of(rows)).collect())) == near(rows)
    assert ngramjoin.near_duplicates(docs_of(rows[:0])).count() == 0


def test_prefixes_shorten_until_the_recall():
    k = ngramjoin.prefix_length(0.8, 0.99999)
    assert 1 - (1 - 0.8**k) ** ngramjoin.TREES >= 0.99999 > 1 - (1 - 0.8 ** (k + 1)) ** ngramjoin.TREES
    assert ngramjoin.prefix_length(0.8, 0.9) > k


def pairs_apart(rng, n, edits):
    """n pairs of texts of 120 words, the second with so many words changed; words of different pairs differ."""
    out = []
    for i in range(n):
        w = [f"p{i}w{rng.randrange(200)}" for _ in range(120)]
        v = list(w)
        for k in rng.sample(range(6, 115, 6), edits):
            v[k] = "changed" + str(k)
        out += [" ".join(w), " ".join(v)]
    return out


def test_forest_adapts_to_what_it_meets(docs_of):
    """Prefixes stay long among close pairs, get shorter near the threshold, and reach the recall asked for."""
    rng = random.Random(12)
    close, far = pairs_apart(rng, 80, 1), pairs_apart(rng, 150, 2)  # similarities about 0.92 and 0.84
    lengths = {}
    for name, texts in (("close", close), ("far", far), ("none", [])):
        rows = [(i, x, "en", "a") for i, x in enumerate(texts)]
        texts_ = ngramjoin.different(ngramjoin.signatures(docs_of(rows)))
        for recall in (0.9, 0.99999):
            shortest = ngramjoin.prefix_length(0.8, recall)
            tries, crowd = ngramjoin.forest(texts_, shortest)
            pairs, lengths[name, recall] = ngramjoin.descended(tries, 0.8, recall, shortest)
            assert crowd.count() == 0
            # Down to that length all pairs that share so much are there once, and no others.
            shared = {}
            for r in tries.collect():
                for x, y in itertools.combinations(r.m, 2):
                    same = next((k for k in range(ngramjoin.DEPTH) if x.label[2 * k : 2 * k + 2] != y.label[2 * k : 2 * k + 2]), ngramjoin.DEPTH)
                    gap = sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(x.sketch, y.sketch, strict=True))
                    if gap <= ngramjoin.FAR:
                        shared[min(x.id, y.id), max(x.id, y.id)] = max(same, shared.get((min(x.id, y.id), max(x.id, y.id)), 0))
            assert sorted((r.a, r.b) for r in pairs.collect()) == sorted(p for p, k in shared.items() if k >= lengths[name, recall])
    assert lengths["close", 0.99999] > lengths["far", 0.99999] >= ngramjoin.prefix_length(0.8, 0.99999) == lengths["none", 0.99999]
    rows = [(i, x, "en", "a") for i, x in enumerate(far)]
    for recall in (0.9, 0.99999):
        got = {r.doc_id: r.n_links for r in ngramjoin.near_duplicates(docs_of(rows), recall=recall).collect()}
        want = {r[0]: r[2] for r in near(rows)}
        assert sum(got.values()) >= recall * sum(want.values()) > 100


def test_common_passage_makes_no_crowd(docs_of, monkeypatch):
    """Texts that share a passage, and nothing else, fall into large nodes but are no candidates; their copies are found."""
    rng = random.Random(13)
    passage = " ".join(f"common{i}" for i in range(80))
    texts = [passage + " " + " ".join(f"t{i}w{rng.randrange(10**6)}" for _ in range(50)) for i in range(120)]
    texts += [texts[i].rsplit(" ", 2)[0] for i in range(10)]
    rows = [(i, x, "en", "a") for i, x in enumerate(texts)]
    monkeypatch.setattr(ngramjoin, "MOST", 8)
    docs = docs_of(rows)
    texts_ = ngramjoin.different(ngramjoin.signatures(docs))
    _, crowd = ngramjoin.forest(texts_, 5)
    assert crowd.count() > 20
    edges = {(min(r.a, r.b), max(r.a, r.b)) for r in ngramjoin.candidates(docs, texts_, 0.8, 0.99999).collect()}
    assert {(i, 120 + i) for i in range(10)} <= edges and len(edges) < 40
    assert Counter(map(tuple, ngramjoin.near_duplicates(docs).collect())) == near(rows)


def test_two_texts_of_one_doc_id(docs_of):
    """Each text of a doc_id has its own links; classes are named by their smallest doc_id."""
    words = [f"w{i}" for i in range(60)]
    one, two = " ".join(words), " ".join(f"v{i}" for i in range(60))
    rows = [(5, one, "en", "a"), (5, two, "en", "a"), (3, two + " end", "en", "a"), (9, one + " end", "en", "a"), (5, two, "en", "a")]
    got = Counter(map(tuple, ngramjoin.near_duplicates(docs_of(rows)).collect()))
    assert got == Counter([(5, 5, 1, 1), (9, 5, 1, 1), (3, 3, 1, 1), (5, 3, 1, 2), (5, 3, 1, 2)])


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)]
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x != r}


def test_gains_of_windows():
    """Every word is in one window, and gains are differences of compressed lengths, window by window."""
    rng = random.Random(1)
    rows = [(" ".join(rng.choices(["sun", "sea", "a", "of", "grimtoad" if k else "hill"], k=30)), k) for k in [0, 1] * 80]
    model = toxicity.fit(rows)
    text = "a  Big of\nGRIMTOAD x " * 7
    assert b" ".join(w.strip() for w in toxicity.windows(text)).decode() == " ".join(text.lower().split())
    want = Counter()
    for w in toxicity.windows(text):
        lengths = [len(c.compress(w)) for c in model.compressors()]
        want[max(-toxicity.GAINS, min(toxicity.GAINS, lengths[0] - lengths[1])) + toxicity.GAINS] += 1
    got = toxicity.gains(text, model.compressors())
    assert Counter({i: n for i, n in enumerate(got) if n}) == want
    assert model.toxic[-40:] == model.ordinary[-40:] and model.toxic != model.ordinary  # the same base


def test_short_and_many_toxic_words():
    """Toxic words of three letters count in windows, and there is no bound on the stems that have evidence."""
    rng = random.Random(4)
    plain = ["".join(rng.choices("etaoinshr", k=6)) for _ in range(300)]
    bad = ["".join(x) for x in itertools.product("kqxz", "uvwy", "bgjkp")][:75]

    def text(label):
        words = rng.choices(plain, k=40) + rng.sample(bad, 25 * label)
        rng.shuffle(words)
        return " ".join(words)

    rows = [(text(k), k) for k in [0] * 600 + [1] * 200]
    rng.shuffle(rows)
    assert {*bad} <= {*toxicity.evidence_stems(rows, 5.0)}
    model = toxicity.fit(rows)
    compressors = model.compressors()
    found = [sum(model.score(np.array([toxicity.gains(text(k), compressors) @ model.ratios]))[0] >= 0.7 for _ in range(20)) for k in (0, 1)]
    assert found[0] <= 1 and found[1] >= 18
