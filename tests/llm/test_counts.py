"""Token counts, quality counts and the mixture against brute force."""

import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barsmith.llm import mixing, quality
from barsmith.llm.tokencount import token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_token_counts(docs_of, odd_rows):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [*odd_rows, (20, "a  b\n c d  e <|endoftext|> f<|endoftext|>g's  \n\n x ", "en", "a"), (21, "\x1c a \x85b c", "en", "a")]
    t = Tokenizer.from_file(path)
    want = Counter((d, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for d, x, *_ in rows)
    assert Counter(map(tuple, token_counts(docs_of(rows), path).collect())) == want
    assert token_counts(docs_of(rows[:0]), path).count() == 0


def test_long_pieces_and_batches(docs_of, monkeypatch):
    """Texts without single blanks are split too; tiny batches and tables give the same counts."""
    import random

    from barsmith.llm import tokencount

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, rng = Tokenizer.from_file(path), random.Random(6)
    parts = ["abc", "x1", "=", "(", ");", "{", "}", "\n", "\n\n", "  ", "\t", " ", "日本語", "です", "。", "、", "'s", "'", "<|endoftext|>", "\x00", "\x1c", "\xa0", "é", "💡", ",", "한국"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 400))) for _ in range(400)]
    texts += ["".join(rng.choice(["日本", "語です", "。", "、"]) for _ in range(500)), "a=b(c,d);" * 300, "line\n" * 500, "q" * 3000]
    assert max(len(x) if isinstance(x, str) else len(x[0]) for text in texts[-4:-1] for x in tokencount.pieces_of(text)) < 40
    assert len(list(tokencount.runs(["é" * 50] * 10, 200))) == 5
    want = {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}
    for bound in (1 << 25, 3000):
        monkeypatch.setattr(tokencount, "MOST_BYTES", bound)
        got = {r.doc_id: r.n_tokens for r in token_counts(docs_of([(i, x, "en", "a") for i, x in enumerate(texts)]), path, batch_bytes=500).collect()}
        assert got == want


def brute(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = {j for i in range(len(words) - 4) if runs[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(again)


def test_quality_counts(docs_of, odd_rows):
    rows = [*odd_rows, (30, "a b c d e f a b c d e g a b c d e\na b\na b\n\n \na b", "en", "a"), (31, "# * | " * 20, "en", "a")]
    got = quality.quality(docs_of(rows)).collect()
    want = Counter((d, *brute(x)) for d, x, *_ in rows)
    assert Counter(tuple(r)[:6] for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.quality(docs_of(rows[:0])).count() == 0


def test_divergence_finds_other_text(docs_of):
    """Without numpy: the distance of each document by a plain formula, and junk told from prose."""
    import math
    import random

    rng = random.Random(3)
    common = "the of and to in is that it was for".split()
    prose = [(i, " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("etaoinshrdlu", k=6)) for _ in range(200)) + ".", "en", "a") for i in range(80)]
    junk = [(100, " ".join("".join(rng.choices("#$%&*|", k=6)) for _ in range(200)), "en", "a"), (101, " ".join("".join(rng.choices("etaoinshrdlu", k=6)) for _ in range(400)), "en", "a")]
    got = {r.doc_id: r for r in quality.quality(docs_of(prose + junk)).collect()}
    assert all(got[i].kept for i, *_ in prose) and not got[100].kept and not got[101].kept
    hist = {d: Counter(w if w in quality.WORDS else "" for w in x.lower().replace(".", "").split()) for d, x, *_ in prose + junk}
    total = sum((hist[d] for d in hist if not got[d].base_failed), Counter())

    def jsd(p, q):
        a, b = sum(p.values()), sum(q.values())
        s = 0.0
        for w in set(p) | set(q):
            x, y = p[w] / a, q[w] / b
            s += sum(v * math.log2(2 * v / (x + y)) for v in (x, y) if v)
        return math.sqrt(s / 2)

    for d in (0, 100, 101):
        assert got[d].word_distance == pytest.approx(jsd(hist[d], total), abs=1e-9)


def seats(votes, total):
    """Highest quotients one by one."""
    got = dict.fromkeys(votes, 0)
    for _ in range(total):
        best = max((v / (2 * got[k] + 1), [-ord(c) for c in k], k) for k, v in votes.items() if v > 0)
        got[best[2]] += 1
    return got


def test_apportionment_takes_the_highest_quotients(spark):
    import random

    rng = random.Random(5)
    for n, total in ((1, 7), (3, 100), (12, 5), (25, 333)):
        votes = {chr(97 + i): rng.choice([0, 1, 5, 50, 1000]) * rng.random() for i in range(n)}
        if not any(votes.values()):
            continue
        df = spark.createDataFrame([(0, k, v, total) for k, v in votes.items()], "g int, k string, v double, s long")
        assert {r.k: r.quota for r in mixing.apportion(df, ["g"], ["k"], "v", "s").collect()} == seats(votes, total)


def fill(sizes, total_share=1.5):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = dict.fromkeys(names, 0.0), total_share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if 2 * sizes[s] < weight[s] * level}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixture(docs_of, odd_rows):
    rows = odd_rows + [(100 + i, " ".join(["w"] * (20 + i % 60)), "en", "abcde"[i * i % 5]) for i in range(400)]
    got = mixing.mix(docs_of(rows), shard_words=3000).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((d, len(WORD.findall(x or ""))) for d, x, *_ in rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"] and r.taken == r.passes * r["size"] + r.words_1 + r.words_2
    want = fill(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= max(0.03 * target[s], 64)
    again = mixing.mix(docs_of(rows[::-1]), shard_words=3000).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    mixed = mixing.mixed(docs_of(rows)).collect()
    words = defaultdict(int)
    for r in mixed:
        words[r.source] += len(WORD.findall(r.text))
    assert all(abs(words[s] - target[s]) <= max(0.03 * target[s], 64) for s in sizes)
    assert mixing.mix(docs_of(rows[:0])).count() == 0


def test_mixture_of_many_shards_and_clashing_columns(docs_of, odd_rows, monkeypatch):
    """Shards in groups give the same sums; equal rows and rows without doc_id get their own shares; no column name clashes."""
    monkeypatch.setattr(mixing, "GROUP", 3)
    rows = odd_rows[:3] + [(i // 2, " ".join(f"w{j}" for j in range(30 + i // 2 % 50)), "en", "ab"[i // 2 % 2]) for i in range(300)]
    rows += [(None, f"a b c {i}", "en", "c") for i in range(60)] + [(7, "same again and again", "en", "c")] * 40
    docs = docs_of(rows)
    for c in ("_id", "_key", "_take", "key", "own", "row", "take", "shares", "group"):
        docs = docs.withColumn(c, docs.url)
    plan = mixing.mix(docs, shard_words=200).collect()
    taken, words = Counter(), Counter()
    for r in plan:
        taken[r.doc_id, r.source] += r.taken
        assert r.taken <= 2 * r["size"]
    for s in "abc":
        got, target = sum(n for (_, x), n in taken.items() if x == s), next(r.target for r in plan if r.source == s)
        assert abs(got - target) <= 0.03 * target
    monkeypatch.setattr(mixing, "mix", lambda docs, seed, mix=mixing.mix: mix(docs, seed, shard_words=200))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    for r in mixed.collect():
        words[r.doc_id, r.source] += len(WORD.findall(r.text))
        assert r._id == r.row == "u"
    assert +taken == +words
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_mixture_keeps_white_space(docs_of):
    """Whole documents of the run of blocks come out as they are, parts as substrings of them."""
    rows = [(i, f"  a{i}\tb{i}\n\n" + "\n".join(f"c  d{i}\x0be{j}" for j in range(20 + i % 7)) + " \n", "en", "abc"[i % 3]) for i in range(60)]
    rows += [(100 + i, " one\n two", "en", "d") for i in range(3)]
    text, whole = {i: t for i, t, *_ in rows}, Counter()
    plan = {r.doc_id: r for r in mixing.mix(docs_of(rows)).collect()}
    got = mixing.mixed(docs_of(rows)).collect()
    words = Counter()
    for r in got:
        assert r.text in text[r.doc_id] and r.n_chars == len(r.text)
        whole[r.doc_id] += r.text == text[r.doc_id]
        words[r.doc_id] += len(WORD.findall(r.text))
    assert {d: r.taken for d, r in plan.items() if r.taken} == dict(words)
    assert all(whole[d] == r.taken // r["size"] for d, r in plan.items())
    assert any(r.passes == 0 and r.taken == r["size"] for r in plan.values()) and any(r.taken % r["size"] for r in plan.values())


def test_small_source_beside_a_hot_one(spark):
    """Blocks suit the smallest source, however large the mean target is."""
    sizes = {"b": (300, 20_000), "a": (10, 10), "c": (7, 100), "d": (1, 1)}
    rows = [(s, n) for s, (k, n) in sizes.items() for _ in range(k)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, n int").repartition(8).selectExpr("doc_id", "source", "repeat('w ', n) AS text")
    got = {r.source: r for r in mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).withColumnsRenamed({"sum(taken)": "taken", "max(target)": "target"}).collect()}
    want = fill({s: k * n for s, (k, n) in sizes.items()})
    for s, r in got.items():
        assert r.target == pytest.approx(want[s]) and abs(r.taken - r.target) <= max(1, 0.01 * r.target), (s, r)


def test_rare_and_null_languages_beside_a_large_one(docs_of):
    """Documents of a language with a thin reference, or of none, are kept unless they are far from every reference."""
    import random

    rng = random.Random(8)

    def prose(lang):
        return " ".join(rng.choice(quality.COMMON_WORDS[lang].split()) if rng.random() < 0.5 else "".join(rng.choices("etaoinshrdlu", k=6)) for _ in range(200)) + "."

    junk = [" ".join("".join(rng.choices("#$%&*|", k=6)) for _ in range(200)) for _ in range(2)]
    rows = [(i, prose("en"), "en", "a") for i in range(90)] + [(100 + i, prose("de"), "de", "a") for i in range(10)] + [(200, prose("fr"), "fr", "a")]
    rows += [(300 + i, prose("en"), None, "a") for i in range(6)] + [(310 + i, prose("es"), None, "a") for i in range(2)] + [(500 + i, prose("es"), "es", "a") for i in range(40)] + [(400, junk[0], "de", "a"), (401, junk[1], "en", "a")]
    got = {r.doc_id: r.kept for r in quality.quality(docs_of(rows)).collect()}
    assert [d for d, *_ in rows if not got[d]] == [400, 401]
