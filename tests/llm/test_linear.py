"""Work in proportion to the text: hostile texts of about a megabyte, and what linear paths must still get right."""

import random
import time

import pytest
from pyspark.sql import functions as F

from barsmith.llm import mixing, pii
from barsmith.llm.html import render

LIMIT = 5.0


def in_time(f, *args):
    start = time.time()
    out = f(*args)
    assert time.time() - start < LIMIT, (f, time.time() - start)
    return out


def test_many_secrets_in_one_text():
    rng = random.Random(1)
    field, words = pii.train(), pii.Words()
    line = lambda: f'token = "{"".join(rng.choices("0123456789abcdef", k=40))}" was set\n'
    text = "".join(line() for _ in range(17_000))
    pii.scan([line()], field, words)
    ((_, more),) = in_time(pii.scan, [text], field, pii.Words())
    spans = sorted((a, b) for _, a, b in more)
    assert len(text) > 1_000_000 and len(spans) > 15_000 and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_added_spans_keep_off_base_ones():
    """Against every earlier span, one by one."""
    rng = random.Random(2)
    field, words = pii.train(), pii.Words()
    bits = ['token = "a1b2c3d4e5f60718293a4b5c6d7e8f9012345678"', "bob@site.org", "+49 30 1234567", "10.0.0.1", "call (555) 123-4567", "jane dot doe at mail dot com", "the end", "4111.1111.1111.1111"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(150)]
    for base, more in pii.scan(texts, field, words):
        spans = sorted((a, b) for _, a, b in more)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
        assert all(b <= a2 or a >= b2 for a, b in spans for _, a2, b2 in base)


PAGES = {
    "p behind a button": "<p><button>" + "<div>x" * 120_000, "closed paragraphs": "<p><button>" + "</p>" * 200_000, "list behind a list": "<li><ul>" + "<b>" * 100_000 + "<li>y" * 100_000,
    "cells": "<table><tr>" + "<td>" + "<i>" * 100_000 + "<td>z" * 50_000, "end tags": "<div>" * 100_000 + "</span>" * 100_000, "options": "<select><b>" + "<option>q" * 100_000, "nested": "<div>" * 200_000 + "deep",
}


@pytest.mark.parametrize("name", PAGES)
def test_hostile_pages(name):
    assert isinstance(in_time(render, PAGES[name]), str)


def test_visibility_is_inherited_and_set_again():
    page = '<p style="visibility:hidden">no <span style="visibility: visible">yes <b>too</b> <i style="visibility:collapse">never</i></span> no</p><p>end</p>'
    assert render(page) == "yes too\n\nend"
    assert render('<div style="display:none">a<span style="visibility:visible">b</span></div>c') == "c"
    assert render('<ul style="visibility:hidden"><li>a<li style="visibility:visible">b</ul>c').split() == ["-", "b", "c"]
    assert render('<table style="visibility:hidden"><tr><td>a</td></tr></table><br style="visibility:hidden">x') == "x"


@pytest.mark.parametrize("tail", [" " * 1_000_000, " \t\n" * 300_000])
def test_padded_text_is_cut_in_time(docs_of, tail):
    """Blanks that no word follows: the cut of a document, and the words of its parts."""
    rows = [(1, " ".join(f"w{i}" for i in range(300)) + tail, "en", "a"), (2, "few words only here" + tail, "en", "b"), (3, tail + "last", "en", "c")]
    docs = docs_of(rows).cache()
    docs.count()
    start = time.time()
    mixed = mixing.mixed(docs).select("doc_id", "text").collect()
    assert time.time() - start < 4 * LIMIT
    words = {r[0]: r[1].split() for r in rows}
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    for d, want in words.items():
        got = [r.text.split() for r in mixed if r.doc_id == d]
        assert sum(map(len, got)) == taken[d] and all(any(want[i : i + len(g)] == g for i in range(len(want))) for g in got)


#: Lines of ordinary text with marks and digits, none from the table that the field is trained on.
ORDINARY = """
reach him at example.net or ring the bell
they said no.Then nothing more was heard
pages 120-140 155 and 160-180 250 are missing
in 1871-1914 1200 letters were sent
the id is 7d444840-9dc0-11d1-b245-5ffdce74fad2 in the log
from https://cdn.example.com/9f8e7d6c5b4a3f2e1d/app.js?v=20240131 it came
see //static.host.io/b3c4d5e6f7a8/logo.png at the top
fit a PX900-17C-22 or a QT55-AB12-9 pump
about 12,500 of 30,000 at 3.5 % in 2021
version 10.4.2.1 is old, 11.0 is new
at the corner, at home, at dot matrix printers
the ISBN 978-0-306-40615-7 was scanned
"""


def test_precision_on_other_lines():
    """What the field adds on ordinary lines of another make, beside what it must find on spelled ones."""
    field, words = pii.train(), pii.Words()
    lines = ORDINARY.strip().splitlines()
    wrong = [(line, [(pii.KINDS[k], line[a:b]) for k, a, b in more]) for line, (_, more) in zip(lines, pii.scan(lines, field, words), strict=True) if more]
    assert len(wrong) <= 1, wrong
    spelled = {"write to mary dot jones at firma dot org now": "email", "please call (444) 765-4321 tonight": "phone", 'token = "99887766554433221100ffeeddccbbaa00112233" and': "secret", "my visa 4012.8888.8888.1881 please": "card"}
    found = [[pii.KINDS[k] for k, _, _ in more] for _, more in pii.scan(list(spelled), field, words)]
    assert [x[:1] for x in found] == [[k] for k in spelled.values()]


def test_null_ids_and_texts_of_one_id_in_the_pipeline(spark, docs_of):
    """A rejected row goes alone, and each class of near duplicates keeps one row, whatever ids and texts are shared."""
    import corpus_pipeline

    rng = random.Random(4)

    def prose(n):
        common = "the of and to in is that it was for".split()
        return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("etaoinshrdlu", k=6)) for _ in range(n)) + "."

    texts = [prose(120) for _ in range(40)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts[:20])] + [(None, t, "en", "a") for t in texts[20:25]]
    rows += [(None, "#$% " * 100, "en", "a"), (7, "#$% " * 100, "en", "a"), (None, None, None, None)]
    good = corpus_pipeline.quality_rules(spark, docs_of(rows), "")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text)
    assert [(r.doc_id, r.text) for r in sorted(good.collect(), key=key)] == [(r[0], r[1]) for r in rows[:25]][:20] + sorted([(None, t) for t in texts[20:25]], key=lambda x: x[1])

    one, two, alone = texts[30], texts[31], texts[32]
    rows = [(5, one, "en", "a"), (5, two, "en", "a"), (3, one + " x", "en", "a"), (9, two + " y", "en", "a"), (4, alone, "en", "a"), (4, alone, "en", "b"), (5, two, "en", "a"), (None, one, "en", "a"), (None, one, "en", "a")]
    left = corpus_pipeline.near_duplicate_join(spark, docs_of(rows), "").collect()
    kept = sorted((r.doc_id, r.text) for r in left if r.doc_id is not None)
    assert kept == sorted([(3, one + " x"), (5, two), (4, alone)]) and sum(r.doc_id is None for r in left) == 2


def test_stage_two_against_brute_force(spark, docs_of, odd_rows):
    """Classes by all pairs of different texts; of each the row with the smallest doc_id stays, once."""
    import corpus_pipeline

    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(rng.randint(1, 4)):
            v = list(base)
            v[rng.randrange(60)] = "new"
            texts.append(" ".join(v))
    rows = odd_rows + [(100 + rng.randrange(30), t, "en", "a") for t in texts + texts[:6]]

    def runs(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    known = sorted({(t or "") for d, t, *_ in rows if d is not None})
    root = {t: t for t in known}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    sets = {t: runs(t) for t in known}
    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    ids = {}
    for d, t, *_ in rows:
        if d is not None:
            ids.setdefault(top(t or ""), []).append(d)
    left = [(r.doc_id, r.text or "") for r in corpus_pipeline.near_duplicate_join(spark, docs_of(rows), "").collect()]
    assert sorted((top(t), d) for d, t in left if d is not None) == sorted((c, min(x)) for c, x in ids.items())
    assert sum(d is None for d, _ in left) == sum(r[0] is None for r in rows)


def test_shared_rows_are_all_judged(docs_of):
    """`accepted` keeps repeated rows and columns of any name."""
    from barsmith.llm.quality import accepted

    rows = [(1, "a b", "en", "a")] * 3 + [(2, " ".join(["the"] + [f"of{i} and" for i in range(20)]), "en", "a")] * 4
    docs = docs_of(rows).withColumns({c: F.lit("x") for c in ("_row", "_d", "_salt", "kept", "text_key")})
    got = accepted(docs)
    assert got.columns == docs.columns and [r.doc_id for r in got.collect()] == [2] * 4
