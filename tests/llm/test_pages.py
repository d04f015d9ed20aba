"""Archives round trip and text of pages."""

import hashlib

import pytest

from barsmith.llm import warc
from barsmith.llm.common import work_dir
from barsmith.llm.html import page_texts, render

PAGES = [
    (1, "http://a/ b", "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n\r\n</p>"), (2, None, "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n\r\n</p>"), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
    (7, "u", "é🎉" * 4000 + "\n\n"), (8, "u", "é🎉" * 4000 + "\n\n"), (9, "u", "\n"), (None, "u", "z" * 300), (10, "u", "z" * 300), (10, "u", "z" * 300),
]


def test_archives(spark):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    path = work_dir(spark, "warc")
    warc.write_archives(pages, path, chunk_bytes=1000)
    chunks = warc.read_archives(spark, path)
    got = sorted(map(tuple, warc.page_records(chunks).collect()), key=str)
    first = {}
    for i, _, h in PAGES:
        if h and len(h.encode()) >= 100 and i is not None:
            first[h] = min(i, first.get(h, i))
    want = []
    for i, _, h in PAGES:
        data = (h or "").encode()
        again = h in first and first[h] != i
        n = 1 if again or len(data) <= 1000 else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h] if again else None, n))
    assert [g[:5] for g in got] == [w[:5] for w in sorted(want, key=str)]
    assert all(g[6] for g in got) and any(g[5] > 10 for g in got)
    parts = chunks.filter("page_id = 7").orderBy("chunk").collect()
    assert b"".join(r.payload for r in parts).decode() == PAGES[6][2] and all(len(r.payload) <= 1000 for r in parts)
    assert parts[2].digest_so_far == hashlib.sha256(b"".join(r.payload for r in parts[:3])).hexdigest()
    empty = work_dir(spark, "warc")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_broken_archives(spark):
    """A lost end, a lost or misplaced segment and a changed byte raise; segments of two records may alternate."""
    payloads = {1: b"a" * 2500, 2: b"b" * 2500}
    texts = {i: list(warc.records(i, "u", memoryview(x), hashlib.sha256(x).hexdigest(), None, False, 1000, "2020-01-01T00:00:00Z")) for i, x in payloads.items()}

    def rows(records):
        reader = warc.Reader(True)
        for line in "\n".join(records).split("\n"):
            reader.line(line)
        reader.close()
        return reader.rows

    mixed = [x for pair in zip(texts[1], texts[2], strict=True) for x in pair]
    got = [r for r in rows(mixed) if r[8]]
    assert [(r[1], r[6], r[7], r[9]) for r in got] == [(i, 2500, hashlib.sha256(x).hexdigest(), True) for i, x in payloads.items()]
    for broken in (texts[1][:-1], texts[1][1:], [texts[1][0], texts[1][2], texts[1][1]], [texts[1][0][:-200]], [*texts[1][:2], texts[1][2][:-100]]):
        with pytest.raises(ValueError):
            rows(broken)
    assert not rows([x.replace("aaab", "aaac").replace("a\r\n\r", "c\r\n\r") for x in texts[1]])[-1][9]
    path = work_dir(spark, "warc")
    spark.createDataFrame([(x.replace("a\r\n\r", "c\r\n\r"),) for x in texts[1]], "value string").coalesce(1).write.option("compression", "gzip").text(path)
    with pytest.raises(Exception, match="not intact"):
        warc.page_records(warc.read_archives(spark, path)).collect()


def test_spans_numbers_widths_and_bounds():
    rows = "<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>日本語<td>x<td>y<tr><td colspan=2>wide<td>z</table>"
    assert render(rows).split("\n") == ["a       b  c", "        d  e", "日本語  x  y", "wide       z"]
    head = "<table><tr><th colspan=2>a long heading<tr><td>x<td>y</table>"
    assert render(head) == "a long heading\nx  y"
    assert render("<ol start=5><li>a<li>b<li value=9>c<li>d</ol>") == "5. a\n6. b\n9. c\n10. d"
    assert render("<dialog>no</dialog><dialog open>yes</dialog>") == "yes"
    for page in (
        "<table><tr><td>" + "x" * 20_000 + "<td>y" + "<tr><td>a<td>b" * 2000 + "</table>", "<ul><li>" * 6000 + "x", "<table>" + "<tr><td colspan=1000>a<td>b" * 2000 + "</table>",
        "<table><tr>" + "<td rowspan=1000>a" * 3000 + "<tr><td>q" * 1000, "<table><tr><td>x<td>y<td>" * 300 + "<br>z" * 50, "<table><tr>" + "<td>" * 999 + "<td>" + "z<br>" * 10_000,
    ):
        assert len(render(page)) < 6 * len(page) + 200_000


def test_layout():
    table = "<table><tr><th>Name<th>Qty<tr><td>apple pie<td>3<tr><td colspan=2>all<tr><td>x<td>12</table>"
    assert render(table).split("\n") == ["Name       Qty", "apple pie  3", "all", "x          12"]
    assert render("<ul><li>one<li>two<ol><li>a<li>b</ol></ul>end") == "- one\n- two\n  1. a\n  2. b\n\nend"
    assert render("<p>a<p>b &amp; c<br>d<div>e<div>f</div></div>") == "a\n\nb & c\nd\n\ne\nf"
    assert render("<head><title>t</title></head><p hidden>no</p><div style='color:red; display : none'>z<p>q</div>yes<script>var t='</p>';</script><!-- c -->!") == "yes!"
    assert render("<pre>  a\n b</pre>x <b>bold</b>er 1 < 2") == "  a\n b\n\nx bolder 1 < 2".strip("\n")
    assert render("<table><tr><td>a<table><tr><td>in<td>ner</table><td>b</table>").split("\n")[-1].rstrip() != ""
    assert render("") == "" and render("<") == "<" and render("<p") == "" and render("a<b 'x") == "a"
    assert render("<div>" * 20_000 + "deep") == "deep" and render("</p></div>x") == "x"


def test_rows(spark):
    pages = spark.createDataFrame([(1, "<p>a</p><p>b</p>", "t"), (2, None, "t"), (2, None, "t")], "page_id long, html string, text string")
    got = page_texts(pages).collect()
    assert sorted((r.page_id, r.text, r.n_chars, r.n_lines) for r in got) == [(1, "a\n\nb", 4, 3), (2, "", 0, 0), (2, "", 0, 0)]
    assert page_texts(pages.limit(0)).count() == 0


def test_visibility():
    """Only an attribute named hidden and the style's own declarations hide."""
    for a in ('title="a hidden gem"', "title='a hidden gem'", 'class="md hidden lg:block"', 'data-style="display:none"', 'data-x="style=display:none"', 'style="x-display:none"', 'style="content:\';display:none;\'"', 'hidden style="display:block"', 'style="display:none;display:block"', "data-hidden", 'style=""'):
        assert render(f"<body {a}><p {a}>seen</p></body>") == "seen", a
    for a in ("hidden", "HIDDEN=''", 'class="x" hidden', 'hidden="until-found"', 'style="color:red;DISPLAY : none !important"', "style=visibility:hidden", "style='display:none!important;display:block'", 'a="b"style="display:none"'):
        assert render(f"<p {a}>no</p>yes") == "yes", a
    assert render("a <svg viewBox='0 0 1 1'><title>t</title><defs><text>no</text></defs><defs/><path d='x'/> z <text x=1>one</text><text>two</text></svg> b") == "a one two b"
    assert render("<svg/>b<p>c<svg><path>d<div>e</div>") == "b\n\nc\n\ne" and render("<svg><text display='none'>n</text></svg>y") == "y"
    assert render("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>") == "x=2"
