import hashlib
import re
import struct
import zlib

import numpy as np
import pytest
from ledgerwise.llm import media, pii
from ledgerwise.llm.html_main import extract, main_text


def test_png_round_trip_of_all_filters():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (40, 64), dtype=np.uint8)
    data = rows.tobytes()
    assert media.read_png(media.write_png(data)).tobytes() == data
    for only in (1, 2, 3, 4, None):
        out, up = b"", np.zeros(64, int)
        for i, row in enumerate(rows.astype(int)):
            kind = i % 5 if only is None else only
            left, corner = np.r_[0, row[:-1]], np.r_[0, up[:-1]]
            p = left + up - corner
            near = np.abs(np.stack([p - left, p - up, p - corner]))
            paeth = np.choose(near.argmin(0), [left, up, corner])
            guess = [0, left, up, (left + up) // 2, paeth][kind]
            out += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
            up = row
        head = struct.pack(">IIBBBBB", 64, 40, 8, 0, 0, 0, 0)
        png = media.SIGNATURE + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"x\0y") + media._chunk(b"IDAT", zlib.compress(out)) + media._chunk(b"IEND", b"")
        assert media.read_png(png).tobytes() == data


def test_broken_png():
    good = media.write_png(bytes(64))
    for bad in (b"", good[:-5], good[:40] + bytes([good[40] ^ 1]) + good[41:], b"x" + good):
        with pytest.raises(ValueError):
            media.read_png(bad)


def test_features():
    rng = np.random.default_rng(2)
    a = np.clip(np.cumsum(rng.normal(0, 9, (100, 64)), 0) + 128, 0, 255).astype(np.uint8)
    b = np.clip(a.astype(int) + rng.integers(-2, 3, a.shape), 0, 255).astype(np.uint8)
    c = rng.integers(0, 256, a.shape, dtype=np.uint8)
    apart = lambda x, y: bin(int(media.feature(x), 16) ^ int(media.feature(y), 16)).count("1")
    assert apart(a, b) < 8 < apart(a, c)
    x = np.arange(7 * 3, dtype=float).reshape(7, 3)
    assert np.allclose(media._averages(x, 7), x) and np.allclose(media._averages(x, 1), x.mean(0))


def test_media_query(spark, docs, rows):
    got = media.measure(media.stored(docs)).collect()
    assert len(got) == len(rows)
    want = {}
    for r in rows:
        t = (r[1] or "").encode()
        p = t + bytes(64 - len(t) % 64 if len(t) % 64 or not t else 0)
        want.setdefault(r[0], set()).add((len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    for g in got:
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) in want[g.doc_id]
        assert len(g.feature) == 16
    assert media.measure(media.stored(docs.limit(0))).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    import random

    r = random.Random(8)
    parts = ["a", "b.c", "@", "x@y.com", "..", "-", "4539578763621486", "4539 5787-6362 1486", "1.2.3.4", "256.1.1.1", "+1 (456) 555-2186", "+", "12", ".5", " ", "é", "_x@y.org", "9" * 20, "%+", "\n", "0001.002.3.4", "(", "()"]
    for _ in range(4000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert pii.base_spans(t) == brute(t), t
    assert pii.base_spans("7" * 20_000 + "@" * 20_000 + "+" * 5000) == []


def test_expectation_maximisation_finds_the_bad_voter():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    rates = [0.95, 0.9, 0.85, 0.5]
    votes = np.stack([np.where(rng.random(4000) < q, truth, ~truth) for q in rates], 1) * 2 - 1
    sets, count = np.unique(votes, axis=0, return_counts=True)
    post, found, share = pii.expectation_maximisation(sets, count.astype(float))
    hit = found[1, :, 2]
    assert abs(share - 0.3) < 0.05
    assert np.allclose(hit[:3], rates[:3], atol=0.06) and abs(hit[3] - 0.5) < 0.1
    lookup = {tuple(s): p > 0.5 for s, p in zip(sets, post)}
    assert np.mean([lookup[tuple(v)] == t for v, t in zip(votes, truth)]) > 0.94


def test_added_spans_and_masks(spark):
    texts = [f"call me, my phone is 456-555-{1000 + i} or a.b{i}@mail.example.com" for i in range(60)] + [f"invoice no 056-155-{2000 + i} for order" for i in range(60)] + ["my iban DE89370400440532013000 at the bank", None, "", "plain words only"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    voters = pii.fit(docs)
    got = {r.doc_id: r for r in pii.find(docs, voters).collect()}
    assert all([s.kind for s in got[i].base] == ["email"] for i in range(60))
    assert all([s.kind for s in got[i].added] == ["contact"] for i in range(60))
    assert all(not got[i].added for i in range(60, 120))
    assert not got[123].added and not got[121].base
    mask = pii.masker(spark, voters)
    out = {r.doc_id: r.m for r in docs.select("doc_id", mask("text").alias("m")).collect()}
    assert out[3] == "call me, my phone is [CONTACT] or [EMAIL]" and out[121] is None and out[122] == "" and out[60] == texts[60]
    assert pii.find(docs.limit(0), pii.fit(docs.limit(0))).count() == 0


def test_secrets_by_features(spark):
    """Keys that are named and assigned are found, hashes of commits, names and long words aren't."""
    import random

    r = random.Random(3)
    hexes = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    keys = [f'text before token = "{hexes()}" and after' for _ in range(40)] + [f"export API_KEY=ghp_{hexes()[:20]}Ab{hexes()[:14]}" for _ in range(20)]
    other = [f"see commit {hexes()} of the log" for _ in range(40)] + ["a_very_long_identifier_name_2020 here", "https://example.org/path/to/page2/index.html", "7" * 300, "1" * 40 + "a"]
    docs = spark.createDataFrame(list(enumerate(keys + other)), "doc_id bigint, text string").repartition(2)
    got = {x.doc_id: [s.kind for s in x.added] for x in pii.find(docs, pii.fit(docs)).collect()}
    assert all(got[i] == ["secret"] for i in range(60))
    assert all(got[i] == [] for i in range(60, len(keys + other)))


def test_long_texts_repeats_and_clashes(spark):
    """A text of thousands of spans takes time in proportion; repeated rows agree; other columns don't matter."""
    import time

    text = " ".join(f"u{i}@mail.example.com 456-555-{1000 + i}" for i in range(8000))
    began = time.time()
    base = pii.base_spans(text)
    found = pii.candidates(text, base)
    assert len(base) == len(found) == 8000 and time.time() - began < 3
    rows = [(1, "mail a.b@mail.example.com", "x", 1), (1, "mail a.b@mail.example.com", "x", 1), (None, text, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kind string, votes int")
    got = pii.find(docs, pii.fit(docs)).collect()
    assert sorted(len(x.base) for x in got) == [1, 1, 8000]


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h2>Site</h2></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice"><p>We use cookies, as everyone does, to know you better.</p></div>
%s
<aside><p>Read this other long story, which is about something else entirely.</p></aside><section class="comments"><p>I disagree, strongly, with all of it. So there!</p></section>
<form><p>Name, please.</p><input name="q"></form><footer>&copy; 2020, all rights reserved.</footer></body></html>"""
TEXT = "A heading & more\nThe first paragraph, quite long, says\xa0something. It goes on for a while!\nAn item, with text.\nSecond; with a link in it, and bold words. Ünïcode.\n3 < 4"


def test_html():
    body = '<h1>A heading &amp; more</h1><p><b>The first</b> paragraph,\n  quite long, says\xa0something.<br>It goes on for a while!<ul><li>An <i>item</i>, with text.</ul><p>Second; with a <a href="x">link in it</a>, and <b>bold words. &Uuml;n&iuml;code.<p>3 &lt; 4</p>'
    want = TEXT.replace("\xa0", " ")
    for tag in ("article", "main", 'div class="post-content"'):
        assert main_text(PAGE % f"<{tag}>{body}</{tag.split()[0]}>") == want, tag
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == ""
    assert main_text("just text, no tags") == "just text, no tags"
    assert main_text("<article><p>cut off, here.<!-- open <p>x") == "cut off, here."
    assert main_text("<p>one, two.</p><p" + " x" * 10) == "one, two."


def test_html_keeps_long_lists_and_tables():
    long = "<p>" + "word " * 118 + "one, two, three, four. Five, six, seven, eight.</p>"
    inner = {
        "list": ("<ul>" + "<li>item no some x</li>" * 20 + "</ul>", 20),
        "table": ("<table><tr>" + "<td>cell ab</td>" * 24 + "</tr></table>", 24),
        "links": ("<ol>" + "<li><a href='x'>A source, by someone</a></li>" * 6 + "</ol>", 6),
    }
    for tag in ("article", "main", 'div class="post-content"'):
        for kind, (part, n) in inner.items():
            for body in (f"<h1>Head</h1>{long * 4}{part}", f"<h1>Head</h1>{long * 2}{part}{long * 2}"):
                want = 5 + (n if tag in ("article", "main") or kind != "links" else 0)
                assert len(main_text(PAGE % f"<{tag}>{body}</{tag.split()[0]}>").split("\n")) == want, (tag, kind)


def test_html_names_are_judged_whole():
    """A name that holds a word of boilerplate among others doesn't lose its text; names of boilerplate do, inline ones too."""
    long = "<p>" + "word " * 60 + "one, two, three, four.</p>"
    text = main_text(PAGE % f"""<article><h1>Head</h1>{long}<div class="forms-of-government"><p>Kept as content, surely.</p></div><section id="comments-on-the-law"><p>Kept as well, of course.</p></section>
        <div class="comment-list"><p>Dropped, as a reader wrote it.</p></div><p>A paragraph <span class="ad">buy this <span>now</span>, cheap</span>goes on. <span class="advanced">Fine.</span></p><div class="AdBanner-top"><p>Dropped, too.</p></div>{long}</article>""")
    assert text.split("\n")[2:5] == ["Kept as content, surely.", "Kept as well, of course.", "A paragraph goes on. Fine."] and "Dropped" not in text and "cheap" not in text


def test_html_deep_nesting_is_linear():
    import time

    began = time.time()
    n = 20_000
    assert main_text("<div>" * n + "Deep, down here." + "</div>" * n + "</p>" * n) == "Deep, down here."
    assert time.time() - began < 5


def test_html_query(spark):
    rows = [(1, "u", PAGE % "<article><p>Only this, once.</p></article>", "clash"), (2, None, None, "c"), (2, None, None, "c"), (None, "v", "<p>" + "many words, " * 20000 + "</p>", "c")]
    got = extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert sorted((g.page_id or 0, g.n_chars) for g in got) == [(0, 12 * 20000 - 1), (1, 16), (2, 0), (2, 0)]
    assert extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
