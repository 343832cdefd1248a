"""Media files and main texts: round trips, planted media, cuts against all labellings."""

import hashlib
import itertools
import random
import struct
import time
import zlib

import pytest
from pyspark.sql import functions as F

from lexgrove.llm import html_extraction as H
from lexgrove.llm import media as M

DOCS = "doc_id long, text string, kind string, media string"


@pytest.mark.parametrize("kind", M.STORED)
def test_round_trip_and_type(kind):
    rnd = random.Random(1)
    for text in (b"", b"a", b"x" * 64, b"y" * 65, bytes(rnd.randrange(256) for _ in range(5000)), b"RIFF BM .snd GIF89a PK\x03\x04 %PDF-1.4" * 9):
        payload = M.padded(text)
        assert len(payload) % 64 == 0 and payload and payload.startswith(text) and len(payload) - len(text) <= 64
        data = M.store(payload, kind)
        assert M.sniff(data)[:2] == (kind, len(data)) and M.samples(data, kind) == payload
        for cut in (data[:-1], data[:20], data[1:]):
            assert M.sniff(cut)[0] == "unknown"


def gif():
    return b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"


def jpeg():
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x05\x08ab\xff\xda\x00\x04cd" + b"scan\xff\x00more" + b"\xff\xd9"


def archive():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello" * 10)
    return out.getvalue()


def test_embedded_media_are_carved():
    parts = [("gif", gif()), ("jpeg", jpeg()), ("zip", archive()), ("wav", M.store(b"s" * 64, "wav")), ("png", M.store(b"p" * 128, "png")), ("pdf", b"%PDF-1.4\n1 0 obj\nstartxref\n9\n%%EOF")]
    for kind, data in parts:
        assert M.sniff(data) == (kind, len(data), [])
    body, want = b"", []
    for kind, data in parts:
        body += b"..BM..RIFFxxxx"
        want.append((kind, len(body), len(data)))
        body += data
    assert M.sniff(body) == ("unknown", 0, want)
    inside = M.store(M.padded(b"text " + gif()), "wav")
    kind, length, embedded = M.sniff(inside)
    assert (kind, length) == ("wav", len(inside)) and [(k, n) for k, _, n in embedded] == [("gif", len(gif()))]
    assert M.sniff(b"") == ("unknown", 0, [])


def png(lines, width, depth=8, colour=0, interlaced=0):
    return b"\x89PNG\r\n\x1a\n" + M._chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(lines), depth, colour, 0, 0, interlaced)) + M._chunk(b"tEXt", b"a\0b") + M._chunk(b"IDAT", zlib.compress(b"".join(lines))) + M._chunk(b"IEND", b"")


def filtered(kind, row, above):
    """One PNG row under a filter, as its definition says."""
    out = []
    for i, x in enumerate(row):
        a, b, c = row[i - 1] if i else 0, above[i], above[i - 1] if i else 0
        p = a + b - c
        best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out.append((x - (0, a, b, (a + b) // 2, best)[kind]) & 255)
    return bytes([kind, *out])


def bmp(width, height, depth, pixels, packing=0):
    head = 54 + (1024 if depth == 8 else 0)
    return b"BM" + struct.pack("<IHHI", head + len(pixels), 0, 0, head) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, depth, packing, len(pixels), 0, 0, 0, 0) + bytes(head - 54) + pixels


def wav(coding, channels, bits, data, extra=b""):
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, coding, channels, 8000, 8000, 1, bits) + extra + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_samples_of_other_writers():
    rnd = random.Random(2)
    rows = [bytes(rnd.randrange(256) for _ in range(13)) for _ in range(10)]
    lines = [filtered(n % 5, row, rows[n - 1] if n else bytes(13)) for n, row in enumerate(rows)]
    cases = [
        (png(lines, 13), "png", b"".join(rows)),
        (png([b"\0" + bytes(39)] * 2, 13, colour=2), "png", None),
        (png([b"\0" + bytes(26)] * 2, 13, depth=16), "png", None),
        (png([b"\0" + bytes(13)] * 2, 13, interlaced=1), "png", None),
        (png([b"\x07" + bytes(13)] * 2, 13), "png", None),
        (bmp(5, 2, 8, b"abcde\0\0\0fghij\0\0\0"), "bmp", b"fghijabcde"),
        (bmp(5, -2, 8, b"abcde\0\0\0fghij\0\0\0"), "bmp", b"abcdefghij"),
        (bmp(4, 2, 24, bytes(24)), "bmp", None),
        (wav(1, 1, 8, b"abc", b"LIST\x03\0\0\0xyz\0"), "wav", b"abc"),
        (wav(1, 2, 8, b"abcd"), "wav", None),
        (wav(1, 1, 16, b"abcd"), "wav", None),
        (b".snd" + struct.pack(">IIIII", 24, 4, 3, 8000, 1) + b"abcd", "au", None),
        (b".snd" + struct.pack(">IIIII", 28, 4, 2, 8000, 1) + b"notegggg", "au", b"gggg"),
        (gif(), "gif", None),
    ]
    for data, kind, want in cases:
        assert M.sniff(data) == (kind, len(data), []) and M.samples(data, kind) == want, (kind, want)


def bmp_of(head, width, height, depth, pixels):
    start = 14 + head + (1024 if depth == 8 else 0)
    return b"BM" + struct.pack("<IHHI", start + len(pixels), 0, 0, start) + struct.pack("<IiiHHIIiiII", head, width, height, 1, depth, 0, len(pixels), 0, 0, 0, 0) + bytes(start - 54) + pixels


def test_later_versions_of_formats():
    chunks = b"".join(b"junk" + struct.pack("<I", n % 4) + bytes(n % 4 + n % 2) for n in range(5000))
    long = wav(1, 1, 8, b"abc", chunks)
    assert M.sniff(long) == ("wav", len(long), []) and M.samples(long, "wav") == b"abc"
    for head in (40, 108, 124):
        data = bmp_of(head, 5, 2, 8, b"abcde\0\0\0fghij\0\0\0")
        assert M.sniff(data) == ("bmp", len(data), []) and M.samples(data, "bmp") == b"fghijabcde"
    form = struct.pack("<HHIIHHHHIH", 0xFFFE, 1, 8000, 8000, 1, 8, 22, 8, 4, 1) + b"\0\0\0\0\x10\0\x80\0\0\xaa\0\x38\x9b\x71"
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", 4) + b"abcd"
    data = b"RIFF" + struct.pack("<I", len(body)) + body
    assert M.sniff(data) == ("wav", len(data), []) and M.samples(data, "wav") == b"abcd"
    grown = b"%PDF-1.4 first startxref 9 %%EOF then startxref 12 %%EOF"
    assert M.sniff(grown) == ("pdf", len(grown), [])
    assert M.sniff(grown + b" x " + grown) == ("pdf", len(grown), [("pdf", len(grown) + 3, len(grown))])


def plain_wav(b, at):
    """A wav's length by a plain walk."""
    if b[at : at + 4] != b"RIFF" or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    p, seen = at + 12, set()
    while end <= len(b) and p + 8 <= end:
        seen.add(b[p : p + 4])
        p += 8 + struct.unpack_from("<I", b, p + 4)[0]
        p += (p - at) % 2 if p < end else 0
    return end - at if end <= len(b) and p == end and {b"fmt ", b"data"} <= seen else None


def plain_png(b, at):
    if b[at : at + 8] != b"\x89PNG\r\n\x1a\n" or b[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
        return None
    p, names = at + 8, []
    while p + 12 <= len(b):
        n, name = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if p + 12 + n > len(b) or names and name == b"IHDR" or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        names.append(name)
        p += 12 + n
        if name == b"IEND":
            return p - at if b"IDAT" in names else None
    return None


def test_sniffing_against_plain_walks():
    """Random media, whole, cut, changed and inside each other, between random bytes."""
    rnd = random.Random(11)

    def medium(deep=0):
        kind = rnd.randrange(5)
        inside = medium(deep + 1) if deep < 2 and rnd.random() < 0.4 else bytes(rnd.randrange(256) for _ in range(rnd.randint(0, 40)))
        if kind == 0:
            extra = b"".join(rnd.choice((b"LIST", b"fmt ", b"junk")) + struct.pack("<I", n) + bytes(n + n % 2) for n in (rnd.randint(0, 5) for _ in range(rnd.randint(0, 6))))
            return wav(1, 1, 8, inside, extra)
        if kind == 1:
            parts = [M._chunk(rnd.choice((b"tEXt", b"IDAT")), inside) for _ in range(rnd.randint(0, 3))]
            return b"\x89PNG\r\n\x1a\n" + M._chunk(b"IHDR", bytes(13)) + b"".join(parts) + M._chunk(b"IEND", b"")
        return gif() if kind == 2 else jpeg() if kind == 3 else inside

    found = 0
    for _ in range(1500):
        data = b"".join(rnd.choice((b"", b"x", b"RIFF", b"\x89PNG\r\n\x1a\n")) + medium() for _ in range(rnd.randint(1, 4)))
        if rnd.random() < 0.3 and data:
            at = rnd.randrange(len(data))
            data = data[:at] + bytes([rnd.randrange(256)]) + data[at + 1 :]
        file = M.File(data)
        for at in range(len(data)):
            for magic, kind, plain in ((b"RIFF", "wav", plain_wav), (b"\x89PNG\r\n\x1a\n", "png", plain_png)):
                if data.startswith(magic, at):
                    want = plain(data, at)
                    assert M.VALIDATORS[kind](file, at) == want, (data, at)
                    found += want is not None
        kind, length, embedded = M.sniff(data)
        past = 0
        for name, at, n in [(kind, 0, length)] * (kind != "unknown") + embedded:
            assert M.VALIDATORS[name](M.File(data), at) == n and at >= past
            past = at + n if at else 0
    assert found > 800


def test_sums_of_stretches():
    rnd = random.Random(4)
    data = rnd.randbytes(60_000)
    file = M.File(data)
    for _ in range(200):
        a, b = sorted(rnd.randrange(len(data) + 1) for _ in "ab")
        assert file.crc(a, b) == zlib.crc32(data[a:b])


def shared_chain(k):
    """PNG heads whose second chunks all lead into one chain of chunks."""
    head = b"\x89PNG\r\n\x1a\n" + M._chunk(b"IHDR", bytes(13))
    each = len(head) + 8
    chain = M._chunk(b"IDAT", b"x") * k + M._chunk(b"IEND", b"")
    return b"".join(head + struct.pack(">I", (k - 1 - n) * each) + b"tEXt" for n in range(k)) + bytes(4) + chain


def test_work_grows_with_the_bytes():
    """Files full of magic numbers and marks that no or every one of them shares."""
    end = b"PK\x05\x06" + bytes(18)
    hostile = [
        b"PK\x03\x04" * 20_000 + end * 4_000,
        b"%PDF-1.4" * 20_000 + b"startxref" * 20_000,
        b"GIF89a" + bytes(7) + (b"GIF89a" + bytes([1]) * 7) * 20_000 + bytes([1]) * 200_000,
        b"GIF89a" + bytes(7) + b"!\xf9" + bytes([255]) * 300_000,
        (b"RIFF" + struct.pack("<I", 700_000) + b"WAVE") * 20_000 + bytes(500_000),
        (b"\x89PNG\r\n\x1a\n" + M._chunk(b"IHDR", bytes(13))) * 10_000,
        shared_chain(8_000),
        (b"RIFF" + struct.pack("<I", 0xFFFF) + b"WAVE") * 5_000 + (b"junk" + bytes(4)) * 60_000,
    ]
    for data in hostile:
        began = time.process_time()
        M.sniff(data)
        assert time.process_time() - began < 6


def test_media_that_others_declare(spark):
    rows = [(1, gif(), "png"), (2, None, None), (3, b"", "wav"), (4, wav(1, 1, 8, b"ab" * 32), "wav"), (5, png([b"\0" + bytes(39)], 13, colour=2), "png"), (6, b"MZ" * 2_000_000, "bmp")]
    seen = M.inspected(spark.createDataFrame(rows, "`a.b` int, media binary, declared string")).collect()
    got = [(r["a.b"], r.kind, r.corrected, r.payload_bytes, r.media_bytes) for r in seen]
    assert got == [(1, "gif", True, None, len(gif())), (2, "unknown", True, None, 0), (3, "unknown", True, None, 0), (4, "wav", False, 64, len(rows[3][1])), (5, "png", False, None, len(rows[4][1])), (6, "unknown", True, None, 4_000_000)]


def test_media_columns(spark):
    texts = [(1, "hello"), (2, ""), (3, None), (None, "é" * 100), (5, "hello"), (6, "z" * 300_000)] + [(n, f"text {n}") for n in range(10, 60)]
    rows = M.inspected(M.stored(spark.createDataFrame([(i, t, "x", "y") for i, t in texts], DOCS))).collect()
    assert len(rows) == len(texts)
    for (i, t), r in zip(texts, rows):
        raw = (t or "").encode()
        payload = M.padded(raw)
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(M.store(payload, r.kind)).hexdigest() and r.media_bytes == r.media_length and r.corrected == (r.kind != r.declared)
    assert {r.kind for r in rows} == set(M.STORED) and any(r.corrected for r in rows)
    same = [tuple(r)[1:] for r in rows if r.doc_id in (1, 5)]
    assert same[0] == same[1]
    assert M.inspected(M.stored(spark.createDataFrame([], DOCS))).count() == 0


def test_minimum_cut_against_all_labellings():
    rnd = random.Random(1)
    for _ in range(400):
        n = rnd.randint(1, 8)
        costs = [rnd.randint(-6, 6) for _ in range(n)]
        joined = {(i, j): rnd.randint(1, 4) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.4}

        def cost(x):
            return sum(c if c > 0 and not y else -c if c < 0 and y else 0 for c, y in zip(costs, x)) + sum(v for (i, j), v in joined.items() if x[i] != x[j])

        best = min((cost(x), sum(x)) for x in itertools.product([False, True], repeat=n))
        got = H.minimum_cut(costs, joined)
        assert (cost(got), sum(got)) == best


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>no";</script></head><body class="home">
<div id="cookie-banner"><p>We use cookies to improve your experience on this site, and you agree to that.</p></div>
<header><h1>Site name</h1><nav><ul><li><a href="/">Home</a></li><li><a href='/b'>About</a></li></ul></nav></header>
<!-- <p>commented out text that is long enough to look like an article, really.</p> -->
<div class="wrap"><aside><p>Read also: many things are here for you to read today.</p></aside>
<%s><h1>Title of it</h1><p>First <b>para</b>graph of   some length, with a <a href="x>y">link</a> inside &amp; more&nbsp;text &#233;.</p><p>Second one<br>goes on here, and it is not closed.
<p>Ok.</p><ul><li>One item</li><li>Two items</li></ul><div class="share-buttons">Share this</div><pre>code  here</pre></%s>
<form><label>Email</label><input><select><option>x</option></select><button>Send</button></form>
<section id="comments"><h3>3 comments</h3><div class="comment"><p>I am a reader and I think this is a wonderful article, thank you so much for it.</p></div></section></div>
<footer>&copy; 2024 Me. All rights reserved</footer><noscript>turn it on</noscript></body></html>"""
WANT = "Title of it First paragraph of some length, with a link inside & more text é. Second one goes on here, and it is not closed. Ok. One item Two items code here"


@pytest.mark.parametrize("tag", ["article", "main", 'div class="entry-content"', 'section class="post"'])
def test_main_text(tag):
    assert H.main_text(PAGE % (tag, tag.split(" ")[0])) == WANT


def test_main_text_edges():
    assert H.main_text(None) == H.main_text("") == H.main_text("<nav><a href=/>Home</a></nav>") == H.main_text("<!-- x") == ""
    assert H.main_text("<article><p>One short.</article><p") == "One short."
    assert H.main_text('<article><p class="x">A &lt;b&gt; &am &amp</p></article>') == "A <b> &am &"
    long = "<article>" + "<p>word word word word word word.</p>" * 20_000 + "</article>"
    assert H.main_text(long).count("word") == 120_000
    for text in ('<a href="' * 3000, "<" * 5000, "<div>" * 3000 + "x" + "</div>" * 3000, "&#0;&#x110000;&bogus;", "<p><p><p></b></i>"):
        H.main_text(text)


LONG = ("The first of them goes on for more than a dozen words, as a paragraph of an article does.", "The second is about as long and says nothing of any use to anyone who reads it at all.")


@pytest.mark.parametrize(
    "inner, kept",
    [
        ('<section id="search"><p>{0}</p><p>{1}</p></section>', True),
        ('<p class="warning">{0}</p><div class="bio">{1}</div>', True),
        ('<div class="content" id="meta"><p>{0}</p><p>{1}</p></div>', True),
        ("<p>{0}</p><footer>{1}</footer>", True),
        ('<p>{0}</p><div class="footer-note"><p>{1}</p></div>', True),
        ('<nav><p>{0}</p></nav><div class="comments"><p>{1}</p></div>', False),
        ('<aside>{0}</aside><div class="advert">{1}</div>', False),
        ('<div hidden>{0}</div><form>{1}</form>', False),
        ('<div class="byline">By Someone</div><p class="meta">Filed under x</p>', False),
    ],
)
@pytest.mark.parametrize("tag", ["article", "main"])
def test_words_do_not_decide_inside_the_main_element(inner, kept, tag):
    text = H.main_text(f"<html><body><{tag}><h1>Title of the page</h1>{inner.format(*LONG)}</{tag}></body></html>")
    assert text == "Title of the page" + (" " + " ".join(LONG) if kept else "")


def test_formulas_stay():
    page = "<article><p>We know that <math><mi>a</mi><mo>=</mo><mn>1</mn><annotation encoding='x'>a = 1</annotation></math> holds for all of the numbers here.</p></article>"
    assert H.main_text(page) == "We know that a=1 holds for all of the numbers here."


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE % ("article", "article"), "t"), (2, None, None, "t"), (None, "u", "", "t"), (1, "u", PAGE % ("main", "main"), "t")], "page_id long, url string, html string, text string")
    rows = H.extract(df).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in rows] == [(1, "u", WANT, len(WANT)), (2, None, "", 0), (None, "u", "", 0), (1, "u", WANT, len(WANT))]
    assert H.extract(df.limit(0)).count() == 0


#: A page without any element or class that tells content, with paragraphs too short to stand alone.
SOUP = "<html><body><div class='x1'><a href='/'>Start</a> <a href='/b'>More of it</a></div><div><div class='x2'><div>{0}</div><div>So.</div><div>{1}</div><div>Not yet</div><div>{2}</div></div></div><div class='x3'><a href='/c'>Terms</a></div></body></html>"


def test_the_cut_keeps_what_its_neighbours_keep():
    texts = [f"This is paragraph {n} of a page that goes on for more than a dozen words in all." for n in range(3)]
    found, labels, own = H.labelled(SOUP.format(*texts))
    kept = [b.text for b, x in zip(found, labels) if x]
    assert kept == [texts[0], "So.", texts[1], "Not yet", texts[2]]
    assert [b.text for b, x, y in zip(found, labels, own) if x != y] == ["So.", "Not yet"]


def test_time_of_unmatched_ends():
    """Ends that match nothing below many open elements, and inline ends that blocks stand before."""
    for n in (4000, 16000):
        for text in ("<div>" * n + "</section>" * n, "<b class=ad>" + "<div>" * n + "</b>" * n, ("<p>" + "</li>") * n):
            began = time.process_time()
            H.blocks(text)
            assert time.process_time() - began < 4, n


def layouts(n, rnd):
    """Pages of a site whose article lies in a plain div, with the article's paragraphs."""
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    for i in range(n):
        paragraphs = [" ".join(word() for _ in range(rnd.randint(14, 40))) + "." for _ in range(rnd.randint(2, 6))]
        box = "".join(f"<p><a href='/{k}'>{word()}</a></p>" for k in range(5))
        yield i, f"<body><div><span>{box}</span></div><div><div>{''.join(f'<div>{p}</div>' for p in paragraphs)}</div></div><div><i>All about us and our fine site that you are on right now.</i></div></body>", " ".join(paragraphs)


def test_fit_to_pages(spark):
    rnd = random.Random(6)
    pages = list(layouts(60, rnd))
    df = spark.createDataFrame([(i, "http://a.example/", html) for i, html, _ in pages] + [(99, None, None), (100, "", ""), (101, "x", "<p>" * 50_000)], "page_id long, url string, html string")
    weights = H.fit(df)
    assert H.fit(df.repartition(5)).score == weights.score and H.fit(df.repartition(5)).edges == weights.edges
    stated = dict(zip(H.STATED, H.Weights().score))
    fitted = dict(zip(H.STATED, weights.score))
    # links and repeated texts speak against content, length for it; what no page shows stays as stated
    assert fitted["share of link text"] <= stated["share of link text"] and fitted["table cell"] == stated["table cell"] and fitted["always"] != stated["always"]
    assert all(x >= 0 for x in weights.edges) and weights.edges[H.SAME] > H.EDGES[H.SAME]
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert len(got) == 63 and all(got[i].removesuffix(" All about us and our fine site that you are on right now.") == want for i, _, want in pages)
    assert H.fit(df.limit(0)).score == H.Weights().score and H.fit(df, sample_pages=1).score == H.Weights().score


def test_fitted_weights_are_the_best():
    """The slopes of the penalised likelihood of the weak labels, written out, are nothing at the fitted weights."""
    import numpy as np

    rnd = np.random.default_rng(5)
    pages = []
    for n in range(12):
        seen = np.zeros((6, len(H.STATED)), "<f4")
        seen[:, 0], seen[:, 1], seen[3:, 3] = 1, [1, 0.9, 1, 0.1, 0.2, 0.1], 1
        pages.append((seen, np.stack([np.array([1, 1, 1, 2, 2, 2]), rnd.integers(0, 10**6, 6)], axis=1), np.array([[i, i + 1, H.SAME] for i in range(5)], "<i4")))
    label = H.weak_labels(pages)
    assert label.tolist() == [1, 1, 1, 0, 0, 0] * 12
    weights = H.learn(pages)
    x, w, stated = np.concatenate([p[0] for p in pages]).astype(float), np.array(weights.score), np.array(list(H.STATED.values()))
    slope = x.T @ ((1 / (1 + np.exp(-(x @ w))) - label) * H.EVIDENCE / 2 / 36) + (w - stated) / H.SPREAD**2
    assert np.abs(slope).max() < 1e-4
    agree = (H.EDGE_PAIRS / (1 + np.exp(-1.0)) + 60 * 0.8) / (H.EDGE_PAIRS + 60)
    assert np.isclose(weights.edges[H.SAME], np.log(agree / (1 - agree)))


def test_repeated_pages_count_once_in_a_sample(spark):
    page = "<html><body><div><p>Some words of a page that is here many times over.</p></div></body></html>"
    many = spark.range(3000).select(F.lit(1).alias("page_id"), F.lit("http://x.org/").alias("url"), F.lit(page).alias("html"))
    seen = []
    whole, H.learn = H.learn, lambda pages: seen.append(len(pages)) or whole(pages)
    try:
        H.fit(many)
        H.fit(many.union(spark.createDataFrame([(2, "u", page), (3, None, None)], "page_id int, url string, html string")))
    finally:
        H.learn = whole
    assert seen == [1, 2]
