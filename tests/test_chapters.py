"""Chapters, reference sections, entries, linking and contents; windows against sequential scans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexgrove.functions import text as T
from lexgrove.operators import chapters as C
from lexgrove.operators import toc


def md(spark, *lines, book="b"):
    return spark.createDataFrame([(book, i, x) for i, x in enumerate(lines)], "book_key string, line_no int, line string")


def found(spark, *lines, **k):
    return [tuple(r)[2:] for r in C.detect(md(spark, *lines), **k).orderBy("ch_ord").collect()]


LONG = "body words that go on and on without a single number of a date in them, longer than ninety characters in all"


def test_detect(spark):
    lines = ["<!-- p. 1 -->", "## Memory Systems", "<!-- p. 5 -->", "## References", "Smith, J. (2001). Title. Journal.", "<!-- p. 10 -->", "# Second Part", "<!-- p. 12 -->", "## Bibliography", "Doe, A. 1999. T. J."]
    assert found(spark, *lines) == [("Memory Systems", 1, 5, 3, 6), ("Second Part", 12, 12, 8, 10)] or found(spark, *lines)[0][:3] == ("Memory Systems", 1, 5)
    assert found(spark, "no", "references here") == []
    assert found(spark, "## Some Title", "## References", "x") == [("Some Title", None, None, 1, 3)]
    assert found(spark, "## Some Title", "## Sources", "x", heading=r"^## Sources$") == [("Some Title", None, None, 1, 3)]


@pytest.mark.parametrize("first", ["## References", "## Summary", "### C H A P T E R 1", "## Ab"])
def test_titles_that_tell_nothing(spark, first):
    assert found(spark, first.replace("References", "Suggested Reading"), "## Real Title", "## References")[0][0] == "Real Title"


@pytest.mark.parametrize(
    "lines, end",
    [
        (["# Next"], 1),
        (["## Next Chapter"], 1),
        (["## Smith, J. (1997) A title"], 2),
        ([LONG, LONG, LONG], 1),
        ([LONG, LONG, "Smith, J. 1999.", LONG], 5),
        (["Smith, J. 1999.", "", "<!-- p. 7 -->", "", "<!-- p. 8 -->", "## Next Chapter"], 3),
        (["Smith, J. 1999.", "<!-- p. 7 -->", "12", "## Next Chapter"], 4),
    ],
)
def test_reference_ends(spark, lines, end):
    assert C.reference_ends(md(spark, "## References", *lines)).first().ref_end == end


def scan_end(lines, start, limit):
    """A sequential statement of the same rule."""
    body, first = 0, limit
    for j in range(start, limit):
        s = lines[j].strip()
        if not s or re.match(C.PAGE_MARK, lines[j]) or re.match(r"\d{1,4}$", s):
            continue
        if re.match("# [^#]", lines[j]):
            return j
        year = re.search(r"\b(1[89]\d\d|20[012]\d)[a-z]?\b", s)
        if lines[j].startswith("## ") and not year:
            at = j
            for k in range(j - 1, start - 1, -1):
                if re.match(C.PAGE_MARK, lines[k]):
                    at = k
                elif lines[k].strip():
                    break
            return at
        if lines[j].startswith("## ") or year or s.startswith("Smith, J") or len(s) <= 90:
            body = 0
            continue
        body += 1
        first = j if body == 1 else first
        if body == 3:
            return first
    return limit


def test_reference_ends_against_scan(spark):
    rnd = random.Random(2)
    kinds = ["", "", "<!-- p. 3 -->", "17", LONG, LONG, LONG, "short", "Smith, J. wrote", "in 1999 it was", "## Smith 1999", "### third"]
    books = {f"b{n}": ["## References"] + [rnd.choice([*kinds, *(["## Stop", "# One"] if rnd.random() < 0.1 else [])]) for _ in range(rnd.randint(1, 25))] for n in range(250)}
    df = spark.createDataFrame([(b, i, x) for b, ls in books.items() for i, x in enumerate(ls)], "book_key string, line_no int, line string")
    for r in C.reference_ends(df).collect():
        assert r.ref_end == scan_end(books[r.book_key], 1, len(books[r.book_key])), books[r.book_key]


def entries(spark, *lines):
    df = spark.createDataFrame([("b", 1, i, x) for i, x in enumerate(lines)], "book_key string, ch_ord int, line_no int, line string")
    return [r.raw for r in C.join_entries(df).orderBy("entry_line").collect()]


def test_join_entries(spark):
    assert entries(spark, "## References", "Smith, J. (2001). A title", "that goes on.", "", "Doe AB. 1999. T.") == ["Smith, J. (2001). A title that goes on.", "Doe AB. 1999. T."]
    assert entries(spark, "Smith, J. 2001.", "", "", "", "lost", "Doe, A. 1999.") == ["Smith, J. 2001.", "Doe, A. 1999."]
    assert entries(spark, "before", "Smith, J. 2001.", "<!-- p. 2 -->", "12", "more") == ["Smith, J. 2001. more"]


def scan_entries(lines):
    out, now, blanks, long = [], [], 0, 0
    for x in lines:
        s = x.strip()
        if re.match(r"<!-- p\. \d+ -->|\d{1,4}$|#{1,4} ", x):
            continue
        if not s:
            blanks += 1
            if blanks >= 3 and now:
                out.append(now)
                now = []
            continue
        blanks = 0
        if s.startswith("Smith, J"):
            if now:
                out.append(now)
            now, long = [s], 0
        elif now:
            if len(s) > 120 and not re.search(r"\b(1[89]\d\d|20[012]\d)\b", s):
                long += 1
                if long >= 4:
                    break
            else:
                long = 0
            now.append(s)
    return [" ".join(x) for x in ([*out, now] if now else out)]


def test_entries_against_scan(spark):
    rnd = random.Random(4)
    kinds = ["", "", "", "<!-- p. 3 -->", "17", "x" * 121, "y" * 121, "z" * 130, "short", "Smith, J. wrote", "in 1999", "w" * 130 + " 1999"]
    books = {f"b{n}": [rnd.choice(kinds) for _ in range(rnd.randint(1, 30))] for n in range(250)}
    df = spark.createDataFrame([(b, 1, i, x) for b, ls in books.items() for i, x in enumerate(ls)], "book_key string, ch_ord int, line_no int, line string")
    got = {}
    for r in C.join_entries(df).orderBy("book_key", "entry_line").collect():
        got.setdefault(r.book_key, []).append(r.raw)
    for b, ls in books.items():
        assert got.get(b, []) == scan_entries(ls), ls


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Smith, J. (2001). A title. Journal, 3, 1-2.", ("Smith, J.", "2001", "A title", "Journal, 3, 1-2.")),
        ("Smith AB. 2001. A title. J Neurosci 3:1.", ("Smith AB.", "2001", "A title", "J Neurosci 3:1.")),
        ("Novak G (2004) Large-scale recording. Nat Neurosci 7:446.", ("Novak G", "2004", "Large-scale recording", "Nat Neurosci 7:446.")),
        ("Miller SC: Some title. Journal 3(1):1–2, 1995 123", ("Miller SC: Some title. Journal 3(1):1–2", "1995", "123", "")),
        ("Miller SC: Some title. Journal", ("Miller SC", "", "Some title", "Journal")),
        ("No year nor colon", ("No year nor colon", "", "", "")),
        ("A 1999. One. Two. Three", ("A", "1999", "One. Two", "Three")),
    ],
)
def test_parse_reference(spark, raw, want):
    r = spark.createDataFrame([(raw,)], "raw string").select(T.parse_reference("raw").alias("r")).first().r
    assert tuple(r)[:4] == want and r.raw == raw


def test_references_by_title(spark):
    lines = md(spark, "<!-- p. 5 -->", "<!-- p. 10 -->", "## References", "Smith, J. 2001. T. V.")
    rows = C.references(lines, C.detect(lines)).collect()
    assert [(r.ch_title, r.authors, r.year) for r in rows] == [("p. 5–10", "Smith, J.", "2001")]


def test_numbered_references(spark):
    lines = md(spark, "A preface of 1990 before all", "1. Smith J. A study of things. 1999", "12", "# Head", "", "more words", "2. short", "3. Doe A. Another work of note. 2004", "4. An entry without a year at all")
    rows = C.numbered_references(lines).orderBy("ref_ord").collect()
    assert [(r.ref_ord, r.year) for r in rows] == [(1, "1990"), (2, "1999"), (3, "2004")]
    assert rows[1].raw == "Smith J. A study of things. 1999 more words"


def test_numbered_sections(spark):
    lines = md(spark, "Nobody wrote this one. 1888", "1. First A. The first of them. 1901", "2. Second B. The second of them. 1902", "text", "1. Third C. The third of them. 1903")
    chapters = spark.createDataFrame([("b", 1, "One", 1, 3), ("b", 2, "Two", 4, None), ("b", 3, "Same", 0, 1), ("b", 4, "Same", None, 2), ("b", 5, None, 3, 4)], "book_key string, ch_ord int, title string, ref_start_line int, ref_end_line int")
    rows = C.numbered_sections(lines, chapters).orderBy("ch_ord", "ref_ord").collect()
    assert [(r.ch_ord, r.ch_title, r.ref_ord, r.year) for r in rows] == [(1, "One", 1, "1901"), (1, "One", 2, "1902"), (2, "Two", 1, "1903"), (4, "Same", 1, "1888"), (4, "Same", 2, "1901")]


def test_int_pages(spark):
    df = spark.createDataFrame([(["5", "abc", "10b", "20–25"],)], "p array<string>")
    assert df.select(T.int_pages("p").alias("p")).first().p == [5, 10, 20]
    parts = df.select(F.transform("p", T.page_parts).alias("p")).first().p
    assert (parts[2].start, parts[2].suffix, parts[3].end) == (10, "b", 25)


def test_link_all(spark):
    lookup = spark.createDataFrame([("synapse", "b", ["25"]), ("far", "b", ["200"]), ("edge", "b", ["1", "50"]), ("other", "c", ["5"])], "term string, book_key string, pages array<string>")
    ch = spark.createDataFrame([("b", 1, "Memory", 1, 50), ("b", 2, "", 51, 60), ("b", 3, "Nowhere", None, 70)], "book_key string, ch_ord int, title string, start_page int, end_page int")
    refs = spark.createDataFrame([("b", 1, "Memory", 1, "A", "1999", "T", "V", "raw1"), ("b", 1, "Memory", 2, "A", "1999", "T", "V", "raw1")], "book_key string, ch_ord int, ch_title string, ref_ord int, authors string, year string, title string, venue string, raw string")
    out = {r.term: r for r in C.link_all(lookup, ch, refs).collect()}
    assert out["synapse"].chapters == ["Memory"] and [r.raw for r in out["synapse"].references] == ["raw1"]
    assert out["edge"].chapters == ["Memory"] and out["far"].chapters is None and out["other"].chapters is None
    assert {r.ch_title for r in C.link_chapters(spark.createDataFrame([("x", "b", ["55"])], lookup.schema), ch).collect()} == {"p. 51–60"}


def test_markers(spark):
    rows = C.page_markers(md(spark, "<!-- p. 45 -->", "x", "<!-- ch. A3 -->", "<!-- p. 45 -->", " <!-- p. 9 -->")).collect()
    assert {r.marker: r.line_idx for r in rows} == {"45": 0, "A3": 2}
    lines = C.markdown_lines(spark.createDataFrame([("b", "a\r\nb\x0cc\n")], "book_key string, markdown string")).orderBy("line_no").collect()
    assert [r.line for r in lines] == ["a", "b", "c"]


def ch(spark, *rows):
    return spark.createDataFrame([("b", i, t, s, e, r) for i, (t, s, e, r) in enumerate(rows)], "book_key string, ch_ord int, title string, start_page int, end_page int, ref_start_line int")


def contents(spark, *rows):
    return spark.createDataFrame([("b", i, level, t, p) for i, (level, t, p) in enumerate(rows)], "book_key string, toc_ord int, level int, title string, start_page int")


def titles(df):
    return [(r.ch_ord, r.title) for r in df.orderBy("ch_ord").collect()]


def test_toc(spark):
    entries = contents(spark, (0, "Chapter 1 One", 5), (1, "part", 7), (0, "Chapter 2 Two", 20))
    chapters = ch(spark, ("x", 1, 4, 9), ("y", 4, 10, 9), ("z", 12, 15, 9), ("w", 18, 30, 9))
    assert titles(toc.asof_titles(chapters, entries)) == [(1, "part"), (2, "part"), (3, "Chapter 2 Two")]
    assert titles(toc.asof_titles(chapters, entries, True))[0] == (0, "x")
    assert [r.title for r in toc.top_level(entries).collect()] == ["Chapter 1 One", "Chapter 2 Two"]
    assert titles(toc.positional_titles(ch(spark, ("a", 1, 1, 1), ("b", 2, 2, 2), ("c", 3, 3, 3)), entries)) == [(0, "Chapter 1 One"), (1, "part"), (2, "Chapter 2 Two")]
    assert titles(toc.positional_titles(ch(spark, ("Chapter 2", 1, 1, 1)), entries)) == [(0, "Chapter 2 Two")]
    ends = toc.ends_before_next(ch(spark, ("a", 1, None, 1), ("b", 10, None, 2)), F.lit(99)).orderBy("ch_ord").collect()
    assert [r.end_page for r in ends] == [9, 99]


def test_toc_by_lines(spark):
    lines = md(spark, "<!-- p. 3 -->", "# Cycle 1", "### Chapter 2", "C H A P T E R", "### A long title", "<!-- p. 12 -->", "## Selected Reading", "x", "## References", "# Cycle 2", "## References")
    assert [(r.title, r.start_page, r.end_page) for r in toc.cycles(lines).orderBy("ch_ord").collect()] == [("Cycle 1", 3, 11), ("Cycle 2", 12, None)]
    opener = toc.spaced_openers(lines).first()
    assert (opener.number, opener.title, opener.first_page, opener.start_page, opener.end_page, opener.ref_line, opener.until) == ("### A long title", "<!-- p. 12 -->", 12, 12, 12, 8, 11)
    refs = ch(spark, ("a", 1, 2, 8))
    assert toc.extended_references(refs, lines).first().ref_start_line == 6
    assert titles(toc.numbered_titles(refs, lines, contents(spark, (0, "1 First", 1), (0, "2 Old", 9), (0, "2  Second", 9)))) == [(0, "Second")]
    starts = spark.createDataFrame([("b", 1), ("b", 9)], "book_key string, line_no int")
    assert {r.line_no: r.ref_line for r in toc.following_headings(starts, lines, C.REFERENCES).collect()} == {1: 8, 9: 10}
    targets = spark.createDataFrame([("b", 4), ("b", 99)], "book_key string, page int")
    assert {r.page: r.line_idx for r in toc.nearest_markers(targets, C.page_markers(lines)).collect()} == {4: 5, 99: None}


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_points_in_ranges(spark):
    from lexgrove.functions.ranking import in_ranges

    rng = random.Random(5)
    points = [(k, rng.choice([None, *range(-40, 700)])) for k in "abc" for _ in range(150)]
    ranges = [(k, n, None if rng.random() < 0.1 else a, None if rng.random() < 0.1 else a + rng.choice([-3, 0, 1, 15, 16, 17, 300, 2**31, 2**60])) for k in "abd" for n in range(40) for a in [rng.randrange(-50, 600)]]
    found = in_ranges(spark.createDataFrame(points, "k string, p int"), spark.createDataFrame(ranges, "k string, n int, a long, b long"), ["k"], "p", "a", "b")
    want = sorted((k, p, n) for k, p in points for j, n, a, b in ranges if j == k and None not in (p, a, b) and a <= p <= b)
    assert sorted((r.k, r.p, r.n) for r in found.collect()) == want


def test_scans_grow_with_the_lines(spark):
    lines = spark.createDataFrame([("b", i, "## References" if i % 5 == 4 else f"## Chapter title {i}") for i in range(40)], "book_key string, line_no int, line string")
    found = C.detect(lines)
    # a window to the end of the book is computed anew for each of its lines
    assert "unboundedfollowing" not in plan_of(found).lower()
    assert [r.title for r in found.orderBy("ch_ord").collect()] == [f"Chapter title {i}" for i in range(0, 40, 5)]
    # a line meets the sections near it, and not all of its book
    for made in (C.references(lines, found), C.numbered_sections(lines, found), C.link_chapters(spark.createDataFrame([("t", "b", ["3"])], "term string, book_key string, pages array<string>"), found)):
        assert "_block" in plan_of(made)


def test_variants_need_no_chapters(spark, tmp_path):
    from lexgrove.plans import source_queries, tables

    parts = [(k, f"{a} {b}", f"Brand#{k % 3 + 1}", "SMALL", k % 50 + 1, 1.0) for k, (a, b) in enumerate([(a, b) for a in ("small", "large", "hot") for b in ("ring", "bolt")] * 4)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    source_queries.QUERIES["variants_top20"](spark, str(tmp_path)).collect()
    kept = {name for name, _, folder in tables._kept if folder == str(tmp_path)}
    assert "pairs" in kept and not kept & {"markdown", "chapters", "references", "relation-occurrences"}


def test_titles_by_place_or_piece(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    chapters = [(k, n, rng.choice(["", word(2), word(3), word(30)])) for k in "xyz" for n in range(12)]
    entries = [(k, n, word(rng.choice([0, 1, 9, 40]))) for k in "xy" for n in range(12 if k == "x" else 30)]
    entries += [("y", 30 + i, "On " + t) for i, (k, _, t) in enumerate(chapters) if k == "y" and len(t) == 30]
    out = toc.positional_titles(spark.createDataFrame(chapters, "book_key string, ch_ord int, title string"), spark.createDataFrame(entries, "book_key string, toc_ord int, title string"))
    of = lambda k: [t for b, _, t in entries if b == k]
    want = {(k, n): of(k)[n] if k == "x" else next((t for t in of(k) if title and title[:25] in t), title) for k, n, title in chapters}
    assert {(r.book_key, r.ch_ord): r.title for r in out.collect()} == want
    # no entry meets all chapters of its book
    assert "contains(" not in plan_of(out).lower()


def test_titles_of_pages_by_blocks(spark):
    rng = random.Random(3)
    page = lambda: rng.choice([None, 0, 1, 7, 8, 63, 64, 511, 5000, 999999, 1000000, *range(20)])
    chapters = [(k, n, f"c{n}", page(), page()) for k in "xyz" for n in range(60)]
    entries = [(k, n, f"{k}{n}", page()) for k, many in (("x", 40), ("y", 4)) for n in range(many)]
    made = toc.asof_titles(spark.createDataFrame(chapters, "book_key string, ch_ord int, title string, start_page int, end_page int"), spark.createDataFrame(entries, "book_key string, toc_ord int, title string, start_page int"), True)

    def want(k, title, start, end):
        own = [(n, t, p) for b, n, t, p in entries if b == k and p is not None]
        inside = [t for _, t, p in own if start is not None and start <= p <= (999999 if end is None else end)]
        before = [t for _, t, p in own if start is not None and p <= start]
        return (inside or before or [title])[-1]

    assert {(r.book_key, r.ch_ord): r.title for r in made.collect()} == {(k, n): want(k, t, a, b) for k, n, t, a, b in chapters}
    # no chapter meets all entries of its book
    assert "start_page#" not in " ".join(x for x in plan_of(made).splitlines() if "Join Inner" in x)
