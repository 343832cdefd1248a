"""Publishers' page layouts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lexgrove.operators import chapters as C
from lexgrove.operators import layouts, pages, toc
from lexgrove.operators.hooks import STAGES, Hooks
from lexgrove.plans import layout_queries

SEGMENT = "book_key string, pdf_page int, book_page int, text string"


def run(spark, layout, stage, rows, **options):
    df = spark.createDataFrame([("b", i, p, t) for i, (p, t) in enumerate(rows)], SEGMENT)
    df = pages.annotate(df) if stage == "post_annotate" else df
    hooks = layouts.install(Hooks(), "b", layout, **options)
    return hooks.apply(stage, df).orderBy("pdf_page").collect()


@pytest.mark.parametrize(
    "layout, texts, want",
    [
        ("numbered chapters", ["Title\nx\n77", "60\nbody", "12\nA. Author et al.\nbody", "3\n44\nbody", "9\nlower body", "4\nUpper title\nbody\n81", "none"], [77, 60, 12, 44, 9, 81, 82]),
        ("author initials", ["front", "Chapter 1\nbody", "14\nD.D. Someone\nbody", "3\nTitle\n15\nbody"], [None, 14, 15]),
        ("bars", ["front", "64 | CHAPTER 2\nbody", "The story | 65\nbody"], [64, 65]),
        ("wide spaces", ["front 12", "8 Part I\nbody", "Title 9\nbody"], [8, 9]),
        ("author lists", ["front", "© Wiley opener", "100\nA. Smith, B. Jones, and C. Lee", "Title\n101\nbody", "© Wiley opener", "2010\nbody"], [100, 101, None]),
        ("inline numbers", ["front", "DOI: 10.1/x", "Title\n(p. 7) text", "Title\nno number"], [7, None]),
        ("outline openers", ["front", "C H A P T E R 1"], [None]),
        ("cycles", ["front", "Cycle 1\nbody", "more"], [None, None]),
    ],
)
def test_page_numbers(spark, layout, texts, want):
    assert [r.book_page for r in run(spark, layout, "post_segment", [(None, t) for t in texts])] == want


@pytest.mark.parametrize(
    "layout, text, want",
    [
        ("author initials", "12\nD.D. Someone\nbody text", "body text"),
        ("bars", "64 | CHAPTER 2\nbody text", "body text"),
        ("wide spaces", "8 Part I\nbody text", "body text"),
        ("author lists", "A. Smith, B. Jones, and C. Lee\nbody text\n12", "body text"),
        ("inline numbers", "\nRunning title\nbody text", "\nbody text"),
        ("outline openers", "C H A P T E R 2\nkept\nO U T L I N E\nlist", "C H A P T E R 2\nkept"),
    ],
)
def test_running_heads(spark, layout, text, want):
    others = [(n, f"other{n}a\nother{n}b\nother{n}c") for n in range(2, 8)]
    assert run(spark, layout, "post_strip", [(1, text), *others])[0].text == want


@pytest.mark.parametrize("layout", ["author initials", "author lists", "bars", "inline numbers", "wide spaces"])
def test_last_five_pages_keep_their_lines(spark, layout):
    # the last window holds five pages, of which one is a fifth
    got = run(spark, layout, "post_strip", [(n, f"head\nfirst{n}\nlast{n}" if layout == "inline numbers" else f"first{n}\nlast{n}") for n in range(20)])
    assert [r.text for r in got] == [f"first{n}\nlast{n}" for n in range(20)]


@pytest.mark.parametrize(
    "layout, text",
    [("spaced openers", "City, France"), ("spaced openers", "O U T"), ("spaced openers", "Smith (Eds.)"), ("bars", "FIGURE 3 Something"), ("bars", "Ends with the"), ("author lists", "A. Smith, B. Jones, and C. Lee"), ("inline numbers", "Page 3 of 12")],
)
def test_headings_that_are_none(spark, layout, text):
    kept = run(spark, layout, "post_annotate", [(1, f"\n{text}\n\nReal Heading Here\n")])[0].headings
    assert [h.text for h in kept] == ["Real Heading Here"]


def test_chapters(spark):
    lines = spark.createDataFrame([("b", i, x) for i, x in enumerate(["<!-- p. 3 -->", "# Cycle 1", "<!-- p. 9 -->", "# Cycle 2", "## Suggested Reading", "<!-- p. 20 -->", "Smith, J. 1999."])], "book_key string, line_no int, line string")
    found = spark.createDataFrame([("b", 1, "x", 3, 9, 4, 7)], "book_key string, ch_ord int, title string, start_page int, end_page int, ref_start_line int, ref_end_line int")
    contents = spark.createDataFrame([("b", 0, 0, "Chapter 1: One", 3), ("b", 1, 1, "part", 5), ("b", 2, 0, "Chapter 2: Two", 9)], "book_key string, toc_ord int, level int, title string, start_page int")
    tables = {"lines": lines, "markers": C.page_markers(lines)}
    get = lambda name, **o: [tuple(r)[2:] for r in layouts.install(Hooks(), "b", name, **o).apply("post_chapter_detect", found, **tables).orderBy("ch_ord").collect()]
    assert get("cycles", bibliography=20) == [("Cycle 1", 3, 8, None, None), ("Cycle 2", 9, 19, None, None), ("Bibliography", 20, None, 5, 7)]
    assert get("bars", contents=contents)[0][:3] == ("One", 3, 8)
    # without a later entry the number of lines stands for its page
    assert get("bars", contents=contents)[1] == ("Two", 9, 6, None, 2)
    assert get("numbered chapters", contents=contents)[0][0] == "Chapter 2: Two" and get("inline numbers")[0][0] == "x"
    for name, held in layouts.layouts().items():
        assert set(held) <= set(STAGES), name


LINES = ["C H A P T E R", " C H A P T E R", "## C H A P T E R 4", "## C H A P T E R", "<!-- p. 3 -->", "<!-- p. 9 -->", "<!-- p. 12 -->", "<!-- p. 20 -->", "<!-- p. 31 -->", "<!-- p. 0 -->", "<!-- ch. 12 -->", "## References", "## References ", "## Suggested Reading", "### A title", "### ab", " ### Other title ", "", "  ", "7", "plain text"]


def book(rnd, most):
    return [rnd.choice(LINES) for _ in range(rnd.randint(0, most))]


def page_of(line):
    m = re.match(r"<!-- p\. (\d+) -->", line)
    return int(m[1]) if m else None


def spaced(lines):
    """Chapters from opening marks by a plain scan."""
    at = [i for i, x in enumerate(lines) if x.strip() == "C H A P T E R"]
    out = []
    for i, until in zip(at, at[1:] + [len(lines)]):
        solid = [x.strip() for x in lines[i + 1 :] if x.strip()]
        body = [p for x in lines[i:until] if (p := page_of(x)) is not None and p > 10]
        refs = [n for n in range(i + 1, until) if re.match(r"## References\s*$", lines[n])]
        out.append((solid[1] if len(solid) > 1 else "", min(body, default=None), max(body, default=None), refs[0] if refs else None, until))
    return out


def outlined(lines):
    """Chapters from opening headings, with one list of references, by a plain scan."""
    found = []
    for i, x in enumerate(lines):
        if x.startswith("## C H A P T E R"):
            title = next((y.strip()[4:] for y in lines[i + 1 : i + 15] if y.strip().startswith("### ") and len(y.strip()) > 6), "")
            page = next((p for y in lines[i + 1 : i + 20] if (p := page_of(y)) is not None), None)
            if page is not None:
                found.append((title, page))
    refs = next((n for n, x in enumerate(lines) if re.match(r"## References\s*$", x)), None)
    first = {}
    for n, x in enumerate(lines):
        if (p := page_of(x)) is not None:
            first.setdefault(p, n)
    out = []
    for k, (title, page) in enumerate(found):
        if k + 1 == len(found):
            out.append((title, page, None, refs, len(lines)))
        else:
            following = found[k + 1][1]
            out.append((title, page, following - 1 if following else None, None, first[following] if following else refs or len(lines)))
    return out


@pytest.mark.parametrize("layout, plain, kept", [("spaced openers", spaced, True), ("outline openers", outlined, False)])
def test_chapters_from_openers(spark, layout, plain, kept):
    rnd = random.Random(5)
    books = {f"b{n}": book(rnd, 120) for n in range(60)}
    lines = spark.createDataFrame([(k, i, x) for k, v in books.items() for i, x in enumerate(v)], "book_key string, line_no int, line string")
    given = spark.createDataFrame([(k, 7, "given", 1, 2, 3, 4) for k in books], CHAPTERS)
    hooks = layouts.install(Hooks(), books, layout)
    got = {k: [] for k in books}
    for r in hooks.apply("post_chapter_detect", given, lines=lines).orderBy("book_key", "ch_ord").collect():
        got[r.book_key].append(tuple(r)[2:])
    assert got == {k: plain(v) or ([("given", 1, 2, 3, 4)] if kept else []) for k, v in books.items()}


CHAPTERS = "book_key string, ch_ord int, title string, start_page int, end_page int, ref_start_line int, ref_end_line int"


def test_first_page_soon_after_an_opener(spark):
    rnd = random.Random(9)
    books = {f"b{n}": book(rnd, 150) for n in range(30)}
    lines = spark.createDataFrame([(k, i, x) for k, v in books.items() for i, x in enumerate(v)], "book_key string, line_no int, line string")
    got = {(r.book_key, r.line_no): r.first_page for r in toc.spaced_openers(lines).collect()}
    want = {(k, i): next((p for y in v[i : i + 30] if (p := page_of(y)) is not None and p > 10), None) for k, v in books.items() for i, x in enumerate(v) if x.strip() == "C H A P T E R"}
    assert got == want


def test_top_level_chapters(spark):
    lines = spark.createDataFrame([("b", i, x) for i, x in enumerate(["<!-- p. 1 -->", "x", "## Suggested Reading", "<!-- ch. 11 -->", "<!-- p. 12 -->", "## Suggested Reading", "<!-- p. 40 -->", "## Suggested Reading"])], "book_key string, line_no int, line string")
    entries = [(0, "Preface", 1), (0, "Chapter 1: Alpha", 1), (1, "Chapter 9: inner", 5), (0, "CHAPTER 2:  Beta ", 11), (0, "Index", 30), (0, "Later", 35)]
    contents = spark.createDataFrame([("b", i, *e) for i, e in enumerate(entries)], "book_key string, toc_ord int, level int, title string, start_page int")
    rows = [tuple(r)[1:] for r in toc.top_level_chapters(contents, lines).orderBy("ch_ord").collect()]
    assert rows == [(1, "Alpha", 1, 10, 2, 4), (2, "Beta", 11, 29, 5, 6)]
    last = toc.top_level_chapters(contents.where("toc_ord < 4"), lines).orderBy("ch_ord").collect()[1]
    assert (last.end_page, last.ref_end_line) == (7, 4)


def test_contents_titles(spark):
    chapters = spark.createDataFrame([("b", 1, "x", None, 4, 0, 0), ("b", 2, "y", 3, 9, 0, 0), ("b", 3, "z", 20, None, 0, 0), ("c", 1, "w", 1, 2, 0, 0)], CHAPTERS)
    contents = spark.createDataFrame([("b", 0, 0, "1 First of it", 4), ("b", 1, 0, "2  Second", 8), ("b", 2, 0, "Third", 50)], "book_key string, toc_ord int, level int, title string, start_page int")
    hooks = layouts.install(Hooks(), ("b", "c"), "numbered chapters", contents=contents)
    assert [(r.book_key, r.title) for r in hooks.apply("post_chapter_detect", chapters).orderBy("book_key", "ch_ord").collect()] == [("b", "x"), ("b", "Second"), ("b", "Third"), ("c", "w")]
    assert [r.toc_title for r in toc.by_number(contents.union(spark.createDataFrame([("b", 9, 0, "2 Newer ", 1)], contents.schema))).orderBy("number").collect()] == ["First of it", "Newer"]
    noise = spark.createDataFrame([("b", "x © Springer"), ("b", "A et al"), ("b", "B et al")], "book_key string, term string")
    hooks = layouts.install(Hooks(), "b", "numbered chapters", noise=("© Springer", "A et al"))
    assert [r.term for r in hooks.apply("post_index_parse", noise).collect()] == ["B et al"]


def test_made_lines_have_their_rule_once(spark):
    lines = layout_queries._tables(spark, "/root/testdata/sf0.001")[1]
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("## Suggested Reading") == 1


def test_many_books_share_a_pass(spark):
    """A thousand hooked books are read as often as two."""

    def scans(n):
        df = spark.range(5000).select(F.concat(F.lit("b"), (F.col("id") % 1500).cast("string")).alias("book_key"), "id")
        hooks = Hooks()
        even, odd = (lambda d, **_: d.where("id % 2 = 0")), (lambda d, **_: d.where("id % 2 = 1"))
        for k in range(n):
            hooks.register(f"b{k}", "post_page_map", even if k % 2 else odd)
        out = hooks.apply("post_page_map", df)
        assert out.count() == 5000 - sum(1 for i in range(5000) if i % 1500 < n and i % 2 == (0 if i % 1500 % 2 == 0 else 1))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Range"), plan.count("Join")

    assert scans(2) == scans(1000)
