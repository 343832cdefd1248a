"""Page segments, headers, headings, markdown."""

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from lexgrove.functions import text as T
from lexgrove.operators import pages
from lexgrove.plans import tables, text_queries

SEGMENT = "book_key string, pdf_page int, book_page int, text string"


def texts(spark, text):
    return spark.createDataFrame([("b", text)], "book_key string, text string")


def segments(spark, rows):
    return spark.createDataFrame([("b", i, p, t) for i, (p, t) in enumerate(rows)], SEGMENT)


def cut(spark, text):
    return [(r.pdf_page, r.book_page) for r in pages.segment(texts(spark, text)).orderBy("pdf_page").collect()]


def test_segments(spark):
    assert cut(spark, "one\n1\fiv\nfront\f\f  \ftwo\n2\fno number") == [(0, 1), (4, 2), (5, None)]
    assert cut(spark, "12\nmiddle\niv") == [(0, 12)] and cut(spark, "iv\nmiddle\n12") == []
    assert cut(spark, "12345\ntext") == [(0, None)]
    assert cut(spark, "aa\nbb\nee\n7\nff\ngg\nhh") == [(0, None)]  # beyond the outer lines


def test_page_map_last_wins(spark):
    rows = pages.page_map(segments(spark, [(1, "x"), (None, "y"), (1, "z"), (2, "w")])).collect()
    assert {r.book_page: r.pdf_page for r in rows} == {1: 2, 2: 3}


def body(i, header="Header"):
    return f"{header}\n{i}\nline a{i}\nline b{i}\nmiddle Header\nline c{i}\nline d{i}\nline e{i}"


def bad(df, **k):
    return {r.line for r in pages.bad_lines(df, **k).collect()}


def test_headers(spark):
    df = segments(spark, [(i, body(i) + f"\n{'Header' if i == 3 else 'x'}\nbody {i}\nHeader in body\ntail1\ntail2\ntail3") for i in range(30)])
    assert "Header" in bad(df) and not any(x.isdigit() for x in bad(df))
    out = {r.pdf_page: r.text for r in pages.strip_headers(df).collect()}
    assert not out[0].startswith("Header") and "Header in body" in out[0] and "Header" in out[3].split("\n")


def test_bad_lines_are_those_of_books_and_windows(spark):
    df = segments(spark, [(i, body(i, ("Header", f"Chapter {i // 20}", f"once {i}")[i % 3])) for i in range(73)])
    both = pages.frequent_lines(df).select("line").union(pages.frequent_in_windows(df).select("line")).distinct()
    assert bad(df) == {r.line for r in both.collect()} and bad(df, global_share=0.01, window_share=2.0) > bad(df)


def test_windows_find_chapter_titles(spark):
    df = segments(spark, [(i, body(i, f"Chapter {i // 20}")) for i in range(100)])
    assert not {r.line for r in pages.frequent_lines(df).collect()} & {"Chapter 0", "Chapter 4"}
    assert {"Chapter 0", "Chapter 1", "Chapter 4"} <= bad(df, size=20, window_share=0.40)


def level(spark, text):
    rows = pages.annotate(segments(spark, [(1, text)])).first().headings
    return [(r.line_idx, r.level, r.text) for r in rows]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Cycle 1", [(0, 1, "Cycle 1")]),
        ("\nNavigation in Real Space\n\nbody text that goes on.", [(1, 2, "Navigation in Real Space")]),
        ("A note", [(0, 3, "A note")]),
        ("\nEnds with a stop.\n", []),
        ("\n42\n", []),
        ("\n" + "x" * 80 + "\n", []),
        ("one line\nright after\nanother", [(0, 3, "one line"), (2, 3, "another")]),
        ("\nALL CAPS HEADING\n", [(1, 2, "ALL CAPS HEADING")]),
        ("\nthe lower start Of Words\n", [(1, 3, "the lower start Of Words")]),
    ],
)
def test_headings(spark, text, want):
    assert level(spark, text) == want


def test_markdown(spark):
    df = pages.annotate(segments(spark, [(1, "Cycle 1\n\nbody of the page.\n#hash."), (None, "dropped"), (2, "  # indented.\nmore body here.")]))
    registry = spark.createDataFrame([("b", "T", "A", 2020, None, "x.epub")], "book_key string, title string, author string, year int, pdf string, epub_path string")
    text = pages.markdown(df, registry).first().markdown
    assert text == "---\ntitle: T\nauthor: A\nyear: 2020\nsource_pdf: x.epub\n---\n\n<!-- p. 1 -->\n\n# Cycle 1\n\nbody of the page.\n\\#hash.\n\n<!-- p. 2 -->\n  # indented.\nmore body here.\n"


def test_lines_between_headings(spark):
    rnd = random.Random(3)
    texts = ["\n".join(rnd.choice(["", "#x", "A Good Heading", "plain text.", "7"]) for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    df = pages.annotate(segments(spark, [(1, t) for t in texts]))
    # one more beyond the last line, as a hook may leave it
    df = df.withColumn("headings", F.concat("headings", F.array(F.struct(F.lit(99).alias("line_idx"), F.lit(2).alias("level"), F.lit("gone").alias("text")))))
    for r in pages.render(df).collect():
        lines = [x.replace("#", "\\#") for x in r.text.split("\n")]
        for h in r.headings[:-1]:
            lines[h.line_idx] = f"\n{'#' * h.level} {h.text}\n"
        assert r.markdown == re.sub(r"\n{3,}", "\n\n", "\n".join(["<!-- p. 1 -->", *lines])).strip()


def test_rendering_does_not_grow_with_headings_times_lines(spark):
    # a page of twenty thousand lines, of which every second is a heading
    df = pages.annotate(segments(spark, [(1, "Good\n\n" * 20000)]))
    began = time.time()
    assert pages.render(df).select(F.length("markdown")).first()[0] == len("<!-- p. 1 -->" + "\n\n### Good" * 20000) and time.time() - began < 20


def test_page_tools(spark):
    df = segments(spark, [(None, "front"), (None, "C H A P T E R"), (5, "five"), (None, "gap"), (None, "gap")])
    assert [r.pdf_page for r in pages.without_front(df, F.contains("text", F.lit("C H A P"))).orderBy("pdf_page").collect()] == [1, 2, 3, 4]
    assert pages.without_front(df, F.lit(False)).count() == 5
    assert [r.book_page for r in pages.interpolated(df).orderBy("pdf_page").collect()] == [None, None, 5, 6, 7]
    outline = segments(spark, [(1, "C H A P T E R\nkeep\nO U T L I N E\ngone"), (2, "O U T L I N E\nstays")])
    assert [r.text for r in pages.cut_from(outline, "C H A P T E R", "O U T L I N E").orderBy("pdf_page").collect()] == ["C H A P T E R\nkeep", "O U T L I N E\nstays"]
    noted = pages.without_headings(pages.annotate(segments(spark, [(1, "\nFigure One Here\n\nA Real Heading\n")])), r"^Figure")
    assert [h.text for h in noted.first().headings] == ["A Real Heading"]


def exchanges(spark, name):
    """How often a query's rows move, and how many tables it stores."""
    tables.forget()
    plan = text_queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), len(tables._kept)


@pytest.mark.parametrize("name", ["header_freq_window", "header_freq_global"])
def test_outer_lines_are_counted_where_pages_are_cut(spark, name):
    assert exchanges(spark, name) == (1, 0)


@pytest.mark.parametrize("name, uses", [("strip_headers", 2), ("heading_detect", 2), ("markdown_render", 3)])
def test_stripping_moves_texts_for_books_alone(spark, name, uses):
    # for the pages, for the lines that are counted, and for the books' names
    assert exchanges(spark, name) == (uses, 0)


def test_headings_are_found_once(spark):
    plan = text_queries.QUERIES["heading_detect"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("cycle") == 1


@pytest.mark.parametrize("name", ["page_interpolation", "page_map", "page_segment"])
def test_numbers_need_no_stored_texts(spark, name):
    assert exchanges(spark, name) == (1, 0)


def test_outlines_have_the_numbers_of_their_texts(spark):
    rnd = random.Random(19)
    some = ["", " ", " ", "12", " 7\t", "iv", "XII ", "x", "-", "12345", "plain text", "9\r", "a\x0b3", "\f", "\f", "3\f4"]
    made = lambda: "\n".join(rnd.choice(some) for _ in range(rnd.randint(0, 14)))
    rows = [(f"b{i}", made(), made(), made()) for i in range(600)] + [("alone", "", "", "")]
    parts = spark.createDataFrame(rows, "book_key string, head string, text string, tail string")
    for place in (lambda text: text, lambda text: F.concat_ws("\n", "head", text, "tail")):
        whole, short = ([tuple(r) for r in pages.segment(parts.select("book_key", place(c).alias("text"))).select("book_key", "pdf_page", "book_page").orderBy("book_key", "pdf_page").collect()] for c in (F.col("text"), pages.outline(F.col("text"))))
        assert whole == short and len({p for _, _, p in whole}) > 3
    assert spark.range(1).select(pages.outline(F.lit(None).cast("string"))).first()[0] == ""


def moved(spark, df):
    """The bytes that a query's rows have when they move."""

    def below(node):
        name = node.getClass().getSimpleName()
        inner = node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan() if name.endswith("QueryStageExec") else None
        children = [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
        own = node.metrics().apply("dataSize").value() if name == "ShuffleExchangeExec" else 0
        return own + sum(map(below, children))

    df.collect()
    return below(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("name", ["page_interpolation", "page_map"])
def test_numbers_are_found_without_moving_texts(spark, tmp_path, name):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") != 7, F.repeat(F.lit("a line of text\n"), 2000)).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = text_queries.QUERIES[name](spark, str(tmp_path))
    assert moved(spark, df) < 300 * 1000
    # a page without text keeps its place
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({text_queries.ORACLES[name]})").fetchall()
    assert {tuple(r) for r in df.collect()} == set(want) and len(want) == 297


def test_white_space(spark):
    rows = spark.createDataFrame([(chr(i),) for i in range(1, 0x3100)], "c string")
    old = F.regexp_replace(F.concat("c", F.lit("\n"), "c", F.lit("a"), "c", F.lit("b"), "c"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    assert rows.where(T.strip(F.concat("c", F.lit("\n"), "c", F.lit("a"), "c", F.lit("b"), "c")) != old).count() == 0
    assert rows.where(T.is_blank("c") != F.col("c").rlike(r"(?U)^[\s\x1c-\x1f]$")).count() == 0
