"""Tables of contents: naming and cutting chapters by them, and chapters from marks in the lines.

toc rows are (book_key, toc_ord, level, title, start_page), lines (book_key, line_no, line).
Nearest-entry joins are equi-joins on the book with an ordered aggregate, so no pair
outlives its group; what lies within a number of lines is a window with a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from .chapters import PAGE_MARK

#: A chapter without an end page is open.
OPEN = 999999

# A chapter's number before its title in the contents.
NUMBERED = r"^(\d+)\s+(.+)"


def in_book():
    """The lines of a book in order."""
    return Window.partitionBy("book_key").orderBy("line_no")


def marked_page() -> Column:
    """The page that a line marks, else null."""
    return F.regexp_extract("line", PAGE_MARK, 1).try_cast("int")


def unnumbered(toc: DataFrame) -> DataFrame:
    """Entries without the number before their title."""
    return toc.withColumn("title", F.regexp_replace("title", NUMBERED, "$2"))


def by_number(toc: DataFrame) -> DataFrame:
    """book_key, number, toc_title: one entry for each number before a title; the last one stands."""
    named = toc.select("book_key", "toc_ord", F.regexp_extract("title", NUMBERED, 1).try_cast("int").alias("number"), strip(F.regexp_extract("title", NUMBERED, 2)).alias("toc_title"))
    return named.where("number IS NOT NULL").groupBy("book_key", "number").agg(F.max_by("toc_title", "toc_ord").alias("toc_title"))


def _with_contents(chapters: DataFrame, toc: DataFrame) -> DataFrame:
    return chapters.join(toc.select("book_key").distinct().withColumn("_known", F.lit(True)), "book_key", "left")


#: Blocks of pages have a size of 2 to a multiple of this; their levels reach as far as pages do.
BITS, LEVELS = 3, 11


def _down(page: Column, level: int) -> Column:
    return F.shiftright(page.cast("long"), BITS * level)


def _blocks(start: Column, end: Column) -> Column:
    """The few whole blocks (level, block) that make up the pages from start to end."""

    def numbers(level: int, low: Column, high: Column) -> Column:
        told = F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(told, lambda b: F.struct(F.lit(level).alias("level"), b.alias("block")))

    span = lambda n: (-_down(-start.cast("long"), n), _down(end.cast("long") + 1, n))
    out = []
    for n in range(LEVELS):
        low, high = span(n)
        if n + 1 < LEVELS:
            over, under = (F.shiftleft(x, BITS) for x in span(n + 1))
            some = over < under
            out += [numbers(n, low, F.when(some, over).otherwise(high)), numbers(n, F.when(some, under).otherwise(high), high)]
        else:
            out.append(numbers(n, low, high))
    return F.concat(*out)


def asof_titles(chapters: DataFrame, toc: DataFrame, keep_unmatched: bool = False) -> DataFrame:
    """Chapters titled by the last entry that begins in their pages, else the last one that begins before.

    Chapters that no entry precedes go, or keep their title with keep_unmatched.  A chapter
    without a start page keeps its title; one without an end page is open.  Books without
    contents are left alone.  The last entry of each block of pages is known, and a chapter
    asks the few blocks that make up its pages.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), _down(F.col("start_page"), n).alias("block")) for n in range(LEVELS)])).alias("at")
    entries = toc.where("start_page IS NOT NULL").select("book_key", "toc_ord", F.col("title").alias("toc_title"), each)
    firsts = entries.groupBy("book_key", "at.level", "at.block").agg(F.max_by("toc_title", "toc_ord").alias("toc_title"), F.max("toc_ord").alias("toc_ord"))
    inside = F.transform(_blocks(F.col("start_page"), F.coalesce("end_page", F.lit(OPEN))), lambda x: F.struct(F.lit(True).alias("inside"), x["level"].alias("level"), x["block"].alias("block")))
    before = F.transform(_blocks(F.lit(-(1 << 31)), F.col("start_page")), lambda x: F.struct(F.lit(False).alias("inside"), x["level"].alias("level"), x["block"].alias("block")))
    spans = chapters.where("start_page IS NOT NULL").select("book_key", "ch_ord", F.explode(F.concat(inside, before)).alias("at")).select("book_key", "ch_ord", "at.*")
    best = spans.join(firsts, ["book_key", "level", "block"]).groupBy("book_key", "ch_ord").agg(F.max_by("toc_title", F.struct("inside", "toc_ord")).alias("toc_title"), F.lit(True).alias("_told"))
    out = _with_contents(chapters, toc).join(best, ["book_key", "ch_ord"], "left")
    if not keep_unmatched:
        out = out.where("_told OR _known IS NULL OR start_page IS NULL")
    return out.withColumn("title", F.when(F.col("_told"), F.col("toc_title")).otherwise(F.col("title"))).select(*chapters.columns)


def nearest_markers(targets: DataFrame, markers: DataFrame) -> DataFrame:
    """targets (book_key, page) with line_idx of the first page mark at or after each page."""
    pages = markers.select("book_key", F.col("marker").try_cast("int").alias("marked"), "line_idx").where("marked IS NOT NULL")
    found = targets.select("book_key", "page").distinct().join(pages, "book_key").where("marked >= page").groupBy("book_key", "page").agg(F.min_by("line_idx", "marked").alias("line_idx"))
    return targets.join(found, ["book_key", "page"], "left")


def positional_titles(chapters: DataFrame, toc: DataFrame) -> DataFrame:
    """Chapters titled one to one where a book has as many entries, else by the first entry that holds the title's first 25 characters."""
    place = lambda order: F.row_number().over(Window.partitionBy("book_key").orderBy(order))
    many = lambda: F.count("*").over(Window.partitionBy("book_key"))
    left = chapters.withColumn("at", place("ch_ord")).withColumn("n", many())
    right = toc.select("book_key", "toc_ord", F.col("title").alias("toc_title")).withColumn("there", place("toc_ord"))
    counts = right.groupBy("book_key").agg(F.count("*").alias("m"))
    placed = left.join(counts, "book_key")
    one = placed.where("n = m").join(right.select("book_key", F.col("there").alias("at"), "toc_title", "toc_ord"), ["book_key", "at"]).select("book_key", "ch_ord", "toc_title", "toc_ord")
    # what a title holds is one of its pieces of that length, so the first entry of a piece is looked up by equality
    asked = placed.where("n <> m AND title <> ''").select("book_key", "ch_ord", F.substring("title", 1, 25).alias("piece"))
    sizes = asked.groupBy("book_key").agg(F.collect_set(F.length("piece")).alias("sizes"))
    texts = right.groupBy("book_key", "toc_title").agg(F.min("toc_ord").alias("toc_ord")).join(sizes, "book_key")
    places = F.sequence(F.lit(1), F.length("toc_title"))
    pieces = F.array_distinct(F.flatten(F.transform("sizes", lambda k: F.transform(F.filter(places, lambda i: i <= F.length("toc_title") - k + 1), lambda i: F.substr("toc_title", i, k)))))
    firsts = texts.select("book_key", "toc_title", "toc_ord", F.explode(pieces).alias("piece")).groupBy("book_key", "piece").agg(F.min(F.struct("toc_ord", "toc_title")).alias("e"))
    held = asked.join(firsts, ["book_key", "piece"]).select("book_key", "ch_ord", "e.toc_title", "e.toc_ord")
    best = one.union(held).groupBy("book_key", "ch_ord").agg(F.min_by("toc_title", "toc_ord").alias("toc_title"))
    return chapters.join(best, ["book_key", "ch_ord"], "left").withColumn("title", F.coalesce("toc_title", "title")).select(*chapters.columns)


def numbered_titles(chapters: DataFrame, lines: DataFrame, toc: DataFrame, pattern: str = r"(?i)^### Chapter\s+(\d+)", back: int = 2000) -> DataFrame:
    """Chapters titled by the number of the nearest chapter heading fewer than `back` lines before their references.

    The first line of a book is never looked at.
    """
    marks = lines.where(F.col("line").rlike(pattern)).select("book_key", "line_no", F.regexp_extract("line", pattern, 1).try_cast("int").alias("number"))
    near = chapters.select("book_key", "ch_ord", "ref_start_line").join(marks, "book_key").where(f"line_no < ref_start_line AND line_no > greatest(0, ref_start_line - {back})")
    numbers = near.groupBy("book_key", "ch_ord").agg(F.max_by("number", "line_no").alias("number"))
    named = numbers.join(by_number(toc), ["book_key", "number"]).select("book_key", "ch_ord", "toc_title")
    return chapters.join(named, ["book_key", "ch_ord"], "left").withColumn("title", F.coalesce("toc_title", "title")).select(*chapters.columns)


def following_headings(openers: DataFrame, lines: DataFrame, heading: str) -> DataFrame:
    """openers (book_key, line_no) with ref_line: the first heading strictly before the next opener."""
    order = Window.partitionBy("book_key").orderBy("line_no")
    spans = openers.withColumn("until", F.lead("line_no").over(order))
    marks = lines.where(F.col("line").rlike(heading)).select("book_key", F.col("line_no").alias("at"))
    found = spans.join(marks, "book_key").where("at > line_no AND (until IS NULL OR at < until)").groupBy("book_key", "line_no").agg(F.min("at").alias("ref_line"))
    return openers.join(found, ["book_key", "line_no"], "left")


def ends_before_next(chapters: DataFrame, last: Column | None = None) -> DataFrame:
    """Chapters whose end page is the page before the next one's start; the last one's is given."""
    order = Window.partitionBy("book_key").orderBy("ch_ord")
    return chapters.withColumn("end_page", F.coalesce(F.lead("start_page").over(order) - 1, F.lit(None).cast("int") if last is None else last))


def top_level(toc: DataFrame, pattern: str = r"^Chapter\s+\d+") -> DataFrame:
    """Entries of the outermost level that are chapters."""
    return toc.where((F.col("level") == 0) & F.col("title").rlike(pattern))


def cycles(lines: DataFrame, pattern: str = r"(?iU)^# (cycle\s+\d+)") -> DataFrame:
    """book_key, ch_ord, title, start_page, end_page: one chapter for each matching heading, from the page it is on."""
    order = Window.partitionBy("book_key").orderBy("line_no")
    page = F.last(F.nullif(F.regexp_extract("line", PAGE_MARK, 1), F.lit("")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    found = lines.withColumn("start_page", page.cast("int")).where(F.col("line").rlike(pattern) & F.col("start_page").isNotNull())
    rows = found.select("book_key", F.row_number().over(order).alias("ch_ord"), F.regexp_extract("line", pattern, 1).alias("title"), "start_page")
    return ends_before_next(rows)


def outline_openers(lines: DataFrame, mark: str = r"^## C H A P T E R", title: str = r"^### (.{3,})$", within: int = 14, pages: int = 19) -> DataFrame:
    """book_key, line_no, title, start_page of each opening mark: the first heading and the first page mark soon after it."""
    soon = lambda c, n: F.first(c, ignorenulls=True).over(in_book().rangeBetween(1, n))
    heading = F.nullif(F.regexp_extract(strip("line"), title, 1), F.lit(""))
    rows = lines.select("book_key", "line_no", F.col("line").rlike(mark).alias("opens"), soon(heading, within).alias("title"), soon(marked_page(), pages).alias("start_page"))
    return rows.where("opens").select("book_key", "line_no", F.coalesce("title", F.lit("")).alias("title"), "start_page")


def spaced_openers(lines: DataFrame, mark: str = "C H A P T E R", heading: str = r"^## References\s*$", above: int = 10, within: int = 30) -> DataFrame:
    """Each line that is an opening mark, with what follows it up to the next one.

    book_key, line_no, number and title (the next two lines that are not blank), first_page
    (the first page mark above `above` in the `within` lines from the mark on), start_page and
    end_page (the least and the largest such page up to the next mark), ref_line (the first
    reference heading) and until (the next mark's line, or the number of lines).
    """
    span = in_book().rowsBetween(Window.unboundedPreceding, 0)
    page = F.when(F.col("page") > above, F.col("page"))
    rows = lines.select("book_key", "line_no", strip("line").alias("s"), marked_page().alias("page"), F.col("line").rlike(heading).alias("refs"))
    rows = rows.withColumn("opener", F.last(F.when(F.col("s") == mark, F.col("line_no")), ignorenulls=True).over(span)).withColumn("first_page", F.first(page, ignorenulls=True).over(in_book().rangeBetween(0, within - 1)))
    spans = rows.where("opener IS NOT NULL").groupBy("book_key", "opener").agg(F.min(page).alias("start_page"), F.max(page).alias("end_page"), F.min(F.when(F.col("refs"), F.col("line_no"))).alias("ref_line"), (F.max("line_no") + 1).alias("until"))
    told = rows.where("s <> ''").select("book_key", "line_no", "s", "first_page", F.lead("s", 1).over(in_book()).alias("number"), F.lead("s", 2).over(in_book()).alias("title")).where(F.col("s") == mark)
    found = told.join(spans.withColumnRenamed("opener", "line_no"), ["book_key", "line_no"])
    return found.select("book_key", "line_no", F.coalesce("number", F.lit("")).alias("number"), F.coalesce("title", F.lit("")).alias("title"), "first_page", "start_page", "end_page", "ref_line", "until")


def page_lines(lines: DataFrame) -> DataFrame:
    """book_key, page, line_no: the first mark of each page."""
    return lines.select("book_key", marked_page().alias("page"), "line_no").where("page IS NOT NULL").groupBy("book_key", "page").agg(F.min("line_no").alias("line_no"))


def line_totals(lines: DataFrame) -> DataFrame:
    return lines.groupBy("book_key").agg((F.max("line_no") + 1).alias("total"))


def top_level_chapters(toc: DataFrame, lines: DataFrame, reading: str = "## Suggested Reading", pattern: str = r"(?i)^Chapter\s+\d+") -> DataFrame:
    """Chapters of the contents' outermost level, cut where the next one begins.

    The last chapter's successor is the next entry of that level, whatever it is, else the
    number of lines.  A page is where its mark is, or that of the next page that has one.
    """
    order = Window.partitionBy("book_key").orderBy("toc_ord")
    outer = toc.where("level = 0").select("book_key", "toc_ord", "title", "start_page", F.lead("start_page").over(order).alias("following"))
    chapters = outer.where(F.col("title").rlike(pattern)).withColumn("following", F.coalesce(F.lead("start_page").over(order), "following")).join(line_totals(lines), "book_key")
    cut = chapters.withColumn("following", F.coalesce("following", "total"))
    marks = page_lines(lines).select("book_key", F.col("page").cast("string").alias("marker"), F.col("line_no").alias("line_idx"))
    at = lambda page, name: nearest_markers(cut.select("book_key", "toc_ord", F.col(page).alias("page")), marks).select("book_key", "toc_ord", F.col("line_idx").alias(name))
    spans = cut.join(at("start_page", "start_line"), ["book_key", "toc_ord"]).join(at("following", "end_line"), ["book_key", "toc_ord"]).withColumns({"start_line": F.coalesce("start_line", F.lit(0)), "end_line": F.coalesce("end_line", "total")})
    lists = lines.where(F.col("line").startswith(reading)).select("book_key", "line_no")
    refs = spans.join(lists, "book_key").where("line_no >= start_line AND line_no < end_line").groupBy("book_key", "toc_ord").agg(F.min("line_no").alias("ref_start_line"))
    named = spans.join(refs, ["book_key", "toc_ord"], "left")
    title = strip(F.regexp_replace("title", r"(?i)^Chapter\s+\d+:\s+", ""))
    return named.select("book_key", F.row_number().over(order).alias("ch_ord"), title.alias("title"), "start_page", (F.col("following") - 1).alias("end_page"), "ref_start_line", F.col("end_line").alias("ref_end_line"))


def extended_references(chapters: DataFrame, lines: DataFrame, heading: str = r"^## Selected Reading", within: int = 119) -> DataFrame:
    """Chapters whose reference section begins at the nearest second-level heading before it, if that is a reading list.

    The first line of a book is never looked at.
    """
    seconds = lines.where(F.col("line").startswith("## ")).select("book_key", "line_no", F.col("line").rlike(heading).alias("reads"))
    near = chapters.select("book_key", "ch_ord", "ref_start_line").join(seconds, "book_key").where(f"line_no < ref_start_line AND line_no >= ref_start_line - {within} AND line_no > 0")
    before = near.groupBy("book_key", "ch_ord").agg(F.max(F.struct("line_no", "reads")).alias("b")).where("b.reads").select("book_key", "ch_ord", F.col("b.line_no").alias("before"))
    return chapters.join(before, ["book_key", "ch_ord"], "left").withColumn("ref_start_line", F.coalesce("before", "ref_start_line")).select(*chapters.columns)
