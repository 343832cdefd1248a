"""Markdown to chapters and references, and linking terms to both.

Lines are rows (book_key, line_no from 0, line).  The sequential scans of a
reference section are windows over classified lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ranking import in_ranges

# Marks, headings and lines of reference sections.
REFERENCES = r"(?iU)^## (?:References|Bibliography)\s*$"
PAGE_MARK = r"^<!-- p\. (\d+) -->"
CHAPTER_MARK = r"(?U)^<!-- ch\. (\w+) -->"
HEADING = r"^(#{1,4}) (.+)"
NO_TITLE = r"(?i)^(?:references|bibliography|suggested reading|further reading|recommended reading|highlights?|key concepts?|summary|introduction|c h a p t e r)"
PAGE_ONLY = r"^\d{1,4}$"
IGNORED = r"(?U)^(?:<!-- p\. \d+ -->|<!-- ch\. \w+ -->|\d{1,4}$|#{1,4} )"
LONG_BODY, LONG_ENTRY, BLANKS, BODY_RUN = 90, 120, 3, 4


def markdown_lines(documents: DataFrame) -> DataFrame:
    """documents (book_key, markdown) -> lines; a last empty line is none."""
    from .claims import LINE_END

    text = F.regexp_replace("markdown", rf"(?:{LINE_END})\z", "")
    return documents.select("book_key", F.posexplode(F.split(text, LINE_END)).alias("line_no", "line"))


def page_markers(lines: DataFrame) -> DataFrame:
    """book_key, marker, line_idx: page numbers and chapter labels, each where it comes first."""
    marker = F.coalesce(F.nullif(F.regexp_extract("line", PAGE_MARK, 1), F.lit("")), F.nullif(F.regexp_extract("line", CHAPTER_MARK, 1), F.lit("")))
    return lines.select("book_key", marker.alias("marker"), "line_no").where("marker IS NOT NULL").groupBy("book_key", "marker").agg(F.min("line_no").alias("line_idx"))


def _opens(heading: str | Column) -> Column:
    """Whether a line opens a reference section; heading is a pattern, or a boolean column of the lines."""
    return F.col("line").rlike(heading) if isinstance(heading, str) else heading


def sections(lines: DataFrame, heading: str | Column = REFERENCES) -> DataFrame:
    """book_key, ref_pos, limit: each reference heading and where the next one (or the book's end) is."""
    total = lines.groupBy("book_key").agg((F.max("line_no") + 1).alias("total"))
    found = lines.where(_opens(heading)).select("book_key", F.col("line_no").alias("ref_pos"))
    following = F.lead("ref_pos").over(Window.partitionBy("book_key").orderBy("ref_pos"))
    return found.withColumn("following", following).join(total, "book_key").select("book_key", "ref_pos", F.coalesce("following", "total").alias("limit"))


def reference_ends(lines: DataFrame, heading: str | Column = REFERENCES) -> DataFrame:
    """book_key, ref_pos, limit, ref_end: where each reference section gives way to other text.

    It ends at a first-level heading, at a second-level one that is no reference (with
    the page marks right before it), or at the first of three long lines without a year
    that follow each other.
    """
    at = Window.partitionBy("book_key").orderBy("line_no")
    so_far = at.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("ref_pos", F.last(F.when(_opens(heading), F.col("line_no")), ignorenulls=True).over(so_far)).where("ref_pos IS NOT NULL AND line_no > ref_pos")
    s = T.strip("line")
    title = T.strip(F.expr("substring(line, 4)"))
    reference = lambda c: c.rlike(T.YEAR) | c.rlike(T.AUTHOR)
    kind = (
        F.when(s == "", "blank")
        .when(F.col("line").rlike("^# [^#]"), "h1")
        .when(F.col("line").rlike(PAGE_MARK), "mark")
        .when(s.rlike(PAGE_ONLY), "number")
        .when(F.col("line").startswith("## "), F.when(reference(title), "reset").otherwise("stop"))
        .when(reference(s) | (F.length(s) <= LONG_BODY), "reset")
        .otherwise("body")
    )
    rows = rows.withColumn("kind", kind)
    section = Window.partitionBy("book_key", "ref_pos").orderBy("line_no")
    before = section.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("solid", F.coalesce(F.last(F.when(~F.col("kind").isin("blank", "mark"), F.col("line_no")), ignorenulls=True).over(before), F.col("ref_pos")))
    run = Window.partitionBy("book_key", "ref_pos", "solid").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("mark", F.min(F.when(F.col("kind") == "mark", F.col("line_no"))).over(run))
    stops = rows.where("kind IN ('h1', 'stop')").select("book_key", "ref_pos", F.col("line_no").alias("trigger"), F.when(F.col("kind") == "stop", F.coalesce("mark", "line_no")).otherwise(F.col("line_no")).alias("result"))
    told = rows.where("kind NOT IN ('blank', 'mark', 'number')")
    told = told.withColumn("one", F.lag("kind", 1).over(section)).withColumn("two", F.lag("kind", 2).over(section)).withColumn("start", F.lag("line_no", 2).over(section))
    bodies = told.where("kind = 'body' AND one = 'body' AND two = 'body'").select("book_key", "ref_pos", F.col("line_no").alias("trigger"), F.col("start").alias("result"))
    ends = stops.union(bodies).groupBy("book_key", "ref_pos").agg(F.min_by("result", "trigger").alias("result"))
    return sections(lines, heading).join(ends, ["book_key", "ref_pos"], "left").select("book_key", "ref_pos", "limit", F.coalesce("result", "limit").alias("ref_end"))


def detect(lines: DataFrame, heading: str | Column = REFERENCES) -> DataFrame:
    """book_key, ch_ord, title, start_page, end_page, ref_start_line, ref_end_line.

    A chapter is what lies between the end of one reference section and the heading
    of the next; its title is its first heading that tells something.
    """
    order = Window.partitionBy("book_key").orderBy("ref_pos")
    ends = reference_ends(lines, heading).withColumn("body", F.coalesce(F.lag("ref_end").over(order), F.lit(0))).withColumn("ch_ord", F.row_number().over(order))
    # the next heading as the last one of the lines backwards: a window that only ever grows
    after = Window.partitionBy("book_key").orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("ref_pos", F.last(F.when(_opens(heading), F.col("line_no")), ignorenulls=True).over(after)).where("ref_pos IS NOT NULL")
    text = T.strip(F.regexp_extract("line", HEADING, 2))
    rows = rows.select("book_key", "ref_pos", "line_no", F.regexp_extract("line", PAGE_MARK, 1).try_cast("int").alias("page"), F.when((F.length(text) >= 5) & ~text.rlike(NO_TITLE), text).alias("title"))
    found = rows.where("page IS NOT NULL OR title IS NOT NULL").join(ends.select("book_key", "ref_pos", "body"), ["book_key", "ref_pos"]).where("line_no >= body")
    told = found.groupBy("book_key", "ref_pos").agg(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("line_no"))).alias("title"), F.min("page").alias("start_page"), F.max("page").alias("end_page"))
    return ends.join(told, ["book_key", "ref_pos"], "left").select("book_key", "ch_ord", F.coalesce("title", F.lit("")).alias("title"), "start_page", "end_page", F.col("ref_pos").alias("ref_start_line"), F.col("ref_end").alias("ref_end_line"))


def join_entries(lines: DataFrame, keys: tuple[str, ...] = ("book_key", "ch_ord")) -> DataFrame:
    """Reference lines (keys, line_no, line) joined to entries: keys, entry_line, raw.

    An entry begins at a line that looks like an author and takes the lines that follow.
    Three blank lines close it.  After four long lines without a year that follow each
    other in an entry, the rest of the section is dropped.
    """
    order = Window.partitionBy(*keys).orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.where(~F.col("line").rlike(IGNORED)).withColumn("s", T.strip("line"))
    rows = rows.withColumn("blank", (F.col("s") == "").cast("int")).withColumn("start", F.when(F.col("s").rlike(T.ENTRY_START), 1).otherwise(0))
    rows = rows.withColumn("g", F.sum("start").over(so_far)).withColumn("n", F.sum(1 - F.col("blank")).over(so_far))
    blanks = F.sum("blank").over(Window.partitionBy(*keys, "n").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("closes", F.when((F.col("blank") == 1) & (blanks >= BLANKS), 1).otherwise(0))
    rows = rows.withColumn("closed", F.max("closes").over(Window.partitionBy(*keys, "g").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    live = rows.where("blank = 0 AND g > 0 AND closed = 0")
    long = (F.col("start") == 0) & (F.length("s") > LONG_ENTRY) & ~F.col("s").rlike(T.YEAR)
    live = live.withColumn("long", long.cast("int")).withColumn("rid", F.sum(1 - F.col("long")).over(so_far))
    longs = F.sum("long").over(Window.partitionBy(*keys, "rid").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    live = live.withColumn("breaks", F.when((F.col("long") == 1) & (longs >= BODY_RUN), 1).otherwise(0))
    kept = live.withColumn("over", F.max("breaks").over(so_far)).where("over = 0")
    parts = F.array_sort(F.collect_list(F.struct("line_no", "s")))
    return kept.groupBy(*keys, "g").agg(F.min("line_no").alias("entry_line"), F.array_join(F.transform(parts, lambda x: x["s"]), " ").alias("raw")).drop("g")


def references(lines: DataFrame, chapters: DataFrame) -> DataFrame:
    """book_key, ch_ord, ch_title, ref_ord, authors, year, title, venue, raw of every chapter with references.

    Where chapters of a book share a title, the last one's references stand for it.
    """
    known = chapters.where("ref_start_line IS NOT NULL").withColumn("ch_title", T.chapter_title("title", "start_page", "end_page"))
    last = Window.partitionBy("book_key", "ch_title").orderBy(F.desc("ch_ord"))
    known = known.withColumn("r", F.row_number().over(last)).where("r = 1").select("book_key", "ch_ord", "ch_title", "ref_start_line", "ref_end_line")
    known = known.withColumn("last_line", F.col("ref_end_line") - 1)
    inside = in_ranges(lines.select("book_key", "line_no", "line"), known, ["book_key"], "line_no", "ref_start_line", "last_line").select("book_key", "ch_ord", "ch_title", "line_no", "line")
    entries = join_entries(inside, ("book_key", "ch_ord", "ch_title"))
    order = Window.partitionBy("book_key", "ch_ord").orderBy("entry_line")
    return entries.select("book_key", "ch_ord", "ch_title", F.row_number().over(order).alias("ref_ord"), T.parse_reference("raw").alias("r")).select("book_key", "ch_ord", "ch_title", "ref_ord", "r.*")


def numbered_references(lines: DataFrame, keys: tuple[str, ...] = ("book_key",), least: int = 15) -> DataFrame:
    """Lines (keys, line_no, line) of numbered references ("12. ...") -> keys, ref_ord, authors, year, title, venue, raw.

    An entry begins at a line that a number opens and takes the lines that follow; lines
    before the first are one entry.  Comments, headings, page numbers and blank lines are
    none.  Entries of fewer than `least` characters, and those without a year, go.
    """
    order = Window.partitionBy(*keys).orderBy("line_no")
    rows = lines.where(~F.col("line").rlike(r"^(?:<!-- |#|\d{1,4}$)") & ~T.is_blank("line"))
    rows = rows.withColumn("piece", F.sum(F.col("line").rlike(r"^\d+\. ").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    whole = rows.groupBy(*keys, "piece").agg(F.array_join(parts, " ").alias("text"))
    entries = whole.withColumn("raw", F.regexp_replace(T.strip("text"), r"(?U)^\d+\.\s+", "")).where(F.length("raw") >= least)
    told = entries.select(*keys, "piece", T.parse_reference("raw").alias("r")).where("r.year <> ''")
    return told.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("piece")).alias("ref_ord"), "r.*")


def numbered_sections(lines: DataFrame, chapters: DataFrame) -> DataFrame:
    """book_key, ch_ord, ch_title, ref_ord, authors, year, title, venue, raw: each chapter's numbered references.

    A section without a first or last line begins or ends with the book.  Where chapters of
    a book share a title, the last one's references stand for it.
    """
    total = lines.groupBy("book_key").agg((F.max("line_no") + 1).alias("total"))
    last = Window.partitionBy("book_key", "ch_title").orderBy(F.desc("ch_ord"))
    known = chapters.withColumn("ch_title", F.coalesce("title", F.lit(""))).withColumn("r", F.row_number().over(last)).where("r = 1").join(total, "book_key")
    spans = known.select("book_key", "ch_ord", "ch_title", F.coalesce("ref_start_line", F.lit(0)).alias("from_line"), (F.coalesce("ref_end_line", "total") - 1).alias("last_line"))
    inside = in_ranges(lines.select("book_key", "line_no", "line"), spans, ["book_key"], "line_no", "from_line", "last_line").select("book_key", "ch_ord", "ch_title", "line_no", "line")
    return numbered_references(inside, ("book_key", "ch_ord", "ch_title"))


def link_chapters(occurrences: DataFrame, chapters: DataFrame) -> DataFrame:
    """occurrences (term, book_key, pages) and chapters -> term, book_key, ch_ord, ch_title; each title once.

    A page lies in a chapter of its book if the chapter's page range holds it, ends
    included.
    """
    placed = occurrences.select("term", "book_key", F.explode(F.array_distinct(T.int_pages("pages"))).alias("page"))
    ranges = chapters.where("start_page IS NOT NULL AND end_page IS NOT NULL").select("book_key", "ch_ord", "start_page", "end_page", T.chapter_title("title", "start_page", "end_page").alias("ch_title"))
    inside = in_ranges(placed, ranges, ["book_key"], "page", "start_page", "end_page")
    return inside.groupBy("term", "book_key", "ch_title").agg(F.min("ch_ord").alias("ch_ord"))


def link_references(linked: DataFrame, refs: DataFrame) -> DataFrame:
    """Linked chapters and references -> term, book_key, ch_ord, ref_ord, raw and more; each raw entry once, first chapter first."""
    joined = linked.join(refs.drop("ch_ord"), ["book_key", "ch_title"]).where("raw <> ''")
    first = Window.partitionBy("term", "book_key", "raw").orderBy("ch_ord", "ref_ord")
    return joined.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def link_all(lookup: DataFrame, chapters: DataFrame, refs: DataFrame) -> DataFrame:
    """The lookup's rows (term, book_key, pages, ...) with chapters (titles) and references (structs), in order."""
    linked = link_chapters(lookup, chapters)
    titles = linked.groupBy("term", "book_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch_ord", "ch_title"))), lambda x: x["ch_title"]).alias("chapters"))
    fields = ("authors", "year", "title", "venue", "raw")
    entries = link_references(linked, refs).groupBy("term", "book_key").agg(F.array_sort(F.collect_list(F.struct("ch_ord", "ref_ord", *fields))).alias("e"))
    entries = entries.select("term", "book_key", F.transform("e", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("references"))
    return lookup.join(titles, ["term", "book_key"], "left").join(entries, ["term", "book_key"], "left")


def totals(chapters: DataFrame, refs: DataFrame) -> DataFrame:
    """book_key, n_chapters, n_references of each book with chapters; n_linked and n_terms are null."""
    held = refs.groupBy("book_key").agg(F.count("*").alias("n_references"))
    counted = chapters.groupBy("book_key").agg(F.count("*").alias("n_chapters")).join(held, "book_key", "left")
    none = F.lit(None).cast("long")
    return counted.select("book_key", "n_chapters", F.coalesce("n_references", F.lit(0)).alias("n_references"), none.alias("n_linked"), none.alias("n_terms"))


def linked_totals(terms: DataFrame, linked: DataFrame) -> DataFrame:
    """One row in the form of `totals`: how many terms there are, and how many of them lie in a chapter."""
    none = F.lit(None)
    inside = linked.agg(F.countDistinct("term").alias("n_linked"))
    row = terms.agg(F.count("*").alias("n_terms")).join(F.broadcast(inside))
    return row.select(none.cast("string").alias("book_key"), none.cast("long").alias("n_chapters"), none.cast("long").alias("n_references"), "n_linked", "n_terms")
