"""Page layouts of publishers: where a page's number is printed, which lines are running heads.

Each layout is a set of hooks (see hooks.py) made of expressions on a page's array
of lines.  `install` registers a layout for a book.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import chapters as C
from . import pages, toc
from .hooks import Hooks

# Patterns of page heads and of headings that are none.
NUMBER = r"^\d{1,4}$"
BAR_LEFT, BAR_RIGHT = r"^(\d{1,4})\s*\|", r"\|\s*(\d{1,4})\s*$"
EDGE_LEFT, EDGE_RIGHT = r"^(\d{1,4}) ", r" (\d{1,4})\s*$"
INITIALS = r"^[A-Z]\.[A-Z]?\."
CHAPTER_LINE = r"(?i)^Chapter\s+\d+$"
INLINE_PAGE = r"\(p\.\s*(\d+)\)"
DOI = r"DOI:\s*10\."
ABSTRACT = r"(?i)\AAbstract and Keywords\z"
PAGE_OF = r"^Page \d+ of \d+$"
CAPTION = r"(?i)^(FIGURE|TABLE|BOX|PLATE)\s+\d"
CAPTION_OF_BARS = r"(?i)^(FIGURE|TABLE|BOX)\s+\d"
TRAILING = r"(?i)\b(a|an|the|in|of|by|for|and|or|to|from|with|on|at|as|into)\s*$"
COUNTRY = r"(?i),\s*(USA|UK|France|Germany|Belgium|Netherlands|Italy|Spain|Switzerland|Canada|Australia|Norway|Sweden|Denmark|Finland)\s*$"
EDITORS = r"(?i)\(Eds?\.\)"
SPACED = r"^[A-Z](\s[A-Z])+$"
SECOND_PASS = 0.20


def full_lines(text: str = "text") -> Column:
    """A page's stripped lines without blank ones."""
    return F.filter(F.transform(F.split(text, "\n"), T.strip), lambda s: s != "")


def _nth(lines: Column, n: int) -> Column:
    return F.coalesce(F.get(lines, F.lit(n)), F.lit(""))


def _first_number(lines: Column, start: int, many: int, low: int, high: int) -> Column:
    """The first bare number of a few lines; null if there is none within the limits."""
    numbers = F.transform(F.filter(F.slice(lines, start + 1, many), lambda s: s.rlike(NUMBER)), lambda s: s.cast("int"))
    return F.get(F.filter(numbers, lambda n: (n > low) & (n <= high)), F.lit(0))


def is_short_author(s: Column) -> Column:
    return (F.length(s) < 55) & F.contains(s, F.lit(".")) & (F.contains(s, F.lit("et al.")) | F.contains(s, F.lit(" and ")))


def is_author_list(s: Column) -> Column:
    return F.contains(s, F.lit(" and ")) & F.contains(s, F.lit(",")) & s.rlike(r"^\p{Lu}")


def head_page(left: str, right: str) -> Column:
    """The number at either end of a page's first line."""
    first = _nth(full_lines(), 0)
    number = F.coalesce(F.nullif(F.regexp_extract(first, left, 1), F.lit("")), F.regexp_extract(first, right, 1))
    return number.try_cast("int")


def numbered_chapter_page(chapters: int = 50, most: int = 540) -> Column:
    """Left pages begin with their number and short authors, right ones with a chapter's number and title."""
    ne = full_lines()
    first, second = _nth(ne, 0), _nth(ne, 1)
    n = first.try_cast("int")
    return (
        F.when(~first.rlike(NUMBER), _first_number(ne, 1, 5, chapters, most))
        .when(n > chapters, F.when(n <= most, n))
        .when(is_short_author(second), n)
        .when(second.rlike(NUMBER), F.when(second.try_cast("int") <= most, second.try_cast("int")))
        .when(second.rlike(r"^\p{Ll}"), n)
        .otherwise(_first_number(ne, 2, 5, -1, most))
    )


def initialled_page(chapters: int = 25) -> Column:
    """Left pages begin with their number and an author's initials, right ones with chapter, title and number."""
    ne = full_lines()
    first, third = _nth(ne, 0), _nth(ne, 2)
    n = first.try_cast("int")
    return F.when(first.rlike(NUMBER) & _nth(ne, 1).rlike(INITIALS), n).when(first.rlike(NUMBER) & third.rlike(NUMBER) & n.between(1, chapters), third.try_cast("int"))


def author_list_page(chapters: int = 26, most: int = 560) -> Column:
    """Left pages begin with their number and full authors, right ones with a title soon followed by the number."""
    ne = full_lines()
    first = _nth(ne, 0)
    n = first.try_cast("int")
    return F.when(first.rlike(NUMBER), F.when((n <= most) & ((n > chapters) | is_author_list(_nth(ne, 1))), n)).otherwise(_first_number(ne, 1, 5, -1, most))


def without_zone_lines(segments: DataFrame, unwanted: Callable[[Column], Column]) -> DataFrame:
    """Segments without the outer lines for which `unwanted` holds."""
    return segments.withColumn("text", pages.without_outer("text", unwanted))


def without_first_line(segments: DataFrame) -> DataFrame:
    """Segments without their first line that is not blank."""
    lines = F.split("text", "\n")
    place = F.array_position(F.transform(lines, lambda s: ~T.is_blank(s)), True).cast("int")
    return segments.withColumn("text", F.when(place > 0, F.array_join(F.concat(F.slice(lines, F.lit(1), place - 1), F.slice(lines, place + 1, F.size(lines))), "\n")).otherwise(F.col("text")))


def after_first(segments: DataFrame, opener: Column) -> DataFrame:
    """Segments after the first one for which `opener` holds; all of a book's if that leaves none."""
    order = Window.partitionBy("book_key").orderBy("pdf_page").rowsBetween(Window.unboundedPreceding, -1)
    marked = segments.withColumn("_after", F.coalesce(F.max(opener.cast("int")).over(order), F.lit(0)))
    some = F.max("_after").over(Window.partitionBy("book_key"))
    return marked.withColumn("_some", some).where("_after = 1 OR _some = 0").drop("_after", "_some")


def _filled(left: str, right: str, opener: Column | None = None):
    """Missing numbers from page heads; pages from the first such head on."""

    def hook(segments: DataFrame, **_) -> DataFrame:
        found = segments.withColumn("book_page", F.coalesce("book_page", head_page(left, right)))
        first = _nth(full_lines(), 0)
        starts = first.rlike(left) | first.rlike(right)
        return pages.without_front(found, F.col("book_page").isNotNull() & (starts if opener is None else starts | opener))

    return hook


def _stripped(unwanted: Callable[[Column], Column]):
    def hook(segments: DataFrame, **_) -> DataFrame:
        return pages.strip_headers(without_zone_lines(segments, unwanted), window_share=SECOND_PASS)

    return hook


def _headings_without(*patterns: str):
    def hook(segments: DataFrame, **_) -> DataFrame:
        for p in patterns:
            segments = pages.without_headings(segments, p)
        return segments

    return hook


def _marked_openers(segments: DataFrame, **_) -> DataFrame:
    """Opening pages carry two marks; they go, and so does all before the first."""
    opener = F.contains(F.col("text"), F.lit("©")) & F.contains(F.col("text"), F.lit("Wiley"))
    found = segments.withColumn("book_page", F.when(~opener, author_list_page()))
    kept = after_first(found, opener).where(~opener)
    rest = found.join(kept.select("book_key").distinct(), "book_key", "left_anti")
    return kept.unionByName(rest)


def _inline_numbers(segments: DataFrame, **_) -> DataFrame:
    found = segments.withColumn("book_page", F.regexp_extract("text", INLINE_PAGE, 1).try_cast("int"))
    return after_first(found, F.col("text").rlike(DOI) | F.col("text").rlike(ABSTRACT))


def _without_abbreviated_headings(segments: DataFrame, **_) -> DataFrame:
    """Lines of the text that are second-level marks of initials go; headings stay as they were found."""
    lines = F.filter(F.split("text", "\n"), lambda s: ~(s.startswith("## ") & T.strip(F.substr(s, F.lit(4))).rlike(INITIALS)))
    return segments.withColumn("text", F.array_join(lines, "\n"))


def _else_kept(made: DataFrame, chapters: DataFrame, books: DataFrame) -> DataFrame:
    """made, and the chapters as they were of books that are not among these."""
    return made.select(*chapters.columns).unionByName(chapters.join(books.select("book_key").distinct(), "book_key", "left_anti"))


def _chapters_of_cycles(bibliography: int):
    def hook(chapters: DataFrame, lines: DataFrame, **_) -> DataFrame:
        """One chapter for each cycle, all with one bibliography that begins at a given page."""
        found = toc.cycles(lines).withColumn("end_page", F.coalesce("end_page", F.lit(bibliography - 1)))
        start = lines.where(toc.marked_page() >= bibliography).groupBy("book_key").agg(F.min("line_no").alias("at"))
        none = F.lit(None).cast("int")
        rows = found.select("book_key", "ch_ord", "title", "start_page", "end_page", none.alias("ref_start_line"), none.alias("ref_end_line"))
        last = found.groupBy("book_key").agg((F.max("ch_ord") + 1).alias("ch_ord")).join(start, "book_key").join(toc.line_totals(lines), "book_key")
        made = rows.union(last.select("book_key", "ch_ord", F.lit("Bibliography"), F.lit(bibliography), none, "at", "total"))
        return _else_kept(made, chapters, found)

    return hook


def _from_spaced_openers(chapters: DataFrame, lines: DataFrame, **_) -> DataFrame:
    """Chapters from lines that are opening marks, with their span's pages and first references."""
    found = toc.spaced_openers(lines)
    rows = found.withColumn("ch_ord", F.row_number().over(toc.in_book())).withColumnsRenamed({"ref_line": "ref_start_line", "until": "ref_end_line"})
    return _else_kept(rows, chapters, found)


def _from_outline_openers(chapters: DataFrame, lines: DataFrame, **_) -> DataFrame:
    """Chapters from opening headings; the book's one reference list goes to the last, the others end where the next begins."""
    found = toc.outline_openers(lines).where("start_page IS NOT NULL")
    following = F.lead("start_page").over(toc.in_book())
    rows = found.select("book_key", "title", "start_page", F.row_number().over(toc.in_book()).alias("ch_ord"), F.nullif(following, F.lit(0)).alias("next_page"), following.isNull().alias("last"))
    lists = lines.where(F.col("line").rlike(r"^## References\s*$")).groupBy("book_key").agg(F.min("line_no").alias("list"))
    starts = toc.page_lines(lines).select("book_key", F.col("page").alias("next_page"), F.col("line_no").alias("next_line"))
    told = rows.join(toc.line_totals(lines), "book_key").join(lists, "book_key", "left").join(starts, ["book_key", "next_page"], "left")
    end = F.when(F.col("last"), F.col("total")).when(F.col("next_page").isNull(), F.coalesce(F.nullif("list", F.lit(0)), "total")).otherwise(F.coalesce("next_line", "total"))
    return told.select("book_key", "ch_ord", "title", "start_page", (F.col("next_page") - 1).alias("end_page"), F.when(F.col("last"), F.col("list")).alias("ref_start_line"), end.alias("ref_end_line"))


def _titled(contents: DataFrame | None, keep: bool):
    return lambda chapters, **_: chapters if contents is None else toc.asof_titles(chapters, contents, keep)


def layouts(contents: DataFrame | None = None, bibliography: int = 373, noise: tuple[str, ...] = ("© Springer", "DOI")) -> dict[str, dict[str, Callable[..., DataFrame]]]:
    """Layout name -> stage -> hook.

    contents: the books' tables of contents (book_key, toc_ord, level, title, start_page).
    noise: phrases of index terms that are none; a book adds its running head's authors.
    """
    noisy = F.lit(False)
    for phrase in noise:
        noisy = noisy | F.contains("term", F.lit(phrase))
    opener = F.contains(F.col("text"), F.lit("C H A P T E R"))
    outline = {
        "post_segment": lambda s, **_: pages.without_front(s, opener),
        "post_strip": lambda s, **_: pages.cut_from(s, "C H A P T E R", "O U T L I N E"),
    }

    def from_top_level(chapters: DataFrame, lines: DataFrame, **_) -> DataFrame:
        return chapters if contents is None else _else_kept(toc.top_level_chapters(contents.join(lines.select("book_key").distinct(), "book_key", "left_semi"), lines), chapters, contents)

    return {
        "outline openers": outline | {"post_chapter_detect": _from_outline_openers},
        "spaced openers": outline | {"post_annotate": _headings_without(COUNTRY, EDITORS, SPACED, CAPTION), "post_chapter_detect": _from_spaced_openers},
        "cycles": {"post_segment": lambda s, **_: pages.without_front(s, T.strip("text").startswith("Cycle 1")), "post_chapter_detect": _chapters_of_cycles(bibliography)},
        "numbered chapters": {
            "post_segment": lambda s, **_: pages.interpolated(s.withColumn("book_page", numbered_chapter_page())),
            "post_index_parse": lambda rows, **_: rows.where(~noisy),
            "post_chapter_detect": _titled(None if contents is None else toc.unnumbered(contents), False),
            "post_ref_parse": lambda refs, lines, chapters, **_: C.numbered_sections(lines, chapters),
        },
        "author initials": {
            "post_segment": lambda s, **_: pages.without_front(s.withColumn("book_page", F.coalesce(initialled_page(), "book_page")), _nth(full_lines(), 0).rlike(CHAPTER_LINE)),
            "post_strip": _stripped(lambda s: s.rlike(NUMBER) | s.rlike(INITIALS)),
            "post_annotate": _without_abbreviated_headings,
            "post_chapter_detect": lambda c, lines, **_: c if contents is None else toc.numbered_titles(c, lines, contents),
        },
        "bars": {
            "post_segment": _filled(BAR_LEFT, BAR_RIGHT, F.lower(_nth(full_lines(), 0)) == "chapter"),
            "post_strip": _stripped(lambda s: s.rlike(BAR_LEFT) | s.rlike(BAR_RIGHT)),
            "post_annotate": _headings_without(CAPTION_OF_BARS, TRAILING),
            "post_chapter_detect": from_top_level,
        },
        "wide spaces": {
            "post_segment": _filled(EDGE_LEFT, EDGE_RIGHT),
            "post_strip": _stripped(lambda s: s.rlike(EDGE_LEFT) | s.rlike(EDGE_RIGHT)),
            "post_chapter_detect": lambda c, lines, **_: toc.extended_references(c, lines),
        },
        "author lists": {
            "post_segment": _marked_openers,
            "post_strip": _stripped(lambda s: s.rlike(NUMBER) | is_author_list(s)),
            "post_annotate": lambda s, **_: s.withColumn("headings", F.filter("headings", lambda h: ~is_author_list(h["text"]))),
            "post_chapter_detect": lambda c, **_: c if contents is None else toc.positional_titles(c, toc.unnumbered(contents)),
        },
        "inline numbers": {
            "post_segment": _inline_numbers,
            "post_strip": lambda s, **_: pages.strip_headers(without_first_line(s), window_share=SECOND_PASS),
            "post_annotate": _headings_without(PAGE_OF, DOI),
            "post_chapter_detect": _titled(None if contents is None else contents.where("title <> 'Bibliography'"), True),
        },
    }


def install(hooks: Hooks, book_keys: str | Iterable[str], layout: str, **options) -> Hooks:
    """Registers a layout's hooks for a book, or for many that share its options."""
    made = layouts(**options)[layout]
    for key in [book_keys] if isinstance(book_keys, str) else book_keys:
        for stage, function in made.items():
            hooks.register(key, stage, function)
    return hooks
