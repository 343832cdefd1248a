"""Page texts: segments, running headers, headings and markdown.

A segment is a row (book_key, pdf_page, book_page, text); a page's lines stay an
array inside its row, so that line logic needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Page numbers, bare numbers, headings, function words.
ARABIC = r"^\d{1,4}$"
ROMAN = r"(?i)^m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
BARE_NUMBER = r"^\d{1,5}$"
CYCLE = r"(?iU)^cycle\s+\d+\s*$"
ALL_CAPS = r"^[A-Z][A-Z0-9 \-:,']+$"
FUNCTION_WORDS = ("a", "an", "the", "of", "in", "on", "at", "to", "for", "and", "or", "but", "with", "by", "from", "as", "is", "no", "not", "that", "than", "this", "its", "it", "are", "was", "be", "been", "have", "has")
LONGEST_HEADING, SHORTEST_H2 = 79, 10
GLOBAL_SHARE, WINDOW, WINDOW_SHARE, LEAST_WINDOW, LEAST_PAGES = 0.35, 30, 0.30, 5, 2


def segment(texts: DataFrame) -> DataFrame:
    """texts (book_key, text) -> segments, cut at form feeds.

    The page number is the first of the outermost lines that is a number; pages whose
    first is a roman one are front matter and left out, as are blank pages.
    """
    # found where pages are cut, so that a filter does not find it again
    each = F.transform(F.split("text", "\f"), lambda page: F.struct(page.alias("text"), _printed_number(page).alias("number")))
    pages = texts.select("book_key", F.posexplode(each).alias("pdf_page", "page")).select("book_key", "pdf_page", "page.*")
    return pages.where(~T.is_blank("text") & F.coalesce("number", F.lit("0")).rlike(ARABIC)).select("book_key", "pdf_page", F.col("number").try_cast("int").alias("book_page"), "text")


def _solid(lines: Column) -> Column:
    return F.filter(lines, lambda s: ~T.is_blank(s))


def _outermost(page: Column) -> Column:
    """The first and last three lines that are not blank; with fewer than six, all."""
    return T.let(_solid(F.split(page, "\n")), lambda full: F.when(F.size(full) >= 6, F.concat(F.slice(full, 1, 3), F.slice(full, -3, 3))).otherwise(full))


def _is_number(s: Column) -> Column:
    return s.rlike(ARABIC) | s.rlike(ROMAN)


def _printed_number(page: Column) -> Column:
    """The first number among the outermost lines of a page; with fewer than six, among all."""
    return F.try_element_at(F.filter(F.transform(_outermost(page), T.strip), _is_number), F.lit(1))


def outline(text: Column) -> Column:
    """A text with as many pages as it has, of each the outermost lines: numbers as they are, a dash for any other.

    Where a text stands on lines of its own, among other lines or alone, its outline in its
    place leaves segments with the same numbers; a null text is an empty one.
    """
    line = lambda s: T.let(T.strip(s), lambda bare: F.when(_is_number(bare), bare).otherwise("-"))
    return F.array_join(F.transform(F.split(F.coalesce(text, F.lit("")), "\f"), lambda page: F.array_join(F.transform(_outermost(page), line), "\n")), "\f")


def page_map(segments: DataFrame) -> DataFrame:
    """book_key, book_page, pdf_page; of a repeated number, the last page."""
    return segments.where("book_page IS NOT NULL").groupBy("book_key", "book_page").agg(F.max("pdf_page").alias("pdf_page"))


def _outer(found: Column) -> Column:
    """The first and last three of an array; of a short one some come twice."""
    return T.let(found, lambda x: F.concat(F.slice(x, 1, 3), F.when(F.size(x) >= 3, F.slice(x, -3, 3)).otherwise(x)))


def zone_places(lines: Column) -> Column:
    """Places (from 0) of the first and last three lines that are not blank."""
    return F.array_distinct(_outer(F.filter(F.transform(lines, lambda s, i: F.when(~T.is_blank(s), i)), lambda i: i.isNotNull())))


def zone_lines(segments: DataFrame) -> DataFrame:
    """The distinct outer lines of each page: book_key, page_no (from 0), n_pages, line."""
    order = Window.partitionBy("book_key").orderBy("pdf_page")
    # before the pages are ordered, so that whole texts don't move
    outer = F.array_distinct(F.transform(_outer(_solid(F.split("text", "\n"))), T.strip))
    rows = segments.select("book_key", "pdf_page", outer.alias("outer"))
    rows = rows.withColumn("page_no", F.row_number().over(order) - 1).withColumn("n_pages", F.count("*").over(Window.partitionBy("book_key")))
    return rows.select("book_key", "page_no", "n_pages", F.explode("outer").alias("line"))


def _tuned(zones: DataFrame, shares: DataFrame | None) -> DataFrame:
    """Zone lines with each book's shares and window size, those without their own with the defaults."""
    names = {"global_thresh": F.lit(GLOBAL_SHARE), "window_size": F.lit(WINDOW), "window_thresh": F.lit(WINDOW_SHARE)}
    if shares is None:
        return zones.withColumns(names)
    own = shares.select("book_key", *[F.col(c).alias(f"own_{c}") for c in names])
    return zones.join(own, "book_key", "left").withColumns({c: F.coalesce(F.nullif(f"own_{c}", F.lit(0)), d) for c, d in names.items()})


def frequent_lines(segments: DataFrame, share: float = GLOBAL_SHARE) -> DataFrame:
    """book_key, line, n: outer lines of at least that share of a book's pages."""
    zones = _tuned(zone_lines(segments), None).withColumn("global_thresh", F.lit(share))
    return _frequent(zones, _whole_book()).select("book_key", "line", "n")


def frequent_in_windows(segments: DataFrame, size: int = WINDOW, share: float = WINDOW_SHARE) -> DataFrame:
    """book_key, window, line, n: outer lines of at least that share of a window of pages.

    Windows of `size` pages begin every half size; those of fewer than five pages don't count,
    nor does a line of a single page, which is a fifth of the five pages that a book may end with.
    """
    zones = _tuned(zone_lines(segments), None).withColumns({"window_size": F.lit(size), "window_thresh": F.lit(share)})
    return _frequent(zones, _windows())


def _step() -> Column:
    return F.greatest(F.lit(1), F.floor(F.col("window_size") / 2))


def _windows() -> Column:
    """The windows that a page is in."""
    low = F.greatest(F.lit(0), F.ceil((F.col("page_no") - F.col("window_size") + 1) / _step()))
    return F.sequence(low.cast("int"), F.floor(F.col("page_no") / _step()).cast("int"))


def _whole_book() -> Column:
    """A book as a window without a number."""
    return F.array(F.lit(None).cast("int"))


def _frequent(zones: DataFrame, windows: Column) -> DataFrame:
    """book_key, window, line, n: lines of at least their share of the pages of a window or of the whole book."""
    whole = F.col("window").isNull()
    held = F.when(whole, F.col("n_pages")).otherwise(F.least("window_size", F.col("n_pages") - F.col("window") * _step()))
    placed = zones.withColumn("window", F.explode(windows)).withColumn("held", held).withColumn("share", F.when(whole, F.col("global_thresh")).otherwise(F.col("window_thresh")))
    counted = placed.where(whole | (F.col("held") >= LEAST_WINDOW)).groupBy("book_key", "window", "line", "held", "share").agg(F.count("*").alias("n"))
    enough = (whole | (F.col("n") >= LEAST_PAGES)) & (F.col("n") / F.col("held") >= F.col("share"))
    return counted.where(enough & ~F.col("line").rlike(BARE_NUMBER)).select("book_key", "window", "line", "n")


def _bad(zones: DataFrame) -> DataFrame:
    return _frequent(zones, F.concat(_whole_book(), _windows())).select("book_key", "line").distinct()


def bad_lines(segments: DataFrame, global_share: float = GLOBAL_SHARE, size: int = WINDOW, window_share: float = WINDOW_SHARE) -> DataFrame:
    """book_key, line: running headers and footers."""
    return _bad(_tuned(zone_lines(segments), None).withColumns({"global_thresh": F.lit(global_share), "window_size": F.lit(size), "window_thresh": F.lit(window_share)}))


def bad_lines_by_book(segments: DataFrame, shares: DataFrame) -> DataFrame:
    """book_key, line, by each book's own shares (book_key, global_thresh, window_size, window_thresh; null or 0: the default)."""
    return _bad(_tuned(zone_lines(segments), shares))


def without_outer(text: str, unwanted: Callable[[Column], Column]) -> Column:
    """A page's text without the outer lines for which `unwanted` holds."""

    def kept(lines: Column) -> Column:
        # the outer places are found once for a page and not for every line
        return T.let(zone_places(lines), lambda zone: F.transform(lines, lambda s, i: F.when(F.array_contains(zone, i) & unwanted(T.strip(s)), None).otherwise(s)))

    return F.array_join(T.let(F.split(text, "\n"), kept), "\n")


def strip_headers(segments: DataFrame, bad: DataFrame | None = None, **shares) -> DataFrame:
    """Segments without the bad lines where these are outer lines; elsewhere they stay."""
    bad = bad_lines(segments, **shares) if bad is None else bad
    listed = bad.groupBy("book_key").agg(F.collect_set("line").alias("bad"))
    joined = segments.join(listed, "book_key", "left").withColumn("bad", F.coalesce("bad", F.array().cast("array<string>")))
    return joined.withColumn("text", without_outer("text", lambda s: F.array_contains("bad", s))).select(*segments.columns)


def _words(s: Column) -> Column:
    return F.filter(F.split(s, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")


def _capital(w: Column) -> Column:
    return w.rlike(r"^[\p{Lu}\p{Lt}]")


def is_title_case(s: Column) -> Column:
    """Whether at least 60 per cent of the words that carry meaning begin with a capital, the first word among them."""
    functional = F.array(*[F.lit(w) for w in FUNCTION_WORDS])

    def weighed(content: Column) -> Column:
        capital = F.size(F.filter(content, _capital))
        return F.when(F.size(content) < 2, (F.size(content) == 1) & (capital == 1)).otherwise(capital / F.size(content) >= 0.6)

    def told(words: Column) -> Column:
        first = F.coalesce(_capital(F.try_element_at(words, F.lit(1))), F.lit(False))
        return first & T.let(F.filter(words, lambda w: ~F.array_contains(functional, F.lower(F.rtrim(w, F.lit(".,;:!?"))))), weighed)

    return T.let(_words(s), told)


def heading_level(s: Column) -> Column:
    return F.when(s.rlike(CYCLE), 1).when((F.length(s) >= SHORTEST_H2) & (s.rlike(ALL_CAPS) | is_title_case(s)), 2).otherwise(3)


def is_heading(s: Column, blank_before: Column, blank_after: Column) -> Column:
    """s: a stripped line."""
    return (s != "") & (blank_before | blank_after) & (F.length(s) <= LONGEST_HEADING) & ~s.rlike(r"[.,;:?!]$") & ~s.rlike(r"(?U)^\d+$")


def detect_headings(lines: Column) -> Column:
    """The headings of a page's lines: (line_idx, level, text)."""

    def found(bare: Column) -> Column:
        blank = lambda i: F.coalesce(F.get(bare, i), F.lit("")) == ""
        one = lambda s, i: F.when(is_heading(s, blank(i - 1), blank(i + 1)), F.struct(i.alias("line_idx"), heading_level(s).alias("level"), s.alias("text")))
        return F.filter(F.transform(bare, one), lambda h: h.isNotNull())

    return T.let(F.transform(lines, T.strip), found)


def annotate(segments: DataFrame) -> DataFrame:
    """Segments with their headings."""
    return segments.withColumn("headings", detect_headings(F.split("text", "\n")))


def render(segments: DataFrame) -> DataFrame:
    """Annotated segments with a column markdown: page mark, headings, other lines with a leading # escaped."""
    plain = F.transform(F.split("text", "\n"), lambda s: F.when(s.startswith("#"), F.regexp_replace(s, r"^(#+)", r"\\$1")).otherwise(s))

    def marked(h):
        return F.concat(F.lit("\n"), F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["text"], F.lit("\n"))

    def placed(lines, held):
        # between two headings lie the lines after the one and before the other
        at = lambda k: F.coalesce(F.get(held, k)["line_idx"], F.when(k < 0, -1).otherwise(F.size(lines)))
        between = lambda k: F.slice(lines, at(k - 1) + 2, at(k) - at(k - 1) - 1)
        each = F.transform(held, lambda h, k: F.concat(between(k), F.array(marked(h))))
        return F.concat(F.flatten(each), between(F.size(held)))

    def inside(lines):
        return T.let(F.filter("headings", lambda h: h["line_idx"] < F.size(lines)), lambda held: placed(lines, held))

    lines = T.let(plain, inside)
    body = F.concat_ws("\n", F.concat(F.lit("<!-- p. "), F.col("book_page").cast("string"), F.lit(" -->")), F.array_join(lines, "\n"))
    return segments.withColumn("markdown", T.strip(F.regexp_replace(body, r"\n{3,}", "\n\n")))


def front_matter(registry: DataFrame) -> DataFrame:
    """book_key, head: the block that a book's markdown begins with."""
    have = set(registry.columns)
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")
    source = F.coalesce(F.nullif(value("pdf"), F.lit("")), value("epub_path"))
    head = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{c}: "), value(c)) for c in ("title", "author", "year")], F.concat(F.lit("source_pdf: "), source), F.lit("---"))
    return registry.select("book_key", head.alias("head"))


def markdown(segments: DataFrame, registry: DataFrame) -> DataFrame:
    """book_key, markdown: one document for each book of its numbered pages in order."""
    # a numbered page has its mark at least, so none is empty
    pages = render(segments.where("book_page IS NOT NULL"))
    joined = pages.groupBy("book_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pdf_page", "markdown"))), lambda x: x["markdown"]), "\n\n").alias("body"))
    whole = F.concat(F.concat_ws("\n\n", F.col("head"), F.col("body")), F.lit("\n"))
    return front_matter(registry).join(joined, "book_key", "left").select("book_key", F.regexp_replace(whole, r"\n{3,}", "\n\n").alias("markdown"))


def without_front(segments: DataFrame, first: Column) -> DataFrame:
    """Segments from the first page for which `first` holds; all of a book's if there is none."""
    order = Window.partitionBy("book_key").orderBy("pdf_page").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(first.cast("int")).over(order)
    some = F.max(first.cast("int")).over(Window.partitionBy("book_key"))
    return segments.withColumn("_seen", seen).withColumn("_some", some).where("_seen = 1 OR coalesce(_some, 0) = 0").drop("_seen", "_some")


def interpolated(segments: DataFrame) -> DataFrame:
    """Segments whose missing page numbers count on from the last known one."""
    order = Window.partitionBy("book_key").orderBy("pdf_page")
    place = F.row_number().over(order)
    rows = segments.withColumn("_at", place).withColumn("_known", F.when(F.col("book_page").isNotNull(), F.col("_at")))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    last, at = F.last("book_page", ignorenulls=True).over(so_far), F.last("_known", ignorenulls=True).over(so_far)
    return rows.withColumn("book_page", F.coalesce("book_page", last + F.col("_at") - at)).select(*segments.columns)


def cut_from(segments: DataFrame, opener: str, mark: str) -> DataFrame:
    """On pages that hold the opener, lines from the first one with the mark go."""
    lines = F.split("text", "\n")
    place = F.array_position(F.transform(lines, lambda s: F.contains(s, F.lit(mark))), True)
    return segments.withColumn("text", F.when(F.contains("text", F.lit(opener)) & (place > 0), F.array_join(F.slice(lines, F.lit(1), (place - 1).cast("int")), "\n")).otherwise(F.col("text")))


def without_headings(segments: DataFrame, pattern: str) -> DataFrame:
    """Annotated segments without the headings whose text matches."""
    return segments.withColumn("headings", F.filter("headings", lambda h: ~h["text"].rlike(pattern)))
