"""Back-of-book indices: finding, joining and parsing their lines.

Lines are rows (book_key, line_no, raw); every window is partitioned by book.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _by_book():
    return Window.partitionBy("book_key").orderBy("line_no")


def join_continuations(lines: DataFrame) -> DataFrame:
    """Wrapped lines merged: book_key, line_no (of the first), line.

    A line goes on with the one before if it holds page references only, or if it
    begins in lower case and the one before ends with a comma.  Blank lines, headings
    and lone letters never do, but lines of page references go on after them.
    """
    rows = lines.select("book_key", "line_no", F.regexp_replace("raw", r"\n+$", "").alias("raw")).withColumn("s", T.strip("raw"))
    skip = F.col("s").rlike(T.INDEX_SKIP)
    before = F.lag("s").over(_by_book())
    goes_on = ~skip & (F.col("s").rlike(T.ONLY_PAGES) | (before.endswith(",") & F.col("s").rlike(r"^\p{Ll}")))
    marked = rows.withColumn("starts", before.isNull() | ~goes_on)
    marked = marked.withColumn("island", F.sum(F.col("starts").cast("int")).over(_by_book()))
    parts = F.array_sort(F.collect_list(F.struct("line_no", "raw", "s")))
    joined = marked.groupBy("book_key", "island").agg(parts.alias("p"))
    head = F.col("p")[0]["raw"]
    tail = F.array_join(F.transform(F.slice("p", F.lit(2), F.size("p")), lambda x: x["s"]), " ")
    return joined.select("book_key", F.col("p")[0]["line_no"].alias("line_no"), F.when(F.size("p") == 1, head).otherwise(F.concat(T.rstrip(head), F.lit(" "), tail)).alias("line"))


def parse_index(lines: DataFrame, strategy: str = "capitalize") -> DataFrame:
    """book_key, term, term_ord, pages of an index; sub-entries as "parent > term".

    capitalize: an unindented line that begins with a capital, a digit or the like is a
    main entry, others belong to the last one.  indent_only: every unindented line is.
    """
    joined = join_continuations(lines).withColumn("s", T.strip("line")).where(~F.col("s").rlike(T.INDEX_SKIP))
    rows = joined.select("book_key", "line_no", "s", T.indent("line").alias("indent"), T.extract_pages("s").alias("pages"), T.term_of_line("s").alias("text")).where("text <> ''")
    main = F.col("indent") == 0 if strategy == "indent_only" else (F.col("indent") == 0) & F.col("s").rlike(T.MAIN_START)
    rows = rows.withColumn("main", main).withColumn("parent", F.last(F.when(F.col("main"), F.col("text")), ignorenulls=True).over(_by_book()))
    named = F.when(F.col("main") | F.col("parent").isNull(), F.col("text")).otherwise(F.concat("parent", F.lit(" > "), "text"))
    keyed = rows.withColumn("term", T.normalize_term(named)).where(F.length("term") > 1)
    held = F.array_sort(F.collect_list(F.struct("line_no", "pages")))
    return keyed.groupBy("book_key", "term").agg(F.min("line_no").alias("term_ord"), F.filter(F.flatten(F.transform(held, lambda x: x["pages"])), lambda p: p != "").alias("pages"))


def index_start(lines: DataFrame) -> DataFrame:
    """book_key, start_line (1-based): the first entry of each book's index; books without one are left out.

    Searched in the last 35 per cent: the first heading that an entry follows within 29
    lines, else the first entry.
    """
    place = F.row_number().over(_by_book()) - 1
    whole = Window.partitionBy("book_key")
    rows = lines.select("book_key", "line_no", T.strip("raw").alias("s")).withColumn("at", place).withColumn("total", F.count("*").over(whole))
    entry = F.when(F.col("s").rlike(T.INDEX_ENTRY), F.col("at"))
    ahead = Window.partitionBy("book_key").orderBy("at").rowsBetween(1, 29)
    rows = rows.withColumn("entry", entry).withColumn("next", F.min("entry").over(ahead)).where(F.col("at") >= F.floor(F.col("total") * 0.65))
    found = rows.groupBy("book_key").agg(F.min_by("next", F.when(F.col("s").rlike(T.INDEX_HEADING) & F.col("next").isNotNull(), F.col("at"))).alias("after_heading"), F.min("entry").alias("first"))
    return found.select("book_key", (F.coalesce("after_heading", "first") + 1).cast("int").alias("start_line")).where("start_line IS NOT NULL")
