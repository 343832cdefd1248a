"""Sources: texts, registries, indices, tables of contents, argument maps, EPUB and PDF.

Every reader gives a DataFrame; files are read whole, one row each, and taken apart by
expressions, so line order never depends on how a file was split.  A file's book is its
name without ending, or the folder book_key=... that it lies in, as sinks write them.
What cannot be read is skipped and reported as a row: `problems` of index files that are
missing or no JSON, `epub_problems` of archives that are damaged.  Empty files give no rows.
"""

from __future__ import annotations

import io
import itertools
import subprocess
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

REGISTRY = "title STRING, author STRING, year INT, pdf STRING, epub_path STRING, text STRING, index_start_line INT, subentry_strategy STRING, header_stripper STRUCT<global_thresh: DOUBLE, window_size: INT, window_thresh: DOUBLE>, md_path STRING, ref_heading_pattern STRING"
# Parts of an EPUB that are no chapters, and its index entries.
NO_CHAPTERS = ("nav", "01_Cover", "02_Halftitle", "03_Title", "04_Copyright", "05_Tableofcontent", "51_Index", "51_Plate")
PAGES_TAIL = r",\s*([\d][,\s\d–\-]*)$"
PAGE_TOKEN = r"\d+(?:[–\-]\d+)?"


def _stem(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")


def _key(files: DataFrame, path: Column | str) -> Column:
    """The book of a file: that of its folder, else its name without ending."""
    return (F.col("book_key").cast("string") if "book_key" in files.columns else _stem(path)).alias("book_key")


def texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """book_key, text of each file; a line end at the very end, which text sinks write, is none of the text."""
    rows = spark.read.text(paths, wholetext=True)
    return rows.select(_key(rows, F.input_file_name()), F.regexp_replace("value", r"\n\z", "").alias("text"))


def lines(files: DataFrame) -> DataFrame:
    """book_key, line_no (from 0), raw of texts."""
    return files.select("book_key", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))


def registry(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """One row for each book of a registry file {key: entry}; of the given keys if any."""
    rows = registry_rows(spark.read.text(path, wholetext=True))
    return rows if keys is None else rows.where(F.col("book_key").isin(*keys))


def registry_rows(whole: DataFrame) -> DataFrame:
    """The books of registry texts (value: {key: entry})."""
    entries = whole.select(F.from_json("value", f"MAP<STRING, STRUCT<{_struct(REGISTRY)}>>").alias("m"))
    return entries.select(F.explode("m").alias("book_key", "entry")).select("book_key", "entry.*")


def _struct(ddl: str) -> str:
    import re

    return re.sub(r"(^|, )(\w+) (STRING|INT|STRUCT<[^>]*>)", r"\1\2: \3", ddl)


def indices(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """book_key, term, term_ord, pages of index files {term: [page]}, in file order."""
    return index_rows(texts(spark, paths))


def problems(files: DataFrame, asked: DataFrame) -> DataFrame:
    """(book_key, problem) of the books asked for (book_key) whose index text (book_key, text) is missing or malformed; an empty file gives no text."""
    held = files.select("book_key", F.from_json("text", "MAP<STRING, ARRAY<STRING>>").isNotNull().alias("fine"))
    told = asked.select("book_key").distinct().join(held, "book_key", "left").where("fine IS NULL OR NOT fine")
    return told.select("book_key", F.when(F.col("fine").isNull(), "missing").otherwise("malformed").alias("problem"))


def index_rows(files: DataFrame) -> DataFrame:
    """The entries of index texts (book_key, text)."""
    entries = F.map_entries(F.from_json("text", "MAP<STRING, ARRAY<STRING>>"))
    return files.select("book_key", F.posexplode(entries).alias("term_ord", "e")).select("book_key", F.col("e.key").alias("term"), "term_ord", F.col("e.value").alias("pages"))


def toc(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """book_key, toc_ord, level, title, start_page of contents files, flat or by levels."""
    return toc_rows(texts(spark, paths))


def toc_rows(files: DataFrame) -> DataFrame:
    """The entries of contents texts (book_key, text)."""
    entry = "ARRAY<STRUCT<level: INT, title: STRING, start_page: INT, pdf_page: INT>>"
    rows = files.select("book_key", F.posexplode(F.from_json("text", entry)).alias("toc_ord", "e"))
    return rows.select("book_key", "toc_ord", F.coalesce("e.level", F.lit(0)).alias("level"), F.col("e.title").alias("title"), F.coalesce("e.start_page", "e.pdf_page").alias("start_page"))


def bookmarks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """book_key, toc_ord, level, title, start_page of bookmark dumps: tabs for the level, then "title/page,...". """
    return bookmark_rows(texts(spark, paths))


def bookmark_rows(files: DataFrame) -> DataFrame:
    """The entries of bookmark texts (book_key, text)."""
    pattern = r"^(\t*)(.*)/(\d+),"
    rows = lines(files).where(F.col("raw").rlike(pattern))
    part = lambda n: F.regexp_extract("raw", pattern, n)
    return rows.select("book_key", F.col("line_no").alias("toc_ord"), F.length(part(1)).alias("level"), part(2).alias("title"), part(3).cast("int").alias("start_page"))


def amaps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, text of argument maps."""
    return texts(spark, paths).withColumnRenamed("book_key", "file")


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """book_key, path, n_bytes of files, without reading them."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(_key(files, "path"), "path", F.col("length").alias("n_bytes"))


class _Elements(HTMLParser):
    """(tag, class, text) of block elements, in order of their ends; an element keeps its descendants' text too."""

    def __init__(self, wanted):
        super().__init__(convert_charrefs=True)
        self.wanted, self.open, self.out = wanted, [], []

    def handle_starttag(self, tag, attrs):
        name = dict(attrs).get("class") or ""
        if self.wanted(tag, name):
            self.open.append([tag, name, [], len(self.out)])
            self.out.append(None)

    def handle_data(self, data):
        if data.strip():
            for e in self.open:
                e[2].append(data.strip())

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                for e in self.open[k:]:
                    self.out[e[3]] = (e[0], e[1], " ".join(e[2]))
                del self.open[k:]
                break


#: Documents that a worker holds at once: those of the session's batches are pages of any length.
TOGETHER = 1000


def _pieces(rows: Iterable[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows as frames of TOGETHER rows, the last one shorter."""
    rows = iter(rows)
    while piece := list(itertools.islice(rows, TOGETHER)):
        yield pd.DataFrame(piece, columns=columns)


def _parse(html: str, wanted) -> list[tuple[str, str, str]]:
    reader = _Elements(wanted)
    reader.feed(html)
    reader.close()
    for e in reader.open:
        reader.out[e[3]] = (e[0], e[1], " ".join(e[2]))
    return [x for x in reader.out if x]


BLOCK_TAGS = ("h1", "h2", "h3", "h4", "h5", "p")


def html_elements(documents: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """documents (keys, html) -> keys, el_no, tag, class, text: headings, paragraphs and elements of class level1 to level3."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*keys).schema)

    def wanted(tag, name):
        return tag in BLOCK_TAGS or any(c in ("level1", "level2", "level3") for c in name.split()[:1])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = ((*(getattr(r, k) for k in keys), n, *e) for r in frame.itertuples(index=False) for n, e in enumerate(_parse(r.html or "", wanted)))
            yield from _pieces(rows, [*keys, "el_no", "tag", "class", "text"])

    return documents.select(*keys, "html").mapInPandas(run, f"{schema}, el_no int, tag string, class string, text string")


def epub_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """book_key, doc_seq, name, html, problem: the documents of EPUB files in reading order, or one row that tells what is wrong."""
    files = spark.read.format("binaryFile").load(paths)
    rows = files.select(_key(files, "path"), "content")

    def documents(r) -> Iterator[tuple]:
        import xml.etree.ElementTree as X

        try:
            with zipfile.ZipFile(io.BytesIO(r.content)) as z:
                order = _reading_order(z)
                # a damaged archive is told in one row, so all is read through before any of it is given
                for name in order:
                    with z.open(name) as member:
                        while member.read(1 << 20):
                            pass
                for n, name in enumerate(order):
                    yield r.book_key, n, name, z.read(name).decode("utf-8", "replace"), None
        except (zipfile.BadZipFile, zlib.error, EOFError, KeyError, NotImplementedError, RuntimeError, X.ParseError) as error:
            yield r.book_key, None, None, None, type(error).__name__

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                for found in _pieces(documents(r), ["book_key", "doc_seq", "name", "html", "problem"]):
                    yield found.astype({"doc_seq": "Int32"})

    return rows.mapInPandas(run, "book_key string, doc_seq int, name string, html string, problem string")


def epub_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """book_key, doc_seq, name, html: the documents of the EPUB files that can be read, in reading order."""
    return epub_files(spark, paths).where("problem IS NULL").drop("problem")


def epub_problems(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """book_key, problem of the EPUB files that cannot be read."""
    return epub_files(spark, paths).where("problem IS NOT NULL").select("book_key", "problem")


def _reading_order(z: zipfile.ZipFile) -> list[str]:
    """The manifest's documents as the spine has them, then any others; all pages if there is no package file."""
    import posixpath
    import xml.etree.ElementTree as X

    names = z.namelist()
    pages = [n for n in names if n.lower().endswith((".xhtml", ".html", ".htm"))]
    package = next((n for n in names if n.endswith(".opf")), None)
    if package is None:
        return pages
    root = X.fromstring(z.read(package))
    bare = lambda e: e.tag.rpartition("}")[2]
    items = {e.get("id"): posixpath.normpath(posixpath.join(posixpath.dirname(package), e.get("href", ""))) for e in root.iter() if bare(e) == "item"}
    spine = [items[e.get("idref")] for e in root.iter() if bare(e) == "itemref" and e.get("idref") in items]
    held, read = set(names), set(spine)
    return [n for n in spine if n in held] + [n for n in pages if n not in read]


def is_index_document(name: Column | str = "name") -> Column:
    """Whether a document of an EPUB is its index: its name without folder and ending says so."""
    return _stem(name).rlike("Index|index")


class _Words(HTMLParser):
    """The text nodes of a document, but for those of scripts, styles and templates."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.silent = [], None

    def handle_starttag(self, tag, attrs):
        if self.silent is None and tag in ("script", "style", "template"):
            self.silent = tag

    def handle_endtag(self, tag):
        if tag == self.silent:
            self.silent = None

    def handle_data(self, data):
        if self.silent is None:
            self.out.append(data)


def epub_text(documents: DataFrame) -> DataFrame:
    """book_key, doc_seq, name, html -> book_key, text: the documents' text nodes by lines, documents by form feeds, the index left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                reader = _Words()
                reader.feed(r.html or "")
                reader.close()
                rows.append((r.book_key, r.doc_seq, "\n".join(reader.out)))
            yield pd.DataFrame(rows, columns=["book_key", "doc_seq", "text"])

    told = documents.where(~is_index_document()).select("book_key", "doc_seq", "html").mapInPandas(run, "book_key string, doc_seq int, text string")
    parts = F.array_sort(F.collect_list(F.struct("doc_seq", "text")))
    return told.groupBy("book_key").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\f").alias("text"))


def epub_markdown(elements: DataFrame) -> DataFrame:
    """book_key, doc_seq, name with their elements -> book_key, markdown.

    h2 to h5 are headings of level one to four, paragraphs text; numbers of chapters,
    authors of chapters and h1 are left out.  Cover, contents, index and the like are no
    chapters; the others are numbered.
    """
    chapter = elements.withColumn("stem", _stem("name")).where(~F.col("stem").isin(*NO_CHAPTERS) & (F.lower("stem") != "nav"))
    order = F.dense_rank().over(_window("book_key", "doc_seq"))
    line = (
        F.when(F.col("tag") == "p", F.when(~F.exists(F.split("class", r"\s+"), lambda c: c.startswith("chap-auth")), F.col("text")))
        .when((F.col("tag") == "h2") & ~F.array_contains(F.split("class", r"\s+"), "Chap-no"), F.concat(F.lit("\n# "), "text", F.lit("\n")))
        .when(F.col("tag").isin("h3", "h4", "h5"), F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.substring("tag", 2, 1).cast("int") - 1), F.lit(" "), "text", F.lit("\n")))
    )
    rows = chapter.withColumn("label", order).withColumn("line", F.when(F.col("text") != "", line))
    join = lambda key, value, glue: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), glue)
    parts = rows.groupBy("book_key", "doc_seq", "label").agg(join("el_no", "line", "\n").alias("body"))
    parts = parts.withColumn("part", F.concat_ws("\n", F.concat(F.lit("<!-- ch. "), F.col("label").cast("string"), F.lit(" -->")), F.nullif("body", F.lit(""))))
    return parts.groupBy("book_key").agg(F.regexp_replace(F.concat(join("doc_seq", "part", "\n\n"), F.lit("\n")), r"\n{3,}", "\n\n").alias("markdown"))


def _window(part: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(order)


def epub_index(elements: DataFrame) -> DataFrame:
    """book_key, term, term_ord, pages of index elements: level1 "A", level2 "A > B", level3 "A > B > C".

    Cross-references and empty entries go; a third level stays only with pages; pages of
    a repeated entry add up.
    """
    from pyspark.sql import Window

    text = T.strip("text")
    tail = F.regexp_extract(text, PAGES_TAIL, 1)
    own = F.when(tail != "", T.strip(F.rtrim(T.strip(F.regexp_replace(text, PAGES_TAIL, "")), F.lit(",")))).otherwise(text)
    rows = elements.withColumn("level", F.regexp_extract("class", r"^level([123])", 1).try_cast("int")).where(F.col("level").isNotNull() & (text != "") & ~text.rlike(r"(?U)\bSee\b"))
    rows = rows.withColumn("own", own).withColumn("pages", F.regexp_extract_all(tail, F.lit(PAGE_TOKEN), F.lit(0))).where("own <> ''")
    order = Window.partitionBy("book_key").orderBy("doc_seq", "el_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("first", F.last(F.when(F.col("level") == 1, F.struct("own", "doc_seq", "el_no")), ignorenulls=True).over(order))
    inside = Window.partitionBy("book_key", "first.doc_seq", "first.el_no").orderBy("doc_seq", "el_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("second", F.last(F.when(F.col("level") == 2, F.col("own")), ignorenulls=True).over(inside))
    term = F.when(F.col("level") == 1, F.col("own")).when(F.col("level") == 2, F.concat_ws(" > ", F.col("first.own"), F.col("own"))).otherwise(F.concat_ws(" > ", F.col("first.own"), F.col("second"), F.col("own")))
    kept = rows.withColumn("term", term).where("level < 3 OR size(pages) > 0")
    held = F.array_sort(F.collect_list(F.struct("doc_seq", "el_no", "pages")))
    return kept.groupBy("book_key", "term").agg(F.min(F.struct("doc_seq", "el_no")).alias("seen"), F.flatten(F.transform(held, lambda x: x["pages"])).alias("pages")).select("book_key", "term", F.row_number().over(Window.partitionBy("book_key").orderBy("seen")).alias("term_ord"), "pages")


def pdf_texts(spark: SparkSession, paths: str | list[str], program: str = "pdftotext") -> DataFrame:
    """book_key (spaces as underscores), text of PDF files, by an external program on the executors; null where it is missing or fails."""
    files = spark.read.format("binaryFile").load(paths).select(F.replace(_stem("path"), F.lit(" "), F.lit("_")).alias("book_key"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    done = subprocess.run([program, "-layout", "-", "-"], input=r.content, capture_output=True, timeout=600, check=True)
                    rows.append((r.book_key, done.stdout.decode("utf-8", "replace")))
                except (OSError, subprocess.SubprocessError):
                    rows.append((r.book_key, None))
            yield pd.DataFrame(rows, columns=["book_key", "text"])

    return files.mapInPandas(run, "book_key string, text string")
