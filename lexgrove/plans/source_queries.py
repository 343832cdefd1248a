"""Queries on what is read and written: registries, indices, contents, EPUB documents, argument maps, sinks and tables.

Texts are made of the driver's tables, one for a book or conversation, in the formats
that the readers take; the reference SQL states what they hold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schema
from ..functions import text as T
from ..functions.storage import durable, remove, shared_folder
from ..operators import chapters as C
from ..operators import claims, lookup, toc
from ..operators.engine import Engine
from ..sources import readers, writers
from . import build, tables, term_queries, text_queries
from .text_queries import DUCK, SPARK

PART = "SELECT p_brand AS book_key, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS rn, p_name, p_partkey, p_size FROM part"


def _parts(spark, sf_dir, sql=PART):
    return spark.sql(sql.format(**SPARK).replace("FROM part", "FROM {part}"), part=tables.table(spark, sf_dir, "part"))


# --- registry, indices, contents ----------------------------------------------------------
def registry_read(spark, sf_dir):
    """Books of a registry text with their settings, and keys asked for that it does not have."""
    year = F.regexp_extract("key", r"(\d+)$", 1).cast("int")
    odd = year % 2 == 1
    entry = F.struct(
        F.concat(F.lit("Title "), F.col("key")).alias("title"),
        (F.lit(1980) + year).alias("year"),
        F.when(odd, F.concat(F.col("key"), F.lit(".pdf"))).otherwise("").alias("pdf"),
        F.concat(F.col("key"), F.lit(".epub")).alias("epub_path"),
        F.when(odd, F.struct((year / 100).alias("global_thresh"), F.lit(20).alias("window_size"))).alias("header_stripper"),
    )
    keys = tables.table(spark, sf_dir, "part").select(F.col("p_brand").alias("key")).distinct()
    whole = keys.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("key", entry)))).alias("value"))
    rows = readers.registry_rows(whole)
    known = rows.select("book_key", F.lit("known").alias("kind"), "title", "year", F.coalesce(F.nullif("pdf", F.lit("")), "epub_path").alias("source"), "header_stripper.global_thresh", "header_stripper.window_size")
    asked = spark.createDataFrame([("Brand#11",), ("no such book",)], "book_key string")
    none = F.lit(None)
    missing = schema.unknown_keys(asked, rows).select("book_key", F.lit("unknown"), none.cast("string"), none.cast("int"), none.cast("string"), none.cast("double"), none.cast("int"))
    return known.union(missing)


def index_read(spark, sf_dir):
    """Index texts {term: [page]} by book, in their order."""
    packed = tables.index(spark, sf_dir).groupBy("book_key").agg(F.array_sort(F.collect_list(F.struct("term_ord", "term", "pages"))).alias("e"))
    files = packed.select("book_key", F.to_json(F.map_from_entries(F.transform("e", lambda x: F.struct(x["term"], x["pages"])))).alias("text"))
    return readers.index_rows(files).select("book_key", "term", "term_ord", F.array_join("pages", ",").alias("pages"))


def toc_read(spark, sf_dir):
    """Contents texts, flat for odd places and by levels for even ones, and bookmark texts."""
    parts = _parts(spark, sf_dir)
    flat = F.struct(F.col("p_name").alias("title"), F.col("rn").alias("start_page"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("int").alias("pdf_page"))
    deep = F.struct(F.col("p_name").alias("title"), F.lit(None).cast("int").alias("start_page"), (F.col("rn") % 3).alias("level"), F.col("rn").alias("pdf_page"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("rn", F.when(F.col("rn") % 2 == 1, flat).otherwise(deep).alias("x")))), lambda e: e["x"])
    contents = parts.groupBy("book_key").agg(F.to_json(entries).alias("text"))
    line = F.concat(F.repeat(F.lit("\t"), F.col("rn") % 3), F.col("p_name"), F.lit("/"), F.col("rn").cast("string"), F.lit(",Black,notItalic"))
    marks = parts.groupBy("book_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("x")))), lambda e: e["x"]), "\n").alias("text"))
    marks = marks.select("book_key", F.concat(F.lit("Title/page, color\n"), "text", F.lit("\nno page here")).alias("text"))
    one = readers.toc_rows(contents).select(F.lit("contents").alias("form"), "book_key", "toc_ord", "level", "title", "start_page")
    return one.union(readers.bookmark_rows(marks).select(F.lit("bookmarks"), "book_key", "toc_ord", "level", "title", "start_page"))


POSITIONAL = """SELECT book_key, rn AS ch_ord, CASE rn % 4 WHEN 0 THEN '' WHEN 1 THEN p_name || ' and what follows it' WHEN 2 THEN upper(p_name) ELSE substr(p_name, 1, 6) END AS title, rn * 10 AS start_page, rn * 10 + 9 AS end_page FROM m WHERE rn % 3 = 0 OR right(book_key, 1) > '3'"""
ENTRIES = "SELECT book_key, rn AS toc_ord, 'On ' || p_name || ' of size ' || p_size AS title FROM m"


def toc_positional(spark, sf_dir):
    """Chapters titled by place where the contents have as many entries, else by the first entry that holds their title."""
    m = _parts(spark, sf_dir)
    of = lambda sql: spark.sql(sql.replace("FROM m", "FROM {m}"), m=m)
    return toc.positional_titles(of(POSITIONAL), of(ENTRIES))


# --- EPUB ---------------------------------------------------------------------------------
# the second document of a book is its index, the third its contents
DOCUMENTS = f"""SELECT book_key, rn AS doc_seq, CASE rn WHEN 2 THEN 'x/51_Index.xhtml' WHEN 3 THEN 'x/05_Tableofcontent.xhtml' ELSE 'x/c' || CAST(rn AS {{string}}) || '.xhtml' END AS name,
  CASE rn WHEN 2 THEN '<p class="level1">Term ' || p_name || ', 3, 4–6</p><div class="level2 x">sub, 7</div><p class="level3">deep, 8</p><p class="level3">none</p><p class="level1">See other, 4</p><p class="level2">second</p><p class="level1">Term ' || p_name || ', 9</p><p class="level2">third, 10</p><p></p>'
  ELSE '<html><head><style>p</style></head><body><h1>Dropped</h1><h2 class="Chap-no">1</h2><h2>Big <i>' || p_name || '</i></h2><p class="chap-auth1">Author</p><h3>Mid &amp; low</h3><p>Text ' || p_name || '</p><script>var</script><h4>Low</h4><h5>Least</h5></body></html>' END AS html FROM ({PART}) m"""


def _documents(spark, sf_dir):
    return _parts(spark, sf_dir, DOCUMENTS)


def _elements(spark, sf_dir):
    return readers.html_elements(_documents(spark, sf_dir), ("book_key", "doc_seq", "name"))


def epub_chapters(spark, sf_dir):
    return readers.epub_markdown(_elements(spark, sf_dir)).select("book_key", F.length("markdown").alias("n_chars"), F.md5("markdown").alias("md5"))


def epub_index(spark, sf_dir):
    found = readers.epub_index(_elements(spark, sf_dir).where(readers.is_index_document()))
    return found.select("book_key", "term", "term_ord", F.array_join("pages", ",").alias("pages"))


def epub_text(spark, sf_dir):
    return readers.epub_text(_documents(spark, sf_dir)).select("book_key", F.length("text").alias("n_chars"), F.md5("text").alias("md5"))


_DOCUMENTS = f"WITH documents_of AS ({DOCUMENTS.format(**DUCK)}), named AS (SELECT d.*, m.p_name FROM documents_of d JOIN ({PART}) m ON d.book_key = m.book_key AND d.doc_seq = m.rn)"

# --- files --------------------------------------------------------------------------------
#: By a book's last figure: 1 is damaged or malformed, 2 is missing, 3 has no package file.
_LAST = "right(book_key, 1)"


def _archive(book):
    """A book's documents as an archive: its manifest goes backwards, its spine forwards without the third document."""
    import io
    import zipfile

    import pandas as pd

    key, names = book.book_key.iloc[0], book.sort_values("doc_seq").name.tolist()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, html in zip(book.name, book.html):
            z.writestr(f"OEBPS/{name}", html)
        if not key.endswith("3"):
            items = "".join(f'<item id="i{n}" href="{name}"/>' for n, name in reversed(list(enumerate(names))))
            spine = "".join(f'<itemref idref="i{n}"/>' for n in range(len(names)) if n != 2)
            z.writestr("OEBPS/book.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}</manifest><spine>{spine}</spine></package>')
    content = out.getvalue()
    return pd.DataFrame([(key, content[: len(content) // 2] if key.endswith("1") else content)], columns=["book_key", "content"])


def epub_files(spark, sf_dir):
    """Archives written to the shared folder and read through the EPUB source: documents in reading order, damaged ones told."""
    folder = f"{shared_folder(spark)}/epub-{uuid.uuid4().hex}"
    docs = _documents(spark, sf_dir).select("book_key", "doc_seq", "name", "html")
    writers.binary_files(docs.groupBy("book_key").applyInPandas(_archive, "book_key string, content binary"), folder)
    told = readers.epub_files(spark, folder)
    listed = told.select("book_key", "doc_seq", "name", F.md5("html").alias("md5"), "problem")
    text = readers.epub_text(readers.epub_documents(spark, folder)).select("book_key", F.lit(-1).alias("doc_seq"), F.lit("text").alias("name"), F.md5("text").alias("md5"), F.lit(None).cast("string").alias("problem"))
    out = durable(listed.union(text))
    remove(spark, folder)
    return out


def index_files(spark, sf_dir):
    """Index files of many books through their source: entries, and the books whose file is missing or no JSON."""
    folder = f"{shared_folder(spark)}/indices-{uuid.uuid4().hex}"
    packed = tables.index(spark, sf_dir).groupBy("book_key").agg(F.array_sort(F.collect_list(F.struct("term_ord", "term", "pages"))).alias("e"))
    text = F.to_json(F.map_from_entries(F.transform("e", lambda x: F.struct(x["term"], x["pages"]))))
    last = F.expr(_LAST)
    writers.text_files(packed.where(last != "2").select("book_key", F.when(last == "1", F.substring(text, 1, 20)).otherwise(text).alias("text")), folder, force=True)
    rows = readers.indices(spark, folder).select(F.lit("entry").alias("kind"), "book_key", "term", "term_ord", F.array_join("pages", ",").alias("pages"))
    wrong = readers.problems(readers.texts(spark, folder), packed).select("problem", "book_key", F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("string"))
    out = durable(rows.union(wrong))
    remove(spark, folder)
    return out


def text_files(spark, sf_dir):
    """Texts of many books written and read through their source: lines, and the files' sizes."""
    folder = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    rows = _parts(spark, sf_dir).select("book_key", "rn", F.when(F.col("rn") % 7 == 0, "").otherwise(F.concat("p_name", F.lit(" – "), F.col("p_size").cast("string"))).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"]), "\n")
    writers.text_files(rows.groupBy("book_key").agg(text.alias("text")), folder, force=True)
    lines = readers.lines(readers.texts(spark, folder)).select("book_key", "line_no", F.col("raw").alias("line"), F.lit(None).cast("long").alias("n_bytes"))
    sizes = readers.sizes(spark, folder).select("book_key", F.lit(-1), F.lit(None).cast("string"), "n_bytes")
    out = durable(lines.union(sizes))
    remove(spark, folder)
    return out


# --- argument maps ------------------------------------------------------------------------
MAPS = """SELECT CAST(conv_id AS {string}) AS file, CAST(count(*) AS INT) AS n, 'Text' || {nl} || '  c0 (R): before' || {nl} || 'CITATIONS' || {nl} || '  c1  (R): Nagel' || CAST(conv_id AS {string}) || ', Chalmers1996' || {nl} || {nl}
  || '  c2 (E): Crick' || CAST(count(*) AS {string}) || ',' || {nl} || '  c1 (R): again' || {nl} || 'END' || {nl} || '  c3 (R): after' || {nl} || '## Gap report' || {nl} || 'G0 not yet' || {nl} || '```' || {nl}
  || 'STRUCTURAL GAPS' || {nl} || '─────' || {nl} || 'G1 gap ' || CAST(conv_id AS {string}) || {nl} || 'no gap' || {nl} || 'NAKED ASSERTIONS (bare)' || {nl} || 'lab' || CAST(conv_id AS {string}) || ' (T) — note ' || CAST(count(*) AS {string}) || {nl}
  || 'STUBS' || {nl} || 'stub1 (E) - later' || {nl} || '```' || {nl} || 'stub2 (E) - outside' AS text FROM conversations GROUP BY conv_id"""


def _map_lines(spark, sf_dir):
    talk = tables.table(spark, sf_dir, "conversations")
    return claims.amap_lines(spark.sql(MAPS.format(**SPARK).replace("FROM conversations", "FROM {talk}"), talk=talk))


def amap_citations(spark, sf_dir):
    return claims.citations_block(_map_lines(spark, sf_dir)).select("file", "label", F.array_join("refs", "|").alias("refs"))


def amap_gaps(spark, sf_dir):
    return claims.gap_report(_map_lines(spark, sf_dir)).select("file", "section", "label", "note")


# --- the documented SQL -------------------------------------------------------------------
def _linked(spark, sf_dir, names):
    """Those named of terms, candidates, chapters, references and term_chapters of the made books; the markdown's chapters."""
    held = {}
    if "terms" in names or "candidates" in names or "term_chapters" in names:
        linked = "term_chapters" in names
        stored = ("terms", "terms_by_id", *(["occurrences"] if linked else []), *(["edges"] if "candidates" in names else []))
        engine = term_queries._engine(spark, sf_dir, *stored)
        held["terms"] = engine.terms
        if "candidates" in names:
            held["candidates"] = engine.candidates
    if "chapters" in names or "term_chapters" in names:
        held["chapters"] = text_queries._chapters(spark, sf_dir).withColumn("id", F.xxhash64("book_key", "ch_ord"))
    if "term_chapters" in names:
        links = C.link_chapters(engine.occurrences.join(engine.terms.withColumnRenamed("id", "term_id"), "term_id"), held["chapters"])
        held["term_chapters"] = links.join(engine.terms, "term").select(F.col("id").alias("term_id"), F.xxhash64("book_key", "ch_ord").alias("chapter_id"))
    if "refs" in names:
        held["refs"] = text_queries._references(spark, sf_dir).withColumn("chapter_id", F.xxhash64("book_key", "ch_ord")).withColumn("year", F.col("year").try_cast("int"))
    return held


CHAPTERS_OF = """SELECT DISTINCT ch.book_key, ch.title, ch.start_page, ch.end_page FROM {term_chapters} tc JOIN {terms} t ON tc.term_id = t.id JOIN {chapters} ch ON tc.chapter_id = ch.id
WHERE t.term IN (SELECT t2.term FROM {candidates} c JOIN {terms} t1 ON c.term1_id = t1.id JOIN {terms} t2 ON c.term2_id = t2.id WHERE t1.term = 'small ring' AND c.score >= 0.4 UNION SELECT 'small ring')"""
NEWEST = """SELECT r.authors, r.year, r.title, r.venue FROM {refs} r JOIN {chapters} ch ON r.chapter_id = ch.id JOIN {term_chapters} tc ON tc.chapter_id = ch.id JOIN {terms} t ON tc.term_id = t.id
WHERE t.term = 'small ring' ORDER BY r.year DESC NULLS LAST, r.raw, ch.book_key, r.ref_ord LIMIT 10"""
VARIANTS = """SELECT t2.term, c.match_type, c.score FROM {candidates} c JOIN {terms} t1 ON t1.term = 'small ring' AND t1.id IN (c.term1_id, c.term2_id)
JOIN {terms} t2 ON t2.id = CASE WHEN c.term1_id = t1.id THEN c.term2_id ELSE c.term1_id END ORDER BY c.score DESC, t2.term LIMIT 20"""


def _documented(sql):
    def query(spark, sf_dir):
        names = [k for k in ("terms", "candidates", "chapters", "refs", "term_chapters") if "{" + k + "}" in sql]
        held = _linked(spark, sf_dir, names)
        return spark.sql(sql, **{k: held[k] for k in names})

    return query


_REFS = text_queries._REFS + ", " + tables.OCC_SQL.strip().removeprefix("WITH ").replace("rows AS (SELECT p_brand", "part_rows AS (SELECT p_brand").replace("FROM rows", "FROM part_rows")
_LINKS = f"""{_REFS}, links AS (SELECT DISTINCT o.term, c.book_key, c.ch_ord, c.title, c.start_page, c.end_page FROM (SELECT book_key, term, CAST(unnest(pages) AS INT) AS page FROM occ) o JOIN chapters c ON o.book_key = c.book_key AND o.page BETWEEN c.start_page AND c.end_page)"""
# the candidates behind the links, all from one WITH
_CANDIDATES = term_queries._CANDIDATES.removeprefix(tables.OCC_SQL).strip().removeprefix(",").strip()
_CANDIDATES_OF = term_queries._CANDIDATES.strip().removeprefix("WITH ")


def book_totals(spark, sf_dir):
    """Chapters and references of each book, and how many of all terms lie in a chapter."""
    chapters, refs = text_queries._chapters(spark, sf_dir), text_queries._references(spark, sf_dir)
    index = tables.index(spark, sf_dir)
    return C.totals(chapters, refs).unionByName(C.linked_totals(index.select("term").distinct(), C.link_chapters(index, chapters)))


# --- edges of the build -------------------------------------------------------------------
def lookup_subentries(spark, sf_dir):
    """The lookup of terms with sub-entries, without and with these."""
    index = tables.index(spark, sf_dir).withColumn("term", F.regexp_replace("term", r" \(", " > ("))
    index = index.groupBy("book_key", "book_ord", "term").agg(F.min("term_ord").alias("term_ord"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"))
    told = lambda kind, with_subentries: lookup.build_lookup(index, with_subentries).select(F.lit(kind).alias("kind"), "term", "n_books", "book_key", F.array_join(F.array_sort("pages"), ",").alias("pages"))
    return told("main", False).union(told("all", True))


def link_edges(spark, sf_dir):
    """Chapters without page ranges or references, books without chapters, candidates of unknown terms."""
    ranges = text_queries._ranges(spark, sf_dir).where("book_key <> 'Brand#13'").withColumn("end_page", F.when(F.col("ch_ord") != 3, F.col("end_page")))
    index = tables.index(spark, sf_dir)
    linked = C.link_chapters(index, ranges).groupBy("book_key").agg(F.count("*").alias("n")).select(F.lit("linked terms").alias("kind"), "book_key", "n")
    chapters = text_queries._chapters(spark, sf_dir)
    cut = chapters.withColumn("ref_start_line", F.when(F.col("ch_ord") > 1, F.col("ref_start_line")))
    refs = C.references(text_queries._markdown(spark, sf_dir), cut).groupBy("book_key").agg(F.count("*").alias("n")).select(F.lit("references"), "book_key", "n")
    terms = term_queries._lookup(spark, sf_dir)
    some = terms.select("term").distinct().orderBy("term").limit(2)
    pairs = some.select(F.col("term").alias("term1"), F.lit("no such term").alias("term2"), F.lit("case").alias("match_type"), F.lit(1.0).alias("score"))
    pairs = pairs.union(some.agg(F.min("term"), F.max("term"), F.lit("case"), F.lit(1.0)))
    kept = lookup.relations(terms, pairs, term_queries._books(spark, sf_dir))["candidates"].agg(F.lit("").alias("book_key"), F.count("*").alias("n")).select(F.lit("known candidates"), "book_key", "n")
    return linked.union(refs).union(kept)


def numbered_references(spark, sf_dir):
    item = F.concat(F.col("rn").cast("string"), F.lit(". "), F.when(F.col("rn") % 3 == 0, "Short one").when(F.col("rn") % 3 == 1, F.concat(F.lit("Small R,\nRing S (1999) "), "p_name", F.lit(". Journal 4."))).otherwise(F.concat(F.lit("An entry without any year of "), "p_name")))
    lines = _parts(spark, sf_dir).select("book_key", "rn", F.posexplode(F.split(item, "\n")).alias("k", "line"))
    return C.numbered_references(lines.select("book_key", (F.col("rn") * 2 + F.col("k")).alias("line_no"), "line"))


def first_tokens(spark, sf_dir):
    return term_queries._terms(spark, sf_dir).select("term", T.first_token("term").alias("token"))


def hit_lines(spark, sf_dir):
    """The formatted hits of a search in capitals."""
    engine = term_queries._engine(spark, sf_dir)
    hits = engine.lookup_icase("SMALL RING").withColumn("mark", F.lit("case"))
    return writers.hit_lines(hits, engine.labels()).select("term", "text")


# --- the whole build ----------------------------------------------------------------------
def whole_build(spark, sf_dir):
    """Texts, a registry and markdown to relations with linked chapters: rows of each relation, and a sum over them."""
    raw = text_queries._index_lines(spark, sf_dir)
    text = lambda df, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", line))), lambda x: x[line]), "\n")
    texts = raw.groupBy("book_key").agg(text(raw, "raw").alias("text"))
    year = F.lit(1990) + F.regexp_extract("book_key", r"(\d+)$", 1).cast("int")
    registry = texts.select("book_key", F.lit("T").alias("title"), F.lit("A").alias("author"), year.alias("year"), F.lit("").alias("pdf"), F.concat("book_key", F.lit(".epub")).alias("epub_path"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("index_start_line"), F.lit(None).cast("string").alias("subentry_strategy"))
    lines = text_queries._markdown(spark, sf_dir)
    markdown = lines.groupBy("book_key").agg(text(lines, "line").alias("markdown"))
    rows = build.with_book_order(build.extract_index(texts, registry), registry)
    made = build.relations(rows, registry, linked=build.extract_references(markdown, registry))
    sums = {"books": F.sum(F.length("pdf_path")), "terms": F.sum(F.col("id") * F.col("n_books")), "occurrences": F.sum(F.col("term_id") * F.size("pages")), "chapters": F.sum("ref_line"), "references": F.sum(F.length("raw")), "term_chapters": F.sum("term_id")}
    out = None
    for name, total in sums.items():
        row = made[name].agg(F.lit(name).alias("relation"), F.count("*").alias("n"), total.cast("long").alias("total"))
        out = row if out is None else out.union(row)
    return out


# --- sinks and tables ---------------------------------------------------------------------
def sink_roundtrip(spark, sf_dir):
    """What the sinks write, read back: index, markdown, page marks, chapters and references by book, the lookup as JSON."""
    folder = f"{shared_folder(spark)}/sinks-{uuid.uuid4().hex}"
    maps = lookup.lookup_maps(term_queries._lookup(spark, sf_dir))
    markdown = text_queries._markdown(spark, sf_dir).groupBy("book_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("markdown"))
    writers.by_book(tables.index(spark, sf_dir), f"{folder}/index")
    writers.lookup_json(maps, f"{folder}/lookup")
    writers.markdown_files(markdown, f"{folder}/markdown")
    writers.whole(term_queries._engine(spark, sf_dir).candidates, f"{folder}/candidates")
    lines = text_queries._markdown(spark, sf_dir)
    for name, df in (("markers", C.page_markers(lines)), ("chapters", text_queries._chapters(spark, sf_dir)), ("references", text_queries._references(spark, sf_dir))):
        writers.by_book(df, f"{folder}/{name}")
    index = spark.read.parquet(f"{folder}/index").groupBy("book_key").agg(F.count("*").alias("n"), F.sum(F.size("pages")).alias("total"))
    lines = spark.read.text(f"{folder}/lookup").select(F.from_json("value", "term STRING, n_books INT, pages MAP<STRING, ARRAY<STRING>>").alias("e"))
    terms = lines.agg(F.lit("").alias("book_key"), F.count("*").alias("n"), F.sum(F.size("e.pages")).alias("total"))
    texts = spark.read.text(f"{folder}/markdown").groupBy("book_key").agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("total"))
    pairs = spark.read.parquet(f"{folder}/candidates").agg(F.lit("").alias("book_key"), F.count("*").alias("n"), F.sum("term1_id").alias("total"))
    named = lambda sink, df: df.select(F.lit(sink).alias("sink"), F.col("book_key").cast("string").alias("book_key"), "n", F.col("total").cast("long").alias("total"))
    held = lambda sink, total: named(sink, spark.read.parquet(f"{folder}/{sink}").groupBy("book_key").agg(F.count("*").alias("n"), F.sum(total).alias("total")))
    out = durable(named("index", index).union(named("lookup", terms)).union(named("markdown", texts)).union(named("candidates", pairs)).union(held("markers", "line_idx")).union(held("chapters", "ref_start_line")).union(held("references", F.length("raw"))))
    remove(spark, folder)
    return out


def catalog_roundtrip(spark, sf_dir):
    """The relations as tables of a catalog: created twice, loaded, counted there, held against the rules, dropped."""
    folder, name = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}", f"shelf_{uuid.uuid4().hex[:8]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder}'")
    for _ in range(2):
        schema.create(spark, name)
    engine = term_queries._engine(spark, sf_dir)
    held = {"books": engine.book_rows, "terms": engine.terms, "occurrences": engine.occurrences, "candidates": engine.candidates}
    schema.load(spark, held, name)
    stored = {t: spark.table(f"{name}.{t}") for t in held}
    broken = schema.violations(stored).agg(F.count("*").alias("broken"))
    out = durable(Engine.of_catalog(spark, name).stats().join(broken))
    schema.drop(spark, name)
    spark.sql(f"DROP DATABASE {name}")
    remove(spark, folder)
    return out


QUERIES = {
    "registry_read": registry_read,
    "index_read": index_read,
    "toc_read": toc_read,
    "toc_positional": toc_positional,
    "epub_chapters": epub_chapters,
    "epub_index": epub_index,
    "epub_text": epub_text,
    "epub_files": epub_files,
    "index_files": index_files,
    "text_files": text_files,
    "amap_citations": amap_citations,
    "amap_gaps": amap_gaps,
    "chapters_of_term": _documented(CHAPTERS_OF),
    "newest_references": _documented(NEWEST),
    "variants_top20": _documented(VARIANTS),
    "book_totals": book_totals,
    "lookup_subentries": lookup_subentries,
    "link_edges": link_edges,
    "numbered_references": numbered_references,
    "first_tokens": first_tokens,
    "hit_lines": hit_lines,
    "whole_build": whole_build,
    "sink_roundtrip": sink_roundtrip,
    "catalog_roundtrip": catalog_roundtrip,
}

_KEYS = "(SELECT DISTINCT p_brand AS book_key FROM part)"
_EPUB_BODY = "'<!-- ch. ' || label || ' -->' || chr(10) || chr(10) || '# Big ' || p_name || chr(10) || chr(10) || chr(10) || '## Mid & low' || chr(10) || chr(10) || 'Text ' || p_name || chr(10) || chr(10) || '### Low' || chr(10) || chr(10) || chr(10) || '#### Least' || chr(10)"
_SUBS = tables.OCC_SQL + """, cut AS (SELECT book_key, replace(term, ' (', ' > (') AS term, min(first_key) AS first_key, list_sort(list_distinct(flatten(list(pages)))) AS pages FROM occ GROUP BY ALL),
subs AS (SELECT term, book_key, array_to_string(pages, ',') AS pages, count(*) OVER (PARTITION BY term) AS n_books FROM cut)"""

ORACLES = {
    "registry_read": f"""WITH k AS (SELECT book_key, CAST(regexp_extract(book_key, '(\\d+)$', 1) AS INT) AS y FROM {_KEYS})
SELECT book_key, 'known' AS kind, 'Title ' || book_key AS title, 1980 + y AS year, book_key || CASE WHEN y % 2 = 1 THEN '.pdf' ELSE '.epub' END AS source, CASE WHEN y % 2 = 1 THEN y / 100 END AS global_thresh, CASE WHEN y % 2 = 1 THEN 20 END AS window_size FROM k
UNION ALL SELECT 'no such book', 'unknown', NULL, NULL, NULL, NULL, NULL UNION ALL SELECT 'Brand#11', 'unknown', NULL, NULL, NULL, NULL, NULL WHERE NOT EXISTS (SELECT 1 FROM k WHERE book_key = 'Brand#11')""",
    "index_read": tables.OCC_SQL + "SELECT book_key, term, CAST(row_number() OVER (PARTITION BY book_key ORDER BY first_key) - 1 AS INT) AS term_ord, array_to_string(pages, ',') AS pages FROM occ",
    "toc_read": f"""WITH m AS ({PART}) SELECT 'contents' AS form, book_key, rn - 1 AS toc_ord, CASE WHEN rn % 2 = 1 THEN 0 ELSE rn % 3 END AS level, p_name AS title, rn AS start_page FROM m
UNION ALL SELECT 'bookmarks', book_key, rn, rn % 3, p_name, rn FROM m""",
    "toc_positional": f"""WITH m AS ({PART}), c AS (SELECT *, row_number() OVER (PARTITION BY book_key ORDER BY ch_ord) AS i, count(*) OVER (PARTITION BY book_key) AS n FROM ({POSITIONAL})),
e AS (SELECT *, row_number() OVER (PARTITION BY book_key ORDER BY toc_ord) AS i, count(*) OVER (PARTITION BY book_key) AS n FROM ({ENTRIES}))
SELECT book_key, ch_ord, coalesce((SELECT arg_min(e.title, e.toc_ord) FROM e WHERE e.book_key = c.book_key AND CASE WHEN e.n = c.n THEN e.i = c.i ELSE c.title <> '' AND contains(e.title, substr(c.title, 1, 25)) END), title) AS title, start_page, end_page FROM c""",
    "epub_chapters": f"""{_DOCUMENTS}, kept AS (SELECT *, row_number() OVER (PARTITION BY book_key ORDER BY doc_seq) AS label FROM named WHERE doc_seq NOT IN (2, 3)),
whole AS (SELECT book_key, regexp_replace(string_agg({_EPUB_BODY}, chr(10) || chr(10) ORDER BY doc_seq) || chr(10), '\\n{{3,}}', chr(10) || chr(10), 'g') AS markdown FROM kept GROUP BY book_key)
SELECT book_key, length(markdown) AS n_chars, md5(markdown) AS md5 FROM whole""",
    "epub_index": f"""{_DOCUMENTS} SELECT book_key, 'Term ' || p_name || x AS term, o AS term_ord, pages FROM named, (VALUES ('', 1, '3,4–6,9'), (' > sub', 2, '7'), (' > sub > deep', 3, '8'), (' > second', 4, ''), (' > third', 5, '10')) AS f(x, o, pages) WHERE doc_seq = 2""",
    "epub_text": f"""{_DOCUMENTS}, whole AS (SELECT book_key, string_agg('Dropped' || chr(10) || '1' || chr(10) || 'Big ' || chr(10) || p_name || chr(10) || 'Author' || chr(10) || 'Mid & low' || chr(10) || 'Text ' || p_name || chr(10) || 'Low' || chr(10) || 'Least', chr(12) ORDER BY doc_seq) AS text FROM named WHERE doc_seq <> 2 GROUP BY book_key)
SELECT book_key, length(text) AS n_chars, md5(text) AS md5 FROM whole""",
    "epub_files": f"""{_DOCUMENTS}, fine AS (SELECT *, {_LAST} AS l, row_number() OVER (PARTITION BY book_key ORDER BY CASE WHEN {_LAST} = '3' THEN 0 ELSE CAST(doc_seq = 3 AS INT) END, doc_seq) - 1 AS pos FROM named WHERE {_LAST} <> '1'),
texts AS (SELECT *, 'Dropped' || chr(10) || '1' || chr(10) || 'Big ' || chr(10) || p_name || chr(10) || 'Author' || chr(10) || 'Mid & low' || chr(10) || 'Text ' || p_name || chr(10) || 'Low' || chr(10) || 'Least' AS t FROM fine WHERE doc_seq <> 2)
SELECT book_key, CAST(pos AS INT) AS doc_seq, 'OEBPS/' || name AS name, md5(html) AS md5, NULL AS problem FROM fine
UNION ALL SELECT DISTINCT book_key, CAST(NULL AS INT), NULL, NULL, 'BadZipFile' FROM named WHERE {_LAST} = '1'
UNION ALL SELECT book_key, -1, 'text', md5(string_agg(t, chr(12) ORDER BY pos)), NULL FROM texts GROUP BY book_key""",
    "index_files": f"""{tables.OCC_SQL} SELECT 'entry' AS kind, book_key, term, CAST(row_number() OVER (PARTITION BY book_key ORDER BY first_key) - 1 AS INT) AS term_ord, array_to_string(pages, ',') AS pages FROM occ WHERE {_LAST} NOT IN ('1', '2')
UNION ALL SELECT DISTINCT CASE {_LAST} WHEN '1' THEN 'malformed' ELSE 'missing' END, book_key, NULL, NULL, NULL FROM occ WHERE {_LAST} IN ('1', '2')""",
    "text_files": f"""WITH m AS ({PART}), l AS (SELECT book_key, rn, CASE WHEN rn % 7 = 0 THEN '' ELSE p_name || ' – ' || p_size END AS line FROM m)
SELECT book_key, rn - 1 AS line_no, line, NULL AS n_bytes FROM l UNION ALL SELECT book_key, -1, NULL, CAST(sum(strlen(line) + 1) AS BIGINT) FROM l GROUP BY book_key""",
    "amap_citations": "SELECT CAST(conv_id AS VARCHAR) AS file, 'c1' AS label, 'again' AS refs FROM conversations GROUP BY conv_id UNION ALL SELECT CAST(conv_id AS VARCHAR), 'c2', 'Crick' || count(*) FROM conversations GROUP BY conv_id",
    "amap_gaps": """WITH c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT CAST(conv_id AS VARCHAR) AS file, 'structural' AS section, NULL AS label, 'G1 gap ' || conv_id AS note FROM c
UNION ALL SELECT CAST(conv_id AS VARCHAR), 'naked_assertions', 'lab' || conv_id, 'note ' || n FROM c UNION ALL SELECT CAST(conv_id AS VARCHAR), 'stubs', 'stub1', 'later' FROM c""",
    "chapters_of_term": f"""{_LINKS}, {_CANDIDATES}, wanted AS (SELECT CASE WHEN ord1 < ord2 THEN term2 ELSE term1 END AS term FROM best WHERE CASE WHEN ord1 < ord2 THEN term1 ELSE term2 END = 'small ring' AND score >= 0.4 UNION SELECT 'small ring')
SELECT DISTINCT book_key, title, start_page, end_page FROM links WHERE term IN (SELECT term FROM wanted)""",
    "newest_references": f"""{_LINKS} SELECT r.authors, TRY_CAST(r.year AS INT) AS year, r.title, r.venue FROM refs r JOIN links l ON r.book_key = l.book_key AND r.ch_ord = l.ch_ord WHERE l.term = 'small ring' ORDER BY year DESC NULLS LAST, r.raw, r.book_key, r.ref_ord LIMIT 10""",
    "variants_top20": f"{term_queries._CANDIDATES} SELECT dst AS term, match_type, score FROM edges WHERE src = 'small ring' ORDER BY score DESC, dst LIMIT 20",
    "book_totals": f"""{_LINKS} SELECT c.book_key, count(*) AS n_chapters, (SELECT count(*) FROM refs r WHERE r.book_key = c.book_key) AS n_references, NULL::BIGINT AS n_linked, NULL::BIGINT AS n_terms FROM chapters c GROUP BY c.book_key
UNION ALL SELECT NULL, NULL, NULL, (SELECT count(DISTINCT term) FROM links), (SELECT count(*) FROM terms)""",
    "lookup_subentries": f"{_SUBS} SELECT 'all' AS kind, term, n_books, book_key, pages FROM subs UNION ALL SELECT 'main', term, n_books, book_key, pages FROM subs WHERE NOT contains(term, '>')",
    "link_edges": f"""{_REFS}, {text_queries._RANGES}, inside AS (SELECT DISTINCT o.term, o.book_key, r.ch_title FROM (SELECT book_key, term, CAST(unnest(pages) AS INT) AS page FROM occ) o JOIN ranges r ON o.book_key = r.book_key AND o.page BETWEEN r.sp AND r.ep WHERE r.ch_ord <> 3 AND o.book_key <> 'Brand#13')
SELECT 'linked terms' AS kind, book_key, count(*) AS n FROM inside GROUP BY book_key UNION ALL SELECT 'references', book_key, count(*) FROM refs WHERE ch_ord > 1 GROUP BY book_key UNION ALL SELECT 'known candidates', '', 1""",
    "numbered_references": f"""WITH m AS ({PART}) SELECT book_key, CAST(row_number() OVER (PARTITION BY book_key ORDER BY rn) AS INT) AS ref_ord, 'Small R, Ring S' AS authors, '1999' AS year, p_name AS title, 'Journal 4.' AS venue, 'Small R, Ring S (1999) ' || p_name || '. Journal 4.' AS raw FROM m WHERE rn % 3 = 1""",
    "first_tokens": f"""{tables.OCC_SQL} SELECT term, coalesce(list_filter(regexp_split_to_array(lower(term), '[\\s\\-/,;:()\\[\\]]+'), lambda t: length(t) > 2 AND t NOT IN {T.STOP_WORDS})[1], substr({term_queries.NORM}, 1, 4)) AS token FROM terms""",
    "hit_lines": f"""{tables.OCC_SQL} SELECT t.term, '  [case] ' || t.term || '  (' || t.n_books || CASE WHEN t.n_books = 1 THEN ' book)' ELSE ' books)' END || chr(10)
  || string_agg('      ' || rpad('Author ' || right(o.book_key, 1) || ' ' || (1990 + CAST(regexp_extract(o.book_key, '(\\d+)$', 1) AS INT)), 30, ' ') || '  pp. ' || array_to_string(o.pages, ', '), chr(10) ORDER BY o.book_key) AS text
FROM terms t JOIN occ o ON o.term = t.term WHERE {term_queries.ASCII.format('t.term')} = 'small ring' GROUP BY t.term, t.n_books""",
    "whole_build": f"""WITH parsed AS ({text_queries._PARSED}), main AS (SELECT * FROM parsed WHERE NOT contains(term, '>')),
books AS (SELECT book_key, row_number() OVER (ORDER BY CAST(regexp_extract(book_key, '(\\d+)$', 1) AS INT), book_key) AS place FROM (SELECT DISTINCT p_brand AS book_key FROM part)),
terms AS (SELECT term, count(*) AS n_books, row_number() OVER (ORDER BY count(*) DESC, lower(term), min(place * 1000000000 + term_ord), term) AS id FROM main JOIN books USING (book_key) GROUP BY term),
ch AS ({text_queries._CHAPTERS} SELECT * FROM chapters), rf AS ({text_queries._REFS} SELECT * FROM refs),
placed AS (SELECT term, book_key, TRY_CAST(regexp_extract(unnest(string_split(pages, '|')), '^\\d+') AS INT) AS page FROM main),
links AS (SELECT DISTINCT p.term, p.book_key, c.title FROM placed p JOIN ch c ON p.book_key = c.book_key AND p.page BETWEEN c.start_page AND c.end_page)
SELECT 'books' AS relation, count(*) AS n, CAST(sum(length(book_key) + 5) AS BIGINT) AS total FROM books
UNION ALL SELECT 'terms', count(*), CAST(sum(id * n_books) AS BIGINT) FROM terms
UNION ALL SELECT 'occurrences', count(*), CAST(sum(id * len(list_filter(string_split(pages, '|'), lambda p: p <> ''))) AS BIGINT) FROM main JOIN terms USING (term)
UNION ALL SELECT 'chapters', count(*), CAST(sum(ref_start_line) AS BIGINT) FROM ch UNION ALL SELECT 'references', count(*), CAST(sum(length(raw)) AS BIGINT) FROM rf
UNION ALL SELECT 'term_chapters', count(*), CAST(sum(id) AS BIGINT) FROM links JOIN terms USING (term)""",
    "sink_roundtrip": f"""{text_queries._REFS}, {_CANDIDATES_OF}
SELECT 'index' AS sink, book_key, count(*) AS n, CAST(sum(len(pages)) AS BIGINT) AS total FROM occ GROUP BY book_key
UNION ALL SELECT 'lookup', '', (SELECT count(*) FROM terms), (SELECT count(*) FROM occ)
UNION ALL SELECT 'markdown', book_key, count(*), CAST(sum(length(line)) AS BIGINT) FROM md GROUP BY book_key
UNION ALL SELECT 'candidates', '', count(*), CAST(sum(least(ord1, ord2)) AS BIGINT) FROM best
UNION ALL SELECT 'markers', book_key, count(*), CAST(sum(line_idx) AS BIGINT) FROM (SELECT book_key, line, min(line_no) AS line_idx FROM md WHERE part IN (0, 3) GROUP BY ALL) GROUP BY book_key
UNION ALL SELECT 'chapters', book_key, count(*), CAST(sum(ref_start_line) AS BIGINT) FROM chapters GROUP BY book_key UNION ALL SELECT 'references', book_key, count(*), CAST(sum(length(raw)) AS BIGINT) FROM refs GROUP BY book_key""",
    "catalog_roundtrip": f"{term_queries.ORACLES['db_stats'].replace(' AS cross_book_terms', ' AS cross_book_terms, 0 AS broken')}",
}
