"""Queries on pages, indices, chapters, references, tables of contents and argument maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chapters as C
from ..operators import claims, index, pages, toc
from ..sources import readers
from . import tables

# --- pages made of documents -------------------------------------------------------------
# 50 pages a book; the first three have roman numbers
BOOK = "source || '-' || CAST(CAST(floor(doc_id / 1000) AS INT) AS {string})"
PAGES = f"""
SELECT {BOOK} AS book_key, doc_id, source, text,
  row_number() OVER (PARTITION BY {BOOK} ORDER BY doc_id) AS rn FROM documents
"""
PAGE_TEXT = """'Running Header ' || {source} || {nl} || CASE WHEN {rn} <= 3 THEN 'iv' ELSE CAST({rn} - 3 AS {string}) END || {nl} || {nl}
  || 'Chapter ' || CAST(CAST(floor(({rn} - 1) / 10) AS INT) + 1 AS {string}) || ' Overview' || {nl} || {nl} || replace({text}, {nl}, {nl} || {nl})"""
SPARK, DUCK = {"string": "STRING", "nl": "'\\n'", "rn": "(i + 1)", "source": "d.source", "text": "d.text"}, {"string": "VARCHAR", "nl": "chr(10)", "rn": "rn", "source": "source", "text": "text"}


def _books(spark, sf_dir, told=lambda text: text):
    """book_key, text: each book's pages joined by form feeds; of a document goes to its book what `told` makes of its text."""
    docs = tables.table(spark, sf_dir, "documents").select(F.expr(BOOK.format(**SPARK)).alias("book_key"), F.struct("doc_id", "source", told(F.col("text")).alias("text")).alias("d"))
    # a page's place is that in its book's list, so texts move once
    listed = docs.groupBy("book_key").agg(F.array_sort(F.collect_list("d")).alias("docs"))
    return listed.select("book_key", F.array_join(F.expr(f"transform(docs, (d, i) -> {PAGE_TEXT.format(**SPARK)})"), "\f").alias("text"))


def _segments(spark, sf_dir):
    """Not stored: a book's pages stay in the task that holds its text, and what counts or orders them moves nothing."""
    return pages.segment(_books(spark, sf_dir))


def _numbered(spark, sf_dir):
    """Segments for what asks for their numbers alone, so that no whole text moves."""
    return pages.segment(_books(spark, sf_dir, pages.outline))


def _stripped(spark, sf_dir):
    return pages.strip_headers(_segments(spark, sf_dir))


def page_segment(spark, sf_dir):
    return pages.segment(_books(spark, sf_dir)).select("book_key", "pdf_page", "book_page", F.length("text").alias("n_chars"), F.md5("text").alias("md5"))


def page_map(spark, sf_dir):
    return pages.page_map(_numbered(spark, sf_dir))


def header_freq_global(spark, sf_dir):
    return pages.frequent_lines(_segments(spark, sf_dir))


def header_freq_window(spark, sf_dir):
    return pages.frequent_in_windows(_segments(spark, sf_dir))


def strip_headers(spark, sf_dir):
    return _stripped(spark, sf_dir).select("book_key", "pdf_page", F.length("text").alias("n_chars"), F.md5("text").alias("md5"))


def heading_detect(spark, sf_dir):
    found = pages.annotate(_stripped(spark, sf_dir))
    # outer: explode would have a filter put before it that finds all headings again
    return found.select("book_key", "pdf_page", F.explode_outer("headings").alias("h")).where("h IS NOT NULL").select("book_key", "pdf_page", F.col("h.line_idx").alias("line_idx"), F.col("h.level").alias("level"), F.col("h.text").alias("text"))


def markdown_render(spark, sf_dir):
    found = pages.annotate(_stripped(spark, sf_dir))
    names = _segments(spark, sf_dir).select("book_key").distinct().select("book_key", F.concat(F.lit("Title "), "book_key").alias("title"), F.lit("A").alias("author"), F.lit(2020).alias("year"), F.lit("").alias("pdf"), F.lit("b.epub").alias("epub_path"))
    return pages.markdown(found, names).select("book_key", F.length("markdown").alias("n_chars"), F.md5("markdown").alias("md5"))


def page_interpolation(spark, sf_dir):
    """Every third page loses its number and gets it back by counting on."""
    gaps = _numbered(spark, sf_dir).withColumn("book_page", F.when(F.col("pdf_page") % 3 != 0, F.col("book_page")))
    return pages.interpolated(gaps).select("book_key", "pdf_page", "book_page")


_SEG = f"""WITH pages_of AS ({PAGES.format(**DUCK)}), made AS (SELECT book_key, rn, {PAGE_TEXT.format(**DUCK)} AS text FROM pages_of),
seg AS (SELECT book_key, CAST(rn - 1 AS INT) AS pdf_page, CAST(rn - 3 AS INT) AS book_page, text, string_split(text, chr(10)) AS lines, row_number() OVER (PARTITION BY book_key ORDER BY rn) - 1 AS page_no, count(*) OVER (PARTITION BY book_key) AS n_pages FROM made WHERE rn > 3)"""
_BARE = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_ZONE = f"""{_SEG}, placed AS (SELECT *, list_filter(list_transform(lines, lambda s, i: CASE WHEN {_BARE.format('s')} <> '' THEN i END), lambda i: i IS NOT NULL) AS ne FROM seg),
zoned AS (SELECT *, list_distinct(list_concat(ne[:3], ne[-3:])) AS zone FROM placed),
outer_lines AS (SELECT book_key, page_no, n_pages, unnest(list_distinct(list_transform(zone, lambda i: {_BARE.format('lines[i]')}))) AS line FROM zoned),
global_bad AS (SELECT book_key, line, count(*) AS n FROM outer_lines GROUP BY book_key, line, n_pages HAVING count(*) / n_pages >= 0.35 AND NOT regexp_full_match(line, '\\d{{1,5}}')),
in_windows AS (SELECT book_key, w.win AS "window", line, n_pages, page_no FROM outer_lines, (SELECT unnest(range(0, 1000000 // 15))::INT AS win) w WHERE w.win * 15 <= page_no AND page_no < w.win * 15 + 30 AND w.win * 15 < n_pages),
window_bad AS (SELECT book_key, "window", line, count(*) AS n FROM in_windows WHERE least(30, n_pages - "window" * 15) >= 5 GROUP BY book_key, "window", line, n_pages HAVING count(*) / least(30, n_pages - "window" * 15) >= 0.30 AND NOT regexp_full_match(line, '\\d{{1,5}}'))""".replace("range(0, 1000000 // 15)", "range(0, 400)")
_STRIPPED = f"""{_ZONE}, bad AS (SELECT book_key, list(DISTINCT line) AS bad FROM (SELECT book_key, line FROM global_bad UNION SELECT book_key, line FROM window_bad) GROUP BY book_key),
stripped AS (SELECT z.book_key, z.pdf_page, z.book_page, list_filter(z.lines, lambda s, i: NOT (list_contains(z.zone, i) AND list_contains(coalesce(b.bad, []), {_BARE.format('s')}))) AS lines FROM zoned z LEFT JOIN bad b ON b.book_key = z.book_key)"""
_FUNCTION = str(pages.FUNCTION_WORDS)
_HEADINGS = f"""{_STRIPPED}, each AS (SELECT book_key, pdf_page, lines, unnest(range(0, len(lines))) AS i FROM stripped),
edges AS (SELECT book_key, pdf_page, CAST(i AS INT) AS line_idx, {_BARE.format('lines[i + 1]')} AS s, i = 0 OR {_BARE.format('lines[i]')} = '' AS b, i = len(lines) - 1 OR {_BARE.format('lines[i + 2]')} = '' AS a FROM each),
candidates AS (SELECT *, list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '') AS words FROM edges WHERE s <> '' AND length(s) <= 79 AND NOT regexp_matches(s, '[.,;:?!]$') AND NOT regexp_full_match(s, '\\d+') AND (a OR b)),
weighed AS (SELECT *, list_filter(words, lambda w: lower(rtrim(w, '.,;:!?')) NOT IN {_FUNCTION}) AS content FROM candidates),
cased AS (SELECT *, len(list_filter(content, lambda w: regexp_matches(w, '^[\\p{{Lu}}\\p{{Lt}}]'))) AS capitals, regexp_matches(words[1], '^[\\p{{Lu}}\\p{{Lt}}]') AS starts FROM weighed)
SELECT book_key, pdf_page, line_idx, CAST(CASE WHEN regexp_full_match(lower(s), 'cycle\\s+\\d+\\s*') THEN 1
  WHEN (regexp_matches(s, '^[A-Z][A-Z0-9 \\-:,'']+$') OR (starts AND CASE WHEN len(content) < 2 THEN len(content) = 1 AND capitals = 1 ELSE capitals / len(content) >= 0.6 END)) AND length(s) >= 10 THEN 2 ELSE 3 END AS INT) AS level, s AS text FROM cased"""

# --- index lines made of parts -----------------------------------------------------------
INDEX_LINES = f"""
SELECT p_brand AS book_key, p_partkey * 4 + k.k AS line_no, CASE k.k
  WHEN 0 THEN upper(substr({tables.TERM}, 1, 1)) || substr({tables.TERM}, 2) || ', ' || CAST(p_size AS {{string}}) || ','
  WHEN 1 THEN CAST(p_size + 1 AS {{string}}) || '–' || CAST(p_size + 2 AS {{string}})
  WHEN 2 THEN '  in ' || p_name || ', ' || CAST(p_size AS {{string}}) || 'f'
  ELSE 'of ' || p_name || ', see also ' || p_type END AS raw
FROM part CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) k
"""


def _index_lines(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    return spark.sql(INDEX_LINES.format(**SPARK).replace("FROM part", "FROM {part}"), part=part)


def continuation_join(spark, sf_dir):
    return index.join_continuations(_index_lines(spark, sf_dir))


def index_parse(spark, sf_dir):
    return index.parse_index(_index_lines(spark, sf_dir)).select("book_key", "term", "term_ord", F.array_join("pages", "|").alias("pages"))


def index_start(spark, sf_dir):
    lines = _index_lines(spark, sf_dir).withColumn("raw", F.when(F.col("line_no") % 40 == 3, "Index").otherwise(F.col("raw")))
    return index.index_start(lines)


_LINES = f"WITH lines AS ({INDEX_LINES.format(**DUCK)})"
_JOINED = f"""{_LINES}, flagged AS (SELECT *, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS s FROM lines),
lagged AS (SELECT *, lag(s) OVER (PARTITION BY book_key ORDER BY line_no) AS before FROM flagged),
starts AS (SELECT *, before IS NULL OR NOT (regexp_full_match(s, '[\\d,\\s\\-–fbte./]+') OR (ends_with(before, ',') AND regexp_matches(s, '^\\p{{Ll}}'))) AS starts FROM lagged),
islands AS (SELECT *, sum(starts::INT) OVER (PARTITION BY book_key ORDER BY line_no) AS island FROM starts),
joined AS (SELECT book_key, min(line_no) AS line_no, CASE WHEN count(*) = 1 THEN min(raw) ELSE rtrim(arg_min(raw, line_no)) || ' ' || array_to_string((list(s ORDER BY line_no))[2:], ' ') END AS line FROM islands GROUP BY book_key, island)"""
_PAGE = "\\b(\\d{1,4}(?:[fbte])?(?:[–\\-]\\d{1,4}[fbte]?)?)\\b"
_NORM = "trim(regexp_replace(regexp_replace({}, ',?\\s*(See also|see also|See|see)\\b.*$', ''), '[\\s,;.:]+$', ''))"
_TERM_TEXT = _NORM.format(f"trim(regexp_replace(s, '{_PAGE}', '', 'g'), ' ,;:–-')")
_PARSED = f"""{_JOINED}, bare AS (SELECT *, trim(line) AS s, length(line) - length(ltrim(line)) AS indent FROM joined),
told AS (SELECT *, {_TERM_TEXT} AS text, regexp_extract_all(s, '{_PAGE}', 1) AS pages FROM bare),
mains AS (SELECT *, indent = 0 AND regexp_matches(s, '^[\\p{{Lu}}\\p{{Lt}}\\p{{Nd}}αβγδεζ(''"\\[]') AS main FROM told WHERE text <> ''),
parents AS (SELECT *, last_value(CASE WHEN main THEN text END IGNORE NULLS) OVER (PARTITION BY book_key ORDER BY line_no) AS parent FROM mains),
keyed AS (SELECT *, {_NORM.format("CASE WHEN main OR parent IS NULL THEN text ELSE parent || ' > ' || text END")} AS term FROM parents)
SELECT book_key, term, min(line_no) AS term_ord, array_to_string(flatten(list(pages ORDER BY line_no)), '|') AS pages FROM keyed WHERE length(term) > 1 GROUP BY book_key, term"""

# --- markdown made of parts --------------------------------------------------------------
# blocks of 40 parts: page mark, heading, body, page mark, references
BLOCK = "CAST(floor((rn - 1) / 40) AS INT)"
MARKDOWN = f"""
WITH numbered AS (SELECT p_brand AS book_key, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part),
heads AS (SELECT DISTINCT book_key, {BLOCK} AS b FROM numbered),
rows AS (
  SELECT book_key, b, 0 AS part, 0 AS rn, 0 AS sub, '<!-- p. ' || CAST(b * 10 + 1 AS {{string}}) || ' -->' AS line FROM heads
  UNION ALL SELECT book_key, b, 1, 0, 0, '## Title number ' || CAST(b AS {{string}}) FROM heads
  UNION ALL SELECT book_key, b, 2, 0, 0, 'Body text of the chapter.' FROM heads
  UNION ALL SELECT book_key, b, 3, 0, 0, '<!-- p. ' || CAST(b * 10 + 5 AS {{string}}) || ' -->' FROM heads
  UNION ALL SELECT book_key, b, 4, 0, 0, '## References' FROM heads
  UNION ALL SELECT book_key, {BLOCK}, 5, rn, 0, CASE p_partkey % 3 WHEN 0 THEN 'Small, R. (1999). ' || p_name || '. Journal 1, 12.' WHEN 1 THEN 'Small RI. 1999. ' || p_name || '.' ELSE 'Small RI: ' || p_name || '. Journal.' END FROM numbered
  UNION ALL SELECT book_key, {BLOCK}, 5, rn, 1, 'Journal 1:12.' FROM numbered WHERE p_partkey % 3 = 1)
SELECT book_key, CAST(row_number() OVER (PARTITION BY book_key ORDER BY b, part, rn, sub) - 1 AS INT) AS line_no, line, b, part, rn FROM rows
"""


def _made_markdown(spark, sf_dir):
    part = tables.table(spark, sf_dir, "part")
    return spark.sql(MARKDOWN.format(**SPARK).replace("FROM part)", "FROM {part})"), part=part).select("book_key", "line_no", "line")


_markdown = tables.kept("markdown", _made_markdown)
_chapters = tables.kept("chapters", lambda spark, sf_dir: C.detect(_markdown(spark, sf_dir)))
_references = tables.kept("references", lambda spark, sf_dir: C.references(_markdown(spark, sf_dir), _chapters(spark, sf_dir)))


def chapter_detect(spark, sf_dir):
    return C.detect(_markdown(spark, sf_dir))


def page_markers(spark, sf_dir):
    return C.page_markers(_markdown(spark, sf_dir))


def ref_parse(spark, sf_dir):
    return C.references(_markdown(spark, sf_dir), _chapters(spark, sf_dir))


_MD = f"WITH md AS ({MARKDOWN.format(**DUCK)})"
_CHAPTERS = f"""{_MD}, made AS (SELECT book_key, b, min(line_no) FILTER (part = 4) AS ref_start_line, max(line_no) + 1 AS ref_end_line FROM md GROUP BY book_key, b),
chapters AS (SELECT book_key, CAST(b + 1 AS INT) AS ch_ord, 'Title number ' || b AS title, CAST(b * 10 + 1 AS INT) AS start_page, CAST(b * 10 + 5 AS INT) AS end_page, ref_start_line, ref_end_line FROM made)"""
_REFS = f"""{_CHAPTERS}, named AS (SELECT p_brand AS book_key, p_name, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part),
refs AS (SELECT book_key, CAST({BLOCK} + 1 AS INT) AS ch_ord, 'Title number ' || {BLOCK} AS ch_title, CAST((rn - 1) % 40 + 1 AS INT) AS ref_ord,
  CASE p_partkey % 3 WHEN 0 THEN 'Small, R.' WHEN 1 THEN 'Small RI.' ELSE 'Small RI' END AS authors, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE '1999' END AS year, p_name AS title,
  CASE p_partkey % 3 WHEN 0 THEN 'Journal 1, 12.' WHEN 1 THEN 'Journal 1:12.' ELSE 'Journal.' END AS venue,
  CASE p_partkey % 3 WHEN 0 THEN 'Small, R. (1999). ' || p_name || '. Journal 1, 12.' WHEN 1 THEN 'Small RI. 1999. ' || p_name || '. Journal 1:12.' ELSE 'Small RI: ' || p_name || '. Journal.' END AS raw FROM named)"""


# --- linking ------------------------------------------------------------------------------
def _ranges(spark, sf_dir):
    """Five chapters of ten pages in every book; the third has no title."""
    keys = tables.index(spark, sf_dir).select("book_key").distinct()
    return keys.select("book_key", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ch_ord")).select("book_key", "ch_ord", F.when(F.col("ch_ord") == 2, "").otherwise(F.concat(F.lit("Chapter "), F.col("ch_ord").cast("string"))).alias("title"), (F.col("ch_ord") * 10 + 1).alias("start_page"), (F.col("ch_ord") * 10 + 10).alias("end_page"))


def link_chapters(spark, sf_dir):
    return C.link_chapters(tables.index(spark, sf_dir), _ranges(spark, sf_dir))


def link_references(spark, sf_dir):
    linked = C.link_chapters(tables.index(spark, sf_dir), _chapters(spark, sf_dir))
    return C.link_references(linked, _references(spark, sf_dir)).select("term", "book_key", "ch_title", "ref_ord", "raw")


_RANGES = "ranges AS (SELECT book_key, k AS ch_ord, CASE WHEN k = 2 THEN 'p. 21–30' ELSE 'Chapter ' || k END AS ch_title, k * 10 + 1 AS sp, k * 10 + 10 AS ep FROM (SELECT DISTINCT book_key FROM occ), (SELECT unnest([0, 1, 2, 3, 4]) AS k))"


# --- tables of contents -------------------------------------------------------------------
def _toc(spark, sf_dir):
    """An entry every seven pages from page 4."""
    keys = tables.index(spark, sf_dir).select("book_key").distinct()
    return keys.select("book_key", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("toc_ord")).select("book_key", "toc_ord", (F.col("toc_ord") % 2).alias("level"), F.concat(F.lit("Chapter "), F.col("toc_ord").cast("string"), F.lit(" of "), "book_key").alias("title"), (F.col("toc_ord") * 7 + 4).alias("start_page"))


def toc_asof_title(spark, sf_dir):
    return toc.asof_titles(_ranges(spark, sf_dir), _toc(spark, sf_dir))


def toc_top_level_ends(spark, sf_dir):
    top = toc.top_level(_toc(spark, sf_dir)).select("book_key", F.col("toc_ord").alias("ch_ord"), "title", "start_page")
    return toc.ends_before_next(top, F.lit(60))


def nearest_marker(spark, sf_dir):
    targets = _toc(spark, sf_dir).select("book_key", F.col("start_page").alias("page"))
    return toc.nearest_markers(targets, C.page_markers(_markdown(spark, sf_dir)))


_TOC = "toc AS (SELECT book_key, k AS toc_ord, k % 2 AS level, 'Chapter ' || k || ' of ' || book_key AS title, k * 7 + 4 AS start_page FROM (SELECT DISTINCT p_brand AS book_key FROM part), (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k))"

# --- argument maps ------------------------------------------------------------------------
CLAIM_LINES = """
SELECT CAST(conv_id AS {string}) AS file, CAST(turn AS INT) AS line_no, '↓ ' || CASE turn % 5 WHEN 0 THEN '? ' WHEN 1 THEN '~ ' WHEN 2 THEN '* ' WHEN 3 THEN '✓ ' ELSE '' END
  || 'c' || CAST(conv_id AS {string}) || '_' || CAST(turn AS {string}) || ' (' || CASE turn % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'E' WHEN 2 THEN 'R' ELSE '!' END || ') "'
  || replace(replace('x' || coalesce(text, ''), '"', ''), {nl}, ' ') || '" [A 2001; B 2002]' AS line FROM conversations
"""


def _claim_lines(spark, sf_dir):
    """Each turn as a claim line, with its whole text."""
    talk = tables.table(spark, sf_dir, "conversations")
    return spark.sql(CLAIM_LINES.format(**SPARK).replace("FROM conversations", "FROM {conversations}"), conversations=talk)


def amap_claims(spark, sf_dir):
    found = claims.parse_claims(_claim_lines(spark, sf_dir))
    return found.select("file", "claim_ord", "label", "status", "type", "text", F.array_join("citations", "|").alias("citations"))


def priority_claims(spark, sf_dir):
    return claims.priority_claims(claims.parse_claims(_claim_lines(spark, sf_dir))).select("file", "priority", "label", "status")


def html_elements(spark, sf_dir):
    return readers.html_elements(tables.table(spark, sf_dir, "pages"), ("page_id",))


def epub_markdown(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "pages").select(F.concat(F.lit("b"), (F.col("page_id") % 20).cast("string")).alias("book_key"), F.col("page_id").cast("int").alias("doc_seq"), F.concat(F.lit("c"), F.col("page_id").cast("string"), F.lit(".xhtml")).alias("name"), "html")
    made = readers.epub_markdown(readers.html_elements(docs, ("book_key", "doc_seq", "name")))
    return made.select("book_key", F.length("markdown").alias("n_chars"), F.md5("markdown").alias("md5"))


_CLAIM = "^↓\\s+([?~*✓]|\\*\\?)?\\s*(\\w+)\\s+\\(([TER!])\\)\\s+\"([^\"]+)\"(?:\\s+\\[([^\\]]*)\\])?"
_CLAIMS = f"""WITH lines AS ({CLAIM_LINES.format(**DUCK)}), claims AS (SELECT file, line_no AS claim_ord, regexp_extract(line, '{_CLAIM}', 2) AS label, regexp_extract(line, '{_CLAIM}', 1) AS status,
  regexp_extract(line, '{_CLAIM}', 3) AS type, regexp_extract(line, '{_CLAIM}', 4) AS text, array_to_string(list_filter(list_transform(string_split(regexp_extract(line, '{_CLAIM}', 5), ';'), lambda c: trim(c)), lambda c: c <> ''), '|') AS citations FROM lines WHERE regexp_matches(line, '{_CLAIM}'))"""

QUERIES = {
    "page_segment": page_segment,
    "page_map": page_map,
    "page_interpolation": page_interpolation,
    "header_freq_global": header_freq_global,
    "header_freq_window": header_freq_window,
    "strip_headers": strip_headers,
    "heading_detect": heading_detect,
    "markdown_render": markdown_render,
    "continuation_join": continuation_join,
    "index_parse": index_parse,
    "index_start": index_start,
    "page_markers": page_markers,
    "chapter_detect": chapter_detect,
    "ref_parse": ref_parse,
    "link_chapters": link_chapters,
    "link_references": link_references,
    "toc_asof_title": toc_asof_title,
    "toc_top_level_ends": toc_top_level_ends,
    "nearest_marker": nearest_marker,
    "amap_claims": amap_claims,
    "priority_claims": priority_claims,
    "html_elements": html_elements,
    "epub_markdown": epub_markdown,
}

ORACLES = {
    "page_segment": f"{_SEG} SELECT book_key, pdf_page, book_page, length(text) AS n_chars, md5(text) AS md5 FROM seg",
    "page_map": f"{_SEG} SELECT book_key, book_page, max(pdf_page) AS pdf_page FROM seg GROUP BY book_key, book_page",
    "page_interpolation": f"""{_SEG}, cut AS (SELECT book_key, pdf_page, page_no, CASE WHEN pdf_page % 3 <> 0 THEN book_page END AS p FROM seg),
known AS (SELECT *, last_value(p IGNORE NULLS) OVER w AS last_page, last_value(CASE WHEN p IS NOT NULL THEN page_no END IGNORE NULLS) OVER w AS last_at FROM cut WINDOW w AS (PARTITION BY book_key ORDER BY pdf_page))
SELECT book_key, pdf_page, CAST(coalesce(p, last_page + page_no - last_at) AS INT) AS book_page FROM known""",
    "header_freq_global": f"{_ZONE} SELECT book_key, line, n FROM global_bad",
    "header_freq_window": f'{_ZONE} SELECT book_key, "window", line, n FROM window_bad',
    "strip_headers": f"{_STRIPPED} SELECT book_key, pdf_page, length(array_to_string(lines, chr(10))) AS n_chars, md5(array_to_string(lines, chr(10))) AS md5 FROM stripped",
    "heading_detect": _HEADINGS,
    "continuation_join": f"{_JOINED} SELECT book_key, line_no, line FROM joined",
    "index_parse": _PARSED,
    "index_start": f"""WITH lines AS (SELECT book_key, line_no, CASE WHEN line_no % 40 = 3 THEN 'Index' ELSE raw END AS raw FROM ({INDEX_LINES.format(**DUCK)})),
numbered AS (SELECT book_key, trim(raw) AS s, row_number() OVER (PARTITION BY book_key ORDER BY line_no) - 1 AS pos, count(*) OVER (PARTITION BY book_key) AS total FROM lines),
entries AS (SELECT *, CASE WHEN regexp_matches(s, '^.{{2,60}},\\s*\\d{{1,4}}[fbte]?') THEN pos END AS entry FROM numbered),
ahead AS (SELECT *, min(entry) OVER (PARTITION BY book_key ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 29 FOLLOWING) AS nxt FROM entries),
late AS (SELECT * FROM ahead WHERE pos >= floor(total * 0.65))
SELECT book_key, CAST(coalesce(arg_min(nxt, pos) FILTER (s = 'Index' AND nxt IS NOT NULL), min(entry)) + 1 AS INT) AS start_line FROM late GROUP BY book_key HAVING start_line IS NOT NULL""",
    "markdown_render": f"""{_HEADINGS.replace("SELECT book_key, pdf_page, line_idx, CAST(CASE WHEN", ", headings AS (SELECT book_key, pdf_page, line_idx, CAST(CASE WHEN", 1)} FROM_CASED),
rendered AS (SELECT e.book_key, e.pdf_page, s.book_page, string_agg(CASE WHEN h.text IS NOT NULL THEN chr(10) || repeat('#', h.level) || ' ' || h.text || chr(10) ELSE regexp_replace(e.lines[e.i + 1], '^(#+)', '\\\\\\1') END, chr(10) ORDER BY e.i) AS body
  FROM each e JOIN stripped s ON e.book_key = s.book_key AND e.pdf_page = s.pdf_page LEFT JOIN headings h ON h.book_key = e.book_key AND h.pdf_page = e.pdf_page AND h.line_idx = e.i GROUP BY ALL),
parts AS (SELECT book_key, pdf_page, trim(regexp_replace('<!-- p. ' || book_page || ' -->' || chr(10) || body, '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS part FROM rendered),
whole AS (SELECT book_key, regexp_replace('---' || chr(10) || 'title: Title ' || book_key || chr(10) || 'author: A' || chr(10) || 'year: 2020' || chr(10) || 'source_pdf: b.epub' || chr(10) || '---' || chr(10) || chr(10) || string_agg(part, chr(10) || chr(10) ORDER BY pdf_page) || chr(10), '\n{{3,}}', chr(10) || chr(10), 'g') AS markdown FROM parts GROUP BY book_key)
SELECT book_key, length(markdown) AS n_chars, md5(markdown) AS md5 FROM whole""".replace(" FROM cased FROM_CASED)", " FROM cased)"),
    "page_markers": f"{_MD} SELECT book_key, regexp_extract(line, '^<!-- p\\. (\\d+) -->', 1) AS marker, min(line_no) AS line_idx FROM md WHERE part IN (0, 3) GROUP BY book_key, marker",
    "chapter_detect": f"{_CHAPTERS} SELECT * FROM chapters",
    "ref_parse": f"{_REFS} SELECT * FROM refs",
    "link_chapters": f"{tables.OCC_SQL}, {_RANGES} SELECT o.term, o.book_key, r.ch_title, min(r.ch_ord) AS ch_ord FROM (SELECT book_key, term, CAST(unnest(pages) AS INT) AS page FROM occ) o JOIN ranges r ON o.book_key = r.book_key AND o.page BETWEEN r.sp AND r.ep GROUP BY ALL",
    "link_references": f"""{_REFS}, {tables.OCC_SQL.strip().removeprefix('WITH ').replace('rows AS (SELECT p_brand', 'part_rows AS (SELECT p_brand').replace('FROM rows', 'FROM part_rows')},
linked AS (SELECT DISTINCT o.term, o.book_key, c.title AS ch_title, c.ch_ord FROM (SELECT book_key, term, CAST(unnest(pages) AS INT) AS page FROM occ) o JOIN chapters c ON o.book_key = c.book_key AND o.page BETWEEN c.start_page AND c.end_page)
SELECT l.term, l.book_key, l.ch_title, r.ref_ord, r.raw FROM linked l JOIN refs r ON l.book_key = r.book_key AND l.ch_title = r.ch_title QUALIFY row_number() OVER (PARTITION BY l.term, l.book_key, r.raw ORDER BY l.ch_ord, r.ref_ord) = 1""",
    "toc_asof_title": f"""WITH {_TOC}, chapters AS (SELECT book_key, k AS ch_ord, k * 10 + 1 AS start_page, k * 10 + 10 AS end_page FROM (SELECT DISTINCT p_brand AS book_key FROM part), (SELECT unnest([0, 1, 2, 3, 4]) AS k))
SELECT c.book_key, c.ch_ord, t.title, c.start_page, c.end_page FROM chapters c JOIN toc t ON c.book_key = t.book_key AND t.start_page <= c.end_page QUALIFY row_number() OVER (PARTITION BY c.book_key, c.ch_ord ORDER BY t.start_page >= c.start_page DESC, t.toc_ord DESC) = 1""",
    "toc_top_level_ends": f"WITH {_TOC} SELECT book_key, toc_ord AS ch_ord, title, start_page, coalesce(lead(start_page) OVER (PARTITION BY book_key ORDER BY start_page) - 1, 60) AS end_page FROM toc WHERE level = 0",
    "nearest_marker": f"""{_MD}, {_TOC}, marks AS (SELECT book_key, CAST(regexp_extract(line, '^<!-- p\\. (\\d+) -->', 1) AS INT) AS page, min(line_no) AS line_no FROM md WHERE part IN (0, 3) GROUP BY ALL)
SELECT t.book_key, t.start_page AS page, (SELECT arg_min(m.line_no, m.page) FROM marks m WHERE m.book_key = t.book_key AND m.page >= t.start_page) AS line_idx FROM toc t""",
    "amap_claims": f"{_CLAIMS} SELECT * FROM claims",
    "priority_claims": f"{_CLAIMS} SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY CASE status WHEN '?' THEN 0 ELSE 1 END, claim_ord) AS INT) AS priority, label, status FROM claims WHERE status IN ('?', '~')",
}
