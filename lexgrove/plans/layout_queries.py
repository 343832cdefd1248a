"""Publishers' page layouts through the hooks of two books, one query for each layout, with reference SQL.

Pages are made of parts: a part is a page of its brand's book, with a text by its place.
The reference SQL states what each made page must come to.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F

from ..operators import pages
from ..operators.chapters import page_markers
from ..operators.hooks import Hooks
from ..operators.layouts import install
from . import tables

#: The last one has no contents; the first has as many entries as chapters.
HOOKED = ("Brand#11", "Brand#12", "Brand#13")
SPARK, DUCK = {"string": "STRING", "nl": "'\\n'"}, {"string": "VARCHAR", "nl": "chr(10)"}
#: A part's place in its book, the number that its page prints, and a line that no other page has.
MADE = """SELECT p_brand AS book_key, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INT) AS rn, p_partkey AS k, p_name AS name,
  CAST(60 + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) % 400 AS {string}) AS p, p_name || '-' || CAST(p_partkey AS {string}) AS body FROM part"""
NOTES = "'Plain text of the page that goes on.' || {nl} || {nl} || 'Good Heading Here' || {nl} || {nl} || '"

#: A book's markdown: six lines for each part, of a kind that its key scatters.
EACH = 6
_SCATTER = "(k * 7919 + {j} * 104729) % 997"
LINE = f"""CASE ({_SCATTER}) % 22 WHEN 0 THEN 'C H A P T E R' WHEN 1 THEN '  C H A P T E R ' WHEN 2 THEN '## C H A P T E R ' || CAST(rn AS {{string}})
  WHEN 3 THEN '<!-- p. ' || CAST(rn AS {{string}}) || ' -->' WHEN 4 THEN '<!-- p. ' || CAST(rn AS {{string}}) || ' -->' WHEN 5 THEN '<!-- p. ' || CAST(rn + 2 AS {{string}}) || ' -->' WHEN 6 THEN '<!-- p. ' || CAST({_SCATTER} % 12 AS {{string}}) || ' -->'
  WHEN 7 THEN '## References' WHEN 8 THEN '## References  ' WHEN 9 THEN '## Suggested Reading' WHEN 10 THEN '## Selected Reading' WHEN 11 THEN '## Other' WHEN 12 THEN '### ' || name WHEN 13 THEN ' ### ' || name
  WHEN 14 THEN '### ab' WHEN 15 THEN '### chapter  ' || CAST({_SCATTER} % 9 AS {{string}}) WHEN 16 THEN '# Cycle ' || CAST({_SCATTER} % 30 AS {{string}}) WHEN 17 THEN '' WHEN 18 THEN '   ' WHEN 19 THEN CAST({_SCATTER} % 40 AS {{string}})
  WHEN 20 THEN CAST({_SCATTER} % 30 AS {{string}}) || '. Small R, Ring S (1999) ' || name || '. Journal 4.' ELSE name END"""
CONTENTS = """SELECT book_key, rn AS toc_ord, CAST(k % 2 AS INT) AS level, CASE k % 5 WHEN 0 THEN 'Chapter ' || CAST(rn AS {string}) || ': ' || name WHEN 1 THEN 'chapter ' || CAST(rn AS {string}) WHEN 2 THEN CAST(k % 9 AS {string}) || '  ' || name
  WHEN 3 THEN 'Bibliography' ELSE name END AS title, rn AS start_page FROM made WHERE book_key <> 'Brand#13' AND rn % CASE WHEN book_key = 'Brand#11' THEN 7 ELSE 3 END = 0"""
CHAPTERS = """SELECT book_key, rn AS ch_ord, CASE rn % 3 WHEN 0 THEN '' WHEN 1 THEN name ELSE substr(name, 1, 4) END AS title, CASE WHEN rn % 5 <> 0 THEN rn - 6 END AS start_page, CASE WHEN rn % 4 <> 0 THEN rn END AS end_page,
  CASE WHEN rn % 6 <> 0 THEN rn * 6 - 3 END AS ref_start_line, CASE WHEN rn % 9 <> 0 THEN rn * 6 END AS ref_end_line FROM made WHERE rn % 7 = 0"""
#: An index term that may be a running head.
TERM_OF_INDEX = "name || CASE k % 4 WHEN 0 THEN ' © Springer' WHEN 1 THEN ' Small et al' WHEN 2 THEN ' Other et al' ELSE '' END"


@dataclass
class Layout:
    """A layout's made inputs and what they must come to, as portable SQL on rn, p and body (and n, the book's pages)."""

    name: str
    text: str  # a page's text
    page: str  # its number, as text or null, in a hooked book
    keep: str = "true"  # whether a hooked book keeps the page
    strip: str | None = None  # its text behind post_strip, where the layout has one
    notice: str | None = None  # a heading that post_annotate drops
    found: str = ""  # the hooked books' chapters in DuckDB's SQL, from lines, marks, contents, chapters and totals
    options: dict = field(default_factory=dict)
    base: str = "CAST(null AS INT)"  # the number that segmentation found


def _asof(contents: str, title: str, otherwise: str) -> str:
    best = f"(SELECT arg_max({title}, toc_ord) FROM {contents} t WHERE t.book_key = c.book_key AND t.start_page"
    return f"""SELECT * FROM (SELECT c.book_key, c.ch_ord, CASE WHEN c.start_page IS NULL OR NOT EXISTS (SELECT 1 FROM contents t WHERE t.book_key = c.book_key) THEN c.title
  ELSE coalesce({best} BETWEEN c.start_page AND coalesce(c.end_page, 999999)), {best} <= c.start_page), {otherwise}) END AS title, c.start_page, c.end_page, c.ref_start_line, c.ref_end_line FROM chapters c) WHERE title IS NOT NULL"""


_BARE = r"regexp_replace(title, '^\d+\s+(.+)', '\1')"
#: Kept as they are: books of which the rule finds nothing.
_ELSE = "UNION ALL SELECT * FROM chapters c WHERE NOT EXISTS (SELECT 1 FROM {0} o WHERE o.book_key = c.book_key)"

LAYOUTS = [
    Layout(
        "numbered_chapters",
        text="""CASE rn % 7 WHEN 0 THEN p || {nl} || body WHEN 1 THEN CAST(rn % 40 + 1 AS {string}) || {nl} || 'A. Smith et al.' || {nl} || body WHEN 2 THEN '7' || {nl} || p || {nl} || body
  WHEN 3 THEN '9' || {nl} || 'lower ' || body WHEN 4 THEN 'Title of ' || body || {nl} || p WHEN 5 THEN '8' || {nl} || 'Upper Case Line' || {nl} || p || {nl} || body ELSE 'Nothing' || {nl} || body END""",
        page="INTERPOLATED CASE rn % 7 WHEN 1 THEN rn % 40 + 1 WHEN 3 THEN 9 WHEN 6 THEN null ELSE CAST(p AS INT) END",
        found=_asof("contents", _BARE, "null"),
        options={"noise": ("© Springer", "DOI", "Small et al")},
    ),
    Layout(
        "author_initials",
        text="CASE WHEN rn = 3 THEN 'Chapter 1' || {nl} || body WHEN rn % 3 = 1 THEN p || {nl} || 'A.B. Smith' || {nl} || body WHEN rn % 3 = 2 THEN '5' || {nl} || body || {nl} || p ELSE 'Text of ' || body END",
        page="CASE WHEN rn % 3 = 0 THEN CAST(rn AS {string}) ELSE p END",
        keep="rn >= 3 OR n < 3",
        strip="CASE WHEN rn = 3 THEN 'Chapter 1' || {nl} || body WHEN rn % 3 = 0 THEN 'Text of ' || body ELSE body END",
        base="rn",
        found=r"""WITH heads AS (SELECT book_key, line_no, TRY_CAST(regexp_extract(line, '(?i)^### Chapter\s+(\d+)', 1) AS INT) AS n FROM lines WHERE regexp_matches(line, '(?i)^### Chapter\s+\d')),
named AS (SELECT book_key, toc_ord, TRY_CAST(regexp_extract(title, '^(\d+)\s', 1) AS INT) AS n, trim(regexp_extract(title, '^\d+\s+(.+)', 1)) AS title FROM contents WHERE regexp_matches(title, '^\d+\s+.')),
told AS (SELECT c.*, (SELECT arg_max(n, line_no) FROM heads h WHERE h.book_key = c.book_key AND h.line_no < c.ref_start_line AND h.line_no > greatest(0, c.ref_start_line - 2000)) AS n FROM chapters c)
SELECT book_key, ch_ord, coalesce((SELECT arg_max(m.title, m.toc_ord) FROM named m WHERE m.book_key = t.book_key AND m.n = t.n), title) AS title, start_page, end_page, ref_start_line, ref_end_line FROM told t""",
    ),
    Layout(
        "bars",
        text="CASE WHEN rn < 3 THEN 'Front ' || body WHEN rn % 2 = 0 THEN p || ' | Head of ' || body || {nl} || body ELSE 'Part of ' || body || ' | ' || p || {nl} || body END",
        page="CASE WHEN rn < 3 THEN null ELSE p END",
        keep="rn >= 3 OR n < 3",
        strip="CASE WHEN rn < 3 THEN 'Front ' || body ELSE body END",
        notice="FIGURE 3 Something",
        found=r"""WITH starts AS (SELECT o.*, coalesce((SELECT arg_min(n.start_page, n.toc_ord) FROM contents n WHERE n.book_key = o.book_key AND n.level = 0 AND n.toc_ord > o.toc_ord AND regexp_matches(n.title, '(?i)^Chapter\s+\d+')),
    (SELECT arg_min(n.start_page, n.toc_ord) FROM contents n WHERE n.book_key = o.book_key AND n.level = 0 AND n.toc_ord > o.toc_ord), t.total) AS following, t.total FROM contents o JOIN totals t ON o.book_key = t.book_key WHERE o.level = 0 AND regexp_matches(o.title, '(?i)^Chapter\s+\d+')),
spans AS (SELECT s.*, coalesce((SELECT arg_min(m.line_no, m.page) FROM firsts m WHERE m.book_key = s.book_key AND m.page >= s.start_page), 0) AS a, coalesce((SELECT arg_min(m.line_no, m.page) FROM firsts m WHERE m.book_key = s.book_key AND m.page >= s.following), s.total) AS b FROM starts s)
SELECT book_key, row_number() OVER (PARTITION BY book_key ORDER BY toc_ord) AS ch_ord, trim(regexp_replace(title, '(?i)^Chapter\s+\d+:\s+', '')) AS title, start_page, following - 1 AS end_page,
  (SELECT min(line_no) FROM lines l WHERE l.book_key = s.book_key AND starts_with(l.line, '## Suggested Reading') AND l.line_no >= s.a AND l.line_no < s.b) AS ref_start_line, b AS ref_end_line FROM spans s
""" + _ELSE.format("contents"),
    ),
    Layout(
        "wide_spaces",
        text="CASE WHEN rn < 2 THEN 'Front ' || body WHEN rn % 2 = 0 THEN p || ' Head of ' || body || {nl} || body ELSE 'Part of ' || body || ' ' || p || {nl} || body END",
        page="CASE WHEN rn < 2 THEN null ELSE p END",
        keep="rn >= 2 OR n < 2",
        strip="CASE WHEN rn < 2 THEN 'Front ' || body ELSE body END",
        found=r"""SELECT book_key, ch_ord, title, start_page, end_page, CASE WHEN (SELECT arg_max(starts_with(l.line, '## Selected Reading'), l.line_no) FROM lines l WHERE l.book_key = c.book_key AND starts_with(l.line, '## ') AND l.line_no BETWEEN greatest(1, c.ref_start_line - 119) AND c.ref_start_line - 1)
  THEN (SELECT max(l.line_no) FROM lines l WHERE l.book_key = c.book_key AND starts_with(l.line, '## ') AND l.line_no < c.ref_start_line) ELSE ref_start_line END AS ref_start_line, ref_end_line FROM chapters c""",
    ),
    Layout(
        "author_lists",
        text="CASE WHEN rn = 2 THEN '© 2014 Wiley' || {nl} || body WHEN rn % 3 = 0 THEN p || {nl} || 'Title' || body WHEN rn % 3 = 1 THEN '9' || {nl} || 'John Smith, Ann Lee, and Bo' || {nl} || body ELSE 'Title ' || body || {nl} || p END",
        page="CASE WHEN rn = 2 THEN null WHEN rn % 3 = 1 THEN '9' ELSE p END",
        keep="rn > 2 OR n <= 2",
        strip="CASE WHEN rn = 2 THEN '© 2014 Wiley' || {nl} || body WHEN rn % 3 = 0 THEN 'Title' || body WHEN rn % 3 = 1 THEN body ELSE 'Title ' || body END",
        notice="John Smith, Ann Lee, and Bo",
        found=f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY book_key ORDER BY ch_ord) AS i, count(*) OVER (PARTITION BY book_key) AS n FROM chapters),
t AS (SELECT book_key, toc_ord, {_BARE} AS entry, row_number() OVER (PARTITION BY book_key ORDER BY toc_ord) AS i, count(*) OVER (PARTITION BY book_key) AS n FROM contents)
SELECT book_key, ch_ord, coalesce((SELECT arg_min(entry, toc_ord) FROM t WHERE t.book_key = c.book_key AND CASE WHEN t.n = c.n THEN t.i = c.i ELSE c.title <> '' AND contains(t.entry, substr(c.title, 1, 25)) END), title) AS title, start_page, end_page, ref_start_line, ref_end_line FROM c""",
    ),
    Layout(
        "inline_numbers",
        text="CASE WHEN rn = 2 THEN 'DOI: 10.1/x' || {nl} || body ELSE 'Head of ' || body || {nl} || body || ' (p. ' || p || ') more' END",
        page="CASE WHEN rn = 2 THEN null ELSE p END",
        keep="rn > 2 OR n <= 2",
        strip="CASE WHEN rn = 2 THEN body ELSE body || ' (p. ' || p || ') more' END",
        notice="Page 3 of 9",
        found=_asof("(SELECT * FROM contents WHERE title <> 'Bibliography')", "title", "c.title"),
    ),
    Layout(
        "outline_openers",
        text="CASE WHEN rn % 5 = 2 THEN 'C H A P T E R' || {nl} || body || {nl} || 'O U T L I N E' || {nl} || 'Part of ' || body ELSE 'Text of ' || body END",
        page="null",
        keep="rn >= 2 OR n < 2",
        strip="CASE WHEN rn % 5 = 2 THEN 'C H A P T E R' || {nl} || body ELSE 'Text of ' || body END",
        found=r"""WITH o AS (SELECT l.book_key, l.line_no, coalesce((SELECT arg_min(substr(trim(h.line), 5), h.line_no) FROM lines h WHERE h.book_key = l.book_key AND h.line_no BETWEEN l.line_no + 1 AND l.line_no + 14 AND regexp_matches(trim(h.line), '^### .{3,}')), '') AS title,
    (SELECT arg_min(m.page, m.line_no) FROM marks m WHERE m.book_key = l.book_key AND m.line_no BETWEEN l.line_no + 1 AND l.line_no + 19) AS page FROM lines l WHERE starts_with(l.line, '## C H A P T E R')),
e AS (SELECT *, row_number() OVER w AS i, lead(page) OVER w AS following, count(*) OVER (PARTITION BY book_key) AS n FROM o WHERE page IS NOT NULL WINDOW w AS (PARTITION BY book_key ORDER BY line_no)),
r AS (SELECT book_key, min(line_no) AS list FROM lines WHERE regexp_matches(line, '^## References\s*$') GROUP BY book_key)
SELECT e.book_key, i AS ch_ord, title, page AS start_page, CASE WHEN following <> 0 THEN following - 1 END AS end_page, CASE WHEN i = n THEN r.list END AS ref_start_line,
  CASE WHEN i = n THEN t.total WHEN following = 0 THEN coalesce(nullif(r.list, 0), t.total) ELSE coalesce((SELECT m.line_no FROM firsts m WHERE m.book_key = e.book_key AND m.page = e.following), t.total) END AS ref_end_line
FROM e JOIN totals t ON e.book_key = t.book_key LEFT JOIN r ON e.book_key = r.book_key""",
    ),
    Layout(
        "spaced_openers",
        text="CASE WHEN rn % 5 = 2 THEN 'C H A P T E R' || {nl} || body || {nl} || 'O U T L I N E' || {nl} || 'Part of ' || body ELSE 'Text of ' || body END",
        page="null",
        keep="rn >= 2 OR n < 2",
        strip="CASE WHEN rn % 5 = 2 THEN 'C H A P T E R' || {nl} || body ELSE 'Text of ' || body END",
        notice="A University Of Somewhere, Belgium",
        found=r"""WITH solid AS (SELECT book_key, line_no, trim(line) AS s, row_number() OVER (PARTITION BY book_key ORDER BY line_no) AS i FROM lines WHERE trim(line) <> ''),
o AS (SELECT *, coalesce(lead(line_no) OVER (PARTITION BY book_key ORDER BY line_no), (SELECT total FROM totals t WHERE t.book_key = solid.book_key)) AS until FROM solid WHERE s = 'C H A P T E R')
SELECT book_key, row_number() OVER (PARTITION BY book_key ORDER BY line_no) AS ch_ord, coalesce((SELECT s FROM solid x WHERE x.book_key = o.book_key AND x.i = o.i + 2), '') AS title,
  (SELECT min(page) FROM marks m WHERE m.book_key = o.book_key AND m.page > 10 AND m.line_no >= o.line_no AND m.line_no < o.until) AS start_page, (SELECT max(page) FROM marks m WHERE m.book_key = o.book_key AND m.page > 10 AND m.line_no >= o.line_no AND m.line_no < o.until) AS end_page,
  (SELECT min(r.line_no) FROM lines r WHERE r.book_key = o.book_key AND regexp_matches(r.line, '^## References\s*$') AND r.line_no > o.line_no AND r.line_no < o.until) AS ref_start_line, until AS ref_end_line FROM o
""" + _ELSE.format("o"),
    ),
    Layout(
        "cycles",
        text="CASE WHEN rn = 3 THEN ' Cycle 1' || {nl} || body ELSE 'Text of ' || body END",
        page="null",
        keep="rn >= 3 OR n < 3",
        found=r"""WITH seen AS (SELECT l.*, (SELECT arg_max(m.page, m.line_no) FROM marks m WHERE m.book_key = l.book_key AND m.line_no <= l.line_no) AS page FROM lines l WHERE regexp_matches(line, '(?i)^# cycle\s+\d+')),
o AS (SELECT *, row_number() OVER (PARTITION BY book_key ORDER BY line_no) AS i FROM seen WHERE page IS NOT NULL)
SELECT book_key, i AS ch_ord, regexp_extract(line, '(?i)^# (cycle\s+\d+)', 1) AS title, page AS start_page, coalesce((SELECT page FROM o n WHERE n.book_key = o.book_key AND n.i = o.i + 1), 40) - 1 AS end_page, null AS ref_start_line, null AS ref_end_line FROM o
UNION ALL SELECT m.book_key, (SELECT max(i) + 1 FROM o WHERE o.book_key = m.book_key), 'Bibliography', 40, null, min(m.line_no), any_value(t.total) FROM marks m JOIN totals t ON m.book_key = t.book_key WHERE m.page >= 40 AND m.book_key IN (SELECT book_key FROM o) GROUP BY m.book_key
""" + _ELSE.format("o"),
        options={"bibliography": 40},
    ),
]


def _tables(spark, sf_dir):
    """(made pages, lines, contents, chapters) of all books."""
    part = tables.table(spark, sf_dir, "part")
    made = spark.sql(MADE.format(**SPARK).replace("FROM part", "FROM {part}"), part=part)
    # the rule stands in the plan once and not for each line of a part, so that its code stays small enough to be compiled
    each = made.select("book_key", "rn", "k", "name", F.explode(F.array(*[F.lit(j) for j in range(EACH)])).alias("j"))
    lines = each.select("book_key", (F.col("rn") * EACH - EACH + F.col("j")).alias("line_no"), F.expr(LINE.format(j="j", **SPARK)).alias("line"))
    of = lambda sql: spark.sql(sql.format(**SPARK).replace("FROM made", "FROM {made}"), made=made)
    return made, lines, of(CONTENTS), of(CHAPTERS)


def _shown(chapters):
    """A chapter as text."""
    return F.concat_ws("|", "title", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("start_page", "end_page", "ref_start_line", "ref_end_line")])


def _query(layout: Layout):
    name = layout.name.replace("_", " ")

    def query(spark, sf_dir):
        made, lines, contents, chapters = _tables(spark, sf_dir)
        row = lambda sql: F.expr(sql.format(**SPARK))
        segments = made.select("book_key", (F.col("rn") - 1).alias("pdf_page"), row(layout.base).cast("int").alias("book_page"), row(layout.text).alias("text"))
        registry = made.select("book_key").distinct()
        hooks = install(Hooks(), HOOKED, name, contents=contents, **layout.options)

        cut = hooks.apply("post_segment", segments, registry=registry)
        out = cut.select(F.lit("segment").alias("stage"), "book_key", F.col("pdf_page").alias("place"), F.concat(F.coalesce(F.col("book_page").cast("string"), F.lit("-")), F.lit("|"), F.md5("text")).alias("value"))
        if layout.strip is not None:
            bare = hooks.apply("post_strip", segments, registry=registry)
            out = out.union(bare.select(F.lit("strip"), "book_key", "pdf_page", F.md5("text")))
        if layout.notice is not None:
            noted = pages.annotate(segments.withColumn("text", row(NOTES + layout.notice.replace("{", "{{") + "'")))
            headed = hooks.apply("post_annotate", noted, registry=registry)
            out = out.union(headed.select(F.lit("annotate"), "book_key", "pdf_page", F.array_join(F.transform("headings", lambda h: h["text"]), "; ")))
        found = hooks.apply("post_chapter_detect", chapters, lines=lines, markers=page_markers(lines))
        return out.union(found.select(F.lit("chapters"), "book_key", "ch_ord", _shown(found)))

    return query


_DERIVED = f"""each AS (SELECT *, unnest(range({EACH})) AS j FROM made),
lines AS (SELECT book_key, CAST(rn * {EACH} - {EACH} + j AS INT) AS line_no, {LINE.format(j="j", **DUCK)} AS line FROM each),
marks AS (SELECT book_key, line_no, CAST(regexp_extract(line, '^<!-- p\\. (\\d+) -->', 1) AS INT) AS page FROM lines WHERE starts_with(line, '<!-- p. ')),
firsts AS (SELECT book_key, page, min(line_no) AS line_no FROM marks GROUP BY ALL), totals AS (SELECT book_key, max(line_no) + 1 AS total FROM lines GROUP BY ALL),
contents AS ({CONTENTS.format(**DUCK)}), chapters AS ({CHAPTERS.format(**DUCK)})"""


def _oracle(layout: Layout) -> str:
    sql = lambda x: x.format(**DUCK)
    hooked = f"book_key IN {HOOKED}"
    if layout.page.startswith("INTERPOLATED "):
        known = sql(layout.page.removeprefix("INTERPOLATED "))
        page = "CAST(coalesce(k, last_value(k IGNORE NULLS) OVER w + rn - last_value(CASE WHEN k IS NOT NULL THEN rn END IGNORE NULLS) OVER w) AS VARCHAR)"
    else:
        known, page = "null", sql(layout.page)
    base = f"CAST({sql(layout.base)} AS VARCHAR)"
    shown = "title || '|' || " + " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in ("start_page", "end_page", "ref_start_line", "ref_end_line"))
    out = f"""WITH made AS ({sql(MADE)}), t AS (SELECT * EXCLUDE (k), count(*) OVER (PARTITION BY book_key) AS n, {sql(layout.text)} AS text, {known} AS k FROM made),
told AS (SELECT *, {page} AS own FROM t WINDOW w AS (PARTITION BY book_key ORDER BY rn)), {_DERIVED}, found AS ({layout.found})
SELECT 'segment' AS stage, book_key, rn - 1 AS place, coalesce(CASE WHEN {hooked} THEN own ELSE {base} END, '-') || '|' || md5(text) AS value FROM told WHERE NOT ({hooked}) OR {layout.keep}"""
    if layout.strip is not None:
        out += f"\nUNION ALL SELECT 'strip', book_key, rn - 1, md5(CASE WHEN {hooked} THEN {sql(layout.strip)} ELSE text END) FROM told"
    if layout.notice is not None:
        out += f"\nUNION ALL SELECT 'annotate', book_key, rn - 1, 'Good Heading Here' || CASE WHEN {hooked} THEN '' ELSE '; {layout.notice}' END FROM told"
    return out + f"""
UNION ALL SELECT 'chapters', book_key, CAST(ch_ord AS INT), {shown} FROM found WHERE {hooked}
UNION ALL SELECT 'chapters', book_key, ch_ord, {shown} FROM chapters WHERE NOT ({hooked})"""


# --- the hooks behind the chapters ----------------------------------------------------------
NUMBERED = next(x for x in LAYOUTS if x.name == "numbered_chapters")


def hook_references(spark, sf_dir):
    """A book's own reading of numbered references in place of the given ones."""
    _, lines, contents, chapters = _tables(spark, sf_dir)
    hooks = install(Hooks(), HOOKED, "numbered chapters", contents=contents)
    raw = F.concat(F.lit("Given ("), F.col("ch_ord").cast("string"), F.lit(")"))
    given = chapters.select("book_key", "ch_ord", F.col("title").alias("ch_title"), F.lit(1).alias("ref_ord"), F.lit("Given").alias("authors"), F.lit("").alias("year"), F.lit("").alias("title"), F.lit("").alias("venue"), raw.alias("raw"))
    return hooks.apply("post_ref_parse", given, lines=lines, chapters=chapters).select("book_key", "ch_ord", "ch_title", "ref_ord", "year", "raw")


def hook_index_terms(spark, sf_dir):
    """Index terms without those that are a hooked book's running heads."""
    made, _, _, _ = _tables(spark, sf_dir)
    rows = made.select("book_key", F.expr(TERM_OF_INDEX).alias("term"), F.col("rn").alias("term_ord"))
    return install(Hooks(), HOOKED, "numbered chapters", **NUMBERED.options).apply("post_index_parse", rows)


#: Volumes of a brand, each a book with a hook of its own.
VOLUMES = 40


def hooks_of_many_books(spark, sf_dir):
    """A thousand books' page maps through two functions: one moves marks by a line, one drops even pages."""
    made, lines, _, _ = _tables(spark, sf_dir)
    volume = F.concat("book_key", F.lit("-"), (F.col("line_no") % VOLUMES).cast("string"))
    marks = page_markers(lines.withColumn("book_key", volume))
    moved = lambda df, **_: df.withColumn("line_idx", F.col("line_idx") + 1)
    odd = lambda df, **_: df.where("try_cast(marker AS INT) % 2 = 1")
    hooks = Hooks()
    for brand in range(55):
        for n in range(VOLUMES):
            if n % 3:
                hooks.register(f"Brand#{brand + 1}-{n}", "post_page_map", moved if n % 3 == 1 else odd)
    return hooks.apply("post_page_map", marks)


QUERIES = {f"layout_{x.name}": _query(x) for x in LAYOUTS} | {"hook_references": hook_references, "hook_index_terms": hook_index_terms, "hooks_of_many_books": hooks_of_many_books}
_MADE = f"WITH made AS ({MADE.format(**DUCK)}), {_DERIVED}"
ORACLES = {f"layout_{x.name}": _oracle(x) for x in LAYOUTS} | {
    "hook_references": f"""{_MADE}, known AS (SELECT c.book_key, ch_ord, title, coalesce(ref_start_line, 0) AS a, coalesce(ref_end_line, total) AS b FROM chapters c JOIN totals t ON c.book_key = t.book_key QUALIFY row_number() OVER (PARTITION BY c.book_key, title ORDER BY ch_ord DESC) = 1),
inside AS (SELECT l.book_key, ch_ord, title, line_no, line FROM lines l JOIN known c ON l.book_key = c.book_key AND line_no >= a AND line_no < b WHERE NOT regexp_matches(line, '^(<!-- |#|\\d{{1,4}}$)') AND trim(line) <> ''),
pieces AS (SELECT *, count(*) FILTER (regexp_matches(line, '^\\d+\\. ')) OVER (PARTITION BY book_key, ch_ord ORDER BY line_no) AS piece FROM inside),
entries AS (SELECT book_key, ch_ord, title, piece, regexp_replace(trim(string_agg(line, ' ' ORDER BY line_no)), '^\\d+\\.\\s+', '') AS raw FROM pieces GROUP BY ALL)
SELECT book_key, ch_ord, title AS ch_title, CAST(row_number() OVER (PARTITION BY book_key, ch_ord ORDER BY piece) AS INT) AS ref_ord, '1999' AS year, raw FROM entries WHERE length(raw) >= 15 AND contains(raw, '(1999)') AND book_key IN {HOOKED}
UNION ALL SELECT book_key, ch_ord, title, 1, '', 'Given (' || ch_ord || ')' FROM chapters WHERE book_key NOT IN {HOOKED}""",
    "hook_index_terms": f"""{_MADE}, terms AS (SELECT book_key, {TERM_OF_INDEX} AS term, rn AS term_ord FROM made)
SELECT * FROM terms WHERE book_key NOT IN {HOOKED} OR NOT (contains(term, '© Springer') OR contains(term, 'DOI') OR contains(term, 'Small et al'))""",
    "hooks_of_many_books": f"""{_MADE}, first AS (SELECT book_key || '-' || line_no % {VOLUMES} AS book_key, line_no % {VOLUMES} % 3 AS f, CAST(page AS VARCHAR) AS marker, min(line_no) AS line_no FROM marks GROUP BY ALL)
SELECT book_key, marker, CASE f WHEN 1 THEN line_no + 1 ELSE line_no END AS line_idx FROM first WHERE f <> 2 OR CAST(marker AS INT) % 2 = 1""",
}
