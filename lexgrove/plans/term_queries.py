"""Queries on terms: lookups, near-duplicate pairs, claims and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims, fuzzy, lookup
from ..operators.engine import Engine
from . import build, tables

ASKED, QUERY = "small ring", "ring small economy"


_lookup = tables.kept("lookup", lambda spark, sf_dir: lookup.build_lookup(tables.index(spark, sf_dir), fill=False))
_books = tables.kept("books", tables.books)
_pairs = tables.kept("pairs", lambda spark, sf_dir: fuzzy.all_pairs(_terms(spark, sf_dir)))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lookup(spark, sf_dir).select("ord", "term", "n_books").distinct()


def _write(name: str):
    def write(spark: SparkSession, sf_dir: str, folder: str) -> None:
        none = spark.createDataFrame([], "term1 string, term2 string, match_type string, score double")
        pairs = _pairs(spark, sf_dir) if name == "edges" else none
        build.store_laid(name, lookup.relations(_lookup(spark, sf_dir), pairs, none), folder)

    return tables.written(f"relation-{name}", write)


_folders = {name: _write(name) for name in build.LAID}


def _engine(spark: SparkSession, sf_dir: str, *needed: str) -> Engine:
    """The engine over stored relations; only the needed ones, if any are named, are stored."""
    held = {name: build.laid(spark, _folders[name](spark, sf_dir), name) for name in needed or build.LAID}
    return build.over(_books(spark, sf_dir), held, build.PARTS)


def _flat(hits: DataFrame, *more: str) -> DataFrame:
    """Hits with books and pages as text."""
    pages = F.array_join(F.transform(F.array_sort(F.map_entries("pages")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return hits.select(*[c for c in ("section", "term", "found") if c in hits.columns], "n_books", F.array_join(F.array_sort("books"), ",").alias("books"), pages.alias("pages"), *more)


HYDRATED = "hits AS (SELECT term, string_agg(book_key, ',' ORDER BY book_key) AS books, string_agg(book_key || '=' || array_to_string(pages, ','), ';' ORDER BY book_key) AS pages FROM occ GROUP BY term)"
# the three cheap strategies, first one wins
NORM = "trim(lower(term), ' ,;:()')"
TOKENS = f"list_distinct(list_filter(regexp_split_to_array(lower(term), '[\\s\\-/,;:()\\[\\]]+'), lambda t: length(t) > 2 AND t NOT IN {T.STOP_WORDS}))"
PAIRS_SQL = (
    tables.OCC_SQL
    + f""", keyed AS (SELECT ord, term, {NORM} AS norm, CASE WHEN len({TOKENS}) > 0 THEN {TOKENS} ELSE [substr({NORM}, 1, 4)] END AS tokens FROM terms),
abbreviation AS (SELECT b.ord AS ord1, h.ord AS ord2, b.term AS term1, h.term AS term2, 'abbreviation' AS match_type, 1.0::DOUBLE AS score
  FROM terms b JOIN (SELECT ord, term, unnest(list_distinct(regexp_extract_all(term, '\\(([A-Z][A-Z0-9\\-]{{1,7}})\\)', 1))) AS k FROM terms) h ON b.term = h.k AND h.term <> b.term WHERE regexp_matches(b.term, '^[A-Z][A-Z0-9\\-]{{1,6}}$')),
case_pairs AS (SELECT a.ord AS ord1, b.ord AS ord2, a.term AS term1, b.term AS term2, 'case' AS match_type, 1.0::DOUBLE AS score FROM keyed a JOIN keyed b ON a.norm = b.norm AND a.ord < b.ord),
blocked AS (SELECT ord, term, norm, tokens, unnest(tokens) AS token FROM keyed),
met AS (SELECT DISTINCT a.ord AS o1, b.ord AS o2, a.term AS t1, b.term AS t2, a.norm AS n1, b.norm AS n2 FROM blocked a JOIN blocked b ON a.token = b.token AND a.ord < b.ord AND a.norm <> b.norm),
held AS (SELECT *, round_even(least(length(n1), length(n2)) / greatest(length(n1), length(n2)), 3) AS score FROM met WHERE length(n1) >= 6 AND (contains(n1, n2) OR contains(n2, n1))),
containment AS (SELECT CASE WHEN length(n2) < length(n1) THEN o2 ELSE o1 END AS ord1, CASE WHEN length(n2) < length(n1) THEN o1 ELSE o2 END AS ord2,
  CASE WHEN length(n2) < length(n1) THEN t2 ELSE t1 END AS term1, CASE WHEN length(n2) < length(n1) THEN t1 ELSE t2 END AS term2, 'containment' AS match_type, score FROM held WHERE score < 0.95)"""
)
LCS = """list_reduce(list_prepend(list_transform(range(0, length(y) + 1), lambda i: 0), list_transform(string_split(x, ''), lambda c: [ascii(c)::int])),
  lambda prev, c: list_reduce(list_prepend([0], list_transform(range(1, length(y) + 1), lambda j: [j::int])),
    lambda cur, jj: list_append(cur, CASE WHEN ascii(y[jj[1]]) = c[1] THEN prev[jj[1]] + 1 ELSE greatest(prev[jj[1] + 1], cur[jj[1]]) END)))[-1]"""


def _ratio_sql(source: str) -> str:
    """CTEs ending in ratios(o1, o2, t1, t2, ratio) from source(o1, o2, t1, t2)."""
    tokens = lambda t: f"list_sort(list_distinct(list_filter(string_split({t}, ' '), lambda w: w <> '')))"
    return f"""split AS (SELECT *, {tokens('t1')} AS a, {tokens('t2')} AS b FROM {source}),
parts AS (SELECT *, array_to_string(list_filter(a, lambda w: NOT list_contains(b, w)), ' ') AS x, array_to_string(list_filter(b, lambda w: NOT list_contains(a, w)), ' ') AS y,
  length(array_to_string(list_filter(a, lambda w: list_contains(b, w)), ' ')) AS s FROM split),
left_over AS (SELECT DISTINCT x, y FROM parts WHERE x <> '' AND y <> ''),
common AS (SELECT x, y, {LCS} AS n FROM left_over),
sized AS (SELECT p.*, length(p.x) AS la, length(p.y) AS lb, CASE WHEN s > 0 THEN 1 ELSE 0 END AS g, coalesce(c.n, 0) AS n FROM parts p LEFT JOIN common c ON p.x = c.x AND p.y = c.y),
ratios AS (SELECT *, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 WHEN s > 0 AND (la = 0 OR lb = 0) THEN 100.0
  WHEN s = 0 THEN 100.0 * (1 - (la + lb - 2 * n) / (la + lb)::DOUBLE)
  ELSE greatest(100.0 * (1 - (la + lb - 2 * n) / (2 * s + 2 * g + la + lb)::DOUBLE), 100.0 * (1 - (g + la) / (2 * s + g + la)::DOUBLE), 100.0 * (1 - (g + lb) / (2 * s + g + lb)::DOUBLE)) END AS ratio FROM sized)"""


ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def term_lookup(spark, sf_dir):
    engine = _engine(spark, sf_dir, "terms", "occurrences")
    return _flat(engine.lookup(ASKED).union(engine.lookup("no such term")))


def lookup_icase(spark, sf_dir):
    return _flat(_engine(spark, sf_dir, "terms", "occurrences").lookup_icase("SMALL RING"))


def term_coverage(spark, sf_dir):
    return _engine(spark, sf_dir, "terms", "occurrences").coverage()


def expand_variants(spark, sf_dir):
    return _flat(_engine(spark, sf_dir).expand(ASKED, 0.4), "match_type", "match_score")


def full_lookup(spark, sf_dir):
    engine = _engine(spark, sf_dir)
    return _flat(engine.full_lookup("SMALL RING", min_score=0.4), "match_type", "match_score")


def books_summary(spark, sf_dir):
    return _engine(spark, sf_dir, "occurrences").books()


def db_stats(spark, sf_dir):
    return _engine(spark, sf_dir, "terms", "occurrences", "edges").stats()


def cross_book_histogram(spark, sf_dir):
    return lookup.cross_book_histogram(_lookup(spark, sf_dir))


def _pair_query(strategy):
    return lambda spark, sf_dir: strategy(_terms(spark, sf_dir))


def all_pairs(spark, sf_dir):
    maps = lookup.lookup_maps(_lookup(spark, sf_dir)).select("ord", "term", "books")
    return fuzzy.all_pairs(maps).select("ord1", "ord2", "term1", "term2", "match_type", "score", "n_union")


def candidates_top30(spark, sf_dir):
    return fuzzy.ordered(all_pairs(spark, sf_dir)).limit(30)


def fuzzy_search(spark, sf_dir):
    return fuzzy.search(_terms(spark, sf_dir), QUERY).select("term", "n_books", F.bround("score", 6).alias("score"))


def build_lookup_merge(spark, sf_dir):
    return _lookup(spark, sf_dir).select("ord", "term", "n_books", "book_key", F.array_join("pages", ",").alias("pages"))


def subentry_fill(spark, sf_dir):
    rows = lookup.build_lookup(tables.index(spark, sf_dir, emptied=True))
    return rows.select("term", "book_key", F.array_join(F.array_sort("pages"), ",").alias("pages"))


def main_term_counts(spark, sf_dir):
    return lookup.main_term_counts(tables.index(spark, sf_dir).withColumn("term", F.regexp_replace("term", " \\(", " > (")))


def _claim_terms(spark, sf_dir):
    """Terms of documents: significant tokens, in as many books as sources."""
    docs = tables.table(spark, sf_dir, "documents").select("source", F.explode(T.significant_tokens("text")).alias("term"))
    return docs.groupBy("term").agg(F.countDistinct("source").alias("n_books"))


def claim_match_topn(spark, sf_dir):
    asked = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_ord"), "text")
    return claims.match_claims(asked, _claim_terms(spark, sf_dir), 10)


def candidate_ingest(spark, sf_dir):
    return _engine(spark, sf_dir, "edges").candidates


def case_sensitive_filters(spark, sf_dir):
    """Candidates above a score whose ends differ, with both names: the documented one-directional join."""
    engine = _engine(spark, sf_dir)
    t = engine.terms
    one, two = t.select(F.col("id").alias("term1_id"), F.col("term").alias("term")), t.select(F.col("id").alias("term2_id"), F.col("term").alias("variant"))
    return engine.candidates.where(F.col("match_type").isin("case", "containment") & (F.col("score") >= 0.6)).join(one, "term1_id").join(two, "term2_id").select("term", "variant", "match_type", "score")


QUERIES = {
    "term_coverage": term_coverage,
    "term_lookup": term_lookup,
    "lookup_icase": lookup_icase,
    "expand_variants": expand_variants,
    "full_lookup": full_lookup,
    "books_summary": books_summary,
    "db_stats": db_stats,
    "cross_book_histogram": cross_book_histogram,
    "abbreviation_pairs": _pair_query(fuzzy.abbreviation_pairs),
    "case_pairs": _pair_query(fuzzy.case_pairs),
    "containment_pairs": _pair_query(fuzzy.containment_pairs),
    "token_set_pairs": _pair_query(fuzzy.token_set_pairs),
    "token_set_pairs_60": _pair_query(lambda terms: fuzzy.token_set_pairs(terms, 60)),
    "all_pairs": all_pairs,
    "candidates_top30": candidates_top30,
    "fuzzy_search": fuzzy_search,
    "claim_match_topn": claim_match_topn,
    "build_lookup_merge": build_lookup_merge,
    "subentry_fill": subentry_fill,
    "main_term_counts": main_term_counts,
    "candidate_ingest": candidate_ingest,
    "typed_candidates_join": case_sensitive_filters,
}

_TOKEN_SET = f"{PAIRS_SQL}, {_ratio_sql('met')}, token_set AS (SELECT o1 AS ord1, o2 AS ord2, t1 AS term1, t2 AS term2, 'token_set' AS match_type, round_even(ratio / 100, 3) AS score FROM ratios WHERE ratio >= 80)"
_ALL = f"""{_TOKEN_SET}, found AS (SELECT *, 1 AS p FROM abbreviation UNION ALL SELECT *, 2 FROM case_pairs UNION ALL SELECT *, 3 FROM containment UNION ALL SELECT *, 4 FROM token_set),
best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY least(ord1, ord2), greatest(ord1, ord2) ORDER BY p, ord1) = 1),
shelves AS (SELECT term, list(book_key) AS books FROM occ GROUP BY term),
everything AS (SELECT b.ord1, b.ord2, b.term1, b.term2, b.match_type, b.score, len(list_distinct(list_concat(s.books, t.books)))::INT AS n_union, p FROM best b JOIN shelves s ON s.term = b.term1 JOIN shelves t ON t.term = b.term2)"""
_CANDIDATES = f"""{_ALL}, edges AS (SELECT term1 AS src, term2 AS dst, match_type, score FROM best UNION ALL SELECT term2, term1, match_type, score FROM best)"""
_NEAR = f"""{_CANDIDATES}, {HYDRATED}"""
_DOC_TERMS = f"""docs AS (SELECT source, unnest(list_filter(regexp_split_to_array(lower(text), '[\\s\\-/,;:()\\[\\]]+'), lambda t: length(t) > 2 AND t NOT IN {T.STOP_WORDS})) AS term FROM documents),
terms AS (SELECT term, count(DISTINCT source) AS n_books FROM docs GROUP BY term)"""

ORACLES = {
    "term_coverage": tables.OCC_SQL + "SELECT term, count(DISTINCT book_key) AS n_books, string_agg(DISTINCT book_key, ', ' ORDER BY book_key) AS books FROM occ GROUP BY term",
    "term_lookup": f"""{tables.OCC_SQL}, {HYDRATED}, asked(term) AS (VALUES ('{ASKED}'), ('no such term'))
SELECT a.term, t.term IS NOT NULL AS found, coalesce(t.n_books, 0) AS n_books, coalesce(h.books, '') AS books, coalesce(h.pages, '') AS pages FROM asked a LEFT JOIN terms t ON a.term = t.term LEFT JOIN hits h ON h.term = t.term""",
    "lookup_icase": f"""{tables.OCC_SQL}, {HYDRATED} SELECT t.term, true AS found, t.n_books, h.books, h.pages FROM terms t JOIN hits h ON h.term = t.term WHERE {ASCII.format('t.term')} = 'small ring'""",
    "expand_variants": f"""{_NEAR} SELECT t.term, true AS found, t.n_books, h.books, h.pages, e.match_type, e.score AS match_score FROM edges e JOIN terms t ON e.dst = t.term JOIN hits h ON h.term = t.term WHERE e.src = '{ASKED}' AND e.score >= 0.4""",
    "full_lookup": f"""{_NEAR}, icase AS (SELECT * FROM terms t WHERE {ASCII.format('t.term')} = 'small ring'),
near AS (SELECT t.term, t.n_books, e.match_type, e.score, row_number() OVER (PARTITION BY t.term ORDER BY i.ord, e.score DESC, e.match_type) AS r FROM icase i JOIN edges e ON e.src = i.term AND e.score >= 0.4 JOIN terms t ON t.term = e.dst WHERE t.term NOT IN (SELECT term FROM icase)),
listed AS (SELECT 'icase' AS section, term, n_books, NULL AS match_type, NULL::DOUBLE AS match_score FROM icase UNION ALL SELECT 'variants', term, n_books, match_type, score FROM near WHERE r = 1)
SELECT l.section, l.term, l.n_books, h.books, h.pages, l.match_type, l.match_score FROM listed l JOIN hits h ON h.term = l.term""",
    "books_summary": tables.OCC_SQL + "SELECT book_key AS key, 'Book ' || book_key AS title, 'Author ' || right(book_key, 1) AS author, 1990 + CAST(regexp_extract(book_key, '(\\d+)$', 1) AS INT) AS year, count(*) AS n_terms FROM occ GROUP BY book_key",
    "db_stats": f"{_CANDIDATES} SELECT (SELECT count(DISTINCT book_key) FROM occ) AS books, (SELECT count(*) FROM terms) AS terms, (SELECT count(*) FROM occ) AS occurrences, (SELECT count(*) FROM best) AS candidates, (SELECT count(*) FROM terms WHERE n_books > 1) AS cross_book_terms",
    "cross_book_histogram": tables.OCC_SQL + "SELECT n_books, count(*) AS n_terms FROM terms GROUP BY n_books",
    "abbreviation_pairs": f"{PAIRS_SQL} SELECT * FROM abbreviation",
    "case_pairs": f"{PAIRS_SQL} SELECT * FROM case_pairs",
    "containment_pairs": f"{PAIRS_SQL} SELECT * FROM containment",
    "token_set_pairs": f"{_TOKEN_SET} SELECT * FROM token_set",
    "token_set_pairs_60": f"{_TOKEN_SET} SELECT * FROM token_set".replace("ratio >= 80", "ratio >= 60"),
    "all_pairs": f"{_ALL} SELECT ord1, ord2, term1, term2, match_type, score, n_union FROM everything",
    "candidates_top30": f"{_ALL} SELECT ord1, ord2, term1, term2, match_type, score, n_union FROM everything ORDER BY n_union DESC, score DESC, p, ord1, ord2 LIMIT 30",
    "fuzzy_search": f"""{tables.OCC_SQL}, asked AS (SELECT ord AS o1, 0 AS o2, term AS t1, '{QUERY}' AS t2, n_books FROM terms), {_ratio_sql('asked')}
SELECT t1 AS term, n_books, round_even(ratio, 6) AS score FROM ratios WHERE ratio >= 50 ORDER BY ratio DESC, t1 LIMIT 20""",
    "claim_match_topn": f"""WITH {_DOC_TERMS},
asked AS (SELECT item_id AS claim_ord, list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\s\\-/,;:()\\[\\]]+'), lambda t: length(t) > 2 AND t NOT IN {T.STOP_WORDS})) AS tokens FROM benchmark),
held AS (SELECT term, n_books, unnest(list_distinct(list_filter(regexp_split_to_array(lower(term), '[\\s\\-/,;:()\\[\\]]+'), lambda t: length(t) > 2 AND t NOT IN {T.STOP_WORDS}))) AS token FROM terms),
each AS (SELECT claim_ord, len(tokens) AS n_tokens, unnest(tokens) AS token FROM asked),
shared AS (SELECT claim_ord, term, n_books, count(*) / any_value(n_tokens)::DOUBLE AS overlap FROM each JOIN held USING (token) GROUP BY claim_ord, term, n_books),
scored AS (SELECT claim_ord, term, n_books, round_even(overlap, 3) AS token_overlap, round_even(overlap * n_books, 3) AS score FROM shared)
SELECT *, row_number() OVER (PARTITION BY claim_ord ORDER BY score DESC, n_books DESC, term)::INT AS place FROM scored QUALIFY place <= 10""",
    "build_lookup_merge": tables.OCC_SQL + "SELECT t.ord, t.term, t.n_books, o.book_key, array_to_string(o.pages, ',') AS pages FROM occ o JOIN terms t ON o.term = t.term",
    "subentry_fill": tables.OCC_SQL
    + """, cut AS (SELECT book_key, term, CASE WHEN plain = 1 AND first_key % 3 = 0 THEN [] ELSE pages END AS pages FROM occ),
filled AS (SELECT c.book_key, c.term, list_sort(list_distinct(flatten(list(d.pages)))) AS pages FROM cut c JOIN cut d ON c.book_key = d.book_key AND starts_with(d.term, c.term || ' ') AND len(d.pages) > 0 WHERE len(c.pages) = 0 GROUP BY c.book_key, c.term)
SELECT c.term, c.book_key, array_to_string(list_sort(CASE WHEN len(c.pages) = 0 THEN coalesce(f.pages, []) ELSE c.pages END), ',') AS pages FROM cut c LEFT JOIN filled f ON f.book_key = c.book_key AND f.term = c.term""",
    "main_term_counts": tables.OCC_SQL + "SELECT book_key, count(*) AS n_terms, count(*) FILTER (NOT contains(term, ' (')) AS n_main, count(*) FILTER (NOT contains(term, ' (')) AS n_main_spaced FROM occ GROUP BY book_key",
    "candidate_ingest": f"{_CANDIDATES} SELECT least(ord1, ord2) AS term1_id, greatest(ord1, ord2) AS term2_id, match_type, score FROM best",
    "typed_candidates_join": f"{_CANDIDATES} SELECT CASE WHEN ord1 < ord2 THEN term1 ELSE term2 END AS term, CASE WHEN ord1 < ord2 THEN term2 ELSE term1 END AS variant, match_type, score FROM best WHERE match_type IN ('case', 'containment') AND score >= 0.6",
}
