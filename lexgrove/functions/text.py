"""Text functions as column expressions.

Everything stays inside Spark's own expressions.  Patterns carry (?U) where white
space, digits, word characters and word boundaries are meant as in Unicode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide results.
PAGE = r"(?U)\b(\d{1,4}(?:[fbte])?(?:[–\-]\d{1,4}[fbte]?)?)\b"
INDEX_SKIP = r"(?U)^\s*(Index|INDEX|Author Index|Name Index|Subject Index|See also|see also|See|see)\s*$|^\s*[A-Z]\s*$|^\s*$"
ONLY_PAGES = r"(?U)^[\d,\s\-–fbte./]+$"
INDEX_HEADING = r"(?U)^(Index|INDEX|Subject Index|Author Index|Name Index)\s*$"
INDEX_ENTRY = r"(?U)^.{2,60},\s*\d{1,4}[fbte]?"
SEE_TAIL = r"(?U),?\s*(See also|see also|See|see)\b.*$"
MAIN_START = r"""^[\p{Lu}\p{Lt}\p{Nd}αβγδεζ('"\[]"""
TOKEN_BREAK = r"(?U)[\s\-/,;:()\[\]]+"
STOP_WORDS = ("a", "an", "the", "of", "in", "and", "or", "for", "with", "to", "by", "on", "at", "as", "is", "its", "from")
YEAR = r"(?iU)\b(1[89]\d\d|20[012]\d)[a-z]?\b"
AUTHOR = r"(?U)^[A-Z][a-záéíóúàèìòùäëïöüñç\w-]+(?:\s+[A-Z]{1,4}[,:.\s]|,\s*[A-Z])"
ENTRY_START = r"(?U)^[A-Z][a-záéíóúàèìòùäëïöüñç\w-]+(?:(?:,\s+[A-Z])|(?:\s+[A-Z]{1,4}[,\.\s])|(?:\s+[A-Z]{1,4}:))"
#: What (?U)\s and \x1c-\x1f match.
SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def strip(c: Column | str) -> Column:
    """White space of every script off both ends."""
    return F.btrim(c, F.lit(SPACE))


def rstrip(c: Column | str) -> Column:
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+$", "")


def lstrip(c: Column | str) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+", "")


def is_blank(c: Column | str) -> Column:
    # from the left alone, which ends at the first other character
    return F.ltrim(c, F.lit(SPACE)) == ""


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), for which value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ascii_lower(c: Column | str) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def normalised(term: Column | str) -> Column:
    """Lower case without spaces, commas, semicolons, colons and round brackets at the ends."""
    return F.btrim(F.lower(term), F.lit(" ,;:()"))


def significant_tokens(text: Column | str) -> Column:
    """Lower-case tokens of three characters or more that are no stop words; repeats stay."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(F.lower(text), TOKEN_BREAK), lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def block_tokens(term: Column | str) -> Column:
    """The distinct tokens that a term is blocked on: its significant ones, else its first four characters."""
    tokens = F.array_distinct(significant_tokens(term))
    return F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.substring(normalised(term), 1, 4)))


def first_token(term: Column | str) -> Column:
    return F.coalesce(F.try_element_at(significant_tokens(term), F.lit(1)), F.substring(normalised(term), 1, 4))


def extract_pages(text: Column | str) -> Column:
    """All page references of a line, as written."""
    return F.regexp_extract_all(text, F.lit(PAGE), F.lit(1))


def normalize_term(term: Column | str) -> Column:
    """A term without "see ..." and without punctuation at its end."""
    return strip(F.regexp_replace(F.regexp_replace(term, SEE_TAIL, ""), r"(?U)[\s,;.:]+$", ""))


def term_of_line(line: Column | str) -> Column:
    """An index line without its page references."""
    return normalize_term(F.btrim(F.regexp_replace(line, PAGE, ""), F.lit(" ,;:–-")))


def indent(raw: Column | str) -> Column:
    return F.length(raw) - F.length(lstrip(raw))


def int_page(page: Column | str) -> Column:
    """The leading number of a page reference; null without one.  Of a range, its start."""
    return F.regexp_extract(strip(page), r"^(\d+)", 1).try_cast("int")


def int_pages(pages: Column | str) -> Column:
    return F.filter(F.transform(pages, int_page), lambda p: p.isNotNull())


def page_parts(page: Column | str) -> Column:
    """start, suffix and end of a page reference such as 12f or 100–105."""
    page = strip(page)
    return F.struct(
        F.regexp_extract(page, r"^(\d+)", 1).try_cast("int").alias("start"),
        F.nullif(F.regexp_extract(page, r"^\d+([fbte])", 1), F.lit("")).alias("suffix"),
        F.regexp_extract(page, r"^\d+[fbte]?[–\-](\d+)", 1).try_cast("int").alias("end"),
    )


def parse_reference(raw: Column | str) -> Column:
    """authors, year, title, venue and raw of one joined reference entry.

    Before the first year stand the authors, after it title and venue.  Without a
    year, a colon within the first 40 characters ends the authors.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    at = F.regexp_instr(raw, F.lit(YEAR))
    year_text = F.regexp_extract(raw, YEAR, 0)
    colon = F.instr(raw, ":")
    has_colon = (colon > 1) & (colon < 41)
    authors = F.when(at > 0, strip(F.rtrim(strip(F.substr(raw, F.lit(1), at - 1)), F.lit("(,")))).when(has_colon, strip(F.substr(raw, F.lit(1), colon - 1))).otherwise(raw)
    after = F.when(at > 0, strip(F.ltrim(strip(F.substr(raw, at + F.length(year_text))), F.lit(").")))).when(has_colon, strip(F.substr(raw, colon + 1))).otherwise(F.lit(""))
    parts = F.split(after, r"\. ")
    n = F.size(parts)
    title = F.when(n == 1, after).otherwise(F.array_join(F.slice(parts, F.lit(1), n - 1), ". "))
    venue = F.when(n == 1, F.lit("")).otherwise(F.element_at(parts, -1))
    return F.struct(authors.alias("authors"), F.regexp_extract(raw, YEAR, 1).alias("year"), title.alias("title"), venue.alias("venue"), raw.alias("raw"))


def chapter_title(title: Column | str, start: Column | str, end: Column | str) -> Column:
    """A chapter's title, or its page range where it has none."""
    return F.coalesce(F.nullif(F.col(title) if isinstance(title, str) else title, F.lit("")), F.concat(F.lit("p. "), F.col(start).cast("string") if isinstance(start, str) else start, F.lit("–"), F.col(end).cast("string") if isinstance(end, str) else end))


def register(spark) -> None:
    """The scalar functions as SQL functions of the session."""
    from .similarity import token_set_ratio

    spark.udf.register("token_set_ratio", token_set_ratio)
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    breaks, page = (x.replace("\\", "\\\\").replace("'", "\\'") for x in (TOKEN_BREAK, PAGE))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION normalise_term(t STRING) RETURNS STRING RETURN btrim(lower(t), ' ,;:()')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION significant_tokens(t STRING) RETURNS ARRAY<STRING> RETURN filter(split(lower(t), '{breaks}'), x -> length(x) > 2 AND NOT array_contains(array({stop}), x))")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION extract_pages(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(t, '{page}', 1)")
